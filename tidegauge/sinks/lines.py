"""Points as text lines of other systems; all native string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import histogram as H
from ..model import KINDS, Value, read_value, tag_value


def _value(kinds=KINDS) -> Value:
    v = read_value(kinds)
    return Value(v.kinds, F.col("kind"), v.of)


def number_text(v: Value) -> Column:
    """Longs and booleans (1, 0) as whole numbers, doubles as doubles; null for anything else."""
    return F.coalesce(v.get("int").cast("string"), v.get("bool").cast("int").cast("string"), v.get("dbl").cast("string"))


def _finite(v: Value) -> Column:
    d = v.get("dbl")
    return d.isNull() | ~(F.isnan(d) | (F.abs(d) == float("inf")))


def _tag_text(x: Column) -> Column:
    return tag_value(x).text()


# --- Wavefront --------------------------------------------------------------

# Lengths that the service accepts.
MAX_TAG, CUT_NAME = 254, 127
#: The source of points that name none.
DEFAULT_SOURCE = "tidegauge"


def wavefront_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^-a-zA-Z_0-9.]", "_")


def wavefront(points: DataFrame, source: str = DEFAULT_SOURCE, fallback_tags: tuple[str, ...] = ()) -> DataFrame:
    """line: ``name value seconds source=… tag="value"``, tags in order; finite numbers only.

    The source is the tag of that name, else cluster, else one of
    ``fallback_tags``, else ``source``; only a tag named source is then left out.
    """
    v = _value()
    quoted = lambda x: F.replace(_tag_text(x), F.lit('"'), F.lit('\\"'))
    pairs = F.transform(F.sort_array(F.map_entries("tags")), lambda e: F.struct(wavefront_name(e["key"]).alias("k"), quoted(e["value"]).alias("v")))

    def cut(e: Column) -> Column:
        fits = F.length(e["k"]) + F.length(e["v"]) <= MAX_TAG - 2
        k = F.when(fits, e["k"]).otherwise(F.substring(e["k"], 1, CUT_NAME))
        return F.struct(k.alias("k"), F.when(fits | (F.length(k) + F.length(e["v"]) <= MAX_TAG - 2), e["v"]).otherwise(F.substring(e["v"], F.lit(1), F.lit(MAX_TAG - 2) - F.length(k))).alias("v"))

    df = points.filter(number_text(v).isNotNull() & _finite(v)).withColumn("pairs", F.transform(pairs, cut))
    named = lambda k: F.get(F.filter("pairs", lambda e: e["k"] == k), F.lit(0))["v"]
    origin = F.coalesce(named("source"), F.replace(named("cluster"), F.lit('"'), F.lit('\\"')), *map(named, fallback_tags), F.lit(source))
    tags = F.array_join(F.transform(F.filter("pairs", lambda e: e["k"] != "source"), lambda e: F.concat(e["k"], F.lit('="'), e["v"], F.lit('"'))), " ")
    name = wavefront_name(F.array_join(F.concat("group_path", "metric_path"), "."))
    stamp = F.floor(F.unix_millis("ts") / 1000).cast("string")
    return df.select(F.concat(name, F.lit(" "), number_text(v), F.lit(" "), stamp, F.lit(" source="), origin, F.lit(" "), tags).alias("line"))


# --- Prometheus -------------------------------------------------------------


def prometheus_name(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(x, "^[^a-zA-Z_:]+", ""), "[^a-zA-Z0-9_:]+", ""))


def prometheus(points: DataFrame) -> DataFrame:
    """line: ``group_metric{tag="value"} number``; numbers only, tags in order."""
    v = _value()
    part = lambda path: F.array_join(F.transform(path, prometheus_name), "_")
    text = lambda x: F.regexp_replace(_tag_text(x), '([\\\\\n"])', "\\\\$1")
    pairs = F.transform(F.sort_array(F.map_entries("tags")), lambda e: F.concat(prometheus_name(e["key"]), F.lit('="'), text(e["value"]), F.lit('"')))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))
    line = F.concat(part("group_path"), F.lit("_"), part("metric_path"), tags, F.lit(" "), number_text(v))
    return points.filter(number_text(v).isNotNull()).select(line.alias("line"))


# --- JSON -------------------------------------------------------------------


def _json(v: Value) -> Column:
    """A value as JSON; empty is null, a histogram an object of ranges."""
    whole = F.coalesce(v.get("int").cast("string"), v.get("bool").cast("string"))
    real = F.when(_finite(v), v.get("dbl").cast("string")).when(v.get("dbl").isNotNull(), F.concat(F.lit('"'), v.get("dbl").cast("string"), F.lit('"')))
    array = F.to_json(F.array(v.get("string")))
    text = F.when(v.get("string").isNotNull(), F.substring(array, F.lit(2), F.length(array) - 2))
    hist = F.concat(F.lit("{"), F.array_join(F.transform(v.get("hist"), lambda r: F.concat(F.lit('"'), r["floor"].cast("string"), F.lit(".."), r["ceil"].cast("string"), F.lit('":'), r["events"].cast("string"))), ","), F.lit("}"))
    return F.coalesce(whole, real, text, hist, F.lit("null"))


def _quoted(x: Column) -> Column:
    array = F.to_json(F.array(x))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def group_label(key: Column, tags: Column) -> Column:
    """A group's name with its tags, as ``path{tag=value}``."""
    v = lambda x: tag_value(x)
    shown = lambda x: F.when(v(x).get("string").isNotNull(), F.concat(F.lit('"'), _tag_text(x), F.lit('"'))).otherwise(_tag_text(x))
    pairs = F.transform(F.sort_array(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), shown(e["value"])))
    return F.when(F.size(tags) > 0, F.concat(key, F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))).otherwise(key)


def json_groups(points: DataFrame) -> DataFrame:
    """ts, group_key, tags_key, json: one object a group and instant: ``"group":{"metric":value,…}``."""
    v = _value()
    each = F.concat(_quoted(F.col("metric_key")), F.lit(":"), _json(v))
    per = points.groupBy("ts", "group_key", "tags_key").agg(F.first("tags").alias("tags"), F.array_join(F.sort_array(F.collect_list(each)), ",").alias("metrics"))
    return per.select("ts", "group_key", "tags_key", F.concat(_quoted(group_label(F.col("group_key"), F.col("tags"))), F.lit(":{"), F.col("metrics"), F.lit("}")).alias("json"))


def json_scrapes(points: DataFrame) -> DataFrame:
    """ts, json: one object a scrape: ts_msec, ts, data."""
    per = json_groups(points).groupBy("ts").agg(F.array_join(F.sort_array(F.collect_list("json")), ",").alias("data"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return per.select("ts", F.concat(F.lit('{"ts_msec":'), F.unix_millis("ts").cast("string"), F.lit(',"ts":"'), stamp, F.lit('","data":{'), F.col("data"), F.lit("}}")).alias("json"))


# --- InfluxDB line protocol -----------------------------------------------------

#: The tag that marks a histogram's range, unless another is asked for.
RANGE_TAG = "__range__"


def influx(points: DataFrame, range_tag: str = RANGE_TAG) -> DataFrame:
    """line: ``group,tag=value metric=value nanoseconds``; a histogram makes one point a range; NaN, infinite and empty values none."""
    v = _value()
    plain = lambda x, chars: F.regexp_replace(x, f"([{chars}])", "\\\\$1")
    tags = F.array_join(F.transform(F.sort_array(F.map_entries("tags")), lambda e: F.concat(F.lit(","), plain(e["key"], ",= "), F.lit("="), plain(_tag_text(e["value"]), ",= "))), "")
    text = F.concat(F.lit('"'), F.regexp_replace(v.get("string"), '(["\\\\])', "\\\\$1"), F.lit('"'))
    field = F.coalesce(F.concat(v.get("int").cast("string"), F.lit("i")), v.get("bool").cast("string"), F.when(_finite(v), v.get("dbl").cast("string")), text)
    ranges = F.transform(v.get("hist"), lambda r: F.struct(F.concat(F.lit(f",{range_tag}="), r["floor"].cast("string"), F.lit(".."), r["ceil"].cast("string")).alias("tag"), r["events"].cast("string").alias("field")))
    rows = F.coalesce(ranges, F.array(F.struct(F.lit("").alias("tag"), field.alias("field"))))
    df = points.withColumn("x", F.explode(rows)).filter("x.field IS NOT NULL")
    head = F.concat(plain(F.array_join("group_path", "."), ", "), tags, F.col("x.tag"))
    return df.select(F.concat(head, F.lit(" "), plain(F.array_join("metric_path", "."), ",= "), F.lit("="), F.col("x.field"), F.lit(" "), (F.unix_millis("ts") * 1_000_000).cast("string")).alias("line"))


# --- metric listing -----------------------------------------------------------


def listing(points: DataFrame, at=None) -> DataFrame:
    """line: one metric of the newest scrape (or that ``at`` an instant) a line, sorted by group, then metric."""
    now = points.filter(F.col("ts") == (points.agg(F.max("ts")).scalar() if at is None else F.lit(at)))
    label = group_label(F.col("group_key"), F.col("tags"))
    v = _value()
    line = F.concat(label, F.lit(" "), F.col("metric_key"), F.lit(" = "), _json(v))
    return now.select(label.alias("g"), "metric_key", line.alias("line")).orderBy("g", "metric_key").select("line")


def write_lines(lines: DataFrame, path: str, mode: str = "append", compression: str = "none") -> None:
    lines.select("line").write.mode(mode).option("compression", compression).text(path)


def send(lines: DataFrame, host: str, port: int, batch: int = 10_000, timeout: float = 30.0) -> None:
    """Lines to a TCP listener, each partition over a connection of its own, in batches."""

    def partition(rows) -> None:
        import socket

        held: list[str] = []
        link = None

        def flush() -> None:
            nonlocal link
            if held:
                link = link or socket.create_connection((host, port), timeout)
                link.sendall(("\n".join(held) + "\n").encode())
                held.clear()

        for r in rows:
            held.append(r["line"])
            if len(held) >= batch:
                flush()
        flush()
        if link:
            link.close()

    lines.select("line").foreachPartition(partition)

"""collectd's JSON messages as points, and which hosts are up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Value, points, tag_text, value
from .json_flat import leaf

SCHEMA = "values array<string>, dstypes array<string>, dsnames array<string>, time double, interval bigint, host string, plugin string, plugin_instance string, type string, type_instance string"
#: How long a host that has gone quiet is reported as down.
REMEMBER_MS = 3_600_000
_TAGS = r"\[([^\]]*)\]$"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Messages of files that hold JSON arrays of them, as the daemon posts."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("multiLine", True).json(path)


def _number(x: Column) -> Value:
    v = leaf(x)
    return value(int=v.get("int"), dbl=F.coalesce(v.get("dbl"), F.when(v.get("int").isNull(), x.try_cast("double"))), string=F.when(x.isNotNull() & x.try_cast("double").isNull(), x))


def instance_tags(instance: Column) -> Column:
    """The tags at the end of a plugin instance, ``name[k=v,k="v"]``: numbers stay numbers, quoted values are texts."""
    body = F.regexp_extract(instance, _TAGS, 1)
    pairs = F.filter(F.regexp_extract_all(body, F.lit(r'[^,="]+=(?:"(?:[^"\\]|\\.)*"|[^,]*)'), F.lit(0)), lambda p: F.contains(p, F.lit("=")))
    key = lambda p: F.trim(F.substring_index(p, "=", 1))
    raw = lambda p: F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p)))

    def text(p: Column) -> Column:
        r = raw(p)
        whole, real = F.when(r.rlike(r"^-?\d+$"), r), F.when(r.rlike(r"^-?\d*\.\d+([eE]-?\d+)?$"), r)
        plain = F.when(r.rlike('^".*"$'), F.regexp_replace(F.substring(r, F.lit(2), F.length(r) - 2), r"\\(.)", "$1")).otherwise(r)
        return F.coalesce(F.concat(F.lit("i:"), whole), F.concat(F.lit("d:"), real.cast("double").cast("string")), F.concat(F.lit("s:"), plain))

    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(key(p).alias("key"), text(p).alias("value"))))


def to_points(messages: DataFrame, base: tuple[str, ...] = ("collectd",)) -> DataFrame:
    """One point a value: group base.plugin.instance, tag host and those of the instance, metric type.type_instance.name.

    A name ``value`` is left out if it is the only one; a metric without any
    name is called ``value``. Of several messages about the same source and
    second the last stays.
    """
    some = lambda *cols: F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != ""))
    bare = F.regexp_replace(F.coalesce("plugin_instance", F.lit("")), _TAGS, "")
    df = messages.withColumn("ts", F.timestamp_millis((F.col("time") * 1000).cast("bigint")))
    df = df.withColumn("group", F.concat(F.array(*[F.lit(b) for b in base]), some(F.col("plugin"), bare)))
    host = F.create_map(F.lit("host"), F.concat(F.lit("s:"), F.col("host")))
    found = instance_tags(F.coalesce("plugin_instance", F.lit("")))
    df = df.withColumn("found", found).withColumn("tags", F.map_concat(F.map_filter(host, lambda k, v: v.isNotNull() & ~F.map_contains_key(F.col("found"), k)), F.col("found")))
    df = df.withColumn("single", F.size("values") == 1).select("*", F.posexplode(F.arrays_zip("values", "dsnames")).alias("place", "x"))
    name = F.when(~(F.col("single") & (F.col("x.dsnames") == "value")), F.col("x.dsnames"))
    path = some(F.col("type"), F.col("type_instance"), name)
    df = df.withColumn("metric", F.when(F.size(path) > 0, path).otherwise(F.array(F.lit("value"))))
    v = _number(F.col("x.values"))
    made = points(df, F.col("group"), F.col("metric"), v, F.col("tags"))
    return made.dropDuplicates(["ts", "group_key", "tags_key", "metric_key"])


def host_states(seen: DataFrame, scrapes: DataFrame, base: tuple[str, ...] = ("collectd",), remember_ms: int = REMEMBER_MS) -> DataFrame:
    """Points ``up`` of each host: true at scrapes it is seen (``seen``: ts, host), false at others within ``remember_ms``.

    A sighting covers the slots of time that it can be remembered in; hosts and
    scrapes meet there, so quiet hosts cost nothing.
    """
    slot = lambda ms: F.floor(ms / remember_ms)
    ms = F.unix_millis("ts")
    dealt = seen.select("host", ms.alias("seen_ms")).distinct().withColumn("slot", F.explode(F.array(slot(F.col("seen_ms")), slot(F.col("seen_ms")) + 1)))
    at = scrapes.select("ts").withColumn("at_ms", ms).withColumn("slot", slot(F.col("at_ms")))
    met = dealt.join(at, "slot").filter(F.col("seen_ms").between(F.col("at_ms") - remember_ms + 1, F.col("at_ms")))
    last = met.groupBy("ts", "host").agg((F.max("seen_ms") == F.max("at_ms")).alias("up"))
    tags = F.create_map(F.lit("host"), tag_text(Value(frozenset(["string"]), F.lit("string"), {"string": F.col("host")})))
    return points(last, F.array(*[F.lit(b) for b in base]), F.array(F.lit("up")), Value(frozenset(["bool"]), F.lit("bool"), {"bool": F.col("up")}), tags)


def newest(messages: DataFrame) -> DataFrame:
    """Of each source's messages in a cycle, the last one."""
    w = W.partitionBy("host", "plugin", "plugin_instance", "type", "type_instance").orderBy(F.desc("time"))
    return messages.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")

"""Query results of InfluxDB, as JSON files or asked of a server slice by slice, back to points."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import histogram as H
from ..model import HIST, POINTS, path_key, read_value, tags_key
from ..sinks.lines import RANGE_TAG
from ..storage import cut
from .json_flat import leaf

SCHEMA = "results array<struct<series:array<struct<name:string,tags:map<string,string>,columns:array<string>,values:array<array<string>>>>>>"

SCHEMA_OF_ANSWER = f"struct<{SCHEMA.replace(' ', ':', 1)}>"
#: Seconds that one query to a server covers.
SLICE_S = 3600


def read(spark: SparkSession, path: str, range_tag: str = RANGE_TAG) -> DataFrame:
    return to_points(spark.read.schema(SCHEMA).option("multiLine", True).json(path), range_tag)


def ask(url: str, database: str, query: str, timeout: float = 60.0) -> str:
    """The answer of an InfluxDB server's query interface, times in milliseconds."""
    args = urllib.parse.urlencode({"db": database, "q": query, "epoch": "ms"})
    with urllib.request.urlopen(f"{url.rstrip('/')}/query?{args}", timeout=timeout) as answer:
        text = answer.read().decode()
    top = json.loads(text)
    wrong = [x["error"] for x in [top, *top.get("results", [])] if "error" in x]
    if wrong:
        raise ValueError(f"InfluxDB: {wrong[0]}")
    return text


def scan(spark: SparkSession, url: str, database: str, begin: datetime, end: datetime, group: str = "/^.*$/", metric: str = "*", slice_s: int = SLICE_S, range_tag: str = RANGE_TAG, timeout: float = 60.0) -> DataFrame:
    """Points of a server in [begin, end]: each slice of time is a query of its own, made by a task of its own.

    ``group`` and ``metric`` are what ``select`` makes of path patterns. An
    instant is in one slice, so histograms stay whole. The server is asked at
    once, and answers are checkpointed, as points are made of them in two ways.
    A query that fails fails its task, which Spark repeats.
    """
    first, last, step = _millis(begin), _millis(end), 1000 * slice_s
    begins = range(first // step * step, last + 1, step)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in b["id"]:
                low, high = max(first, at), min(last, at + step - 1)
                text = ask(url, database, f"SELECT {metric} FROM {group} WHERE time >= {low}ms AND time <= {high}ms GROUP BY *", timeout)
                yield pd.DataFrame({"text": [text]})

    slices = spark.range(begins.start, max(begins.start, last + 1), step, max(1, len(begins)))
    answers = cut(slices.mapInPandas(run, "text string")).select(F.from_json("text", SCHEMA_OF_ANSWER).alias("x")).select("x.results")
    return to_points(answers, range_tag)


def _millis(t: datetime) -> int:
    """Without a zone: UTC."""
    return (t.replace(tzinfo=t.tzinfo or UTC) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


def to_points(results: DataFrame, range_tag: str = RANGE_TAG) -> DataFrame:
    """A row of values makes a point a column; series that differ only in ``range_tag`` are one histogram.

    Measurement and column names are dotted paths. Null cells are absent.
    """
    series = results.select(F.explode("results").alias("r")).select(F.explode("r.series").alias("x")).select("x.name", F.coalesce("x.tags", F.create_map().cast("map<string,string>")).alias("raw"), "x.columns", F.explode("x.values").alias("row"))
    cells = series.select("*", F.get("row", F.array_position("columns", F.lit("time")).cast("int") - 1).alias("time"), F.posexplode("columns").alias("place", "column")).filter("column <> 'time'")
    cells = cells.withColumn("cell", F.get("row", F.col("place"))).filter("cell IS NOT NULL")
    millis = F.when(F.col("time").rlike("^[0-9]+$"), F.timestamp_millis(F.col("time").try_cast("bigint"))).otherwise(F.to_timestamp("time"))
    own = F.map_filter("raw", lambda k, v: (k != range_tag) & (v != ""))
    quoted = lambda c: F.when(c.rlike(r"^(-?[0-9.]+([eE][-+]?[0-9]+)?|true|false)$"), c).otherwise(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    cells = cells.select(millis.alias("ts"), F.split("name", r"\.").alias("group_path"), F.transform_values(own, lambda k, v: F.concat(F.lit("s:"), v)).alias("tags"), F.split("column", r"\.").alias("metric_path"), F.try_element_at("raw", F.lit(range_tag)).alias("range"), quoted(F.col("cell")).alias("cell"))
    cells = cells.withColumn("group_key", path_key(F.col("group_path"))).withColumn("metric_key", path_key(F.col("metric_path"))).withColumn("tags_key", tags_key(F.col("tags")))
    order = [f.split(" ")[0] for f in POINTS.split(", ")]
    base = ["ts", "group_key", "group_path", "tags", "tags_key", "metric_key", "metric_path"]
    plain = cells.filter("range IS NULL").select(*base, *leaf(F.col("cell")).columns())
    end = lambda i: F.get(F.split("range", r"\.\."), F.lit(i)).cast("double")
    part = F.struct(end(0).alias("floor"), end(1).alias("ceil"), F.col("cell").cast("double").alias("events"))
    keys = ["ts", "group_key", "tags_key", "metric_key"]
    hist = cells.filter("range IS NOT NULL").groupBy(*keys).agg(F.first("group_path").alias("group_path"), F.first("tags").alias("tags"), F.first("metric_path").alias("metric_path"), F.collect_list(part).cast(HIST).alias("parts"))
    hist = hist.withColumn("h", H.normalise(F.col("parts"))).select(*base, *read_value(["hist"]).columns())
    return plain.select(*order).unionByName(hist.select(*order))


def path_regex(pattern) -> str | None:
    """A path pattern as the service's regular expression; None if it is literal. It may select too much; the engine filters again."""
    import re

    from ..functions.paths import is_literal
    from ..plans.nodes import Wild

    if is_literal(pattern):
        return None

    def one(e: str | Wild) -> str:
        if isinstance(e, str):
            return re.escape(e)
        if e.kind == "regex":
            return ".*" if e.regex.startswith("^") or e.regex.endswith("$") else f".*{e.regex}.*"
        return ".*"

    return "/^" + r"\.".join(map(one, pattern)) + "$/"


def select(pattern) -> str:
    """What to put into FROM or SELECT for a path pattern."""
    regex = path_regex(pattern)
    return regex if regex is not None else '"' + ".".join(pattern).replace('"', '\\"') + '"'

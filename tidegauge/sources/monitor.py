"""The engine's own metrics, and the alerts that watch it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Dataset, no_tags, points, value
from ..operators import alerts, lookback
from .tables import melt

GROUP = ("tidegauge",)
#: How long collections may fail before that alert fires.
FAILED_FOR_MS = 300_000


def metrics(ds: Dataset, failed: DataFrame | None = None, has_config: bool = True, timings: Mapping[str, float] | None = None, group: tuple[str, ...] = GROUP) -> DataFrame:
    """Points about each scrape: groups, metric (how many), failed_collections, has_config_file, scrape.*, timing.*.

    ``failed`` has ts, failed; ``timings`` milliseconds by name.
    """
    per = ds.points.groupBy("ts").agg(F.count_distinct("group_key", "tags_key").alias("groups"), F.count(F.lit(1)).alias("metric"))
    out = ds.scrapes.select("ts").join(per, "ts", "left").join(lookback.collection_interval(ds.scrapes), "ts")
    out = out.join(failed, "ts", "left") if failed is not None else out.withColumn("failed", F.lit(0))
    out = out.withColumn("first", ds.scrapes.agg(F.min("ts")).scalar())
    whole = lambda c: ("int", F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")))
    named = {
        "groups": whole("groups"), "metric": whole("metric"), "failed_collections": whole("failed"), "has_config_file": ("bool", F.lit(has_config)),
        "scrape.interval": whole("interval_ms"), "scrape.ts": ("int", F.unix_millis("ts")), "scrape.uptime": ("int", F.unix_millis("ts") - F.unix_millis("first")),
    }
    named |= {f"timing.{k}": ("dbl", F.lit(float(x))) for k, x in (timings or {}).items()}
    tall = melt(out, F.array(*[F.lit(g) for g in group]), no_tags(), named)
    v = value(bool=F.col("b"), int=F.col("i"), dbl=F.col("d"))
    return points(tall, F.col("group_path"), F.split(F.get("metric_path", F.lit(0)), r"\."), v)


def builtin_alerts(monitor: DataFrame, scrapes: DataFrame, group: tuple[str, ...] = GROUP) -> DataFrame:
    """down (never, while it says so), some collections failed, and no configuration."""
    root = ".".join(group)
    tested = {"failed_collections": (F.col("i") != 0, f"{root}.failure", FAILED_FOR_MS, "some collectors failed"), "has_config_file": (~F.col("b"), f"{root}.configuration_missing", 0, "there is no configuration file"), "groups": (F.lit(False), f"{root}.down", 0, "not running for some time")}
    out = None
    for metric, (test, key, for_ms, message) in tested.items():
        rows = monitor.filter((F.col("metric_key") == metric) & (F.col("group_key") == root)).select("ts", F.lit(key).alias("alert_key"), "tags_key", "tags", test.alias("triggered"))
        one = alerts.states(rows, scrapes, for_ms).withColumn("message", F.lit(message))
        out = one if out is None else out.unionByName(one)
    return out

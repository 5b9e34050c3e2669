"""The past of a dataset: shifted points, interpolation, and stepping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import histogram as H
from ..model import COLUMN, Dataset, Value, read_value, value

SERIES = ["group_key", "tags_key"]


def previous(scrapes: DataFrame, n: int = 1) -> DataFrame:
    """ts, past: for each instant the n-th before it; only the column of instants is ordered."""
    return scrapes.select("ts").withColumn("past", F.lag("ts", n).over(W.orderBy("ts"))).filter("past IS NOT NULL")


def before(scrapes: DataFrame, ms: int) -> DataFrame:
    """ts, past: each instant and the one ``ms`` milliseconds earlier, if history reaches so far back."""
    past = F.timestamp_millis(F.unix_millis("ts") - ms)
    return scrapes.select("ts", past.alias("past")).filter(F.col("past") >= scrapes.agg(F.min("ts")).scalar())


def newest_before(scrapes: DataFrame, ms: int) -> DataFrame:
    """ts, past: for each instant the newest one that is at least ``ms`` milliseconds older."""
    millis = F.unix_millis("ts")
    w = W.orderBy("ms").rangeBetween(W.unboundedPreceding, -ms)
    return scrapes.select("ts").withColumn("ms", millis).withColumn("past", F.max("ts").over(w)).filter("past IS NOT NULL").select("ts", "past")


def collection_interval(scrapes: DataFrame) -> DataFrame:
    """ts, interval_ms: time since the scrape before; 0 for the first."""
    lag = F.lag("ts").over(W.orderBy("ts"))
    return scrapes.select("ts", F.coalesce(F.unix_millis("ts") - F.unix_millis(lag), F.lit(0).cast("bigint")).alias("interval_ms"))


def shifted(ds: Dataset, moves: DataFrame) -> Dataset:
    """The dataset as it was: what was measured at ``past`` appears at ``ts``."""
    m = moves.select(F.col("ts").alias("new_ts"), F.col("past").alias("ts"))
    points = ds.points.join(m, "ts").drop("ts").withColumnRenamed("new_ts", "ts")
    return Dataset(points, moves.select("ts"), ds.kinds, ds.metric_kinds)


def interpolate(a: Value, b: Value, share: Column) -> Value:
    """Between an older and a newer value, ``share`` of the way: numbers as doubles, texts as the older, other mixtures empty."""
    of = {}
    numeric = {"bool", "int", "dbl"}
    if a.kinds & numeric:
        of["dbl"] = a.number() * (1 - share) + b.number() * share
    if "string" in a.kinds:
        of["string"] = F.when(b.get("string").isNotNull(), a.get("string"))
    if "hist" in a.kinds:
        both = a.get("hist").isNotNull() & b.get("hist").isNotNull()
        of["hist"] = F.when(both, H.add(H.scale(a.get("hist"), 1 - share), H.scale(b.get("hist"), share)))
    return value(**of)


def gaps(ds: Dataset, targets: DataFrame, reach_ms: int | None = None) -> DataFrame:
    """target, group_key, tags_key, older, newer: groups wholly absent at a target, between two scrapes that hold them.

    ``reach_ms`` limits how far either may be. A group's scrapes and the next
    ones are stretches. Every instant knows how many targets there are up to
    it, so a stretch knows the places of the targets strictly inside it, and
    only those with any make rows: as many as there are gaps. The column of
    instants and targets is ordered by one task, one long each.
    """
    wanted = targets.select(F.col("target").alias("ts"), F.lit(1).alias("n")).distinct()
    instants = wanted.unionByName(ds.scrapes.select("ts", F.lit(0).alias("n"))).groupBy("ts").agg(F.max("n").alias("n"))
    upto = instants.withColumn("upto", F.sum("n").over(W.orderBy("ts").rowsBetween(W.unboundedPreceding, 0)))
    held = ds.points.select("ts", *SERIES).distinct().join(upto.select("ts", "upto", (F.col("upto") - F.col("n")).alias("below")), "ts")
    w = W.partitionBy(*SERIES).orderBy("ts")
    stretch = held.select(*SERIES, F.col("ts").alias("older"), F.lead("ts").over(w).alias("newer"), (F.col("upto") + 1).alias("first"), F.lead("below").over(w).alias("last"))
    stretch = stretch.filter("first <= last")
    ms = lambda c: F.unix_millis(c)
    if reach_ms is not None:
        stretch = stretch.filter(ms("newer") - ms("older") <= 2 * reach_ms)
    inside = stretch.select(*SERIES, "older", "newer", F.explode(F.sequence("first", "last")).alias("place"))
    out = inside.join(upto.filter("n = 1").select(F.col("ts").alias("target"), F.col("upto").alias("place")), "place").drop("place")
    if reach_ms is not None:
        out = out.filter((ms("target") - ms("older") <= reach_ms) & (ms("newer") - ms("target") <= reach_ms))
    return out


def filled(ds: Dataset, targets: DataFrame, reach_ms: int | None = None) -> DataFrame:
    """Points at each target: measured ones, and for groups wholly absent, interpolated ones of the metrics both neighbours have."""
    wanted = targets.select("target").distinct()
    exact = ds.points.join(wanted.withColumnRenamed("target", "ts"), "ts")
    between = gaps(ds, targets, reach_ms)
    values = ["kind", *COLUMN.values()]
    series = [*SERIES, "metric_key"]
    older = ds.points.withColumnRenamed("ts", "older").join(between, [*SERIES, "older"])
    newer = ds.points.select(F.col("ts").alias("newer"), *series, *[F.col(c).alias(f"n_{c}") for c in values])
    both = older.join(newer, [*series, "newer"])
    ms = lambda c: F.unix_millis(c).cast("double")
    share = (ms("target") - ms("older")) / (ms("newer") - ms("older"))
    kinds = ds.kinds | {"empty"}
    made = interpolate(Value(kinds, F.col("kind"), read_value(kinds).of), Value(kinds, F.col("n_kind"), read_value(kinds, "n_").of), share)
    names = [c for c in ds.points.columns if c not in ("ts", *values)]
    found = both.select(F.col("target").alias("ts"), *names, *made.columns())
    return exact.select("ts", *names, *values).unionByName(found)


def shifted_by(ds: Dataset, ms: int, reach_ms: int | None = None) -> tuple[Dataset, DataFrame]:
    """The dataset as it was ``ms`` milliseconds ago, gaps of groups interpolated; and the moves."""
    moves = before(ds.scrapes, ms)
    there = filled(ds, moves.select(F.col("past").alias("target")), reach_ms)
    past = Dataset(there, ds.scrapes, ds.kinds | {"dbl", "empty"})
    return shifted(past, moves), moves


def interpolated(ds: Dataset, reach_ms: int) -> Dataset:
    """The dataset with groups that are wholly absent from a scrape filled in from up to ``reach_ms`` on either side."""
    points = filled(ds, ds.scrapes.select(F.col("ts").alias("target")), reach_ms)
    return Dataset(points, ds.scrapes, ds.kinds | {"dbl", "empty"})


def stepped(scrapes: DataFrame, step_ms: int) -> DataFrame:
    """The first instant, then each first one at least ``step_ms`` after the one before it that was taken.

    Where to step next depends on the last step, so instants are passed one by
    one, sorted, through a single task: one long an instant, kept as a running
    state. The rest of the data never gets there.
    """
    if step_ms <= 0:
        return scrapes.select("ts").distinct()

    def stride(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = None
        for b in batches:
            ms, at, keep = b["ms"].to_numpy(), 0, []
            while True:
                at = at if due is None else max(at, int(ms.searchsorted(due)))
                if at >= len(ms):
                    break
                keep.append(at)
                due = ms[at] + step_ms
            yield b.iloc[keep]

    instants = scrapes.select(F.unix_millis("ts").alias("ms")).distinct().repartition(1).sortWithinPartitions("ms")
    return instants.mapInPandas(stride, "ms long").select(F.timestamp_millis("ms").alias("ts"))

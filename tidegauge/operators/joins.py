"""Pairing of two frames by tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Value, tags_key
from ..plans.frame import Frame, column_names, frame, renamed
from ..plans.nodes import Match


def projected(x: Frame, by: tuple[str, ...]) -> Frame:
    """A vector by some of its tags; keys that several series share are dropped.

    Partial aggregation comes before the shuffle, so a key that most series
    share costs one row a task.
    """
    picked = F.map_filter("tags", lambda k, v: k.isin(list(by))) if by else F.map_filter("tags", lambda k, v: F.lit(False))
    names = column_names(x.value)
    held = x.df.withColumn("by_key", tags_key(picked)).groupBy(*x.ctx, "by_key")
    one = held.agg(F.count(F.lit(1)).alias("n"), F.first("tags").alias("tags"), *[F.first(c).alias(c) for c in names]).filter("n = 1")
    return Frame(one.withColumnRenamed("by_key", "tags_key").select(*x.ctx, "tags_key", "tags", *names), x.value, False, x.ctx)


def paired(x: Frame, y: Frame, match: Match) -> tuple[DataFrame | None, Value, Value, bool]:
    """One relation of both sides, their values in it, and whether it is a scalar.

    Vectors pair by an inner equi-join on instant and tags, which Catalyst and
    AQE carry out as they see fit; a scalar goes to every series of its instant.
    """
    scalar = x.scalar and y.scalar
    if x.is_literal or y.is_literal:
        return (y if x.is_literal else x).df, x.value, y.value, scalar
    if match.by is not None and not x.scalar and not y.scalar:
        x, y = projected(x, match.by), projected(y, match.by)
    right, v = renamed(y, "r_")
    keys = x.ctx if x.scalar or y.scalar else (*x.ctx, "tags_key")
    df = x.df.join(right, list(keys))
    if x.scalar and not y.scalar:
        df = df.withColumnRenamed("r_tags", "tags")
    if match.by is not None and not x.scalar and not y.scalar:
        if match.keep_common:
            common = F.map_filter("tags", lambda k, t: F.coalesce(F.try_element_at(F.col("r_tags"), k) == t, F.lit(False)))
        else:
            common = F.map_filter("tags", lambda k, t: k.isin(list(match.by)) if match.by else F.lit(False))
        df = df.withColumn("tags", common).withColumn("tags_key", tags_key(F.col("tags")))
    return df, x.value, v, scalar


def combine(x: Frame, y: Frame, match: Match, op: Callable[[Value, Value], Value]) -> Frame:
    df, a, b, scalar = paired(x, y, match)
    out = op(a, b)
    return Frame(None, out, True, x.ctx) if df is None else frame(df, out, scalar, x.ctx)

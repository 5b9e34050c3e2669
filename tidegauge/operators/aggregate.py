"""Aggregates over series and over time.

Every aggregate is a few mergeable sums, minima or maxima, so partial results
are formed before any shuffle, and a look-back window merges the partial
results of its instants. A hot group is one row a task and instant.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import histogram as H
from ..functions.scalar import _add
from ..model import KINDS, Value, empty, literal, no_tags, read_value, tags_key, tags_of, value
from ..plans.frame import Frame, frame, on_spine, value_columns
from ..plans.nodes import Clause


@dataclass(frozen=True)
class Fold:
    """``start``: state columns from a group's rows; ``merge``: how to merge each; ``end``: the value of a state."""

    start: dict[str, Column]
    merge: dict[str, Callable[[Column], Column]]
    end: Value


def _sum_of_int(x: Column) -> tuple[Column, Column]:
    """Sums of the upper and the lower half of longs, which can't overflow."""
    return F.sum(F.shiftright(x, 32)), F.sum(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def _numbers(v: Value, hist: Callable[[Column], Column]) -> Column:
    d = v.number()
    return F.coalesce(d, hist(v.get("hist"))) if "hist" in v.kinds else d


def _fold_sum(v: Value) -> Fold:
    """Longs stay a long and wrap; any double or histogram makes a double; a text makes it empty; nothing sums to 0."""
    start: dict[str, Column] = {}
    if v.kinds & {"int", "bool"}:
        start["hi"], start["lo"] = _sum_of_int(v.integer())
    if v.kinds & {"dbl", "hist"}:
        parts = [v.get("dbl")] * ("dbl" in v.kinds) + ([H.total(v.get("hist"))] if "hist" in v.kinds else [])
        start["d"] = F.sum(F.coalesce(*parts))
    if "string" in v.kinds:
        start["bad"] = F.max(v.is_("string"))
    merge = {k: F.max if k == "bad" else F.sum for k in start}
    zero = F.lit(0).cast("bigint")
    col = lambda k: F.coalesce(F.col(k), F.lit(0).cast("bigint"))
    whole = _add(F.shiftleft(col("hi"), 32), col("lo")) if "hi" in start else zero
    bad = F.coalesce(F.col("bad"), F.lit(False)) if "bad" in start else None
    of = {"int": whole}
    if "d" in start:
        of = {"int": F.when(F.col("d").isNull(), whole), "dbl": F.col("d") + whole.cast("double")}
    if bad is not None:
        of = {k: F.when(~bad, c) for k, c in of.items()}
    end = Value(frozenset(["int"]), F.lit("int"), of) if len(of) == 1 and bad is None else value(**of)
    if start:
        return Fold(start, merge, end)
    return Fold({"none": F.max(F.lit(0))}, {"none": F.max}, literal(0))


def _fold_avg(v: Value) -> Fold:
    start = {"total": F.sum(_numbers(v, H.total)), "n": F.sum(F.coalesce(F.when(v.number().isNotNull(), F.lit(1.0)), H.events(v.get("hist")) if "hist" in v.kinds else F.lit(None).cast("double")))}
    return Fold(start, dict.fromkeys(start, F.sum), value(dbl=F.when(F.col("n") != 0, F.col("total") / F.col("n"))))


def _fold_extreme(v: Value, pick: Callable, edge: Callable) -> Fold:
    """The least or greatest number; a long if a long is it."""
    start = {"m": pick(_numbers(v, edge))}
    if v.kinds & {"int", "bool"}:
        start["mi"] = pick(v.integer())
    m = F.col("m")
    of = {"dbl": m}
    if "mi" in start:
        whole = F.when(F.col("mi").cast("double") == m, F.col("mi"))
        of = {"int": whole} if v.only("int", "bool", "empty", "string") else {"int": whole, "dbl": F.when(whole.isNull(), m)}
    return Fold(start, dict.fromkeys(start, pick), value(**of))


def _fold_count(v: Value) -> Fold:
    """Values that aren't empty, texts too; a histogram counts its events, as a double."""
    plain = F.lit(1) if v.only("bool", "int", "dbl", "string") else F.when(~v.is_("empty") & ~v.is_("hist"), F.lit(1))
    start = {"n": F.sum(plain.cast("bigint"))}
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    if "hist" not in v.kinds:
        return Fold(start, {"n": F.sum}, Value(frozenset(["int"]), F.lit("int"), {"int": n}))
    start["events"] = F.sum(H.events(v.get("hist")))
    end = value(int=F.when(F.col("events").isNull(), n), dbl=F.col("events") + n.cast("double"))
    return Fold(start, dict.fromkeys(start, F.sum), end)


def _fold_percentile(v: Value, p: float) -> Fold:
    return Fold({"p": F.percentile(v.number(), p / 100)}, {}, value(dbl=F.col("p")))


def _weighted_percentile(f: Fold, p: float) -> Fold:
    """Over parts (p, n): a number and how often it occurs. Within a window no row is copied to the instants that look back on it."""
    return Fold({"p": F.col("p"), "n": F.col("n")}, {"p": lambda c: F.percentile(c, p / 100, F.col("n"))}, f.end)


def fold(fn: str, v: Value, percentile: float | None = None) -> Fold:
    if fn == "percentile_agg":
        return _fold_percentile(v, percentile)
    return {
        "sum": _fold_sum,
        "avg": _fold_avg,
        "min": lambda x: _fold_extreme(x, F.min, H.floor),
        "max": lambda x: _fold_extreme(x, F.max, H.ceil),
        "count": _fold_count,
    }[fn](v)


def nothing(fn: str) -> Value:
    """A scalar result without any input."""
    return literal(0) if fn in ("sum", "count") else empty()


def _union(frames: list[Frame], kinds: frozenset[str]) -> DataFrame:
    out = None
    for x in frames:
        tags = [F.col("tags_key"), F.col("tags")] if not x.scalar else [tags_key(no_tags()).alias("tags_key"), no_tags().alias("tags")]
        df = x.df.select(*x.ctx, *tags, *[c for c in Value(kinds, x.value.kind, x.value.of).columns([k for k in KINDS if k in kinds])])
        out = df if out is None else out.unionByName(df)
    return out


def _grouped(df: DataFrame, clause: Clause) -> DataFrame:
    """``df`` with group: the key of its group of tags; series that lack a listed tag are dropped."""
    listed = clause.by or clause.without
    if not listed:
        return df.withColumn("group", F.lit("[]"))
    for t in listed:
        df = df.filter(F.map_contains_key("tags", t))
    keep = (lambda k, v: k.isin(list(listed))) if clause.by else (lambda k, v: ~k.isin(list(listed)))
    return df.withColumn("group", tags_key(F.map_filter("tags", keep)))


def _common(df: DataFrame, ctx: tuple[str, ...], over: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ctx, group, common: the tags that all members of a group share. Entries are counted, so no group is gathered.

    ``over`` sums counts (ctx, group, n) over a look-back window.
    """
    count = F.count(F.lit(1)).alias("n")
    total = over(df.groupBy(*ctx, "group").agg(count)).withColumnRenamed("n", "total")
    entries = df.select(*ctx, "group", F.explode(F.map_entries("tags")).alias("e")).select(*ctx, F.struct("group", "e").alias("group"))
    entries = over(entries.groupBy(*ctx, "group").agg(count)).select(*ctx, "group.*", "n")
    shared = entries.join(total, [*ctx, "group"]).filter("n = total").groupBy(*ctx, "group").agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("common"))
    return total.select(*ctx, "group").join(shared, [*ctx, "group"], "left").withColumn("common", F.coalesce("common", no_tags()))


def _ms(ts: str = "ts") -> Column:
    return F.unix_millis(ts)


def _windowed(parts: DataFrame, f: Fold, spine: DataFrame, ctx: tuple[str, ...], d: int, every: bool) -> DataFrame:
    """States of parts (ctx, group, state) merged over [ts - d, ts], at each instant whose window holds one (``every``: at all).

    Windows are cut into stretches of eight window lengths; parts near the end
    of one are copied to the next, so that one long series is many tasks.
    """
    own = [c for c in ctx if c != "ts"]
    d1 = max(d, 1)
    slot = lambda c: F.floor(c / d1)
    stretch = lambda c: F.floor(c / (8 * d1))
    at = spine.select(*ctx).withColumn("ms", _ms())
    if every:
        grid = at.withColumn("group", F.lit("[]"))
    else:
        slots = parts.withColumn("ms", _ms()).select(*own, "group", F.explode(F.array_distinct(F.array(slot(F.col("ms")), slot(F.col("ms") + d)))).alias("slot")).distinct()
        grid = at.withColumn("slot", slot(F.col("ms"))).join(slots, ["slot", *own]).drop("slot")
    names = list(f.start)
    rows = parts.withColumn("ms", _ms()).withColumn("stretch", F.explode(F.array_distinct(F.array(stretch(F.col("ms")), stretch(F.col("ms") + d)))))
    rows = rows.select(*ctx, "group", "ms", "stretch", F.lit(True).alias("is_part"), *names)
    grid = grid.select(*ctx, "group", "ms", stretch(F.col("ms")).alias("stretch"), F.lit(False).alias("is_part"), *[F.lit(None).cast(parts.schema[n].dataType).alias(n) for n in names])
    w = W.partitionBy(*own, "group", "stretch").orderBy("ms").rangeBetween(-d, 0)
    merged = rows.unionByName(grid).select(*ctx, "group", "is_part", F.max("is_part").over(w).alias("any_part"), *[m(F.col(n)).over(w).alias(n) for n, m in f.merge.items()])
    return merged.filter(~F.col("is_part") & (F.lit(every) | F.col("any_part")))


def aggregate(fn: str, frames: list[Frame], clause: Clause, spine: DataFrame, ctx: tuple[str, ...], window_ms: int | None = None, percentile: float | None = None) -> Frame:
    """The aggregate of all values of ``frames``; a vector if the clause names tags or keeps common ones, else a scalar."""
    vector = bool(clause.by or clause.without or clause.keep_common)
    kinds = frozenset().union(*[x.value.kinds for x in frames])
    scalars = [on_spine(x, spine) for x in frames if x.scalar]
    vectors = [x for x in frames if not x.scalar]
    v = read_value(kinds)
    if len(kinds) > 1:
        v = Value(kinds, F.col("kind"), v.of)
    if vector:
        if not vectors:
            rows = members = _grouped(_union(scalars, kinds), clause).filter(F.lit(False))
        else:
            rows = members = _grouped(_union(vectors, kinds), clause)
            if scalars:  # every scalar joins each group of its instant
                groups = rows.select(*ctx, "group").distinct()
                rows = rows.unionByName(_union(scalars, kinds).join(groups, list(ctx)).withColumn("tags", tags_of(F.col("group"))))
    else:
        rows = _union([*vectors, *scalars], kinds).withColumn("group", F.lit("[]"))
    f = fold(fn, v, percentile)
    if window_ms is None:
        states = rows.groupBy(*ctx, "group").agg(*[c.alias(k) for k, c in f.start.items()])
    else:
        if fn == "percentile_agg":  # its parts are how often each number occurs at an instant
            parts, f = rows.groupBy(*ctx, "group", v.number().alias("p")).agg(F.count(F.lit(1)).alias("n")), _weighted_percentile(f, percentile)
        else:
            parts = rows.groupBy(*ctx, "group").agg(*[c.alias(k) for k, c in f.start.items()])
        states = _windowed(parts, f, spine, ctx, window_ms, every=not vector)
    if vector:
        if clause.keep_common:
            summed = Fold({"n": F.col("n")}, {"n": F.sum}, literal(0))
            over = lambda counts: counts if window_ms is None else _windowed(counts, summed, spine, ctx, window_ms, every=False).select(*ctx, "group", "n")
            states = states.join(_common(members, ctx, over), [*ctx, "group"]).withColumn("tags", F.col("common")).withColumn("tags_key", tags_key(F.col("tags")))
        else:
            states = states.withColumn("tags_key", F.col("group")).withColumn("tags", tags_of(F.col("group")))
        return frame(states, f.end, False, ctx)
    out = states.select(*ctx, *value_columns(f.end), F.lit(True).alias("present"))
    filled = spine.select(*ctx).join(out, list(ctx), "left")
    got, none = read_value(f.end.kinds), nothing(fn)
    if none.kinds == {"empty"} and "empty" in f.end.kinds:
        return frame(filled, Value(f.end.kinds, F.coalesce(F.col("kind"), F.lit("empty")) if len(f.end.kinds) > 1 else F.lit("empty"), got.of), True, ctx)
    kinds = f.end.kinds | none.kinds
    absent = F.col("present").isNull()
    of = {k: F.when(absent, none.get(k)).otherwise(got.get(k)) for k in kinds if k != "empty"}
    kind = F.when(absent, none.kind).otherwise(got.kind)
    return frame(filled, Value(kinds, kind if len(kinds) > 1 else F.lit(next(iter(kinds))), of), True, ctx)

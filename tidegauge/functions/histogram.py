"""Histograms as arrays of (floor, ceil, events), in order and without overlap; all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import HIST


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _row(floor: Column, ceil: Column, events: Column) -> Column:
    return F.struct(floor.alias("floor"), ceil.alias("ceil"), events.alias("events"))


def normalise(ranges: Column) -> Column:
    """Any ranges as a histogram.

    The ends of all ranges cut the axis into cells; a range spreads its events
    evenly over its cells. Cells without events go, and neighbours of equal
    density become one. Ranges of no width keep their events where they are.
    """
    wide = F.filter(ranges, lambda r: r["ceil"] > r["floor"])
    points = F.filter(ranges, lambda r: r["ceil"] == r["floor"])
    ends = F.sort_array(F.array_distinct(F.concat(F.transform(ranges, lambda r: r["floor"]), F.transform(ranges, lambda r: r["ceil"]))))
    pairs = F.when(F.size(ends) > 1, F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda a, i: F.struct(a.alias("a"), F.get(ends, i + 1).alias("b")))).otherwise(F.array().cast("array<struct<a:double,b:double>>"))
    share = lambda c: _sum(F.transform(F.filter(wide, lambda r: (r["floor"] <= c["a"]) & (r["ceil"] >= c["b"])), lambda r: r["events"] * ((c["b"] - c["a"]) / (r["ceil"] - r["floor"]))))
    cells = F.transform(pairs, lambda c: _row(c["a"], c["b"], share(c)))
    spots = F.transform(F.array_distinct(F.transform(points, lambda r: r["floor"])), lambda p: _row(p, p, _sum(F.transform(F.filter(points, lambda r: r["floor"] == p), lambda r: r["events"]))))
    cells = F.sort_array(F.filter(F.concat(cells, spots), lambda c: c["events"] != 0))

    def joined(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        width = lambda x: x["ceil"] - x["floor"]
        same = (F.size(done) > 0) & (last["ceil"] == c["floor"]) & (width(c) > 0) & (last["events"] * width(c) == c["events"] * width(last))
        one = _row(last["floor"], c["ceil"], last["events"] + c["events"])
        return F.when(F.size(done) == 0, F.array(c)).when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(one))).otherwise(F.concat(done, F.array(c)))

    return F.aggregate(cells, F.array().cast(HIST), joined).cast(HIST)


def scale(h: Column, by: Column) -> Column:
    return F.filter(F.transform(h, lambda r: _row(r["floor"], r["ceil"], r["events"] * by)), lambda r: r["events"] != 0).cast(HIST)


def add(x: Column, y: Column) -> Column:
    return normalise(F.concat(x, y))


def one_sign(h: Column) -> Column:
    """``h``, or null if some counts are positive and others negative."""
    return F.when(~(F.exists(h, lambda r: r["events"] > 0) & F.exists(h, lambda r: r["events"] < 0)), h)


def subtract(x: Column, y: Column) -> Column:
    return one_sign(add(x, scale(y, F.lit(-1.0))))


def compare(x: Column, y: Column) -> Column:
    """-1, 0 or 1: by the first range that differs, its floor, then ceil, then events; a histogram that ends first is less."""
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def events(h: Column) -> Column:
    return _sum(F.transform(h, lambda r: r["events"]))


def total(h: Column) -> Column:
    """The sum of all values, each taken as the middle of its range."""
    return _sum(F.transform(h, lambda r: (r["floor"] + r["ceil"]) / 2 * r["events"]))


def floor(h: Column) -> Column:
    return F.get(h, F.lit(0))["floor"]


def ceil(h: Column) -> Column:
    return F.get(h, F.size(h) - 1)["ceil"]


def average(h: Column) -> Column:
    return F.when(F.size(h) > 0, total(h) / events(h))


def at(h: Column, index: Column) -> Column:
    """The value at a position: ranges before it are passed, within one it is interpolated. An end shared by two ranges belongs to the later."""
    before = lambda i: events(F.slice(h, F.lit(1), i))
    spans = F.transform(h, lambda r, i: F.struct(before(i).alias("low"), r.alias("r")))
    found = F.filter(spans, lambda s: s["low"] + s["r"]["events"] > index)
    hit = F.coalesce(F.get(found, F.lit(0)), F.element_at(spans, -1))
    share = (index - hit["low"]) / hit["r"]["events"]
    return F.when(F.size(h) > 0, hit["r"]["ceil"] * share + hit["r"]["floor"] * (1 - share))


def percentile(h: Column, p: float) -> Column:
    return at(h, events(h) * p / 100)


def median(h: Column) -> Column:
    return percentile(h, 50)

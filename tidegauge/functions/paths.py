"""Path patterns as filters, and references into bound paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import path_key
from ..plans import nodes as n


def is_literal(pattern: n.Pattern) -> bool:
    return all(isinstance(e, str) for e in pattern)


def matches(pattern: n.Pattern, path: Column, key: Column) -> Column:
    """Whether a path, given as array and as key, matches.

    Literal patterns are equality on the key, which scans push down; a literal
    beginning adds a prefix test on the key, which they push down as well.
    ``**`` stands for any number of components, none included.
    """
    if is_literal(pattern):
        return key == path_key(list(pattern))
    size = F.size(path)
    fixed = sum(not (isinstance(e, n.Wild) and e.kind == "**") for e in pattern)

    def one(e: str | n.Wild, at: Column) -> Column:
        x = F.get(path, at)
        if isinstance(e, str):
            return x == e
        return x.rlike(e.regex) if e.kind == "regex" else F.lit(True)

    def from_(i: int, at: Column) -> Column:
        if i == len(pattern):
            return size == at
        e = pattern[i]
        if not (isinstance(e, n.Wild) and e.kind == "**"):
            return one(e, at) & from_(i + 1, at + 1)
        if i + 1 == len(pattern):
            return F.lit(True)
        places = F.when(at <= size, F.sequence(at, size)).otherwise(F.array().cast("array<int>"))
        return F.exists(places, lambda p: from_(i + 1, p))

    test = (size == fixed if fixed == len(pattern) else size >= fixed) & F.coalesce(from_(0, F.lit(0)), F.lit(False))
    lead = []
    for e in pattern:
        if not isinstance(e, str):
            break
        lead.append(e)
    return F.startswith(key, F.lit(path_key(lead))) & test if lead else test


def sub(ref: n.Ref, path: Column) -> Column:
    """The components of ``path`` that ``ref`` takes; an index out of range takes none."""
    size = F.size(path)
    if not ref.sub:
        return path
    place = lambda i: F.lit(i) if i >= 0 else size + i
    if ref.sub == "index":
        at = place(ref.begin)
        return F.when((at >= 0) & (at < size), F.slice(path, at + 1, F.lit(1))).otherwise(F.array().cast("array<string>"))
    begin = F.lit(0) if ref.begin is None else place(ref.begin)
    end = size if ref.end is None else place(ref.end)
    begin, end = F.greatest(begin, F.lit(0)), F.least(end, size)
    return F.when(end > begin, F.slice(path, begin + 1, end - begin)).otherwise(F.array().cast("array<string>"))


def sub_literal(ref: n.Ref, path: tuple[str, ...]) -> tuple[str, ...]:
    if not ref.sub:
        return path
    place = lambda i: i if i >= 0 else len(path) + i
    if ref.sub == "index":
        at = place(ref.begin)
        return path[at : at + 1] if 0 <= at < len(path) else ()
    begin = 0 if ref.begin is None else max(0, place(ref.begin))
    end = len(path) if ref.end is None else min(len(path), place(ref.end))
    return path[begin:end] if end > begin else ()

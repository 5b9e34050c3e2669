"""Arguments of collectors: products of tuples, names and addresses made of them."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import tag_literal
from ..plans.nodes import Collect

_HOLE = re.compile(r"\$(?:(\d+)|\{(\d+)\}|\{([A-Za-z_][A-Za-z0-9_]*)\})")


def bindings(arguments: tuple) -> Iterator[dict[object, object]]:
    """Each combination of the lines' tuples, as name (or place) to value."""
    lines = [[dict(zip(keys, row, strict=True)) for row in rows] for keys, rows in arguments]
    for combination in product(*lines):
        out: dict[object, object] = {}
        for part in combination:
            out |= part
        yield out


def expand(template: str, bound: dict[object, object]) -> str:
    """``template`` with $0, ${0} and ${name} filled in; an argument that isn't bound is an error."""

    def one(m: re.Match) -> str:
        key = int(m[1] or m[2]) if m[1] or m[2] else m[3]
        if key not in bound:
            raise KeyError(f"{m[0]} of {template} is not bound")
        x = bound[key]
        return str(x).lower() if isinstance(x, bool) else str(x)

    return _HOLE.sub(one, template)


def group_of(path: tuple[str, ...] | None, bound: dict[object, object]) -> tuple[tuple[str, ...], dict[str, str]]:
    """Path and tags of a target: values bound by place extend the path in order, named ones are tags."""
    places = [str(bound[k]) for k in sorted(k for k in bound if isinstance(k, int))]
    return (*(path or ()), *places), {k: tag_literal(v) for k, v in bound.items() if isinstance(k, str)}


def numbers(end: int, begin: int = 0) -> tuple[tuple[int], ...]:
    """Tuples of one number each, from ``begin`` to before ``end``."""
    return tuple((i,) for i in range(begin, end))


class Cached:
    """The tuples of a resolver that is slow or fails.

    They are reused for ``min_age`` seconds. From then on each call tries
    again, but not within ``retry`` seconds of a failure; meanwhile the old
    ones serve, until they are ``max_age`` old and the failure is raised.
    """

    def __init__(self, resolve: Callable[[], Iterable[tuple]], min_age: float, max_age: float, retry: float = 5.0, clock: Callable[[], float] = time.monotonic):
        self.resolve, self.min_age, self.max_age, self.retry, self.clock = resolve, min_age, max_age, retry, clock
        self.tuples: tuple[tuple, ...] = ()
        self.since: float | None = None
        self.failed: tuple[float, Exception] | None = None

    def __call__(self) -> tuple[tuple, ...]:
        now = self.clock()
        age = float("inf") if self.since is None else now - self.since
        if age < self.min_age:
            return self.tuples
        if self.failed is None or now - self.failed[0] >= self.retry:
            try:
                self.tuples, self.since, self.failed = tuple(self.resolve()), now, None
                return self.tuples
            except Exception as e:  # whatever a source raises is told once the tuples are too old
                self.failed = now, e
        if age >= self.max_age:
            raise self.failed[1]
        return self.tuples


def targets(spark: SparkSession, c: Collect) -> DataFrame:
    """target, group_path, tags of a collector's every target; as many rows as its arguments combine to."""
    rows = []
    for bound in bindings(c.arguments):
        path, tags = group_of(c.path, bound)
        mains = [expand(m, bound) for m in c.main] or [None]
        rows += [(m, list(path), tags, {str(k): str(v) for k, v in bound.items()}) for m in mains]
    return spark.createDataFrame(rows, "target string, group_path array<string>, tags map<string,string>, bound map<string,string>")


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """target, change: those that came (``created``) and went (``closed``) between two resolutions."""
    came = now.select("target").distinct().join(before.select("target"), "target", "left_anti").withColumn("change", F.lit("created"))
    return came.unionByName(before.select("target").distinct().join(now.select("target"), "target", "left_anti").withColumn("change", F.lit("closed")))

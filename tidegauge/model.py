"""The data model: typed values, tags, paths, and the table of points.

A point is one metric of one tagged group at one instant. Its value is a
tagged union spread over columns: ``kind`` (bool, int, dbl, string, hist,
empty) and one column a kind. ``empty`` is a value that says "not known", which
differs from the point being absent.

Tags are a map from name to a typed text (``s:web1``, ``i:17``, ``d:0.5``,
``b:true``), so that equal texts of different types stay apart; ``tags_key``
renders the map in order of names and serves every join and grouping, as maps
themselves can't be joined on; the tags can be read back from it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIST = "array<struct<floor:double,ceil:double,events:double>>"
#: Kinds that carry a value, and the column type of each.
TYPES = {"bool": "boolean", "int": "bigint", "dbl": "double", "string": "string", "hist": HIST}
KINDS = (*TYPES, "empty")
COLUMN = {"bool": "b", "int": "i", "dbl": "d", "string": "s", "hist": "h"}
POINTS = f"ts timestamp, group_key string, group_path array<string>, tags map<string,string>, tags_key string, metric_key string, metric_path array<string>, kind string, b boolean, i bigint, d double, s string, h {HIST}"
NO_TAGS = "map<string,string>"


def null(kind: str) -> Column:
    return F.lit(None).cast(TYPES[kind])


@dataclass(frozen=True)
class Value:
    """A value as expressions: which kinds it can be, which it is, and what it holds.

    Operators build on ``kinds``, which is known when a plan is made: of a value
    that is always a double, nothing but its double is ever computed.
    """

    kinds: frozenset[str]
    kind: Column
    of: Mapping[str, Column] = field(default_factory=dict)

    def get(self, kind: str) -> Column:
        return self.of.get(kind, null(kind))

    def only(self, *kinds: str) -> bool:
        return self.kinds <= set(kinds)

    def is_(self, kind: str) -> Column:
        if kind not in self.kinds:
            return F.lit(False)
        return F.lit(True) if len(self.kinds) == 1 else self.kind == kind

    def number(self) -> Column:
        """As a double; null unless bool, int or dbl."""
        parts = [self.get(k).cast("double") for k in ("dbl", "int", "bool") if k in self.kinds]
        return F.coalesce(*parts) if parts else null("dbl")

    def integer(self) -> Column:
        """Int or bool as a long; null otherwise."""
        parts = [self.get(k).cast("bigint") for k in ("int", "bool") if k in self.kinds]
        return F.coalesce(*parts) if parts else null("int")

    def truth(self) -> Column:
        """As a boolean: numbers unless zero (NaN and -0.0 are not zero), histograms unless empty; null otherwise."""
        d = self.get("dbl")
        parts = {
            "bool": self.get("bool"),
            "int": self.get("int") != 0,
            "dbl": (d != 0) | F.isnan(d) | (d.cast("string") == "-0.0"),
            "hist": F.size(self.get("hist")) > 0,
        }
        known = [F.when(self.get(k).isNotNull(), parts[k]) for k in parts if k in self.kinds]
        return F.coalesce(*known) if known else null("bool")

    def text(self) -> Column:
        """As text; null for histograms and empty."""
        parts = [self.get(k).cast("string") for k in ("string", "int", "dbl", "bool") if k in self.kinds]
        return F.coalesce(*parts) if parts else null("string")

    def columns(self, kinds: Iterable[str] = KINDS) -> list[Column]:
        """The value as columns named kind, b, i, d, s, h, of the kinds asked for."""
        return [self.kind.alias("kind"), *[self.get(k).alias(COLUMN[k]) for k in kinds if k != "empty"]]


def value(**of: Column) -> Value:
    """A value whose kind follows from which of its columns isn't null; empty if none."""
    kind = F.lit("empty")
    for k in reversed(list(of)):
        kind = F.when(of[k].isNotNull(), k).otherwise(kind)
    return Value(frozenset([*of, "empty"]), kind, of)


def empty() -> Value:
    return Value(frozenset(["empty"]), F.lit("empty"))


def literal(x: object) -> Value:
    """A constant: bool, int, float, str, or a list of (floor, ceil, events)."""
    if isinstance(x, bool):
        return Value(frozenset(["bool"]), F.lit("bool"), {"bool": F.lit(x)})
    if isinstance(x, int):
        return Value(frozenset(["int"]), F.lit("int"), {"int": F.lit(x).cast("bigint")})
    if isinstance(x, float):
        return Value(frozenset(["dbl"]), F.lit("dbl"), {"dbl": F.lit(x)})
    if isinstance(x, str):
        return Value(frozenset(["string"]), F.lit("string"), {"string": F.lit(x)})
    rows = [F.struct(F.lit(float(a)).alias("floor"), F.lit(float(b)).alias("ceil"), F.lit(float(n)).alias("events")) for a, b, n in x]
    return Value(frozenset(["hist"]), F.lit("hist"), {"hist": (F.array(*rows) if rows else F.array()).cast(HIST)})


def read_value(kinds: Iterable[str], prefix: str = "") -> Value:
    """The value that a frame holds in columns kind, b, i, d, s, h."""
    kinds = frozenset(kinds)
    kind = F.lit(next(iter(kinds))) if len(kinds) == 1 else F.col(f"{prefix}kind")
    return Value(kinds, kind, {k: F.col(f"{prefix}{COLUMN[k]}") for k in kinds if k != "empty"})


# --- tags -----------------------------------------------------------------

_MARK = {"string": "s:", "int": "i:", "dbl": "d:", "bool": "b:"}


def tag_text(v: Value) -> Column:
    """The typed text of a tag value; null for what can't be one (empty, histogram)."""
    parts = [F.concat(F.lit(_MARK[k]), v.get(k).cast("string")) for k in _MARK if k in v.kinds]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")


def tag_value(text: Column) -> Value:
    """The value of a typed text."""
    held = lambda mark, kind: F.when(F.startswith(text, F.lit(mark)), F.substring(text, 3, 1 << 30).try_cast(TYPES[kind]))
    return value(**{k: held(m, k) for k, m in _MARK.items()})


def tag_literal(x: object) -> str:
    if isinstance(x, bool):
        return f"b:{str(x).lower()}"
    return f"{'i' if isinstance(x, int) else 'd' if isinstance(x, float) else 's'}:{x}"


_ENTRIES = "array<struct<key:string,value:string>>"


def tags_key(tags: Column) -> Column:
    """``tags`` as JSON, in order of names."""
    return F.to_json(F.sort_array(F.map_entries(tags)))


def tags_of(key: Column) -> Column:
    """The tags that a key renders."""
    return F.map_from_entries(F.from_json(key, _ENTRIES))


def no_tags() -> Column:
    return F.create_map().cast(NO_TAGS)


# --- paths ----------------------------------------------------------------


def path_key(path: list[str] | Column) -> str | Column:
    """A path in one text: plain identifiers as they are, other components quoted."""
    if isinstance(path, list):
        import re

        return ".".join(p if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", p) else "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'" for p in path)
    plain = lambda p: p.rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    quote = lambda p: F.concat(F.lit("'"), F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.array_join(F.transform(path, lambda p: F.when(plain(p), p).otherwise(quote(p))), ".")


# --- points ---------------------------------------------------------------


@dataclass(frozen=True)
class Dataset:
    """Points, the instants of all scrapes (scrapes without points exist too), and what is known of kinds.

    ``points`` has a column only for kinds that occur; ``kinds`` lists them.
    """

    points: DataFrame
    scrapes: DataFrame
    kinds: frozenset[str] = frozenset(KINDS)
    #: kinds by metric key, where known more closely
    metric_kinds: Mapping[str, frozenset[str]] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.points.sparkSession

    def with_points(self, points: DataFrame, kinds: Iterable[str] | None = None) -> Dataset:
        return replace(self, points=points, kinds=frozenset(self.kinds if kinds is None else kinds), metric_kinds={})


def points(df: DataFrame, group: Column, metric: Column, v: Value, tags: Column | None = None, ts: str = "ts") -> DataFrame:
    """Points of ``df``: ``group`` and ``metric`` are arrays of path components."""
    tags = no_tags() if tags is None else tags
    return df.select(
        F.col(ts).alias("ts"), path_key(group).alias("group_key"), group.alias("group_path"), tags.alias("tags"), tags_key(tags).alias("tags_key"),
        path_key(metric).alias("metric_key"), metric.alias("metric_path"), *v.columns(),
    )


def dataset(points_df: DataFrame, scrapes: DataFrame | None = None, kinds: Iterable[str] = KINDS, metric_kinds: Mapping[str, Iterable[str]] | None = None) -> Dataset:
    scrapes = points_df.select("ts").distinct() if scrapes is None else scrapes.select("ts")
    return Dataset(points_df, scrapes, frozenset(kinds), {k: frozenset(v) for k, v in (metric_kinds or {}).items()})

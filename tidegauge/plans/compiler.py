"""Expressions to DataFrame plans over all instants at once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import histogram as H
from ..functions import paths, scalar
from ..model import COLUMN, Dataset, Value, empty, literal, path_key, read_value, tag_value, value
from ..operators import joins, lookback
from ..operators.aggregate import aggregate
from . import nodes as n
from .frame import Frame, frame, on_spine, renamed


@dataclass(frozen=True)
class Scope:
    """What identifiers stand for: paths (alias), or columns of a frame of bindings (match).

    ``bindings`` has ts, bind, and for each group identifier its path, key and
    tags key, for each metric identifier its path and key.
    """

    aliases: Mapping[str, n.Name] = field(default_factory=dict)
    groups: tuple[str, ...] = ()
    metrics: Mapping[str, str] = field(default_factory=dict)  # metric identifier: its group's
    bindings: DataFrame | None = None

    @property
    def ctx(self) -> tuple[str, ...]:
        return ("ts",) if self.bindings is None else ("ts", "bind")


class Compiler:
    def __init__(self, ds: Dataset, scope: Scope = Scope()):
        self.ds, self.scope, self.ctx = ds, scope, scope.ctx

    @property
    def spine(self) -> DataFrame:
        """The instants, or instants and bindings, that a scalar has a value for."""
        return self.ds.scrapes.select("ts") if self.scope.bindings is None else self.scope.bindings.select("ts", "bind")

    def past(self, ds: Dataset) -> Compiler:
        return Compiler(ds, self.scope)

    # --- names ------------------------------------------------------------

    def literal_name(self, name: n.Name) -> tuple[str, ...] | None:
        """The components of a name that doesn't depend on a binding."""
        out: list[str] = []
        for e in name:
            if isinstance(e, str):
                out.append(e)
                continue
            if e.ident in self.scope.aliases:
                found = self.literal_name(self.scope.aliases[e.ident])
                if found is None:
                    return None
                out += paths.sub_literal(e, found)
            elif e.ident in self.scope.groups or e.ident in self.scope.metrics:
                return None
            else:
                raise KeyError(f"unknown identifier {e.ident}")
        return tuple(out)

    def name_column(self, name: n.Name) -> Column:
        """A name as an array, on the columns of the bindings."""
        parts = []
        for e in name:
            if isinstance(e, str):
                parts.append(F.array(F.lit(e)))
            elif e.ident in self.scope.aliases:
                parts.append(F.array(*[F.lit(x) for x in paths.sub_literal(e, self.literal_name(self.scope.aliases[e.ident]))]).cast("array<string>"))
            else:
                parts.append(paths.sub(e, F.col(f"{e.ident}_path")))
        return F.concat(*parts)

    def _bound(self, group: n.Name) -> str | None:
        e = group[0]
        return e.ident if len(group) == 1 and isinstance(e, n.Ref) and not e.sub and e.ident in self.scope.groups else None

    # --- selectors --------------------------------------------------------

    def group_points(self, group: n.Name) -> DataFrame:
        """The points of a group, with the columns of ctx."""
        fixed = self.literal_name(group)
        ident = self._bound(group)
        points = self.ds.points
        if fixed is not None:
            found = points.filter(F.col("group_key") == path_key(list(fixed))) if fixed else points.filter(F.lit(False))
            return found if self.scope.bindings is None else found.join(self.scope.bindings.select("ts", "bind"), "ts")
        b = self.scope.bindings
        if ident:
            at = b.select("ts", "bind", F.col(f"{ident}_key").alias("group_key"), F.col(f"{ident}_tags_key").alias("tags_key"))
            return points.join(at, ["ts", "group_key", "tags_key"])
        at = b.select("ts", "bind", path_key(self.name_column(group)).alias("group_key"))
        return points.join(at, ["ts", "group_key"])

    def _kinds(self, metric: str | None) -> frozenset[str]:
        return self.ds.metric_kinds.get(metric, self.ds.kinds)

    def select(self, group: n.Name, metric: n.Name) -> Frame:
        found, name = self.group_points(group), self.literal_name(metric)
        if name is None:
            at = self.scope.bindings.select("ts", "bind", path_key(self.name_column(metric)).alias("metric_key"))
            return self._frame(found.join(at, ["ts", "bind", "metric_key"]), self.ds.kinds)
        key = path_key(list(name))
        return self._frame(found.filter(F.col("metric_key") == key), self._kinds(key))

    def _frame(self, points: DataFrame, kinds: frozenset[str]) -> Frame:
        return frame(points, read_value(kinds), False, self.ctx)

    def matched(self, m: n.MetricMatch) -> Frame:
        test = paths.matches(m.group, F.col("group_path"), F.col("group_key")) & paths.matches(m.metric, F.col("metric_path"), F.col("metric_key"))
        found = self.ds.points.filter(test)
        if self.scope.bindings is not None:
            found = found.join(self.scope.bindings.select("ts", "bind"), "ts")
        kinds = self._kinds(path_key(list(m.metric))) if paths.is_literal(m.metric) else self.ds.kinds
        return self._frame(found, kinds)

    def metric_variable(self, ident: str) -> Frame:
        owner = self.scope.metrics[ident]
        at = self.scope.bindings.select("ts", "bind", F.col(f"{owner}_key").alias("group_key"), F.col(f"{owner}_tags_key").alias("tags_key"), F.col(f"{ident}_key").alias("metric_key"))
        return self._frame(self.ds.points.join(at, ["ts", "group_key", "tags_key", "metric_key"]), self.ds.kinds)

    # --- expressions ------------------------------------------------------

    def compile(self, x: n.Node) -> Frame:
        fused = self._fused(x)
        return fused if fused is not None else getattr(self, f"_{type(x).__name__}")(x)

    def _Const(self, x: n.Const) -> Frame:
        return Frame(None, literal(x.value), True, self.ctx)

    def _Selector(self, x: n.Selector) -> Frame:
        return self.select(x.group, x.metric)

    def _MetricVar(self, x: n.MetricVar) -> Frame:
        return self.metric_variable(x.ident)

    def _MetricMatch(self, x: n.MetricMatch) -> Frame:
        return self.matched(x)

    def _map(self, x: Frame, v: Value) -> Frame:
        return Frame(None, v, True, self.ctx) if x.is_literal else frame(x.df, v, x.scalar, self.ctx)

    def _Unary(self, x: n.Unary) -> Frame:
        inner = self.compile(x.x)
        return self._map(inner, scalar.unary(x.op, inner.value))

    def _Binary(self, x: n.Binary) -> Frame:
        return joins.combine(self.compile(x.left), self.compile(x.right), x.match, lambda a, b: scalar.binary(x.op, a, b))

    def _RegexTest(self, x: n.RegexTest) -> Frame:
        inner = self.compile(x.x)
        return self._map(inner, scalar.matches(inner.value, x.regex, x.negate))

    def _Regexp(self, x: n.Regexp) -> Frame:
        inner = self.compile(x.x)
        return self._map(inner, scalar.regexp(inner.value, x.regex, x.template))

    def _Str(self, x: n.Str) -> Frame:
        first = self.compile(x.args[0])
        out = self._map(first, scalar.concat(literal(""), first.value))
        return reduce(lambda a, b: joins.combine(a, b, x.match, scalar.concat), map(self.compile, x.args[1:]), out)

    def _NameOf(self, x: n.NameOf) -> Frame:
        fixed = self.literal_name(x.name)
        if fixed is not None:
            return Frame(None, scalar.named(list(fixed)), True, self.ctx)
        at = self.scope.bindings.select(*self.ctx, self.name_column(x.name).alias("path"))
        return frame(at, scalar.named_column(F.col("path")), True, self.ctx)

    def _TagOf(self, x: n.TagOf) -> Frame:
        if isinstance(x.target, tuple):
            df = self.group_points(x.target).select(*self.ctx, "tags_key", "tags").dropDuplicates([*self.ctx, "tags_key"])
        else:
            inner = self.compile(x.target)
            if inner.scalar:
                return frame(on_spine(inner, self.spine).df.filter(F.lit(False)).select(*self.ctx), empty(), True, self.ctx)
            df = inner.df
        held = F.try_element_at("tags", F.lit(x.tag))
        return frame(df.filter(held.isNotNull()), tag_value(held), False, self.ctx)

    def _Aggregate(self, x: n.Aggregate) -> Frame:
        return aggregate(x.fn, [self.compile(a) for a in x.args], x.clause, self.spine, self.ctx, x.window_ms, x.percentile)

    def _Rate(self, x: n.Rate) -> Frame:
        """The argument now, and in the dataset as it was; joined by tags."""
        if x.window_ms is None:
            moves = lookback.previous(self.ds.scrapes)
            past = lookback.shifted(self.ds, moves)
        else:
            past, moves = lookback.shifted_by(self.ds, x.window_ms)
        now, was = self.compile(x.x), self.past(past).compile(x.x)
        if now.is_literal:
            now, was = on_spine(now, self.spine), on_spine(was, self.spine)
        right, before = renamed(was, "r_")
        seconds = (F.unix_millis("ts") - F.unix_millis("past")) / 1000
        df = now.df.join(right, list(now.keys), "left" if now.scalar else "inner").join(moves, "ts", "left" if now.scalar else "inner")
        a, b = now.value, before
        of = {}
        if a.kinds & b.kinds - {"empty", "string", "hist"} or (a.kinds & {"bool", "int", "dbl"} and b.kinds & {"bool", "int", "dbl"}):
            of["dbl"] = F.when(seconds != 0, (a.number() - b.number()) / seconds)
        if "hist" in a.kinds & b.kinds:
            of["hist"] = F.when(seconds != 0, H.scale(H.subtract(a.get("hist"), b.get("hist")), 1 / seconds))
        return frame(df, value(**of) if of else empty(), now.scalar, self.ctx)

    # --- several metrics of one group in one pass ---------------------------

    def _fused(self, x: n.Node) -> Frame | None:
        """An expression over two or more metrics of one group, without a self-join.

        Its metrics are pivoted by one aggregation on instant and tags, partial
        before the shuffle; as pairing drops series that lack a metric, so does
        this.
        """
        if not isinstance(x, n.Binary):
            return None
        groups: set[n.Name] = set()
        metrics: dict[str, int] = {}
        if not self._gather(x, groups, metrics) or len(groups) != 1 or len(metrics) < 2:
            return None
        found = self.group_points(next(iter(groups))).filter(F.col("metric_key").isin(list(metrics)))
        cols, values = [], {}
        for key, i in metrics.items():
            kinds = self._kinds(key)
            if "hist" in kinds and len(kinds) < 3:
                return None
            here = F.col("metric_key") == key
            cols.append(F.max(F.when(here, True)).alias(f"m{i}"))
            cols += [F.first(F.when(here, F.col(COLUMN[k])), True).alias(f"m{i}_{COLUMN[k]}") if k in ("string", "hist") else F.max(F.when(here, F.col(COLUMN[k]))).alias(f"m{i}_{COLUMN[k]}") for k in kinds if k != "empty"]
            of = {k: F.col(f"m{i}_{COLUMN[k]}") for k in kinds if k != "empty"}
            values[key] = Value(kinds, F.lit(next(iter(kinds))), of) if len(kinds) == 1 else Value(kinds | {"empty"}, value(**of).kind if of else F.lit("empty"), of)
        wide = found.groupBy(*self.ctx, "tags_key").agg(F.first("tags").alias("tags"), *cols)
        for i in metrics.values():
            wide = wide.filter(F.col(f"m{i}"))
        return frame(wide, self._value_of(x, values), False, self.ctx)

    def _gather(self, x: n.Node, groups: set, metrics: dict[str, int]) -> bool:
        if isinstance(x, n.Const):
            return True
        if isinstance(x, n.Selector):
            name = self.literal_name(x.metric)
            if name is None:
                return False
            groups.add(x.group)
            metrics.setdefault(path_key(list(name)), len(metrics))
            return True
        if isinstance(x, (n.Unary, n.RegexTest, n.Regexp)):
            return self._gather(x.x, groups, metrics)
        return isinstance(x, n.Binary) and x.match.by is None and self._gather(x.left, groups, metrics) and self._gather(x.right, groups, metrics)

    def _value_of(self, x: n.Node, values: dict[str, Value]) -> Value:
        if isinstance(x, n.Const):
            return literal(x.value)
        if isinstance(x, n.Selector):
            return values[path_key(list(self.literal_name(x.metric)))]
        if isinstance(x, n.Unary):
            return scalar.unary(x.op, self._value_of(x.x, values))
        if isinstance(x, n.RegexTest):
            return scalar.matches(self._value_of(x.x, values), x.regex, x.negate)
        if isinstance(x, n.Regexp):
            return scalar.regexp(self._value_of(x.x, values), x.regex, x.template)
        return scalar.binary(x.op, self._value_of(x.left, values), self._value_of(x.right, values))


# --- what an expression needs of history -----------------------------------


def lookback_ms(x: n.Node) -> tuple[int, int]:
    """How far back an expression looks: milliseconds, and scrapes on top of that."""
    if isinstance(x, n.Rate):
        ms, scrapes = lookback_ms(x.x)
        return (ms, scrapes + 1) if x.window_ms is None else (ms + x.window_ms, scrapes)
    parts = [lookback_ms(c) for c in children(x)]
    ms, scrapes = max((p[0] for p in parts), default=0), max((p[1] for p in parts), default=0)
    return (ms + x.window_ms, scrapes) if isinstance(x, n.Aggregate) and x.window_ms is not None else (ms, scrapes)


def children(x: n.Node) -> list[n.Node]:
    if isinstance(x, n.Binary):
        return [x.left, x.right]
    if isinstance(x, (n.Unary, n.RegexTest, n.Regexp, n.Rate)):
        return [x.x]
    if isinstance(x, (n.Aggregate, n.Str)):
        return list(x.args)
    return [x.target] if isinstance(x, n.TagOf) and isinstance(x.target, n.Node) else []


def name_filter(xs: list[n.Node]) -> set[tuple[n.Pattern, n.Pattern]] | None:
    """Group and metric patterns that cover all that expressions read; None if they can't be told."""
    out: set[tuple[n.Pattern, n.Pattern]] = set()
    for x in xs:
        if isinstance(x, n.MetricMatch):
            out.add((x.group, x.metric))
        elif isinstance(x, n.Selector):
            if any(isinstance(e, n.Ref) for e in (*x.group, *x.metric)):
                return None
            out.add((x.group, x.metric))
        elif isinstance(x, n.MetricVar):
            return None
        elif isinstance(x, n.TagOf) and isinstance(x.target, tuple):
            if any(isinstance(e, n.Ref) for e in x.target):
                return None
            out.add((x.target, (n.Wild("**"),)))
        inner = name_filter(children(x)) if children(x) else set()
        if inner is None:
            return None
        out |= inner
    return out


def filtered(ds: Dataset, xs: list[n.Node]) -> Dataset:
    """``ds`` with only the points that expressions can read; scrapes stay."""
    wanted = name_filter(xs)
    if wanted is None:
        return ds
    tests = [paths.matches(g, F.col("group_path"), F.col("group_key")) & paths.matches(m, F.col("metric_path"), F.col("metric_key")) for g, m in sorted(wanted, key=repr)]
    return replace(ds, points=ds.points.filter(reduce(lambda a, b: a | b, tests) if tests else F.lit(False)))


def compile_expression(ds: Dataset, x: n.Node, scope: Scope = Scope()) -> Frame:
    return Compiler(ds, scope).compile(x)

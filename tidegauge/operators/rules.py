"""Rules: statements that add to, change or watch a dataset, applied in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..model import COLUMN, Dataset, Value, literal, no_tags, path_key, read_value, tag_text, tags_key
from ..plans import nodes as n
from ..plans import printer
from ..plans.compiler import Compiler, Scope
from ..plans.frame import Frame, frame, on_spine
from ..storage import cut
from . import alerts

_VALUES = ["kind", *COLUMN.values()]
_POINT = ["ts", "group_key", "group_path", "tags", "tags_key", "metric_key", "metric_path", *_VALUES]


@dataclass(frozen=True)
class Outcome:
    """The dataset after the rules, and all alerts: ts, alert_key, tags, tags_key, triggered, state, start, for_ms, message, attributes."""

    dataset: Dataset
    alerts: DataFrame | None = None


def upsert(points: DataFrame, new: DataFrame) -> DataFrame:
    """Points of ``new`` in the place of those with the same instant, group and metric."""
    key = ["ts", "group_key", "tags_key", "metric_key"]
    kept = points.join(new.select(*key), key, "left_anti")
    return kept.select(*_POINT).unionByName(new.select(*_POINT))


def _array(components) -> F.Column:
    return F.array(*[F.lit(c) for c in components]).cast("array<string>")


def _path(c: Compiler, df: DataFrame, name: n.Name, column: str) -> DataFrame:
    """``df`` with a name's components as ``column``, taken from the bindings where it refers to them."""
    fixed = c.literal_name(name)
    if fixed is not None:
        return df.withColumn(column, _array(fixed))
    return df.join(c.scope.bindings.select(*c.ctx, c.name_column(name).alias(column)), list(c.ctx))


def _points(c: Compiler, x: Frame, group: n.Name, metric: n.Name) -> DataFrame:
    """A frame as points of a group and metric."""
    df = x.df if not x.scalar else x.df.withColumn("tags", no_tags()).withColumn("tags_key", tags_key(no_tags()))
    df = _path(c, _path(c, df, group, "group_path"), metric, "metric_path")
    v = x.value
    return df.select("ts", path_key(F.col("group_path")).alias("group_key"), "group_path", "tags", "tags_key", path_key(F.col("metric_path")).alias("metric_key"), "metric_path", *v.columns())


def _once(points: DataFrame) -> DataFrame:
    """One point an instant, group and metric; bindings may say the same thing repeatedly."""
    return points.dropDuplicates(["ts", "group_key", "tags_key", "metric_key"])


def _tagged(c: Compiler, x: Frame, tags: tuple[tuple[str, n.Node], ...]) -> Frame:
    """``x`` with more tags, each a scalar or a vector paired by tags; empty values and histograms set none."""
    old = ["tags"] if not x.scalar else []
    df = x.df if old else x.df.withColumn("tags", no_tags())
    if not old:
        df = df.withColumn("tags_key", tags_key(no_tags()))
    added = []
    for i, (k, node) in enumerate(tags):
        t = c.compile(node)
        if t.is_literal:
            text = tag_text(t.value)
        elif t.scalar:
            df = df.join(t.df.select(*c.ctx, tag_text(t.value).alias(f"tag{i}")), list(c.ctx), "left")
            text = F.col(f"tag{i}")
        else:
            df = df.join(t.df.select(*c.ctx, "tags_key", tag_text(t.value).alias(f"tag{i}")), [*c.ctx, "tags_key"], "left")
            text = F.col(f"tag{i}")
        added.append((k, text))
    return frame(_with_tags(df, added), x.value, False, c.ctx)


def _with_tags(df: DataFrame, added: list) -> DataFrame:
    names = [k for k, _ in added]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), t.alias("value")) for k, t in added])
    new = F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
    kept = F.map_filter("tags", lambda k, v: ~k.isin(names) | ~F.map_contains_key(F.col("__new"), k))
    df = df.withColumn("__new", new)
    df = df.withColumn("tags", F.map_concat(kept, F.col("__new"))).drop("__new")
    return df.withColumn("tags_key", tags_key(F.col("tags")))


#: Changes of any points after which they are checkpointed, as each reads them several times and plans would double; layers after which they become one.
CUT_EVERY, LAYERS = 3, 8


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


class Rules:
    """Applies statements to a dataset; aliases hold for later statements.

    A statement that names its group or its metrics literally changes points of
    those names only. The others stay in ``base``, behind a filter that reaches
    the scan; what was made of the changed ones is a layer beside it, which is
    checkpointed once another change follows. So such statements neither
    shuffle nor rewrite the dataset, however many there are.
    """

    def __init__(self, ds: Dataset, scope: Scope = Scope()):
        self.ds, self.scope, self.found, self.changes = ds, scope, [], 0
        self.base, self.layers, self.loose = ds.points.select(*_POINT), [], False

    def _target(self, group: n.Name, metrics: Iterable[n.Name] = ()) -> F.Column | None:
        """Which points a statement may replace, by the names that are literal; None: any."""
        is_ = lambda column, name: F.col(column).eqNullSafe(path_key(list(name)))
        fixed, names = self.compiler.literal_name(group), [self.compiler.literal_name(m) for m in metrics]
        tests = [is_("group_key", fixed)] if fixed else []
        if names and all(names):
            tests.append(reduce(lambda a, b: a | b, [is_("metric_key", x) for x in names]))
        return reduce(lambda a, b: a & b, tests) if tests else None

    def _change(self, target: F.Column | None, change: Callable[[DataFrame], DataFrame], kinds: Iterable[str] = ()) -> None:
        """``change`` maps the points of the target to new ones of the target."""
        points = _union([self.base, *self.layers])
        self.loose = target is not None
        if self.loose:
            self.base, self.layers = self.base.filter(~target), [*[x.filter(~target) for x in self.layers], change(points.filter(target))]
        else:
            self.base, self.layers, self.changes = change(points), [], self.changes + 1
            if self.changes % CUT_EVERY == 0:
                self.base = cut(self.base)
        self.ds = replace(self.ds, kinds=self.ds.kinds | frozenset(kinds), metric_kinds={})
        self._show()

    def _show(self) -> None:
        self.ds = replace(self.ds, points=_union([self.base, *self.layers]))

    def _settle(self) -> None:
        """Before a change: the layer of the one before is checkpointed."""
        if self.loose:
            self.layers[-1], self.loose = cut(self.layers[-1]), False
            if len(self.layers) > LAYERS:
                self.layers = [cut(_union(self.layers))]
            self._show()

    @property
    def compiler(self) -> Compiler:
        return Compiler(self.ds, self.scope)

    def apply(self, rules: Iterable[n.Node]) -> Outcome:
        for r in rules:
            getattr(self, f"_{type(r).__name__}")(r)
        found = reduce(lambda a, b: a.unionByName(b), self.found) if self.found else None
        return Outcome(self.ds, found)

    def _Alias(self, r: n.Alias) -> None:
        self.scope = replace(self.scope, aliases={**self.scope.aliases, r.ident: r.name})

    def _Constant(self, r: n.Constant) -> None:
        """The metrics on every group there is at that path; without one nothing happens."""
        self._settle()
        c = self.compiler
        groups = c.group_points(r.group).select("ts", *c.ctx[1:], "group_path", "tags", "tags_key", "group_key").dropDuplicates(["ts", "group_key", "tags_key", *c.ctx[1:]])
        made, kinds = [], set()
        for name, x in r.metrics:
            v = literal(x)
            kinds |= v.kinds
            df = _path(c, groups, name, "metric_path")
            made.append(df.select("ts", "group_key", "group_path", "tags", "tags_key", path_key(F.col("metric_path")).alias("metric_key"), "metric_path", *v.columns()))
        new = _once(reduce(lambda a, b: a.unionByName(b), made))
        self._change(self._target(r.group, [name for name, _ in r.metrics]), lambda points: upsert(points, new), kinds)

    def _Define(self, r: n.Define) -> None:
        self._settle()
        c, made, kinds = self.compiler, [], set()
        for name, node in r.metrics:
            x = on_spine(c.compile(node), c.spine)
            if r.tags:
                x = _tagged(c, x, r.tags)
            made.append(_points(c, x, r.group, name))
            kinds |= x.value.kinds
        if made:
            new = _once(reduce(lambda a, b: a.unionByName(b), made))
            self._change(self._target(r.group, [name for name, _ in r.metrics]), lambda points: upsert(points, new), kinds)

    def _SetTag(self, r: n.SetTag) -> None:
        """Renames groups; a renamed group replaces one that has its new name already."""
        self._settle()
        c = self.compiler
        groups = c.group_points(r.group).select(*c.ctx, "group_key", "tags_key", "tags").dropDuplicates([*c.ctx, "group_key", "tags_key"])
        named = groups.withColumn("old_key", F.col("tags_key"))
        v = Value(frozenset(["string"]), F.lit("string"), {"string": F.concat_ws("\0", "group_key", "old_key")})
        moved = _tagged(c, Frame(frame(named, v, False, c.ctx).df, read_value(["string"]), False, c.ctx), r.tags)
        was = F.split(F.col("s"), "\0")
        moves = moved.df.select("ts", F.get(was, F.lit(0)).alias("group_key"), F.get(was, F.lit(1)).alias("tags_key"), F.col("tags_key").alias("new_key"), F.col("tags").alias("new_tags"))
        moves = moves.dropDuplicates(["ts", "group_key", "tags_key"]).filter("new_key <> tags_key")
        replaced = moves.select("ts", "group_key", F.col("new_key").alias("tags_key")).distinct()

        def renamed(points: DataFrame) -> DataFrame:
            there = points.join(moves, ["ts", "group_key", "tags_key"]).withColumn("tags", F.col("new_tags")).withColumn("tags_key", F.col("new_key")).select(*_POINT)
            rest = points.join(moves, ["ts", "group_key", "tags_key"], "left_anti").join(replaced, ["ts", "group_key", "tags_key"], "left_anti")
            return rest.select(*_POINT).unionByName(_once(there))

        self._change(self._target(r.group), renamed)

    def _MatchRule(self, r: n.MatchRule) -> None:
        """All combinations of what the selectors match, as rows: the rules run once, over all of them."""
        outer, before = self.scope, self.scope.bindings
        b = self.ds.scrapes.select("ts", F.lit("").alias("bind")) if before is None else before
        groups, metrics = list(outer.groups), dict(outer.metrics)
        for s in r.bindings:
            test = paths.matches(s.group, F.col("group_path"), F.col("group_key"))
            found = self.ds.points.filter(test)
            i = s.ident
            cols = [F.col("group_path").alias(f"{i}_path"), F.col("group_key").alias(f"{i}_key"), F.col("tags_key").alias(f"{i}_tags_key")]
            keys = [f"{i}_key", f"{i}_tags_key"]
            groups.append(i)
            if s.metric is not None:
                found = found.filter(paths.matches(s.metric, F.col("metric_path"), F.col("metric_key")))
                m = s.metric_ident
                cols += [F.col("metric_path").alias(f"{m}_path"), F.col("metric_key").alias(f"{m}_key")]
                keys.append(f"{m}_key")
                metrics[m] = i
            found = found.select("ts", *cols).dropDuplicates(["ts", *keys])
            b = b.join(found, "ts").withColumn("bind", F.concat_ws("\1", "bind", *keys))
        scope = Scope(outer.aliases, tuple(groups), metrics, b)
        if r.where is not None:
            holds = on_spine(Compiler(self.ds, scope).compile(r.where), b.select("ts", "bind"))
            true = holds.df.filter(holds.value.truth()).select("ts", "bind").distinct()
            scope = replace(scope, bindings=b.join(true, ["ts", "bind"], "left_semi"))
        self.scope = scope
        for rule in r.rules:
            getattr(self, f"_{type(rule).__name__}")(rule)
        self.scope = outer

    def _Alert(self, r: n.Alert) -> None:
        c = self.compiler
        x = on_spine(c.compile(r.when), c.spine)
        df = x.df if not x.scalar else x.df.withColumn("tags", no_tags()).withColumn("tags_key", tags_key(no_tags()))
        rows = _path(c, df.select(*c.ctx, "tags_key", "tags", x.value.truth().alias("triggered")), r.name, "alert_path").withColumn("alert_key", path_key(F.col("alert_path")))
        rows = self._attributes(c, rows, r.attributes)
        rows = rows.drop("alert_path", *c.ctx[1:]).dropDuplicates(["ts", "alert_key", "tags_key"])
        out = alerts.states(rows, self.ds.scrapes, r.for_ms)
        message = r.message if r.message is not None else printer.expression(r.when)
        self.found.append(out.select("ts", "alert_key", "tags_key", "tags", "triggered", "state", "start", "for_ms", F.lit(message).alias("message"), "attributes"))

    def _attributes(self, c: Compiler, rows: DataFrame, attributes) -> DataFrame:
        """Each attribute as an array of texts, looked up by the alert's tags; missing ones are empty arrays."""
        pairs = []
        for i, (k, given) in enumerate(attributes):
            parts = []
            for j, node in enumerate(given if isinstance(given, tuple) else (given,)):
                x, col = c.compile(node), f"a{i}_{j}"
                if x.is_literal:
                    parts.append(x.value.text())
                    continue
                right = x.df.select(*x.keys, x.value.text().alias(col))
                rows = rows.join(right, list(x.keys), "left")
                parts.append(F.col(col))
            pairs.append(F.struct(F.lit(k).alias("key"), F.filter(F.array(*parts), lambda t: t.isNotNull()).alias("value")))
        none = F.create_map().cast("map<string,array<string>>")
        return rows.withColumn("attributes", F.map_from_entries(F.array(*pairs)) if pairs else none).drop(*[x for x in rows.columns if x.startswith("a") and x[1:2].isdigit()])


def apply_rules(ds: Dataset, rules: Iterable[n.Node]) -> Outcome:
    return Rules(ds).apply(rules)

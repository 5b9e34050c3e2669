import pytest
from conftest import EMPTY, replay

from tidegauge.operators.rules import Rules, apply_rules
from tidegauge.plans.parser import parse_rules

N = None
G = "com.groups.metrics.test"


def states(spark, text, series, n=None, key="test"):
    ds = replay(spark, series, n)
    out = apply_rules(ds, parse_rules(text))
    got = {}
    for r in out.alerts.collect():
        if r.alert_key == key:
            got.setdefault(tuple(sorted(r.tags.items())), {})[r.ts.hour * 60 + r.ts.minute] = r.state
    n = n or max(len(v) for *_, v in series)
    return {k: [v.get(i) for i in range(n)] for k, v in got.items()}


O, T, F, U = "OK", "TRIGGERING", "FIRING", "UNKNOWN"


@pytest.mark.parametrize(
    ("text", "series", "expected"),
    [
        ("alert test if rate(G a) < 0;", [("G", {}, "a", [0, 1000, 100])], [N, O, F]),
        ("alert test if sum(G0 a, G1 a, G2 a) != G expected;", [("G0", {}, "a", [0, 0, 12, 1, N]), ("G1", {}, "a", [0, 1, 13, 1, 0]), ("G2", {}, "a", [0, 2, 17, 1, 0]), ("G", {}, "expected", [0, 3, 42, 1, 0])], [O, O, O, F, O]),
        ("alert test if sum(G.*.* a) != G expected;", [("G.0.i", {}, "a", [0, 0, 12, 1, N]), ("G.1.i", {}, "a", [0, 1, 13, 1, 0]), ("G.2.i", {}, "a", [0, 2, 17, 1, 0]), ("G", {}, "expected", [0, 3, 42, 1, 0])], [O, O, O, F, O]),
        ("alert test if sum(G.//^0|2$//.//dexed$// a) != G expected;", [("G.0.indexed", {}, "a", [0, 0, 12, 1, N]), ("G.1.indexed", {}, "a", [0, 1, 13, 1, 0]), ("G.2.indexed", {}, "a", [0, 2, 17, 1, 0]), ("G", {}, "expected", [0, 2, 29, 1, 0])], [O, O, O, F, O]),
        ("alert test if foo b for 1m;", [("foo", {}, "b", [False, True, True, True])], [O, T, F, F]),
        ("alert test if foo b for 1m;", [("foo", {}, "b", [False, True, True, False])], [O, T, F, O]),
        ("alert test if foo b;", [("foo", {}, "b", [True, N, False])], [F, N, O]),
        ("alert test if foo b for 3m;", [("foo", {}, "b", [True, True, True, True, N, N, True])], [T, T, T, F, N, N, T]),
        ("alert test if foo b for 3m;", [("foo", {}, "b", [N, N, N, True])], [N, N, N, T]),
        ("alert test if foo b for 2m;", [("foo", {}, "b", [True, EMPTY, True, False, EMPTY, True, True])], [T, U, F, O, U, T, F]),
        ("alert test if G up <= 15*60*1000 for 20m;", [("G", {}, "up", [i * 60_000 for i in range(1, 26)])], [T] * 15 + [O] * 10),
        ("define test x = G y; alert test if test x > 2;", [("G", {}, "y", [1, 2, 3])], [O, O, F]),
        ("constant G lim 2; alert test if G y > G lim;", [("G", {}, "y", [1, 2, 3])], [O, O, F]),
        ("alias a.b.c as q; alert test if q y > 2;", [("a.b.c", {}, "y", [1, 2, 3])], [O, O, F]),
    ],
)
def test_states(spark, text, series, expected):
    n = len(expected)
    got = states(spark, text, series, n)
    assert got.get((), [N] * n) == expected


def test_rate_does_not_bridge_a_gap(spark):
    rule = "alert test if rate(G a) < G low || rate(G a) > G high;"
    low, high = [0.99 / 60] * 4 + [0, 1.98 / 60], [1.01 / 60] * 4 + [1, 2.02 / 60]
    got = states(spark, rule, [("G", {}, "a", [0, 1, 2, N, 3, 5]), ("G", {}, "low", [float(x) for x in low]), ("G", {}, "high", [float(x) for x in high])])
    assert got[()] == [N, O, O, N, N, O]


def test_by_host(spark):
    series = [("G", {"host": "localhost", "id": "a"}, "a", [0, 1, 2, 3, 4, 5]), ("G", {"host": "localhost", "id": "b"}, "a", [14, 13, 12, 6, 4, 2])]
    assert states(spark, "alert test if sum(G a) by (host) != 14;", series) == {(("host", "s:localhost"),): [O, O, O, F, F, F]}


def test_tag_and_negation(spark):
    got = states(spark, "tag G as bool = G a; alert test if !tag(G, bool);", [("G", {}, "a", [True, False, N])], 3)
    assert got == {(("bool", "b:true"),): [O, N, N], (("bool", "b:false"),): [N, F, N]}


def test_match_alerts_per_group(spark):
    series = [("com.groups.test", {}, "x", [False, True]), ("com.test", {}, "x", [True, False])]
    rule = "match com.**.test as t { alert ${t} if t x; }"
    assert states(spark, rule, series, key="com.groups.test") == {(): [O, F]}
    assert states(spark, rule, series, key="com.test") == {(): [F, O]}
    got = states(spark, "match com.** as M where M a { alert test if M a; }", [("com.q", {}, "a", [True, False, N])], 3)
    assert got == {(): [F, N, N]}


def test_name_of_bound_groups(spark):
    series = [(f"com.groups.metrics.{x}", {}, "a", [1]) for x in ("17", "true", "3e4", "text")]
    out = apply_rules(replay(spark, series), parse_rules("match com.groups.metrics.* as G { define out.${G[-1]} v = name(${G[3]}); define out.${G[1:3]} w = 1; define gone.${G[9]} w = 1; }"))
    got = {r.group_key: (r.kind, r.i, r.d, r.b, r.s) for r in out.dataset.points.filter("metric_key = 'v'").collect()}
    assert got == {"out.'17'": ("int", 17, N, N, N), "out.true": ("bool", N, N, True, N), "out.'3e4'": ("dbl", N, 30000.0, N, N), "out.text": ("string", N, N, N, "text")}
    assert {r.group_key for r in out.dataset.points.filter("metric_key = 'w'").collect()} == {"out.groups.metrics", "gone"}


def test_match_binding_follows_time(spark):
    out = apply_rules(replay(spark, [("a.x", {"t": 1}, "c", [0, 60, 180])]), parse_rules("match a.* as g { define r.${g[1]} v = rate(g c); }"))
    assert [r.d for r in out.dataset.points.filter("metric_key = 'v'").orderBy("ts").collect()] == [1.0, 2.0]


@pytest.mark.parametrize(("op", "expected"), [("+", [3, 5, 7, 9, 11]), ("-", [-1] * 5), ("*", [2, 6, 12, 20, 30]), ("%", [1, 2, 3, 4, 5])])
def test_operator_by(spark, op, expected):
    ds = replay(spark, [("a", {"id": 0, "q": "l"}, "x", [1, 2, 3, 4, 5]), ("b", {"id": 0, "q": "r"}, "y", [2, 3, 4, 5, 6])])
    out = apply_rules(ds, parse_rules(f"define z v = a x {op} by (id) b y;"))
    assert [r.i for r in out.dataset.points.filter("group_key = 'z'").orderBy("ts").collect()] == expected


def test_define_adds_tags_and_overwrites(spark):
    ds = replay(spark, [("input", {"key": 17}, "x", [0, 1, 2, 3, 4])])
    got = states(spark, "define test tag (id = 1) { x = input x; } alert test if test x > 2;", [("input", {"key": 17}, "x", [0, 1, 2, 3, 4])])
    assert got == {(("id", "i:1"), ("key", "i:17")): [O, O, O, F, F]}
    out = apply_rules(ds, parse_rules("define input x = input x * 2; define input tag (key = input q) x = input x;"))
    assert sorted(r.i for r in out.dataset.points.collect()) == [0, 2, 4, 6, 8]


def test_rename_replaces(spark):
    ds = replay(spark, [("G", {"a": 1}, "x", [1]), ("G", {"a": 2}, "x", [2])])
    out = apply_rules(ds, parse_rules("tag G as a = 2;"))
    rows = out.dataset.points.collect()
    assert [(r.tags, r.i) for r in rows] == [({"a": "i:2"}, 1)]


def test_attributes_and_message(spark):
    ds = replay(spark, [("G", {"h": "a"}, "x", [5]), ("G", {"h": "b"}, "x", [1]), ("H", {"h": "a"}, "y", ["text"])])
    out = apply_rules(ds, parse_rules('alert z if G x > 2 attributes { one = H y, many = [G x, H y, "c"] }')).alerts
    got = {r.tags["h"]: (r.state, r.attributes, r.message) for r in out.collect()}
    assert got["s:a"] == (F, {"one": ["text"], "many": ["5", "text", "c"]}, "G x > 2")
    assert got["s:b"] == (O, {"one": [], "many": ["1", "c"]}, "G x > 2")


def test_many_rules(spark):
    text = "".join(f"define r{i} v = {'G x' if i == 0 else f'r{i - 1} v'} + 1; tag r{i} as n = {i};" for i in range(6))
    out = apply_rules(replay(spark, [("G", {}, "x", [1, 2])]), parse_rules(text))
    got = {(r.group_key, r.ts.minute): (r.i, r.tags) for r in out.dataset.points.collect()}
    assert got["r5", 1] == (8, {"n": "i:5"}) and got["r0", 0] == (2, {"n": "i:0"}) and len(got) == 14


def test_named_rules_leave_other_points_alone(spark):
    """Literal names: what isn't named is only filtered, and neither joined nor written again."""
    ds = replay(spark, [("G", {"h": 1}, "x", [1, 2]), ("G", {"h": 1}, "y", [5, 6]), ("H", {"h": 1}, "x", [7, 8])])
    text = "define G x = G x + 1; constant G lim 3; define r v = G x + G lim; tag r as t = 1; match G as g { define ${g} x = 2 * g x; define out.${g[0]} w = g x; }"
    rules = Rules(ds)
    out = rules.apply(parse_rules(text))
    got = {(r.group_key, r.metric_key, r.ts.minute): (r.i, len(r.tags)) for r in out.dataset.points.collect()}
    assert got == {(g, m, i): (v[i], tags) for g, m, v, tags in [("G", "x", [4, 6], 1), ("G", "y", [5, 6], 1), ("H", "x", [7, 8], 1), ("G", "lim", [3, 3], 1), ("r", "v", [5, 6], 2), ("out.G", "w", [4, 6], 1)] for i in range(2)}
    plan = rules.base._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "Join" not in plan and "LogicalRDD" in plan and "Aggregate" not in plan
    assert len(rules.layers) == 6

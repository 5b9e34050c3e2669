"""``expr = expected`` must hold on every scrape, and results have the kinds expected."""

import math
import random

import numpy as np
import pytest
from conftest import EMPTY, instant, replay
from pyspark.sql import functions as F

from tidegauge.operators import lookback
from tidegauge.plans.evaluate import evaluate, evaluate_frames

N = None


def values(spark, expr, n=None, seconds=60, **metrics):
    """Values by scrape and tags; a scalar is under no tags."""
    ds = replay(spark, [("TEST", {}, k, v) if not isinstance(v, list) or not v or not isinstance(v[0], tuple) else ("TEST", dict(v[0]), k, v[1:]) for k, v in metrics.items()], n, seconds)
    return of(evaluate(ds, {"x": expr}))


def of(rows):
    got = {}
    for r in rows.orderBy("ts", "tags_key").collect():
        x = {"bool": r.b, "int": r.i, "dbl": r.d, "string": r.s, "hist": r.h and [tuple(b) for b in r.h], "empty": EMPTY}[r.kind]
        got.setdefault(r.ts, []).append(x)
    return [got[t][0] if len(got[t]) == 1 else got[t] for t in sorted(got)]


@pytest.mark.parametrize(
    ("expr", "metrics", "expected"),
    [
        ("TEST a + TEST b", dict(a=[0, 2, -1, 1], b=[1, 3, -2, -2]), [1, 5, -3, -1]),
        ("TEST a * TEST b + TEST c * TEST d", dict(a=[4], b=[4], c=[5], d=[5]), [41]),
        ("TEST a = TEST b", dict(a=[True, True, False, False], b=[True, False, True, False]), [True, False, False, True]),
        ("TEST a / TEST b", dict(a=[7, -7, 7, 1], b=[2, 2, 0, -1]), [3, -3, EMPTY, -1]),
        ("TEST a % TEST b", dict(a=[7, -7, 7, 5.5, 1.5], b=[4, 4, 0, 2, 1.0]), [3, -3, EMPTY, -0.5, -0.5]),
        ("TEST a / TEST b", dict(a=[1.0, -1.0, 1.0], b=[0.0, 0.0, -0.0]), [math.inf, -math.inf, -math.inf]),
        ("TEST a + 1", dict(a=[2**63 - 1, True, "x", 1.5]), [-(2**63), 2, EMPTY, 2.5]),
        ("TEST a * 3", dict(a=[2**62]), [-(2**62)]),
        ("-TEST a", dict(a=[1, 2.5, True, "x"]), [-1, -2.5, -1, EMPTY]),
        ("TEST a << 65", dict(a=[3]), [6]),
        ("TEST a >> 1", dict(a=[-3, 3.0]), [-2, 1.5]),
        ("TEST a < TEST b", dict(a=[1, 2, 1.5, "x"], b=[2, 1, 2, "y"]), [True, False, True, EMPTY]),
        ("TEST a = TEST b", dict(a=[1, "x", 1, math.nan], b=[1.0, "x", "1", math.nan]), [True, True, EMPTY, False]),
        ("TEST a != TEST b", dict(a=[1, "x", 1], b=[2.0, "y", "1"]), [True, True, EMPTY]),
        ("TEST a && TEST b", dict(a=[True, False, EMPTY, 2], b=[1, EMPTY, True, 0]), [True, EMPTY, EMPTY, False]),
        ("!TEST a", dict(a=[True, 0, "x", -0.0, math.nan]), [False, True, EMPTY, False, False]),
        ("TEST a =~ //^[a-z]+_[^_]+$//", dict(a=["foobar", "foobar_bla", "foo_foo_bar", "88_88"]), [False, True, False, False]),
        ("TEST a !~ //^[a-z]+_[^_]+$//", dict(a=["foobar", "foobar_bla", "foo_foo_bar", 5]), [True, False, True, EMPTY]),
        ("sum(* a, TEST b + 6, -13)", dict(a=[0, 1, 2, N, 3, 5], b=[1] * 6), [-6, -5, -4, -6, -3, -1]),
        ("sum(* a, TEST b)", dict(a=[N, 1], b=[N, "x"]), [0, EMPTY]),
        ("sum(TEST *)", dict(a=[2**63 - 1], b=[1]), [-(2**63)]),
        ("percentile_agg(50, TEST *)", dict(a=[4, 7, -2, 0], b=[1, 9, -1, N], c=[1, 11, -3, N]), [1.0, 9.0, -2.0, 0.0]),
        ("percentile_agg(50, TEST *)", dict(a=[4, 7, -2, 0], b=[1, 9, -1, 1], c=[1, 11, -3, 2], d=[1, 13, -3, N]), [1.0, 10.0, -2.5, 1.0]),
        ("percentile_agg(99, TEST *)", {f"m{i}": [i] for i in range(11)}, [9.9]),
        ("max(TEST *)", dict(a=[4, 7, -2, 0], b=[1, 9, -1, N], c=[1, 11, -3, N]), [4, 11, -1, 0]),
        ("min(TEST *)", dict(a=[4, 7, -2, 0], b=[1, 9.5, -1, N], c=[1, 11, -3.5, N]), [1, 7, -3.5, 0]),
        ("avg(TEST *)", dict(a=[4, 7, -2, 0], b=[1, 9, -1, N], c=[1, 11, -3, "x"]), [2.0, 9.0, -2.0, 0.0]),
        ("min(TEST q)", dict(a=[1, 2]), [EMPTY, EMPTY]),
        ("count(TEST a, TEST b, TEST c)", dict(a=[0, 0, 12, 1, N, N], b=[0, 1, 13, 1, 0, N], c=[0, 2, 17, EMPTY, 0, N]), [3, 3, 3, 2, 2, 0]),
        ("count[3m](TEST a)", dict(a=[0, 0, 12, 1, 4, N, N, 6]), [1, 2, 3, 4, 4, 3, 2, 2]),
        ("count[3m 15s](TEST a)", dict(a=[0, 0, 12, 1, 4, N, N, 6]), [1, 2, 3, 4, 4, 3, 2, 2]),
        ("percentile_agg[1m](50, TEST a)", dict(a=[1, 3, 7]), [1.0, 2.0, 5.0]),
        ('regexp(TEST a, "(o+)", "$1")', dict(a=["foo", "oooooooo!", "abracadabra", "lao", "oo o", "o oo", N]), ["oo", "oooooooo", EMPTY, "o", "oo", "o"]),
        ('regexp(TEST a, "(?<x>[a-z])([0-9])", "${2}-${x}-$$")', dict(a=["a1"]), None),
        ('str(TEST a, "-", TEST b)', dict(a=[1, 2, 3, N, 5], b=["a", "b", "c", "d", N]), ["1-a", "2-b", "3-c"]),
        ('str(TEST a, "")', dict(a=[1.5, True, EMPTY, 1e7]), ["1.5", "true", EMPTY, "1.0E7"]),
        ("rate[2m](TEST a) * 60", dict(a=[0, 1, 2, N, 4, 5, 6]), [1.0, 1.0, 1.0, 1.0]),
        ("rate[1m 30s](TEST a) * 60", dict(a=[0, 1, 2, N, 4, 5, 6]), [1.0, 1.0, 1.0, 1.0]),
        ("rate(TEST a) * 60", dict(a=[0, 1, 2, N, 3, 5]), [1.0, 1.0, 2.0]),
        ("rate(TEST a)", dict(a=["x", "y", 3]), [EMPTY, EMPTY]),
        ("rate(rate(TEST a)) * 3600", dict(a=[0, 1, 3, 6]), [1.0, 1.0]),
        ("name(a.b)", dict(a=[1]), ["a.b"]),
        ("name('1e2')", dict(a=[1]), [100.0]),
        ("TEST a + [0..10=20, 0..10=4, 0.0..10=1]", dict(a=[[(0.0, 2.0, 10.0)]]), [[(0.0, 2.0, 15.0), (2.0, 10.0, 20.0)]]),
        ("TEST a + TEST b", dict(a=[[(0.0, 10.0, 10.0)]], b=[[(0.0, 1.0, 10.0)]]), [[(0.0, 1.0, 11.0), (1.0, 10.0, 9.0)]]),
        ("TEST a - TEST b", dict(a=[[(0.0, 1.0, 10.0)], [(0.0, 1.0, 1.0)]], b=[[(0.0, 1.0, 1.0)], [(5.0, 6.0, 1.0)]]), [[(0.0, 1.0, 9.0)], EMPTY]),
        ("TEST a / 2", dict(a=[[(0.0, 2.0, 10.0)]]), [[(0.0, 2.0, 5.0)]]),
        ("2 * TEST a", dict(a=[[(0.0, 10.0, 10.0)]]), [[(0.0, 10.0, 20.0)]]),
        ("sum(TEST a)", dict(a=[[(0.0, 10.0, 4.0)]]), [20.0]),
        ("percentile_agg(50, TEST a, 3)", dict(a=[[(0.0, 10.0, 4.0)]]), [3.0]),
        ("rate(TEST a)", dict(a=[[(0.0, 1.0, 60.0)], [(0.0, 1.0, 180.0)]]), [[(0.0, 1.0, 2.0)]]),
        ("TEST a = TEST b", dict(a=[[(0.0, 1.0, 2.0)], EMPTY], b=[[(0.0, 1.0, 2.0)], [(0.0, 1.0, 2.0)]]), [True, EMPTY]),
    ],
)
def test_golden(spark, expr, metrics, expected):
    if expected is None:
        with pytest.raises(ValueError):
            values(spark, expr, **metrics)
        return
    got = values(spark, expr, max(map(len, metrics.values())), **metrics)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        if isinstance(b, float) and not isinstance(a, list):
            assert isinstance(a, float) and (a == pytest.approx(b))
        else:
            assert a == b and type(a) is type(b)


def test_by_drops_ambiguous_and_keeps_common(spark):
    ds = replay(spark, [("A", {"h": "x", "i": 1}, "m", [1]), ("A", {"h": "y", "i": 1}, "m", [2]), ("A", {"h": "y", "i": 2}, "m", [3]), ("B", {"h": "x", "i": 1}, "m", [10]), ("B", {"h": "y"}, "m", [20])])
    assert of(evaluate(ds, {"x": "A m + by (h) B m"})) == [11]
    r = evaluate(ds, {"x": "A m + by (h) keep_common B m"}).collect()
    assert [(x.i, x.tags) for x in r] == [(11, {"h": "s:x", "i": "i:1"})]
    assert of(evaluate(ds, {"x": "A m + B m"})) == [11]


def test_aggregation_clauses(spark):
    ds = replay(spark, [("G", {"host": "a", "x": 1, "id": 1}, "m", [1, 2]), ("G", {"host": "b", "x": 1, "id": 2}, "m", [10]), ("G", {"host": "b", "x": 1, "id": 3}, "m", [20]), ("G", {"x": 1}, "m", [100])])
    got = {tuple(sorted(r.tags.items())): r.i for r in evaluate(ds, {"x": "sum(G m) by (host)"}).filter("ts = timestamp'2024-01-01'").collect()}
    assert got == {(("host", "s:a"),): 1, (("host", "s:b"),): 30}
    got = {tuple(sorted(r.tags.items())): r.i for r in evaluate(ds, {"x": "sum(G m, 5) by (host) keep_common"}).filter("ts = timestamp'2024-01-01'").collect()}
    assert got == {(("host", "s:a"), ("id", "i:1"), ("x", "i:1")): 6, (("host", "s:b"), ("x", "i:1")): 35}
    got = {tuple(sorted(r.tags.items())): r.i for r in evaluate(ds, {"x": "sum(G m) without (id)"}).collect() if r.ts.minute == 0}
    assert got == {(("host", "s:a"), ("x", "i:1")): 1, (("host", "s:b"), ("x", "i:1")): 30}
    assert [r.tags for r in evaluate(ds, {"x": "count(G m) keep_common"}).collect()][0] == {"x": "i:1"}


def test_windows_by_brute_force(spark):
    """Percentiles and common tags over a window: as of all its values, though no row is copied to the instants that see it."""
    rng, n = random.Random(5), 40
    series = [({"host": h, "x": 1, "id": i}, [rng.choice([N, 1, 2, 2, 3.5, 8, "text"]) if rng.random() < 0.6 else N for _ in range(n)]) for i, h in enumerate("aabbbc")]
    ds = replay(spark, [("G", t, "m", v) for t, v in series], n)
    seen = lambda h, i: [(t, v[j]) for t, v in series if h in (N, t["host"]) for j in range(max(0, i - 7), i + 1) if v[j] is not N]
    tags_of = lambda rows: {k: f"{'s' if k == 'host' else 'i'}:{v}" for k, v in rows[0][0].items() if all(t.get(k) == v for t, _ in rows)}
    numbers = lambda rows: [x for _, x in rows if x != "text"]
    middle = lambda rows: float(np.percentile(numbers(rows), 50)) if numbers(rows) else N
    asked = {"p": "percentile_agg[7m](50, G m) by (host)", "k": "percentile_agg[7m](50, G m) by (host) keep_common", "c": "count[7m](G m) by (host) keep_common", "all": "percentile_agg[7m](50, G m)", "kc": "count[7m](G m) keep_common"}
    expected = {k: set() for k in asked}
    for i in range(n):
        for h in "abc":
            rows = seen(h, i)
            if rows:
                expected["p"].add((i, (("host", f"s:{h}"),), middle(rows)))
                expected["k"].add((i, tuple(sorted(tags_of(rows).items())), middle(rows)))
                expected["c"].add((i, tuple(sorted(tags_of(rows).items())), len(rows)))
        rows = seen(N, i)
        expected["all"].add((i, (), middle(rows)))
        if rows:
            expected["kc"].add((i, tuple(sorted(tags_of(rows).items())), len(rows)))
    for k, expr in asked.items():
        got = {(r.ts.minute, tuple(sorted((r.tags or {}).items())), r.i if k in ("c", "kc") else r.d) for r in evaluate(ds, {"x": expr}).collect()}
        assert got == expected[k], k


def test_group_interpolation(spark):
    ds = replay(spark, [("A", {}, "i", [4, N, N, N, 8]), ("A", {}, "b", [False, N, N, N, True]), ("A", {}, "s", ["foo", N, N, N, "bar"]), ("A", {}, "mixed", [1, N, N, N, "x"]), ("B", {}, "q", [1] * 5)], seconds=15)
    points = {(r.ts.minute * 60 + r.ts.second, r.metric_key): r for r in lookback.interpolated(ds, 60_000).points.filter("group_key = 'A'").collect()}
    assert points[15, "i"].d == 5.0 and points[15, "b"].d == 0.25 and points[15, "s"].s == "foo" and points[15, "mixed"].kind == "empty"
    assert points[0, "i"].i == 4 and points[60, "i"].i == 8
    near = lookback.interpolated(ds, 20_000).points.filter("group_key = 'A'")
    assert near.count() == ds.points.filter("group_key = 'A'").count()


def test_stepping_is_greedy(spark):
    ds = replay(spark, [("A", {}, "x", list(range(13)))])
    got = evaluate_frames(ds, {"x": "A x"}, step_ms=300_000)["x"].df.orderBy("ts").collect()
    assert [r.i for r in got] == [0, 5, 10]
    assert lookback.stepped(ds.scrapes.filter(F.minute("ts") != 5), 300_000).count() == 3


def test_range_keeps_its_lookback(spark):
    from conftest import instant

    ds = replay(spark, [("A", {}, "x", [1] * 10)])
    got = evaluate(ds, {"x": "sum[3m](A x)"}, instant(2), instant(6)).orderBy("ts").collect()
    assert [r.i for r in got] == [3, 4, 4, 4, 4]
    got = evaluate(ds, {"x": "rate(A x)"}, instant(2), instant(3)).collect()
    assert len(got) == 2


def test_gaps_make_no_more_rows_than_there_are(spark):
    """A long series with few gaps: rows between scan and result stay near the input."""
    n = 600
    ds = replay(spark, [("A", {}, "x", [None if i % 200 == 7 else i for i in range(n)]), ("B", {}, "x", list(range(n)))])
    got = lookback.gaps(ds, ds.scrapes.select(F.col("ts").alias("target")))
    assert sorted((r.target, r.group_key) for r in got.collect()) == [(instant(i), "A") for i in (7, 207, 407)]
    plan = got._jdf.queryExecution().executedPlan()
    most, todo = 0, [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        node = node.plan() if "QueryStage" in node.nodeName() else node
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    assert 0 < most <= 3 * 2 * n

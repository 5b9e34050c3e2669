"""Queries over the driver's tables, one for each operator, with the SQL that DuckDB answers them by.

All run over whole tables. Instants are shown as epoch milliseconds, numbers
rounded to six places, empty values as null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Dataset, tag_value
from .operators import lookback
from .operators.rules import Outcome, apply_rules
from .functions import histogram
from .plans.evaluate import evaluate_frames, validate
from .plans.frame import Frame
from .plans.nodes import Collect
from .plans.parser import parse_rules
from .sinks import lines
from .sources import collectd, influx_json, json_flat, monitor, probe, resolver, tables
from .sources.history import History, convert, first_wins, last_wins
from .storage import scratch
from .streaming import engine

Load = Callable[[SparkSession, str], Dataset]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- the derived datasets in SQL ---------------------------------------------

HOURLY = """
h AS (SELECT date_trunc('hour', ts) AS t, event_type AS type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL),
e AS (SELECT epoch_ms(t) AS ts_ms, type, n, total, (sum(n) OVER (PARTITION BY type ORDER BY t))::BIGINT AS cum FROM h),
sp AS (SELECT DISTINCT ts_ms FROM e),
sq AS (SELECT ts_ms, lag(ts_ms) OVER (ORDER BY ts_ms) AS prev FROM sp)"""
USERS = """
l AS (SELECT date_trunc('hour', ts) AS t, event_type AS type, user_id AS usr, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY ALL),
u AS (SELECT epoch_ms(t) AS ts_ms, type, usr, value, (props->>'$.k')::BIGINT AS k FROM l)"""
SALES = """
s AS (SELECT epoch_ms(date_trunc('day', l_shipdate)) AS ts_ms, l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, count(*)::BIGINT AS lines FROM lineitem GROUP BY ALL),
sp AS (SELECT DISTINCT ts_ms FROM s)"""
SEGMENTS = """
c AS (SELECT 0::BIGINT AS ts_ms, lower(c_mktsegment) AS segment, c_nationkey::BIGINT AS nation, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS bal, min(c_name) AS first FROM customer GROUP BY ALL)"""
DOCS = """
d AS (SELECT 0::BIGINT AS ts_ms, doc_id AS id, lang, source, n_chars FROM documents)"""
_SQL = {tables.hourly_events: HOURLY, tables.user_events: USERS, tables.daily_sales: SALES, tables.order_groups: SEGMENTS, tables.documents: DOCS}


def ts_ms() -> Column:
    return F.unix_millis("ts").alias("ts_ms")


def shown(x: Frame, form: str, tags: Sequence[str] = ()) -> DataFrame:
    """ts_ms, the tags named, and v: as a number (num, with its kind), a truth value (bool) or text."""
    v = x.value
    cols = [ts_ms()]
    for t in tags:
        held = tag_value(F.try_element_at("tags", F.lit(t)))
        cols.append((held.get("int") if t in ("usr", "user", "id", "nation") else held.text()).alias("usr" if t == "user" else t))
    if form == "num":
        cols += [v.kind.alias("kind"), F.round(v.number(), 6).alias("v")]
    elif form == "bool":
        cols.append(v.truth().alias("v"))
    else:
        cols.append(v.text().alias("v"))
    return x.df.select(*cols)


def expression(name: str, load: Load, expr: str, form: str, tags: Sequence[str], sql: str, **how) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(evaluate_frames(load(spark, sf_dir), {"x": expr}, **how)["x"], form, tags)

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH RECURSIVE {_SQL[load].strip()} {sql}"


def rules(name: str, load: Load, text: str, show: Callable[[Outcome], DataFrame], sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return show(apply_rules(load(spark, sf_dir), parse_rules(text)))

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = f"WITH RECURSIVE {_SQL[load].strip()} {sql}"


# --- selectors ------------------------------------------------------------------

H, U, S, C, D = tables.hourly_events, tables.user_events, tables.daily_sales, tables.order_groups, tables.documents
TYPE = ("type",)


def hourly(name: str, expr: str, kind: str, v: str, where: str = "type = 'click'") -> None:
    """An expression over one series of the hourly events."""
    expression(name, H, expr, "num", TYPE, f"SELECT ts_ms, type, {kind if ' ' in kind else repr(kind)} AS kind, round(({v})::DOUBLE, 6) AS v FROM e WHERE {where}")


def truth(name: str, expr: str, v: str) -> None:
    expression(name, H, expr, "bool", TYPE, f"SELECT ts_ms, type, {v} AS v FROM e WHERE type = 'click'")


hourly("select_exact", "evh.click total", "dbl", "total")
hourly("select_star", "sum(evh.* n) by (type)", "int", "n", "true")
hourly("select_doublestar", "sum(** total) by (type)", "dbl", "total", "true")
hourly("select_doublestar_inner", "sum(**.view n) by (type)", "int", "n", "type = 'view'")
hourly("select_regex", "sum(evh.//^(click|view)$// n) by (type)", "int", "n", "type IN ('click', 'view')")
expression("select_metric_star", H, "count(evh.click *)", "num", (), "SELECT sp.ts_ms, 'int' AS kind, (count(e.ts_ms) * 3)::DOUBLE AS v FROM sp LEFT JOIN e ON e.ts_ms = sp.ts_ms AND type = 'click' GROUP BY ALL")
expression("select_absent", H, "evh.nothing n", "num", (), "SELECT ts_ms, 'int' AS kind, 0.0::DOUBLE AS v FROM e WHERE false")
expression("select_tagged", U, "ev.purchase value", "num", ("user",), "SELECT ts_ms, usr, 'dbl' AS kind, round(value, 6) AS v FROM u WHERE type = 'purchase'")
expression("select_quoted", C, "customer.building.'7' first", "text", ("segment", "nation"), "SELECT ts_ms, segment, nation, first AS v FROM c WHERE segment = 'building' AND nation = 7")

# --- arithmetic ---------------------------------------------------------------

hourly("arith_add", "evh.click total + evh.click n", "dbl", "total + n")
hourly("arith_sub_int", "evh.click n - evh.click cum", "int", "n - cum")
hourly("arith_mul", "evh.click total * evh.click n * 0.5", "dbl", "total * n * 0.5")
hourly("arith_div_int", "evh.click cum / evh.click n", "int", "cum // n")
hourly("arith_div_zero", "evh.click cum / (evh.click n - 1)", "CASE WHEN n = 1 THEN 'empty' ELSE 'int' END", "CASE WHEN n <> 1 THEN cum // (n - 1) END")
hourly("arith_div_dbl", "evh.click n / (evh.click total / (evh.click n - 1))", "dbl", "CASE WHEN n = 1 THEN 0.0 ELSE n / (total / (n - 1)) END", "type = 'click' AND total > 0")
hourly("arith_mod_int", "-evh.click cum % 7", "int", "-(cum % 7)")
hourly("arith_mod_ieee", "evh.click total % 10.0", "dbl", "total - 10.0 * round_even(total / 10.0, 0)")
hourly("arith_wrap", "(evh.click n + 9223372036854775800) >> 1", "int", "((CASE WHEN n > 7 THEN n::HUGEINT + 9223372036854775800 - 18446744073709551616 ELSE n::HUGEINT + 9223372036854775800 END)::BIGINT) >> 1")
hourly("arith_empty_string", 'evh.click n + "x"', "empty", "NULL::DOUBLE")
hourly("shift_left", "evh.click n << 3", "int", "n * 8")
hourly("shift_right", "evh.click cum >> 2", "int", "cum // 4")
hourly("shift_dbl", "evh.click total << 2", "dbl", "total * 4")
hourly("neg", "-evh.click total", "dbl", "-total")
hourly("precedence", "evh.click n + evh.click n * 2 << 1", "int", "(n + n * 2) * 2")

# --- predicates ---------------------------------------------------------------

for _name, _op, _sql in (("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">="), ("eq", "=", "="), ("ne", "!=", "<>")):
    truth(f"cmp_{_name}", f"evh.click n {_op} 3", f"n {_sql} 3")
truth("cmp_mixed", "evh.click total >= evh.click n * 20", "total >= n * 20")
truth("logic_and", "evh.click n > 2 && evh.click total > 50.0", "n > 2 AND total > 50")
truth("logic_or", "evh.click n > 2 || evh.click total > 50.0", "n > 2 OR total > 50")
truth("logic_not", "!(evh.click n > 2)", "NOT n > 2")
truth("logic_empty", "evh.click n / (evh.click n - 1) > 100 && false", "CASE WHEN n <> 1 THEN false END")
truth("logic_left", "evh.click n = 1 || evh.click n = 2 && evh.click total > 50.0", "(n = 1 OR n = 2) AND total > 50")
expression("regex_match", D, "docs source =~ //^src1//", "bool", ("id",), "SELECT ts_ms, id, regexp_matches(source, '^src1') AS v FROM d WHERE source IS NOT NULL")
expression("regex_mismatch", D, 'docs lang !~ "^(en|de)$"', "bool", ("id",), "SELECT ts_ms, id, NOT regexp_matches(lang, '^(en|de)$') AS v FROM d WHERE lang IS NOT NULL")
expression("eq_text", D, 'docs lang = "fr"', "bool", ("id",), "SELECT ts_ms, id, lang = 'fr' AS v FROM d WHERE lang IS NOT NULL")
expression("eq_incomparable", D, "docs lang = docs n_chars", "bool", ("id",), "SELECT ts_ms, id, NULL::BOOLEAN AS v FROM d WHERE lang IS NOT NULL AND n_chars IS NOT NULL")

# --- joins --------------------------------------------------------------------

hourly("join_default", "sum(evh.* total) by (type) / sum(evh.* n) by (type)", "dbl", "total / n", "true")
expression("join_default_series", U, "ev.click value - ev.view value", "num", ("user",), "SELECT a.ts_ms, a.usr, 'dbl' AS kind, round(a.value - b.value, 6) AS v FROM u a JOIN u b ON a.ts_ms = b.ts_ms AND a.usr = b.usr WHERE a.type = 'click' AND b.type = 'view'")
expression("join_scalar_vector", H, "sum(evh.* total) by (type) / sum(evh.* total)", "num", TYPE, "SELECT ts_ms, type, 'dbl' AS kind, round(total / sum(total) OVER (PARTITION BY ts_ms), 6) AS v FROM e")
expression("join_scalar_scalar", H, "sum(evh.* n) * 2 + count(evh.* n)", "num", (), "SELECT ts_ms, 'int' AS kind, (sum(n) * 2 + count(*))::DOUBLE AS v FROM e GROUP BY ALL")
expression("join_by", S, "sales qty / by (flag) sum(sales price) by (flag)", "num", ("flag", "status"), "SELECT a.ts_ms, a.flag, NULL::VARCHAR AS status, 'dbl' AS kind, round(a.qty / b.price, 6) AS v FROM (SELECT ts_ms, flag, max(qty) AS qty FROM s GROUP BY ALL HAVING count(*) = 1) a JOIN (SELECT ts_ms, flag, sum(price) AS price FROM s GROUP BY ALL) b ON a.ts_ms = b.ts_ms AND a.flag = b.flag")
expression("join_by_keep_common", S, "sales qty - by (status) keep_common sales lines", "num", ("flag", "status"), "SELECT ts_ms, max(flag) AS flag, status, 'dbl' AS kind, round(max(qty) - max(lines), 6) AS v FROM s GROUP BY ts_ms, status HAVING count(*) = 1")
expression("join_by_nothing", H, "evh.click n + by (none) evh.view n", "num", TYPE, "SELECT a.ts_ms, NULL::VARCHAR AS type, 'int' AS kind, (a.n + b.n)::DOUBLE AS v FROM e a JOIN e b ON a.ts_ms = b.ts_ms WHERE a.type = 'click' AND b.type = 'view'")

# --- aggregates -----------------------------------------------------------------

_AGG = {
    "sum": ("sum(sales qty{})", "round(sum(qty), 6)", "dbl"),
    "avg": ("avg(sales qty{})", "round(avg(qty), 6)", "dbl"),
    "min": ("min(sales lines{})", "min(lines)::DOUBLE", "int"),
    "max": ("max(sales price{})", "round(max(price), 6)", "dbl"),
    "count": ("count(sales qty{})", "count(*)::DOUBLE", "int"),
    "pct50": ("percentile_agg(50, sales qty{})", "round(quantile_cont(qty, 0.5), 6)", "dbl"),
    "pct99": ("percentile_agg(99, sales qty{})", "round(quantile_cont(qty, 0.99), 6)", "dbl"),
}
for _fn, (_expr, _v, _kind) in _AGG.items():
    _expr = _expr.replace("{}", "")
    _tags = ("flag", "status")
    expression(f"agg_{_fn}_none", S, _expr, "num", (), f"SELECT ts_ms, '{_kind}' AS kind, {_v} AS v FROM s GROUP BY ALL")
    expression(f"agg_{_fn}_by", S, f"{_expr} by (flag)", "num", _tags, f"SELECT ts_ms, flag, NULL::VARCHAR AS status, '{_kind}' AS kind, {_v} AS v FROM s GROUP BY ts_ms, flag")
    expression(f"agg_{_fn}_without", S, f"{_expr} without (flag)", "num", _tags, f"SELECT ts_ms, NULL::VARCHAR AS flag, status, '{_kind}' AS kind, {_v} AS v FROM s GROUP BY ts_ms, status")
    expression(f"agg_{_fn}_keep_common", S, f"{_expr} keep_common", "num", _tags, f"SELECT ts_ms, CASE WHEN min(flag) = max(flag) THEN min(flag) END AS flag, CASE WHEN min(status) = max(status) THEN min(status) END AS status, '{_kind}' AS kind, {_v} AS v FROM s GROUP BY ts_ms")
expression("agg_by_keep_common", S, "sum(sales qty) by (status) keep_common", "num", ("flag", "status"), "SELECT ts_ms, CASE WHEN min(flag) = max(flag) THEN min(flag) END AS flag, status, 'dbl' AS kind, round(sum(qty), 6) AS v FROM s GROUP BY ts_ms, status")
expression("agg_missing_tag", S, "sum(sales qty) by (nowhere)", "num", (), "SELECT ts_ms, 'dbl' AS kind, qty AS v FROM s WHERE false")
expression("agg_mixed_args", H, "sum(evh.* n, evh.click total, 5)", "num", (), "SELECT ts_ms, CASE WHEN count(*) FILTER (type = 'click') > 0 THEN 'dbl' ELSE 'int' END AS kind, round(sum(n) + coalesce(sum(total) FILTER (type = 'click'), 0) + 5, 6)::DOUBLE AS v FROM e GROUP BY ts_ms")
expression("agg_scalar_into_groups", H, "max(evh.* n, 3) by (type)", "num", TYPE, "SELECT ts_ms, type, 'int' AS kind, greatest(n, 3)::DOUBLE AS v FROM e")
expression("agg_fallback_sum", H, "sum(evh.nothing n)", "num", (), "SELECT ts_ms, 'int' AS kind, 0.0::DOUBLE AS v FROM sp")
expression("agg_fallback_min", H, "min(evh.nothing n)", "num", (), "SELECT ts_ms, 'empty' AS kind, NULL::DOUBLE AS v FROM sp")
expression("agg_text_poisons_sum", D, "sum(docs *)", "num", (), "SELECT 0::BIGINT AS ts_ms, 'empty' AS kind, NULL::DOUBLE AS v")
expression("agg_text_counts", D, "count(docs *)", "num", (), "SELECT ts_ms, 'int' AS kind, (count(lang) + count(source) + count(n_chars))::DOUBLE AS v FROM d GROUP BY ts_ms")
expression("agg_text_ignored_max", D, "max(docs *)", "num", (), "SELECT ts_ms, 'int' AS kind, max(n_chars)::DOUBLE AS v FROM d GROUP BY ts_ms")
expression("agg_users", U, "avg(ev.* value) by (user)", "num", ("user",), "SELECT ts_ms, usr, 'dbl' AS kind, round(avg(value), 6) AS v FROM u GROUP BY ALL")
expression("agg_segments", C, "sum(customer.*.* bal) by (segment)", "num", ("segment",), "SELECT ts_ms, segment, 'dbl' AS kind, round(sum(bal), 6) AS v FROM c GROUP BY ts_ms, segment")

# --- look-back --------------------------------------------------------------------

_DAY = 24 * 3_600_000
_ROLL = {"sum": ("n", "sum(e.n)::DOUBLE", "int"), "avg": ("total", "round(avg(e.total), 6)", "dbl"), "min": ("n", "min(e.n)::DOUBLE", "int"), "max": ("total", "round(max(e.total), 6)", "dbl"), "count": ("n", "count(*)::DOUBLE", "int"), "pct": ("total", "round(quantile_cont(e.total, 0.5), 6)", "dbl")}
for _fn, (_m, _v, _kind) in _ROLL.items():
    _call = f"percentile_agg[24h](50, evh.* {_m})" if _fn == "pct" else f"{_fn}[24h](evh.* {_m})"
    _from = f"FROM sp JOIN e ON e.ts_ms BETWEEN sp.ts_ms - {_DAY} AND sp.ts_ms GROUP BY"
    expression(f"roll_{_fn}_24h", H, f"{_call} by (type)", "num", TYPE, f"SELECT sp.ts_ms, e.type, '{_kind}' AS kind, {_v} AS v {_from} sp.ts_ms, e.type")
    expression(f"roll_{_fn}_24h_none", H, _call, "num", (), f"SELECT sp.ts_ms, '{_kind}' AS kind, {_v} AS v {_from} sp.ts_ms")
expression("roll_sum_sparse", U, "sum[6h](ev.purchase k) by (user)", "num", ("user",), "SELECT p.ts_ms, u.usr, 'int' AS kind, sum(u.k)::DOUBLE AS v FROM (SELECT DISTINCT ts_ms FROM u) p JOIN u ON u.ts_ms BETWEEN p.ts_ms - 21600000 AND p.ts_ms WHERE u.type = 'purchase' GROUP BY ALL")
expression("rate_default", H, "rate(evh.click cum)", "num", TYPE, "SELECT a.ts_ms, a.type, 'dbl' AS kind, round((a.cum - b.cum) / ((a.ts_ms - b.ts_ms) / 1000.0), 6) AS v FROM e a JOIN sq USING (ts_ms) JOIN e b ON b.ts_ms = sq.prev AND b.type = a.type WHERE a.type = 'click'")
expression("rate_of_sum", H, "rate(sum(evh.* total))", "num", (), "SELECT ts_ms, CASE WHEN prev IS NULL THEN 'empty' ELSE 'dbl' END AS kind, round((x - y) / ((ts_ms - prev) / 1000.0), 6) AS v FROM (SELECT sq.ts_ms, sq.prev, (SELECT sum(total) FROM e WHERE e.ts_ms = sq.ts_ms) AS x, (SELECT sum(total) FROM e WHERE e.ts_ms = sq.prev) AS y FROM sq)")
_AT = "(SELECT e.ts_ms, e.type, e.cum::DOUBLE AS cum, lead(e.ts_ms) OVER (PARTITION BY type ORDER BY ts_ms) AS nts, lead(e.cum) OVER (PARTITION BY type ORDER BY ts_ms) AS ncum FROM e)"
expression("rate_2h", H, "rate[2h](evh.click cum)", "num", TYPE, f"SELECT a.ts_ms, a.type, 'dbl' AS kind, round((a.cum - CASE WHEN p.ts_ms = a.ts_ms - 7200000 THEN p.cum ELSE p.cum + (p.ncum - p.cum) * ((a.ts_ms - 7200000 - p.ts_ms)::DOUBLE / (p.nts - p.ts_ms)) END) / 7200.0, 6) AS v FROM e a ASOF JOIN {_AT} p ON a.type = p.type AND a.ts_ms - 7200000 >= p.ts_ms WHERE a.type = 'click'")
expression("step_5h", H, "sum(evh.* n)", "num", (), ", st AS (SELECT min(ts_ms) AS ts_ms FROM sp UNION ALL SELECT (SELECT min(sp.ts_ms) FROM sp WHERE sp.ts_ms >= st.ts_ms + 18000000) FROM st WHERE (SELECT max(ts_ms) FROM sp) >= st.ts_ms + 18000000) SELECT st.ts_ms, 'int' AS kind, sum(n)::DOUBLE AS v FROM st JOIN e USING (ts_ms) GROUP BY ALL", step_ms=5 * 3_600_000)


def _range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days in the middle; the look-back reads the day before them too."""
    from datetime import datetime

    f = evaluate_frames(H(spark, sf_dir), {"x": "sum[24h](evh.* n) by (type)"}, datetime(2024, 1, 10), datetime(2024, 1, 12))["x"]
    return shown(f, "num", TYPE)


QUERIES["range_scan"] = _range_query
ORACLE_SQL["range_scan"] = f"WITH {HOURLY.strip()} SELECT sp.ts_ms, e.type, 'int' AS kind, sum(e.n)::DOUBLE AS v FROM sp JOIN e ON e.ts_ms BETWEEN sp.ts_ms - {_DAY} AND sp.ts_ms WHERE sp.ts_ms BETWEEN epoch_ms(TIMESTAMP '2024-01-10') AND epoch_ms(TIMESTAMP '2024-01-12') GROUP BY ALL"


def _interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours without a click, filled in from up to six hours on either side."""
    ds = lookback.interpolated(H(spark, sf_dir), 6 * 3_600_000)
    p = ds.points.filter("group_key = 'evh.click' AND metric_key = 'cum'")
    return p.select(ts_ms(), "kind", F.round(F.coalesce("d", F.col("i").cast("double")), 6).alias("v"))


QUERIES["interp_gap"] = _interpolated
ORACLE_SQL["interp_gap"] = f"""WITH {HOURLY.strip()}, x AS (SELECT * FROM {_AT} WHERE type = 'click')
SELECT sp.ts_ms, CASE WHEN x.ts_ms = sp.ts_ms THEN 'int' ELSE 'dbl' END AS kind, round(CASE WHEN x.ts_ms = sp.ts_ms THEN x.cum ELSE x.cum * (1 - (sp.ts_ms - x.ts_ms)::DOUBLE / (x.nts - x.ts_ms)) + x.ncum * ((sp.ts_ms - x.ts_ms)::DOUBLE / (x.nts - x.ts_ms)) END, 6) AS v
FROM sp JOIN x ON x.ts_ms = sp.ts_ms OR (x.ts_ms < sp.ts_ms AND sp.ts_ms < x.nts AND sp.ts_ms - x.ts_ms <= 21600000 AND x.nts - sp.ts_ms <= 21600000)"""


def _moves(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(H(spark, sf_dir).scrapes).select(ts_ms(), *[F.unix_millis("past").alias("past_ms")])
    ORACLE_SQL[name] = f"WITH {HOURLY.strip()} {sql}"


_moves("previous_by_count", lambda s: lookback.previous(s, 3), "SELECT * FROM (SELECT ts_ms, lag(ts_ms, 3) OVER (ORDER BY ts_ms) AS past_ms FROM sp) WHERE past_ms IS NOT NULL")
_moves("previous_by_duration", lambda s: lookback.newest_before(s, 90 * 60_000), "SELECT a.ts_ms, b.ts_ms AS past_ms FROM sp a ASOF JOIN sp b ON a.ts_ms - 5400000 >= b.ts_ms")
QUERIES["collection_interval"] = lambda spark, sf_dir: lookback.collection_interval(H(spark, sf_dir).scrapes).select(ts_ms(), "interval_ms")
ORACLE_SQL["collection_interval"] = f"WITH {HOURLY.strip()} SELECT ts_ms, coalesce(ts_ms - prev, 0) AS interval_ms FROM sq"

# --- text functions ---------------------------------------------------------------

expression("fn_str", H, 'str(evh.click n, "-", evh.click cum)', "text", TYPE, "SELECT ts_ms, type, n || '-' || cum AS v FROM e WHERE type = 'click'")
expression("fn_regexp", D, r'regexp(docs source, //^src(\d+)$//, "n$1 of ${1}")', "text", ("id",), r"SELECT ts_ms, id, CASE WHEN regexp_matches(source, '^src(\d+)$') THEN 'n' || regexp_extract(source, '^src(\d+)$', 1) || ' of ' || regexp_extract(source, '^src(\d+)$', 1) END AS v FROM d WHERE source IS NOT NULL")
expression("fn_tag", C, "tag(customer.building.'3', nation) + 1", "num", ("nation",), "SELECT ts_ms, nation, 'int' AS kind, (nation + 1)::DOUBLE AS v FROM c WHERE segment = 'building' AND nation = 3")
expression("fn_tag_expr", U, "tag(ev.click value, user) * 2", "num", ("user",), "SELECT ts_ms, usr, 'int' AS kind, (usr * 2)::DOUBLE AS v FROM u WHERE type = 'click'")
expression("fn_name", H, "name(a.b.c)", "text", (), "SELECT ts_ms, 'a.b.c' AS v FROM sp")
expression("fn_name_number", H, "name('17') + 1", "num", (), "SELECT ts_ms, 'int' AS kind, 18.0::DOUBLE AS v FROM sp")

# --- histograms ------------------------------------------------------------------


def _hist(name: str, expr: str, result: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = evaluate_frames(H(spark, sf_dir), {"x": expr})["x"]
        return f.df.select(ts_ms(), F.array_join(F.transform("h", lambda r: F.concat_ws("|", r["floor"].cast("string"), r["ceil"].cast("string"), F.round(r["events"], 6).cast("string"))), ";").alias("v"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {HOURLY.strip()} SELECT ts_ms, '{result}' AS v FROM sp"


_hist("hist_add", "[0..10=10] + [0..1=10]", "0.0|1.0|11.0;1.0|10.0|9.0")
_hist("hist_sub", "[0..1=10] - [0..1=1]", "0.0|1.0|9.0")
_hist("hist_scale", "[0..10=10] * 2", "0.0|10.0|20.0")
_hist("hist_div", "[0..2=10] / 2", "0.0|2.0|5.0")
_hist("hist_shift", "[0..2=10] << 3", "0.0|2.0|80.0")
_hist("hist_normalise", "[0..2=10] + [0..10=20, 0..10=4, 0.0..10=1]", "0.0|2.0|15.0;2.0|10.0|20.0")
expression("hist_sum", H, "sum([0..10=4], evh.click n)", "num", (), "SELECT sp.ts_ms, 'dbl' AS kind, (20.0 + coalesce(max(n), 0))::DOUBLE AS v FROM sp LEFT JOIN e ON e.ts_ms = sp.ts_ms AND type = 'click' GROUP BY ALL")
expression("hist_count", H, "count([0..10=4, 20..30=1])", "num", (), "SELECT ts_ms, 'dbl' AS kind, 5.0::DOUBLE AS v FROM sp")

# --- rules --------------------------------------------------------------------------


def _tagged_points(group: str, metric: str, *tags: str) -> Callable[[Outcome], DataFrame]:
    def show(o: Outcome) -> DataFrame:
        p = o.dataset.points.filter((F.col("group_key") == group) & (F.col("metric_key") == metric))
        cols = [tag_value(F.try_element_at("tags", F.lit(t))).text().alias(t) for t in tags]
        return p.select(ts_ms(), *cols, "kind", F.round(F.coalesce("d", F.col("i").cast("double"), F.col("b").cast("double")), 6).alias("v"))

    return show


def _counted(o: Outcome) -> DataFrame:
    return o.dataset.points.groupBy("group_key", "metric_key").agg(F.count(F.lit(1)).alias("points"))


rules("rule_constant", H, "constant evh.click { answer 42; n 7; } constant evh.nobody x 1;", _counted, "SELECT 'evh.' || type AS group_key, m AS metric_key, count(*) AS points FROM e, (SELECT unnest(['n', 'total', 'cum']) AS m) GROUP BY ALL UNION ALL SELECT 'evh.click', 'answer', count(*) FROM e WHERE type = 'click'")
rules("rule_constant_value", H, "constant evh.click n 7;", _tagged_points("evh.click", "n", "type"), "SELECT ts_ms, type, 'int' AS kind, 7.0::DOUBLE AS v FROM e WHERE type = 'click'")
rules("rule_alias", H, "alias evh.click as c; define out x = c n + c cum;", _tagged_points("out", "x", "type"), "SELECT ts_ms, type, 'int' AS kind, (n + cum)::DOUBLE AS v FROM e WHERE type = 'click'")
rules("rule_define", H, "define ratio mean = sum(evh.* total) by (type) / sum(evh.* n) by (type); define ratio double = ratio mean * 2;", _tagged_points("ratio", "double", "type"), "SELECT ts_ms, type, 'dbl' AS kind, round(total / n * 2, 6) AS v FROM e")
rules("rule_define_tag", H, 'define out tag (id = 1, name = str("t-", tag(evh.click n, type))) { x = evh.click n; y = evh.click cum; }', _tagged_points("out", "x", "type", "id", "name"), "SELECT ts_ms, type, '1' AS id, 't-click' AS name, 'int' AS kind, n::DOUBLE AS v FROM e WHERE type = 'click'")
rules("rule_tag", H, "tag evh.click as big = evh.click n > 3; tag evh.view { site = 17, type = \"V\" }", lambda o: o.dataset.points.filter("metric_key = 'n'").select(ts_ms(), "group_key", F.expr("tags['type']").alias("type_tag"), F.expr("tags['big']").alias("big"), F.expr("tags['site']").alias("site"), F.col("i").cast("double").alias("v")), "SELECT ts_ms, 'evh.' || type AS group_key, CASE WHEN type = 'view' THEN 's:V' ELSE 's:' || type END AS type_tag, CASE WHEN type = 'click' THEN 'b:' || (n > 3) END AS big, CASE WHEN type = 'view' THEN 'i:17' END AS site, n::DOUBLE AS v FROM e")
rules("rule_match", H, "match evh.* as g { define copy.${g[1]}.${g[-1:]} total = g total * 2; }", lambda o: o.dataset.points.filter(F.startswith("group_key", F.lit("copy."))).select(ts_ms(), "group_key", F.round("d", 6).alias("v")), "SELECT ts_ms, 'copy.' || type || '.' || type AS group_key, round(total * 2, 6) AS v FROM e")
rules("rule_match_where", H, "match evh.* as g where g n > 4 { define busy n = g n; }", _tagged_points("busy", "n", "type"), "SELECT ts_ms, type, 'int' AS kind, n::DOUBLE AS v FROM e WHERE n > 4")
rules("rule_match_metric", H, "match evh.//c// //^n$// as g, m { define found x = m + 1; }", _tagged_points("found", "x", "type"), "SELECT ts_ms, type, 'int' AS kind, (n + 1)::DOUBLE AS v FROM e WHERE contains(type, 'c')")
rules("rule_match_product", H, "match evh.click as a, evh.view as b { define both tag (l = tag(a n, type), r = \"x\") n = sum(a n, b n); }", _tagged_points("both", "n", "r"), "SELECT a.ts_ms, 'x' AS r, 'int' AS kind, (a.n + b.n)::DOUBLE AS v FROM e a JOIN e b ON a.ts_ms = b.ts_ms WHERE a.type = 'click' AND b.type = 'view'")


def _alerts(o: Outcome) -> DataFrame:
    return o.alerts.select(ts_ms(), "alert_key", tag_value(F.try_element_at("tags", F.lit("type"))).text().alias("type"), "state", F.unix_millis("start").alias("start_ms"), "message")


_ISLANDS = """, r AS (SELECT e.*, {test} AS f FROM e WHERE {where}), q AS (SELECT r.*, sq.prev, lag(r.ts_ms) OVER w AS lts, lag(coalesce(f, true)) OVER w AS lf FROM r JOIN sq USING (ts_ms) WINDOW w AS (PARTITION BY type ORDER BY r.ts_ms)),
i AS (SELECT *, sum(CASE WHEN lts IS NOT DISTINCT FROM prev AND lts IS NOT NULL AND lf = coalesce(f, true) THEN 0 ELSE 1 END) OVER (PARTITION BY type ORDER BY ts_ms) AS g FROM q),
b AS (SELECT *, min(ts_ms) OVER (PARTITION BY type, g) AS start_ms FROM i)
SELECT ts_ms, {name} AS alert_key, type, CASE WHEN f IS NULL THEN 'UNKNOWN' WHEN NOT f THEN 'OK' WHEN ts_ms - start_ms >= {ms} THEN 'FIRING' ELSE 'TRIGGERING' END AS state, start_ms, {message} AS message{more} FROM b"""
rules("alert_state_for", H, 'alert busy if sum(evh.* n) by (type) > 2 for 2h message "many";', _alerts, _ISLANDS.format(test="n > 2", where="true", name="'busy'", ms=7_200_000, message="'many'", more=""))
rules("alert_immediate", H, "alert low if evh.click total < 30.0;", _alerts, _ISLANDS.format(test="total < 30", where="type = 'click'", name="'low'", ms=0, message="'evh.click total < 30.0'", more=""))
rules("alert_unknown", H, 'alert part if evh.click cum / (evh.click n - 1) > 50 for 1h message "m";', _alerts, _ISLANDS.format(test="CASE WHEN n <> 1 THEN cum // (n - 1) > 50 END", where="type = 'click'", name="'part'", ms=3_600_000, message="'m'", more=""))
rules("alert_in_match", H, 'match evh.* as g { alert ${g}.high if g total > 100.0 for 1h message "m"; }', _alerts, _ISLANDS.format(test="total > 100", where="true", name="'evh.' || type || '.high'", ms=3_600_000, message="'m'", more=""))
rules("alert_attributes", H, 'alert busy if sum(evh.* n) by (type) > 2 message "many" attributes { share = sum(evh.* n) by (type), listed = [sum(evh.* n) by (type), evh.click n, "x"] }', lambda o: _alerts(o).join(o.alerts.select(ts_ms(), tag_value(F.try_element_at("tags", F.lit("type"))).text().alias("type"), F.array_join(F.col("attributes")["share"], ",").alias("share"), F.array_join(F.col("attributes")["listed"], ",").alias("listed")), ["ts_ms", "type"]), _ISLANDS.format(test="n > 2", where="true", name="'busy'", ms=0, message="'many'", more=", n::VARCHAR AS share, CASE WHEN type = 'click' THEN n || ',' || n || ',x' ELSE n || ',x' END AS listed"))

# --- sinks ---------------------------------------------------------------------------


def sink(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None, load: Load = H) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(load(spark, sf_dir).points)
    if sql:
        ORACLE_SQL[name] = f"WITH {_SQL[load].strip()} {sql}"


_TEXTS = "(SELECT ts_ms, type, 'n' AS m, n::VARCHAR AS x, n || 'i' AS xi FROM e UNION ALL SELECT ts_ms, type, 'cum', cum::VARCHAR, cum || 'i' FROM e UNION ALL SELECT ts_ms, type, 'total', total::VARCHAR, total::VARCHAR FROM e)"
sink("sink_prometheus", lambda p: lines.prometheus(p), f"""SELECT 'evh_' || type || '_' || m || '{{type="' || type || '"}} ' || x AS line FROM {_TEXTS}""")
sink("sink_wavefront", lambda p: lines.wavefront(p), f"""SELECT 'evh.' || type || '.' || m || ' ' || x || ' ' || (ts_ms // 1000) || ' source={lines.DEFAULT_SOURCE} type="' || type || '"' AS line FROM {_TEXTS}""")
sink("sink_influx", lambda p: lines.influx(p), f"""SELECT 'evh.' || type || ',type=' || type || ' ' || m || '=' || xi || ' ' || (ts_ms * 1000000) AS line FROM {_TEXTS}""")
sink("sink_json", lambda p: lines.json_scrapes(p).select(ts_ms(), "json"), """SELECT ts_ms, '{"ts_msec":' || ts_ms || ',"ts":"' || strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z","data":{' || string_agg('"evh.' || type || '{type=\\"' || type || '\\"}":{"cum":' || cum || ',"n":' || n || ',"total":' || total || '}', ',' ORDER BY type) || '}}' AS json FROM e GROUP BY ts_ms""")
sink("sink_listing", lambda p: lines.listing(p), f"""SELECT 'evh.' || type || '{{type="' || type || '"}} ' || m || ' = ' || x AS line FROM {_TEXTS} WHERE ts_ms = (SELECT max(ts_ms) FROM sp)""")

# --- sources ---------------------------------------------------------------------------


def source(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.concat(F.lit('{"p":'), F.col("props"), F.lit(',"a":['), F.col("user_id").cast("string"), F.lit(',"'), F.col("event_type"), F.lit('",null]}'))
    flat = json_flat.flatten(_events(spark, sf_dir).select("event_id", nested.alias("j")), "j")
    return flat.select("event_id", F.array_join("metric", ".").alias("metric"), "kind", F.coalesce(F.col("i").cast("string"), F.col("s")).alias("v"))


source("src_json_flatten", _json, """
SELECT event_id, 'body.p.k' AS metric, 'int' AS kind, props->>'$.k' AS v FROM events
UNION ALL SELECT event_id, 'body.a.0', 'int', user_id::VARCHAR FROM events
UNION ALL SELECT event_id, 'body.a.1', 'string', event_type FROM events
UNION ALL SELECT event_id, 'body.a.2', 'empty', NULL FROM events""")


def _collectd(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    messages = e.select(
        F.array(F.col("user_id").cast("string"), text("value")).alias("values"), F.array(F.lit("rx"), F.lit("tx")).alias("dsnames"), F.col("event_id").cast("double").alias("time"), F.concat(F.lit("h"), text("user_id")).alias("host"),
        F.col("event_type").alias("plugin"), F.concat(F.lit("i[user="), text("user_id"), F.lit(",x=y]")).alias("plugin_instance"), F.lit("if").alias("type"), F.lit("").alias("type_instance"),
    )
    tag = lambda k: tag_value(F.try_element_at("tags", F.lit(k))).text().alias(k)
    return collectd.to_points(messages).select(ts_ms(), "group_key", tag("host"), tag("user"), tag("x"), "metric_key", F.round(F.coalesce("d", F.col("i").cast("double")), 6).alias("v"))


source("src_collectd", _collectd, """
SELECT event_id * 1000 AS ts_ms, 'collectd.' || event_type || '.i' AS group_key, 'h' || user_id AS host, user_id::VARCHAR AS "user", 'y' AS x, m AS metric_key, round(CASE WHEN m = 'if.rx' THEN user_id ELSE value END, 6)::DOUBLE AS v
FROM events, (SELECT unnest(['if.rx', 'if.tx']) AS m)""")


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _events(spark, sf_dir).select(F.date_trunc("hour", "ts").alias("ts"), F.col("user_id").cast("string").alias("host"))
    found = collectd.host_states(seen, seen.select("ts").distinct(), remember_ms=3 * 3_600_000)
    return found.select(ts_ms(), tag_value(F.try_element_at("tags", F.lit("host"))).text().alias("host"), F.col("b").alias("up"))


source("src_collectd_hosts", _hosts, """
WITH s AS (SELECT DISTINCT epoch_ms(date_trunc('hour', ts)) AS ts_ms, user_id::VARCHAR AS host FROM events), p AS (SELECT DISTINCT ts_ms FROM s)
SELECT p.ts_ms, s.host, max(s.ts_ms) = p.ts_ms AS up FROM p JOIN s ON s.ts_ms > p.ts_ms - 10800000 AND s.ts_ms <= p.ts_ms GROUP BY p.ts_ms, s.host""")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored copies of every scrape, the later with other values: groups of the earlier stay."""
    p = H(spark, sf_dir).points
    later = p.withColumn("i", F.col("i") + 1).withColumn("batch", F.lit(2).cast("bigint"))
    some = p.filter("group_key <> 'evh.view' OR metric_key <> 'n'").withColumn("batch", F.lit(1).cast("bigint"))
    return first_wins(later.unionByName(some)).filter("kind = 'int'").select(ts_ms(), "group_key", "metric_key", F.col("i").alias("v"))


source("merge_first_wins", _merged, f"WITH {HOURLY.strip()} SELECT ts_ms, 'evh.' || type AS group_key, m AS metric_key, CASE WHEN m = 'n' THEN n ELSE cum END AS v FROM e, (SELECT unnest(['n', 'cum']) AS m) WHERE type <> 'view' OR m = 'cum'")


def _monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.metrics(H(spark, sf_dir)).select(ts_ms(), "metric_key", F.coalesce("i", F.col("b").cast("bigint")).alias("v"))


source("self_monitoring", _monitor, f"""WITH {HOURLY.strip()}, g AS (SELECT sq.ts_ms, count(*) AS groups, coalesce(sq.ts_ms - any_value(prev), 0) AS interval, sq.ts_ms - (SELECT min(ts_ms) FROM sp) AS uptime FROM sq JOIN e ON e.ts_ms = sq.ts_ms GROUP BY sq.ts_ms)
SELECT ts_ms, m.k AS metric_key, m.v::BIGINT AS v FROM (SELECT ts_ms, unnest([{{'k': 'groups', 'v': groups}}, {{'k': 'metric', 'v': groups * 3}}, {{'k': 'failed_collections', 'v': 0}}, {{'k': 'has_config_file', 'v': 1}}, {{'k': 'scrape.interval', 'v': interval}}, {{'k': 'scrape.ts', 'v': ts_ms}}, {{'k': 'scrape.uptime', 'v': uptime}}]) AS m FROM g)""")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe target for each pair of a region and a port."""
    names = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    c = Collect("url", ("http://$0:${port}/",), ("web",), (((0,), tuple((x,) for x in names)), (("port",), resolver.numbers(82, 80))))
    return resolver.targets(spark, c).select("target", F.array_join("group_path", ".").alias("path"), F.col("tags")["port"].alias("port"))


source("src_resolver", _targets, "SELECT 'http://' || r_name || ':' || p || '/' AS target, 'web.' || r_name AS path, 'i:' || p AS port FROM region, (SELECT unnest([80, 81]) AS p)")


def _api(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.evaluate import as_json, evaluate

    return as_json(evaluate(H(spark, sf_dir), {"n": "sum(evh.* n)", "c": "evh.click cum"}), ["n", "c"]).select(ts_ms(), "json")


source("eval_json", _api, f"""WITH {HOURLY.strip()} SELECT ts_ms, '{{"timestamp_msec":' || ts_ms || ',"timestamp_str":"' || strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z","metrics":{{"n":[{{"tags":{{}},"value":"' || sum(n) || '","name_tags":"n[]"}}],"c":[' || coalesce(max('{{"tags":{{"type":"s:click"}},"value":"' || cum || '","name_tags":"c[{{\\\\"key\\\\":\\\\"type\\\\",\\\\"value\\\\":\\\\"s:click\\\\"}}]"}}') FILTER (type = 'click'), '') || ']}}}}' AS json FROM e GROUP BY ts_ms""".replace("\\\\", "\\"))

# --- history ---------------------------------------------------------------------------

_POINTS = "(SELECT ts_ms, 'evh.' || type AS group_key, unnest([{'m': 'n', 'k': 'int', 'v': n::DOUBLE}, {'m': 'cum', 'k': 'int', 'v': cum::DOUBLE}, {'m': 'total', 'k': 'dbl', 'v': total}]) AS x FROM e)"


def _points(p: DataFrame) -> DataFrame:
    return p.select(ts_ms(), "group_key", "metric_key", "kind", F.round(F.coalesce("d", F.col("i").cast("double")), 6).alias("v"))


def _written(spark: SparkSession, sf_dir: str, parts: int = 1) -> History:
    """The hourly events as a history, appended in ``parts`` runs of hours."""
    ds, h = H(spark, sf_dir), History(spark, scratch(spark, "history"))
    for i in range(parts):
        some = ds.scrapes if parts == 1 else ds.scrapes.filter(F.floor(F.unix_millis("ts") / 3_600_000 / 100) % parts == i)
        h.append(Dataset(ds.points.join(some, "ts", "left_semi") if parts > 1 else ds.points, some), i)
    return h


def history(name: str, make: Callable[[SparkSession, str], DataFrame], where: str = "true", what: str = "ts_ms, group_key, x.m AS metric_key, x.k AS kind, round(x.v, 6) AS v") -> None:
    QUERIES[name] = make
    ORACLE_SQL[name] = f"WITH RECURSIVE {HOURLY.strip()} SELECT {what} FROM {_POINTS} WHERE {where}"


def _overlapping(spark: SparkSession, sf_dir: str) -> History:
    """Runs of hours out of order, and all of it once more with other values."""
    h, ds = _written(spark, sf_dir, 3), H(spark, sf_dir)
    h.append(Dataset(ds.points.withColumn("i", F.col("i") + 1), ds.scrapes), 9)
    return h


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _overlapping(spark, sf_dir)
    h.compact()
    return _points(h.scan().points)


def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _written(spark, sf_dir)
    h.retain(1)
    return _points(h.scan().points)


def _copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    copy = History(spark, scratch(spark, "history"), "gzip")
    convert(_written(spark, sf_dir), copy)
    return _points(copy.scan().points)


def _from(day: int):
    from datetime import datetime

    return datetime(2024, 1, day)


_CLICK = '[{"key":"type","value":"s:click"}]'
history("history_scan", lambda spark, sf_dir: _points(_written(spark, sf_dir).scan().points))
history("history_overlap", lambda spark, sf_dir: _points(_overlapping(spark, sf_dir).scan().points))
history("history_compact", _compacted)
history("history_retain", _retained, "date_trunc('day', make_timestamp(ts_ms * 1000)) = (SELECT date_trunc('day', make_timestamp(max(ts_ms) * 1000)) FROM sp)")
history("history_convert", _copied)
history("history_range", lambda spark, sf_dir: _points(_written(spark, sf_dir).scan(_from(10), _from(12)).points), "ts_ms BETWEEN epoch_ms(TIMESTAMP '2024-01-10') AND epoch_ms(TIMESTAMP '2024-01-12')")
history("history_reversed", lambda spark, sf_dir: _points(_written(spark, sf_dir).reversed(None, _from(5))), "ts_ms <= epoch_ms(TIMESTAMP '2024-01-05')")
history("history_group", lambda spark, sf_dir: _points(_written(spark, sf_dir).group("evh.click", _CLICK, _from(20))), "group_key = 'evh.click' AND ts_ms >= epoch_ms(TIMESTAMP '2024-01-20')")
history("history_stepped", lambda spark, sf_dir: _points(_written(spark, sf_dir).stepped(5 * 3_600_000).points), "ts_ms IN (WITH RECURSIVE st AS (SELECT min(ts_ms) AS ts_ms FROM sp UNION ALL SELECT (SELECT min(sp.ts_ms) FROM sp WHERE sp.ts_ms >= st.ts_ms + 18000000) FROM st WHERE (SELECT max(ts_ms) FROM sp) >= st.ts_ms + 18000000) SELECT ts_ms FROM st)")
history("history_catalog", lambda spark, sf_dir: _written(spark, sf_dir).catalog().agg(F.unix_millis(F.min("begin")).alias("begin_ms"), F.unix_millis(F.max("end")).alias("end_ms"), F.sum("points").alias("points"), (F.min("bytes") > 0).alias("sized")), what="min(ts_ms) AS begin_ms, max(ts_ms) AS end_ms, count(*)::BIGINT AS points, true AS sized")


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within one collection a group that is told again replaces what was told before."""
    p = H(spark, sf_dir).points
    again = p.filter("group_key = 'evh.view' AND metric_key = 'n'").withColumn("i", F.col("i") + 1).withColumn("batch", F.lit(2))
    return _points(last_wins(p.withColumn("batch", F.lit(1)).unionByName(again)))


history("merge_last_wins", _last, "group_key <> 'evh.view' OR x.m = 'n'", "ts_ms, group_key, x.m AS metric_key, x.k AS kind, round(x.v + CASE WHEN group_key = 'evh.view' THEN 1 ELSE 0 END, 6) AS v")

# --- micro-batches ------------------------------------------------------------------------


def _streamed(text: str, points: bool) -> Callable[[SparkSession, str], DataFrame]:
    """Rules over three micro-batches in order of time, each with the history that they look back to."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds, h, known = H(spark, sf_dir), History(spark, scratch(spark, "stream")), parse_rules(text)
        cuts = [_from(1).replace(year=2000), _from(8), _from(20), _from(1).replace(year=2100)]
        alerts = None
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = (F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))
            out = engine.step(Dataset(ds.points.filter(part), ds.scrapes.filter(part), ds.kinds, ds.metric_kinds), h, known)
            h.append(out.dataset, i)
            if out.alerts is not None:
                h.append_alerts(out.alerts)
                alerts = spark.read.parquet(h.alerts_path)
        return _points(h.scan().points.filter("group_key = 'out'")) if points else _alerts(Outcome(ds, alerts))

    return run


QUERIES["stream_alerts"] = _streamed('alert busy if sum(evh.* n) by (type) > 2 for 2h message "many";', False)
ORACLE_SQL["stream_alerts"] = ORACLE_SQL["alert_state_for"]
QUERIES["stream_look_back"] = _streamed("define out x = sum[24h](evh.* n);", True)
ORACLE_SQL["stream_look_back"] = f"WITH {HOURLY.strip()} SELECT sp.ts_ms, 'out' AS group_key, 'x' AS metric_key, 'int' AS kind, sum(e.n)::DOUBLE AS v FROM sp JOIN e ON e.ts_ms BETWEEN sp.ts_ms - {_DAY} AND sp.ts_ms GROUP BY sp.ts_ms"

# --- the rest of the language -----------------------------------------------------------------

hourly("unary_plus", "+evh.click total", "dbl", "total")
QUERIES["rate_by_argument"] = lambda spark, sf_dir: shown(evaluate_frames(H(spark, sf_dir), {"x": "rate(evh.click cum, 2h)"})["x"], "num", TYPE)
ORACLE_SQL["rate_by_argument"] = ORACLE_SQL["rate_2h"]
expression("fn_str_by", H, 'str(sum(evh.* n) by (type), "/", sum(evh.* cum) by (type)) by (type)', "text", TYPE, "SELECT ts_ms, type, n || '/' || cum AS v FROM e")
expression("escapes", H, r"""str("a\"b\\\x41\u00e9", evh.click n)""", "text", TYPE, "SELECT ts_ms, type, 'a\"b\\Aé' || n AS v FROM e WHERE type = 'click'")
rules("rule_rename_replaces", H, "tag evh.click as type = \"view\"; tag evh.view as kind = 1;", lambda o: o.dataset.points.filter("metric_key = 'n'").select(ts_ms(), "group_key", "tags_key", F.col("i").alias("v")), """SELECT ts_ms, 'evh.' || type AS group_key, CASE type WHEN 'view' THEN '[{"key":"kind","value":"i:1"},{"key":"type","value":"s:view"}]' WHEN 'click' THEN '[{"key":"type","value":"s:view"}]' ELSE '[{"key":"type","value":"s:' || type || '"}]' END AS tags_key, n AS v FROM e""")


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the validation of some expressions says: whether they parse, and their canonical text."""
    asked = ["1+2*3", "sum( evh.*   n )by(type)", "rate[120s]( a.b c )", "a.'b c' d", "sum(", "!x y&&true"]
    return spark.createDataFrame([(q, v.ok, v.normalized_query) for q in asked for v in [validate(q)]], "query string, ok boolean, normalized string")


source("validate_api", _said, "SELECT * FROM (VALUES ('1+2*3', true, '1 + 2 * 3'), ('sum( evh.*   n )by(type)', true, 'sum(evh.* n) by (type)'), ('rate[120s]( a.b c )', true, 'rate[2m](a.b c)'), ('a.''b c'' d', true, 'a.''b c'' d'), ('sum(', false, NULL), ('!x y&&true', true, '!x y && true')) AS t(query, ok, normalized)")


def _ordered_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of a type's hours compared with one of fixed counts; and their statistics."""
    e = H(spark, sf_dir).points.filter("metric_key = 'n'")
    bar = lambda c: F.array(F.struct(F.lit(0.0).alias("floor"), F.lit(10.0).alias("ceil"), c.cast("double").alias("events")))
    x = bar(F.col("i"))
    return e.select(ts_ms(), "group_key", histogram.compare(x, bar(F.lit(3))).alias("order"), histogram.events(x).alias("events"), histogram.total(x).alias("total"), histogram.average(x).alias("avg"), F.round(histogram.percentile(x, 25), 6).alias("p25"), histogram.median(x).alias("median"), histogram.floor(x).alias("low"), histogram.ceil(x).alias("high"))


source("hist_statistics", _ordered_histograms, f"WITH {HOURLY.strip()} SELECT ts_ms, 'evh.' || type AS group_key, sign(n - 3)::INT AS \"order\", n::DOUBLE AS events, n * 5.0::DOUBLE AS total, 5.0::DOUBLE AS avg, 2.5::DOUBLE AS p25, 5.0::DOUBLE AS median, 0.0::DOUBLE AS low, 10.0::DOUBLE AS high FROM e")


def _hist_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = H(spark, sf_dir)
    h = F.array(F.struct(F.lit(0.0).alias("floor"), F.lit(1.0).alias("ceil"), F.col("i").cast("double").alias("events")))
    p = ds.points.filter("metric_key = 'cum' AND group_key = 'evh.click'").select(*[c for c in ds.points.columns if c not in ("kind", "b", "i", "d", "s", "h")], F.lit("hist").alias("kind"), h.alias("h"))
    f = evaluate_frames(Dataset(p, ds.scrapes, frozenset(["hist"])), {"x": "rate(evh.click cum)"})["x"]
    return f.df.select(ts_ms(), F.round(histogram.events(f.value.get("hist")), 9).alias("v"))


source("hist_rate", _hist_rate, f"WITH {HOURLY.strip()} SELECT a.ts_ms, round((a.cum - b.cum) / ((a.ts_ms - b.ts_ms) / 1000.0), 9) AS v FROM e a JOIN sq USING (ts_ms) JOIN e b ON b.ts_ms = sq.prev AND b.type = a.type WHERE a.type = 'click'")

# --- more sources ----------------------------------------------------------------------------


def _mbeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dumped bean an event, with nested attributes."""
    text = lambda c: F.col(c).cast("string")
    beans = _events(spark, sf_dir).select(F.timestamp_seconds("event_id").alias("ts"), F.concat(F.lit("app:type="), F.col("event_type"), F.lit(",user="), text("user_id")).alias("object"), F.concat(F.lit('{"p":'), F.col("props"), F.lit(',"a":[1],"n":null,"v":'), text("user_id"), F.lit("}")).alias("attributes"))
    return probe.mbean_points(beans).select(ts_ms(), "group_key", F.expr("tags['user']").alias("user_tag"), "metric_key", F.col("i").alias("v"))


source("src_mbeans", _mbeans, """
SELECT event_id * 1000 AS ts_ms, 'app.' || event_type AS group_key, 'i:' || user_id AS user_tag, m.k AS metric_key, m.v AS v
FROM (SELECT *, unnest([{'k': 'p.k', 'v': (props->>'$.k')::BIGINT}, {'k': 'v', 'v': user_id}]) AS m FROM events)""")


def _influx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result a type, a row an event; null cells are absent."""
    e = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k"))
    row = F.array(F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.col("k")))
    one = F.struct(F.concat(F.lit("ev."), "event_type").alias("name"), F.create_map(F.lit("host"), F.concat(F.lit("h"), F.col("user_id").cast("string"))).alias("tags"), F.array(F.lit("time"), F.lit("u"), F.lit("p.k")).alias("columns"), F.array(row).alias("values"))
    found = influx_json.to_points(e.select(F.array(F.struct(F.array(one).alias("series"))).alias("results")))
    return found.select(ts_ms(), "group_key", F.expr("tags['host']").alias("host"), "metric_key", "kind", F.col("i").alias("v"))


source("src_influx", _influx, """
SELECT event_id AS ts_ms, 'ev.' || event_type AS group_key, 's:h' || user_id AS host, m.k AS metric_key, 'int' AS kind, m.v AS v
FROM (SELECT *, unnest([{'k': 'u', 'v': user_id}, {'k': 'p.k', 'v': CASE WHEN event_id % 2 = 0 THEN (props->>'$.k')::BIGINT END}]) AS m FROM events) WHERE m.v IS NOT NULL""")


def _came_and_went(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who buy on one day and on the next, as targets that come and go."""
    e = _events(spark, sf_dir).filter("event_type = 'purchase'")
    seen = lambda day: e.filter(F.to_date("ts") == F.lit(_from(day).date())).select(F.col("user_id").cast("string").alias("target"))
    return resolver.changes(seen(10), seen(11))


source("src_target_changes", _came_and_went, """
WITH a AS (SELECT DISTINCT user_id::VARCHAR AS target FROM events WHERE ts::DATE = DATE '2024-01-10' AND event_type = 'purchase'), b AS (SELECT DISTINCT user_id::VARCHAR AS target FROM events WHERE ts::DATE = DATE '2024-01-11' AND event_type = 'purchase')
SELECT target, 'created' AS change FROM b WHERE target NOT IN (SELECT target FROM a) UNION ALL SELECT target, 'closed' FROM a WHERE target NOT IN (SELECT target FROM b)""")

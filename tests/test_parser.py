import pytest

from tidegauge.plans import nodes as n
from tidegauge.plans import printer
from tidegauge.plans.compiler import lookback_ms, name_filter
from tidegauge.plans.parser import ParseError, parse, parse_configuration, parse_rules
from tidegauge.plans.evaluate import validate

EXPRESSIONS = [
    "a.b c + d e * 2", "sum(* a, TEST b + 6, -13)", "-a b", "rate[1m 30s](G a)", "sum[5m](G.//^0|2$//.//dexed$// a) by (host) keep_common",
    "a x =~ //^[a-z]+_[^_]+$//", "a x + [0..10=20, 0.0..10=1, 0..1e-7=3]", "percentile_agg(50, TEST *) without (x, 'y z')", 'str(G a, "-", G b) by (h)',
    "name(${G[3]}.x.${q[1:]})", "tag(G a + 1, 'host') != G expected", "tag(G, host)", 'regexp(G a, "(o+)", "$1")', "(a b < 3) = true && c d || !(e f)",
    "a b << 2 + 3", "a b || (c d && e f)", "(a b - c d) - e f", "a b - (c d - e f)", 'a b = "x\\"y\\n\\u00e9"', "a.'1 2'.c 'by'", "count(a **)", "a b * by () c d", "[]", "a b % 0x1f + 010 + 1.5e3",
]


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_canonical_text_parses_to_the_same(text):
    node = parse(text)
    assert parse(printer.expression(node)) == node


def test_levels():
    assert parse("a b + c d * e f") == n.Binary("+", parse("a b"), parse("c d * e f"))
    assert parse("a b || c d && e f") == n.Binary("&&", parse("a b || c d"), parse("e f"))
    assert parse("rate(a b, 2m)") == n.Rate(parse("a b"), 120_000)
    assert parse("0x1f") == n.Const(31) and parse("010") == n.Const(8)


@pytest.mark.parametrize("text", ["a b < c d < e f", "a", "sum()", "percentile_agg(101, a b)", "a b +", "rate[5x](a b)", "(a b", '"\\200"', "a b = c d = e f", "a ? b"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse(text)
    assert not validate(text).ok


CONFIG = """import all from "x.conf"; collect url "http://x/$0" as a.b { 0=["x","y"], (h,p)=[("a",1),("b",2)] }
collect jmx_listener "a","b"; collect tcp as t { (host, port) = [("h", 80)] }
alias com.x as G; constant G m 7; constant a.b { x "s"; y -1.5; z true; }
match com.**.test as t, foo.* *.x as G2, M where t x > 1 { alert ${t}.z if t x for 3m message "m" attributes { k = t x, l = [t x, M] } define q tag (id=1) { x = M + 1; } tag t as k = 5; }
tag G { a = 1, b = G x }
define test x = G y; define test { x = G y; y = G z; }
alert a if b c for 1d 2h;"""


def test_configuration_round_trip():
    c = parse_configuration(CONFIG)
    assert parse_configuration(printer.configuration(c)) == c
    assert c.collects[0].arguments[1] == (("h", "p"), (("a", 1), ("b", 2)))


def test_match_identifiers_must_differ():
    with pytest.raises(ParseError):
        parse_rules("match a as x, b as x { }")


def test_lookback_and_name_filter():
    assert lookback_ms(parse("rate[2m](sum[5m](a b))")) == (420_000, 0)
    assert lookback_ms(parse("rate(rate(a b)) + c d")) == (0, 2)
    assert name_filter([parse("a b + sum(c.* d)")]) == {(("a",), ("b",)), (("c", n.Wild("*")), ("d",))}

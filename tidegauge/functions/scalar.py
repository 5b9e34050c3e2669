"""Operators on single values: arithmetic, comparison, logic, text.

All are expressions on the columns of ``Value``; a null in every column of the
result means empty. Nothing depends on the session's ANSI mode.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Value, empty, literal, value
from . import histogram as H

INT, DBL = ("int", "bool"), ("dbl", "int", "bool")
_WRAP = "decimal(38,0)"


def _wrapped(x: Column) -> Column:
    """A decimal reduced to 64 bits of two's complement."""
    half, whole = F.lit(str(2**63)).cast(_WRAP), F.lit(str(2**64)).cast(_WRAP)
    return (F.pmod(x + half, whole) - half).cast("bigint")


def _whole(op: Callable, checked: Callable) -> Callable[[Column, Column], Column]:
    """Long arithmetic that wraps: the checked result, or what 64 bits hold of the full one."""
    return lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.coalesce(checked(x, y), _wrapped(op(x.cast("decimal(19,0)"), y.cast("decimal(19,0)")).cast(_WRAP))))


_add = _whole(lambda x, y: x + y, F.try_add)
_sub = _whole(lambda x, y: x - y, F.try_subtract)
_mul = _whole(lambda x, y: x * y, F.try_multiply)
_INF, _NAN = float("inf"), float("nan")


def _div_int(x: Column, y: Column) -> Column:
    return F.when(y == -1, _sub(F.lit(0).cast("bigint"), x)).when(y != 0, F.call_function("div", x, y))


def _div_dbl(x: Column, y: Column) -> Column:
    negative = (x < 0) != (y.cast("string") == "-0.0")
    by_zero = F.when((x == 0) | F.isnan(x), F.lit(_NAN)).when(negative, F.lit(-_INF)).otherwise(F.lit(_INF))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def _rem_int(x: Column, y: Column) -> Column:
    return F.when(y == -1, F.lit(0).cast("bigint")).when(y != 0, x % y)


def _rem_dbl(x: Column, y: Column) -> Column:
    """IEEE remainder: what is left of the nearest multiple, ties to the even one."""
    infinite = lambda v: F.abs(v) == _INF
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when((y == 0) | F.isnan(x) | F.isnan(y) | infinite(x), F.lit(_NAN)).when(infinite(y), x).otherwise(x - y * F.rint(F.try_divide(x, y)))


def _shift(name: str) -> Callable[[Column, Column], Column]:
    return lambda x, y: F.call_function(name, x, y.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def _power(sign: int) -> Callable[[Column, Column], Column]:
    return lambda x, y: x * F.pow(F.lit(2.0), y * sign)


#: Operator: on longs, on doubles.
_NUMERIC = {
    "+": (_add, lambda x, y: x + y),
    "-": (_sub, lambda x, y: x - y),
    "*": (_mul, lambda x, y: x * y),
    "/": (_div_int, _div_dbl),
    "%": (_rem_int, _rem_dbl),
    "<<": (_shift("shiftleft"), _power(1)),
    ">>": (_shift("shiftright"), _power(-1)),
}


def _histograms(op: str, x: Value, y: Value) -> Column | None:
    hx, hy = x.of.get("hist"), y.of.get("hist")
    both = lambda a, b, f: F.when(a.isNotNull() & b.isNotNull(), f)
    found = []
    if hx is not None and hy is not None and op in "+-":
        found.append(both(hx, hy, (H.add if op == "+" else H.subtract)(hx, hy)))
    if hx is not None and op in ("*", "/", "<<", ">>") and y.kinds & set(DBL):
        n = y.number()
        by = {"*": n, "/": F.when(n != 0, F.try_divide(F.lit(1.0), n)), "<<": F.pow(F.lit(2.0), n), ">>": F.pow(F.lit(2.0), -n)}[op]
        found.append(both(hx, by, H.scale(hx, by)))
    if hy is not None and op == "*" and x.kinds & set(DBL):
        found.append(both(hy, x.number(), H.scale(hy, x.number())))
    return F.coalesce(*found) if found else None


def arithmetic(op: str, x: Value, y: Value) -> Value:
    """Two longs give a long, wrapped; any double a double; histograms as far as they make sense; else empty."""
    whole, real = _NUMERIC[op]
    of = {}
    ints = bool(x.kinds & set(INT) and y.kinds & set(INT))
    if ints:
        of["int"] = whole(x.integer(), y.integer())
    if "dbl" in x.kinds | y.kinds and x.kinds & set(DBL) and y.kinds & set(DBL):
        d = real(x.number(), y.number())
        of["dbl"] = F.when(x.integer().isNull() | y.integer().isNull(), d) if ints else d
    h = _histograms(op, x, y)
    if h is not None:
        of["hist"] = h
    if not of:
        return empty()
    sure = len(of) == 1 and op in "+-*" and "hist" not in of and x.only(*DBL) and y.only(*DBL)
    kind = next(iter(of))
    return Value(frozenset([kind]), F.lit(kind), of) if sure else value(**of)


def _truth(test: Column, sure: bool) -> Value:
    return Value(frozenset(["bool"]), F.lit("bool"), {"bool": test}) if sure else value(bool=test)


def compare(op: str, x: Value, y: Value) -> Value:
    if op in ("=", "!="):
        return _equal(x, y, op == "!=")
    if not (x.kinds & set(DBL) and y.kinds & set(DBL)):
        return empty()
    exact = x.only(*INT) and y.only(*INT)
    a, b = (x.integer(), y.integer()) if exact else (x.number(), y.number())
    test = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    return _truth(test, x.only(*DBL) and y.only(*DBL))


def _equal(x: Value, y: Value, negate: bool) -> Value:
    """Numbers and booleans with each other, texts, histograms; any other pair is empty. NaN equals nothing."""
    found = []
    if x.kinds & set(DBL) and y.kinds & set(DBL):
        a, b = x.number(), y.number()
        real = (a == b) & ~F.isnan(a) if "dbl" in x.kinds | y.kinds else None
        whole = x.integer() == y.integer() if x.kinds & set(INT) and y.kinds & set(INT) else None
        found += [t for t in (whole, real) if t is not None]
    if "string" in x.kinds & y.kinds:
        found.append(x.get("string") == y.get("string"))
    if "hist" in x.kinds & y.kinds:
        found.append(x.get("hist") == y.get("hist"))
    if not found:
        return empty()
    test = F.coalesce(*found)
    return _truth(~test if negate else test, x.only(*DBL) and y.only(*DBL))


def logic(op: str, x: Value, y: Value) -> Value:
    """Empty if either side is, whatever the other says."""
    a, b = x.truth(), y.truth()
    return value(bool=F.when(a.isNotNull() & b.isNotNull(), (a & b) if op == "&&" else (a | b)))


def binary(op: str, x: Value, y: Value) -> Value:
    if op in _NUMERIC:
        return arithmetic(op, x, y)
    return logic(op, x, y) if op in ("&&", "||") else compare(op, x, y)


def unary(op: str, x: Value) -> Value:
    if op == "+":
        return x
    if op == "!":
        return value(bool=~x.truth())
    of = {}
    if x.kinds & set(INT):
        of["int"] = _sub(F.lit(0).cast("bigint"), x.integer())
    if "dbl" in x.kinds:
        of["dbl"] = -x.get("dbl")
    return value(**of) if of else empty()


def matches(x: Value, regex: str, negate: bool = False) -> Value:
    """Only texts are tested; anything else is empty."""
    if "string" not in x.kinds:
        return empty()
    test = x.get("string").rlike(regex)
    return _truth(~test if negate else test, x.only("string"))


def concat(x: Value, y: Value) -> Value:
    """Both as text; empty if either has none."""
    return value(string=F.concat(x.text(), y.text()))


_TEMPLATE = re.compile(r"\\(.)|\$(?:(\d)|\{(\d+)\}|\{([A-Za-z_][A-Za-z0-9_]*)\})|(\$)")


def template_parts(regex: str, template: str) -> list[str | int]:
    """The pieces of a template: texts and numbers of groups."""
    names = {m[1]: i for i, m in enumerate((m for m in re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?!\?)|\(\?<([A-Za-z][A-Za-z0-9]*)>", regex) if m[0][0] == "("), 1) if m[1]}
    out: list[str | int] = []
    last = 0
    for m in _TEMPLATE.finditer(template):
        out.append(template[last : m.start()])
        last = m.end()
        if m[1]:
            out.append(m[1])
        elif m[4]:
            if m[4] not in names:
                raise ValueError(f"no group named {m[4]} in {regex}")
            out.append(names[m[4]])
        elif m[5]:
            raise ValueError(f"a lone $ in {template}")
        else:
            out.append(int(m[2] or m[3]))
    return [p for p in [*out, template[last:]] if p != ""]


def regexp(x: Value, regex: str, template: str) -> Value:
    """The template filled from the first match in a text; empty without one."""
    if "string" not in x.kinds:
        return empty()
    s = x.get("string")
    parts = [F.lit(p) if isinstance(p, str) else F.regexp_extract(s, regex, p) for p in template_parts(regex, template)]
    return value(string=F.when(s.rlike(regex), F.concat(*parts) if parts else F.lit("")))


def named(path: list[str]) -> Value:
    """A name as a value: one component as true, false, a long, a double or itself; several joined by dots."""
    if len(path) != 1:
        return literal(".".join(path)) if path else empty()
    x = path[0]
    if x in ("true", "false"):
        return literal(x == "true")
    if re.fullmatch(r"[+-]?\d{1,19}", x) and -(2**63) <= int(x) < 2**63:
        return literal(int(x))
    if re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?\s*", x):
        return literal(float(x.strip().rstrip("fFdD")))
    return literal({"NaN": _NAN, "Infinity": _INF, "+Infinity": _INF, "-Infinity": -_INF}.get(x, x))


def named_column(path: Column) -> Value:
    """The same for a path that is only known row by row."""
    one = F.when(F.size(path) == 1, F.get(path, F.lit(0)))
    truth = F.when(one == "true", True).when(one == "false", False)
    whole = F.when(one.rlike(r"^[+-]?\d{1,19}$"), one.try_cast("bigint"))
    real = F.when(one.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?\s*$"), F.regexp_replace(F.trim(one), "[fFdD]$", "").try_cast("double"))
    text = F.when(F.size(path) > 0, F.array_join(path, "."))
    known = F.coalesce(truth, F.lit(False)).isNotNull() & truth.isNotNull()
    return value(bool=truth, int=F.when(~known, whole), dbl=F.when(~known & whole.isNull(), real), string=F.when(~known & whole.isNull() & real.isNull(), text))

"""Nodes to text that parses to the same nodes."""

from __future__ import annotations

import re

from . import nodes as n
from .parser import KEYWORDS, LEVELS, UNITS

_ESCAPES = {"\\": "\\\\", "\a": "\\a", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\v": "\\v", "\f": "\\f", "\r": "\\r"}


def _quoted(text: str, quote: str) -> str:
    out = []
    for c in text:
        if c == quote:
            out.append("\\" + c)
        elif c in _ESCAPES:
            out.append(_ESCAPES[c])
        elif ord(c) < 32:
            out.append(f"\\x{ord(c):02x}")
        else:
            out.append(c)
    return quote + "".join(out) + quote


def ident(x: str) -> str:
    return x if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", x) and x not in KEYWORDS else _quoted(x, "'")


def duration(ms: int) -> str:
    out, rest = [], ms // 1000
    for unit in ("d", "h", "m", "s"):
        count, rest = divmod(rest, UNITS[unit] // 1000)
        if count:
            out.append(f"{count}{unit}")
    return " ".join(out) or "0s"


def number(x: int | float) -> str:
    if isinstance(x, int):
        return str(x)
    text = repr(x)
    mantissa, e, power = text.partition("e")
    if not e:
        return text
    if power.startswith("-"):  # a fraction can't have a negative exponent: move the point
        digits = mantissa.replace(".", "").lstrip("-")
        shift = len(digits) - 1
        return ("-" if x < 0 else "") + f"{digits}e-{int(power[1:]) + shift}"
    return f"{mantissa if '.' in mantissa else mantissa + '.0'}e{power.lstrip('+')}"


def name(x: n.Name) -> str:
    def element(e: str | n.Ref) -> str:
        if isinstance(e, str):
            return ident(e)
        sub = {"": "", "index": f"[{e.begin}]", "range": f"[{'' if e.begin is None else e.begin}:{'' if e.end is None else e.end}]"}[e.sub]
        return f"${{{ident(e.ident)}{sub}}}"

    return ".".join(map(element, x))


def group(x: n.Name) -> str:
    bound = len(x) == 1 and isinstance(x[0], n.Ref) and not x[0].sub
    return ident(x[0].ident) if bound else name(x)


def pattern(x: n.Pattern) -> str:
    return ".".join(ident(e) if isinstance(e, str) else regex(e.regex) if e.kind == "regex" else e.kind for e in x)


def regex(x: str) -> str:
    return "//" + x.replace("/", "\\/") + "//"


def _match(m: n.Match) -> str:
    return "" if m.by is None else f" by ({', '.join(map(ident, m.by))})" + " keep_common" * m.keep_common


def _level(x: n.Node) -> int:
    if isinstance(x, n.Binary):
        return next(i for i, ops in enumerate(LEVELS) if x.op in ops)
    if isinstance(x, n.RegexTest):
        return 1
    return len(LEVELS) if isinstance(x, n.Unary) else len(LEVELS) + 1


def constant(x: object) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return number(x)
    if isinstance(x, str):
        return _quoted(x, '"')
    return "[" + ", ".join(f"{number(float(a))}..{number(float(b))}={number(float(c))}" for a, b, c in x) + "]"


def expression(x: n.Node) -> str:
    def inner(y: n.Node, least: int) -> str:
        return expression(y) if _level(y) >= least else f"({expression(y)})"

    if isinstance(x, n.Const):
        return constant(x.value)
    if isinstance(x, n.Selector):
        return f"{group(x.group)} {name(x.metric)}"
    if isinstance(x, n.MetricVar):
        return ident(x.ident)
    if isinstance(x, n.Unary):
        return x.op + inner(x.x, len(LEVELS))
    if isinstance(x, n.Binary):
        level = _level(x)
        left = inner(x.left, level + (level == 1))
        return f"{left} {x.op}{_match(x.match)} {inner(x.right, level + 1)}"
    if isinstance(x, n.RegexTest):
        return f"{inner(x.x, 2)} {'!~' if x.negate else '=~'} {regex(x.regex)}"
    if isinstance(x, n.MetricMatch):
        return f"{pattern(x.group)} {pattern(x.metric)}"
    if isinstance(x, n.Aggregate):
        window = f"[{duration(x.window_ms)}]" if x.window_ms is not None else ""
        args = [number(x.percentile)] if x.percentile is not None else []
        c = x.clause
        clause = f" without ({', '.join(map(ident, c.without))})" if c.without else (f" by ({', '.join(map(ident, c.by))})" if c.by else "") + " keep_common" * c.keep_common
        return f"{x.fn}{window}({', '.join([*args, *map(expression, x.args)])}){clause}"
    if isinstance(x, n.Rate):
        return f"rate{f'[{duration(x.window_ms)}]' if x.window_ms is not None else ''}({expression(x.x)})"
    if isinstance(x, n.Str):
        return f"str({', '.join(map(expression, x.args))}){_match(x.match)}"
    if isinstance(x, n.Regexp):
        return f"regexp({expression(x.x)}, {regex(x.regex)}, {constant(x.template)})"
    if isinstance(x, n.TagOf):
        return f"tag({group(x.target) if isinstance(x.target, tuple) else expression(x.target)}, {ident(x.tag)})"
    if isinstance(x, n.NameOf):
        return f"name({name(x.name)})"
    raise TypeError(f"not an expression: {x}")


def rule(x: n.Node, indent: str = "") -> str:
    i = indent
    if isinstance(x, n.Alias):
        return f"{i}alias {name(x.name)} as {ident(x.ident)};"
    if isinstance(x, n.Constant):
        lines = [f"{name(k)} {constant(v)};" for k, v in x.metrics]
        return f"{i}constant {group(x.group)} " + (lines[0] if len(lines) == 1 else "{\n" + "".join(f"{i}    {line}\n" for line in lines) + f"{i}}}")
    if isinstance(x, n.Define):
        tags = f" tag ({', '.join(f'{ident(k)} = {expression(v)}' for k, v in x.tags)})" if x.tags else ""
        lines = [f"{name(k)} = {expression(v)};" for k, v in x.metrics]
        return f"{i}define {name(x.group)}{tags} " + (lines[0] if len(lines) == 1 else "{\n" + "".join(f"{i}    {line}\n" for line in lines) + f"{i}}}")
    if isinstance(x, n.SetTag):
        pairs = [f"{ident(k)} = {expression(v)}" for k, v in x.tags]
        return f"{i}tag {group(x.group)} " + (f"as {pairs[0]};" if len(pairs) == 1 else "{\n" + ",\n".join(f"{i}    {p}" for p in pairs) + f"\n{i}}}")
    if isinstance(x, n.MatchRule):
        bound = ", ".join(f"{pattern(b.group)}{f' {pattern(b.metric)}' if b.metric else ''} as {ident(b.ident)}{f', {ident(b.metric_ident)}' if b.metric else ''}" for b in x.bindings)
        where = f" where {expression(x.where)}" if x.where else ""
        return f"{i}match {bound}{where} {{\n" + "".join(rule(r, i + "    ") + "\n" for r in x.rules) + f"{i}}}"
    if isinstance(x, n.Alert):
        out = f"{i}alert {name(x.name)} if {expression(x.when)}"
        out += f" for {duration(x.for_ms)}" if x.for_ms else ""
        out += f" message {constant(x.message)}" if x.message is not None else ""
        if not x.attributes:
            return out + ";"
        shown = lambda v: f"[{', '.join(map(expression, v))}]" if isinstance(v, tuple) else expression(v)
        return out + " attributes {\n" + ",\n".join(f"{i}    {ident(k)} = {shown(v)}" for k, v in x.attributes) + f"\n{i}}}"
    raise TypeError(f"not a rule: {x}")


def collect(x: n.Collect) -> str:
    shown = lambda v: str(v) if isinstance(v, int) and not isinstance(v, bool) else constant(v)
    key = lambda k: str(k) if isinstance(k, int) else ident(k)
    out = f"collect {x.kind}" + (f" {', '.join(map(constant, x.main))}" if x.main else "")
    out += f" as {'.'.join(map(ident, x.path))}" if x.path else ""
    if not x.arguments:
        return out + ";"
    lines = []
    for keys, rows in x.arguments:
        if len(keys) == 1:
            lines.append(f"    {key(keys[0])} = [{', '.join(shown(r[0]) for r in rows)}]")
        else:
            lines.append(f"    ({', '.join(map(key, keys))}) = [{', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}]")
    return out + " {\n" + ",\n".join(lines) + "\n}"


def configuration(x: n.Configuration) -> str:
    lines = [f'import {i.what} from {constant(i.file)};' for i in x.imports]
    return "\n".join([*lines, *map(collect, x.collects), *map(rule, x.rules)]) + "\n"

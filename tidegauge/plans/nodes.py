"""What expressions and rules are made of, before they are compiled."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Ref:
    """A component taken from the path that an identifier is bound to: all of it, ``[i]``, or ``[b:e]``."""

    ident: str
    sub: str = ""  # "", "index", "range"
    begin: int | None = None
    end: int | None = None


#: A name: literal components and references, in order.
Name = tuple["str | Ref", ...]


@dataclass(frozen=True)
class Match:
    """How a binary operator pairs tags: by all of them, or by some."""

    by: tuple[str, ...] | None = None
    keep_common: bool = False


@dataclass(frozen=True)
class Clause:
    """How an aggregate groups tags."""

    by: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    keep_common: bool = False


@dataclass(frozen=True)
class Wild:
    """A path pattern's element: ``*``, ``**`` or a regular expression."""

    kind: str
    regex: str = ""


#: A path pattern: literal components and wild ones.
Pattern = tuple["str | Wild", ...]


class Node:
    pass


@dataclass(frozen=True)
class Const(Node):
    value: object  # bool, int, float, str, or a tuple of (floor, ceil, events)


@dataclass(frozen=True)
class Selector(Node):
    """``group metric``; a group of one reference without brackets is a bound identifier."""

    group: Name
    metric: Name


@dataclass(frozen=True)
class MetricVar(Node):
    """A metric identifier bound by ``match … as G, M``."""

    ident: str


@dataclass(frozen=True)
class Unary(Node):
    op: str
    x: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node
    match: Match = Match()


@dataclass(frozen=True)
class RegexTest(Node):
    x: Node
    regex: str
    negate: bool = False


@dataclass(frozen=True)
class MetricMatch(Node):
    """All series and metrics that match two patterns; only as an argument of an aggregate."""

    group: Pattern
    metric: Pattern


@dataclass(frozen=True)
class Aggregate(Node):
    fn: str
    args: tuple[Node, ...]
    clause: Clause = Clause()
    window_ms: int | None = None
    percentile: float | None = None


@dataclass(frozen=True)
class Rate(Node):
    x: Node
    window_ms: int | None = None


@dataclass(frozen=True)
class Str(Node):
    args: tuple[Node, ...]
    match: Match = Match()


@dataclass(frozen=True)
class Regexp(Node):
    x: Node
    regex: str
    template: str


@dataclass(frozen=True)
class TagOf(Node):
    target: "Node | Name"  # an expression, or a group
    tag: str


@dataclass(frozen=True)
class NameOf(Node):
    name: Name


# --- rules ----------------------------------------------------------------


@dataclass(frozen=True)
class Alias(Node):
    name: Name
    ident: str


@dataclass(frozen=True)
class Constant(Node):
    group: Name
    metrics: tuple[tuple[Name, object], ...]


@dataclass(frozen=True)
class Define(Node):
    group: Name
    metrics: tuple[tuple[Name, Node], ...]
    tags: tuple[tuple[str, Node], ...] = ()


@dataclass(frozen=True)
class SetTag(Node):
    group: Name
    tags: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class Binding:
    """``pattern as G`` or ``pattern pattern as G, M``."""

    group: Pattern
    ident: str
    metric: Pattern | None = None
    metric_ident: str | None = None


@dataclass(frozen=True)
class MatchRule(Node):
    bindings: tuple[Binding, ...]
    rules: tuple[Node, ...]
    where: Node | None = None


@dataclass(frozen=True)
class Alert(Node):
    name: Name
    when: Node
    for_ms: int = 0
    message: str | None = None
    attributes: tuple[tuple[str, "Node | tuple[Node, ...]"], ...] = ()


@dataclass(frozen=True)
class Import:
    what: str  # all, collectors
    file: str


@dataclass(frozen=True)
class Collect:
    """``collect kind "main", … as path { arguments }``; an argument line gives names and rows of values."""

    kind: str
    main: tuple[str, ...] = ()
    path: tuple[str, ...] | None = None
    arguments: tuple[tuple[tuple[object, ...], tuple[tuple[object, ...], ...]], ...] = ()


@dataclass(frozen=True)
class Configuration:
    imports: tuple[Import, ...] = ()
    collects: tuple[Collect, ...] = ()
    rules: tuple[Node, ...] = field(default=())

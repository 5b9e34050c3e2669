"""Configurations: loading with imports, checking, and applying."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from ..model import Dataset
from . import nodes as n
from . import printer
from .parser import ParseError, parse_configuration

COLLECTORS = ("url", "json_url", "jmx_listener", "collectd_push", "tcp")


def load(path: str | Path) -> n.Configuration:
    """A configuration and, before its own statements, those it imports; files are relative to the one that names them."""
    return _load(Path(path), ())


def _load(path: Path, above: tuple[Path, ...]) -> n.Configuration:
    path = path.resolve()
    if path in above:
        raise ValueError(f"{path} imports itself")
    c = parse_configuration(path.read_text())
    collects, rules = [], []
    for i in c.imports:
        inner = _load(path.parent / i.file, (*above, path))
        collects += inner.collects
        if i.what == "all":
            rules += inner.rules
    return n.Configuration((), (*collects, *c.collects), (*rules, *c.rules))


@dataclass(frozen=True)
class Report:
    file: str
    ok: bool
    errors: tuple[str, ...] = ()
    canonical: str | None = None


def check(path: str | Path, recursive: bool = False) -> list[Report]:
    """Whether a file parses, names known collectors and, if asked, its imports do."""
    path, out = Path(path), []
    try:
        c = parse_configuration(path.read_text())
        unknown = tuple(f"unknown collector {x.kind}" for x in c.collects if x.kind not in COLLECTORS)
        out.append(Report(str(path), not unknown, unknown, printer.configuration(c)))
        for i in c.imports if recursive else ():
            out += check(path.parent / i.file, True)
    except (ParseError, OSError) as e:
        out.append(Report(str(path), False, (str(e),)))
    return out


def apply(ds: Dataset, c: n.Configuration):
    """The outcome of a configuration's rules on a dataset."""
    from ..operators.rules import apply_rules

    return apply_rules(ds, c.rules)

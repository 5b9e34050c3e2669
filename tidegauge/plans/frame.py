"""What an expression compiles to: a vector of tagged values, or a scalar, for each instant."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import COLUMN, Value, read_value

TAGS = ("tags_key", "tags")


@dataclass(frozen=True)
class Frame:
    """``df`` has the columns of ``ctx`` (ts, and bind within a match), tags if a vector, and those of ``value``.

    A literal has no ``df``: its value holds everywhere. A scalar has at most
    one row an instant and binding.
    """

    df: DataFrame | None
    value: Value
    scalar: bool
    ctx: tuple[str, ...] = ("ts",)

    @property
    def is_literal(self) -> bool:
        return self.df is None

    @property
    def keys(self) -> tuple[str, ...]:
        return self.ctx if self.scalar else (*self.ctx, "tags_key")


def value_columns(v: Value) -> list[Column]:
    kind = [v.kind.alias("kind")] if len(v.kinds) > 1 else []
    return kind + [v.get(k).alias(c) for k, c in COLUMN.items() if k in v.kinds]


def column_names(v: Value) -> list[str]:
    return ["kind"] * (len(v.kinds) > 1) + [c for k, c in COLUMN.items() if k in v.kinds]


def frame(df: DataFrame, v: Value, scalar: bool, ctx: tuple[str, ...]) -> Frame:
    """A frame of ``df`` with value ``v``, an expression on its columns."""
    out = df.select(*ctx, *([] if scalar else TAGS), *value_columns(v))
    return Frame(out, read_value(v.kinds), scalar, ctx)


def renamed(x: Frame, prefix: str) -> tuple[DataFrame, Value]:
    """Tags and value columns of ``x`` under a prefix; the columns of ctx and tags_key stay."""
    names = [*([] if x.scalar else ["tags"]), *column_names(x.value)]
    df = x.df.select(*x.keys, *[F.col(c).alias(prefix + c) for c in names])
    return df, read_value(x.value.kinds, prefix)


def on_spine(x: Frame, spine: DataFrame) -> Frame:
    """A literal as a scalar of rows."""
    return frame(spine.select(*x.ctx), x.value, True, x.ctx) if x.is_literal else x

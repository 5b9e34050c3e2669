"""Personal data in texts: patterns propose, checksums confirm, context adjusts.

Only DataFrame operations. For each kind a pattern proposes spans; the pieces
between matches give the offsets, so no position is searched for again.
Validators (Luhn, mod 97, number ranges) confirm them; words near a span raise
its score, and a span counts from a score of 0.5 on. The base kinds are certain
once valid.

The patterns are written so that a scan stays linear in the text: quantifiers
don't give back, and a run is only tried from its start.

Defined results: null text has no spans; ids may repeat; further columns pass
through, whatever their names, but for one named spans, which ``find`` replaces. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements summed directly in ``starts``; beyond it sums of blocks are used.
BLOCK = 128


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of ``x`` pass Luhn."""
    d = digits_of(x)
    n = F.length(d)
    at = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, twice(at(i))).otherwise(at(i))) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether ``x``, with its first four characters moved to the end and A-Z read as 10-35, is 1 modulo 97."""
    c = F.regexp_replace(x, r"\x20", "")
    moved = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))
    chars = F.split(moved, "")
    step = lambda s, k: F.when(k.rlike("[0-9]"), (s * 10 + k.cast("int")) % 97).otherwise((s * 100 + F.ascii(k) - 55) % 97)
    return F.aggregate(F.filter(chars, lambda k: k != ""), F.lit(0), step) == 1


def octets(x: Column) -> Column:
    """Whether every dotted part is at most 255, leading zeros aside."""
    value = lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0))
    return F.forall(F.split(x, r"\."), lambda p: value(p) <= 255)


def digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda x: F.length(digits_of(x)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """``trigger``: a string that every match holds, or None; ``valid``: confirms a match; score: before context; context: words that raise it by 0.4."""

    name: str
    pattern: str
    trigger: str | None
    valid: Callable[[Column], Column] | None
    score: float
    context: str | None = None


# The kinds of the base contract.
BASE_KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", None, 1.0),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", ".", octets, 1.0),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", None, luhn, 1.0),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", digit_count(8, 15), 1.0),
)
MORE_KINDS = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])", None, mod97, 0.6, "iban|account|konto|compte|cuenta|bank"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", None, 0.2, "ssn|social security"),
    Kind("shortcard", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", None, luhn, 0.2, "card|visa|amex|credit|karte|carte|tarjeta"),
)
KINDS = BASE_KINDS + MORE_KINDS


def starts(lengths: str) -> tuple[Column, Column]:
    """Two stages of the exclusive prefix sums of an array column: sums of blocks, then a function of it and the array."""
    arr = F.col(lengths)
    add = lambda a, x: a + x
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(arr, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), add))
    return arr, blocks


def add_spans(docs: DataFrame, kind: Kind, text: str) -> DataFrame:
    """``docs`` with __<kind>: array of (kind, start, end, score), confirmed, in order."""
    t = F.col(text)
    k = f"__{kind.name}"
    tried = t if kind.trigger is None else F.when(F.contains(t, F.lit(kind.trigger)), t)
    found = F.regexp_extract_all(tried, F.lit(kind.pattern), F.lit(0))
    out = docs.withColumn(f"{k}_m", F.when(F.size(found) > 0, found) if kind.trigger is None else found)
    m = F.col(f"{k}_m")
    some = F.size(m) > 0
    out = out.withColumn(f"{k}_p", F.when(some, F.split(t, kind.pattern, -1)))
    p = F.col(f"{k}_p")
    # lengths of a piece and the match after it: the end of match i is the sum of the first i + 1
    out = out.withColumn(f"{k}_l", F.when(some, F.zip_with(m, F.slice(p, F.lit(1), F.size(m)), lambda a, b: F.length(a) + F.length(b))))
    arr, blocks = starts(f"{k}_l")
    out = out.withColumn(f"{k}_b", F.when(some, blocks))
    b = F.col(f"{k}_b")
    add = lambda a, x: a + x
    out = out.withColumn(f"{k}_c", F.when(some, F.transform(b, lambda x, i: F.aggregate(F.slice(b, F.lit(1), i), F.lit(0), add))))
    c = F.col(f"{k}_c")

    def span(x: Column, i: Column) -> Column:
        j = F.floor(i / BLOCK).cast("int")
        end = F.get(c, j) + F.aggregate(F.slice(arr, j * BLOCK + 1, i - j * BLOCK + 1), F.lit(0), add)
        return F.struct(F.lit(kind.name).alias("kind"), (end - F.length(x)).alias("start"), end.alias("end"), x.alias("x"))

    spans = F.when(some, F.filter(F.transform(m, span), lambda s: kind.valid(s["x"]) if kind.valid else F.lit(True)))
    out = out.withColumn(f"{k}_s", spans)
    score = F.lit(kind.score)
    if kind.context:
        near = lambda s: F.lower(F.substring(t, F.greatest(s["start"] - 39, F.lit(1)), s["end"] - s["start"] + 80))
        scored = lambda s: F.when(near(s).rlike(kind.context), score + 0.4).otherwise(score)
    else:
        scored = lambda s: score
    done = F.transform(f"{k}_s", lambda s: F.struct(s["kind"], s["start"].alias("start"), s["end"].alias("end"), scored(s).alias("score")))
    done = F.coalesce(F.filter(done, lambda s: s["score"] >= 0.5), F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))
    return out.withColumn(k, done).drop(*[f"{k}_{x}" for x in "mplbcs"])


def find(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with spans: array of (kind, start, end, score), by kind as listed, then start."""
    names = [c for c in docs.columns if c != "spans"]
    out = docs.select(F.struct(*names).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    for kind in kinds:
        out = add_spans(out, kind, "__text")
    return out.select("__row.*", F.concat(*[F.col(f"__{k.name}") for k in kinds]).alias("spans"))


def redact(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with each span that ``find`` reports replaced by [KIND]; texts without any stay as they are.

    Spans that overlap are replaced as one, under the kind of the first of
    them, or of those that start alike the one listed first.
    """
    names = docs.columns
    out = find(docs.select(F.struct(*names).alias("row"), F.col(text).alias("t")), "t", kinds)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k.name, i)])
    out = out.withColumn("s", F.when(F.size("spans") > 0, F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))))))
    ends, t = F.col("s")["end"], F.col("t")
    out = out.withColumn("b", F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / BLOCK).cast("int")), lambda b: F.array_max(F.slice(ends, b * BLOCK + 1, F.lit(BLOCK)))))

    def upto(i: Column) -> Column:
        """Where the spans before the i-th end at last."""
        j = F.floor(i / BLOCK).cast("int")
        last = lambda x: F.coalesce(F.array_max(x), F.lit(0))
        return F.greatest(last(F.slice("b", F.lit(1), j)), last(F.slice(ends, j * BLOCK + 1, i - j * BLOCK)))

    out = out.withColumn("h", F.filter(F.transform("s", lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), upto(i).alias("after"))), lambda h: h["start"] >= h["after"]))
    told = F.transform("h", lambda h: F.concat(F.substring(t, h["after"] + 1, h["start"] - h["after"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
    rest = F.substring(t, F.array_max(ends) + 1, F.length(t))
    out = out.withColumn("new", F.when(F.col("s").isNull(), t).otherwise(F.concat(F.array_join(told, ""), rest)))
    return out.select(*[F.col("new").alias(c) if c == text else F.col("row")[c].alias(c) for c in names])

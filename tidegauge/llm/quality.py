"""Quality rules as a short-circuit cascade of native expressions.

``measures`` derives the counts that the rules look at; ``cascade`` orders
rules by rejection per cost, both estimated on a sample, and evaluates them as
one CASE, so that a row stops at the first rule that rejects it. The order
only decides how much is evaluated: the verdict is that of all rules together.

Defined results: null text counts as no words (and no lines); a text of blanks
only has no words; ids may repeat, as nothing is grouped by them; further
columns pass through untouched, but for those named like a measure or kept,
which are replaced. Windows are compared by a 64-bit hash of
their three words, within one text only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``reject``: true for rows to drop; ``cost``: what it takes, in characters or elements looked at."""

    name: str
    reject: Column
    cost: Column


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A window repeats if its hash has a neighbour of equal hash once windows are
    sorted by hash; texts whose windows all differ, the usual case, skip that.
    """
    names = [c for c in docs.columns if c not in MEASURES]
    t = F.coalesce(F.col("__text"), F.lit(""))
    out = docs.select(F.struct(*names).alias("__row"), F.col(text).alias("__text"))
    out = out.withColumn("__words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    n = F.size("__words")
    word = F.col("__words")
    out = out.withColumn("n_words", n.cast("long")).withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    out = out.withColumn("n_symbols", F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"))
    out = out.withColumn("__lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    hashes = F.transform(word, lambda w, i: F.xxhash64(w, F.get(word, i + 1), F.get(word, i + 2)))
    out = out.withColumn("__h", F.when(n >= 3, F.slice(hashes, F.lit(1), n - 2)).otherwise(F.lit(None)))
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    out = out.withColumn("__at", F.when(again, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.col("__at")
    near = lambda p, j: F.coalesce(F.get(at, j)["h"] == p["h"], F.lit(False))
    repeated = F.filter(at, lambda p, j: near(p, j - 1) | near(p, j + 1))
    out = out.withColumn("__pos", F.sort_array(F.transform(repeated, lambda p: p["i"])))
    pos = F.col("__pos")
    covered = F.aggregate(F.transform(pos, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(pos, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.select("__row.*", *MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(text: str = "text") -> list[Rule]:
    """Rules over the columns of ``measures`` and, where those don't say enough, the text."""
    n, one = F.col("n_words"), F.lit(1.0)
    t = F.coalesce(F.col(text), F.lit(""))
    mean = F.try_divide(F.col("word_chars"), n)
    unlettered = F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"))
    return [
        Rule("few_words", n < 50, one),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 50 * n, one),
        Rule("symbols", 10 * F.col("n_symbols") > n, one),
        Rule("duplicate_lines", 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"), one),
        Rule("mean_word_length", (n > 0) & ((mean < 2) | (mean > 14)), one),
        Rule("words_without_letters", 100 * unlettered > 30 * n, F.length(t).cast("double")),
        Rule("endless_word", t.rlike(r"[^\x20\x09-\x0D]{1000}"), F.length(t).cast("double")),
    ]


def ordered(sample: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """``rules`` by rejection per cost on ``sample``, most first; one row reaches the driver."""
    got = sample.agg(*[F.avg(F.coalesce(r.reject, F.lit(False)).cast("double")).alias(f"r{i}") for i, r in enumerate(rules)], *[F.avg(r.cost).alias(f"c{i}") for i, r in enumerate(rules)]).first()
    gain = lambda i: (got[f"r{i}"] or 0.0) / max(got[f"c{i}"] or 0.0, 1e-9)
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gain(i), i))]


def sampled(docs: DataFrame, files: int = 8, share: float = 0.01) -> DataFrame:
    """A random ``share`` of the rows of up to ``files`` of the files that ``docs`` was read from, from first to last."""
    found = sorted(docs.inputFiles())
    if not found:
        return docs
    chosen = sorted({found[i * (len(found) - 1) // max(1, files - 1)] for i in range(files)})
    return docs.sparkSession.read.schema(docs.schema).parquet(*chosen).sample(share, seed=4)


def cascade(docs: DataFrame, rules: Sequence[Rule], sample: DataFrame) -> DataFrame:
    """``docs`` with kept: false from the first rule that rejects the row on."""
    verdict = None
    for rule in ordered(sample, rules):
        verdict = F.when(rule.reject, F.lit(False)) if verdict is None else verdict.when(rule.reject, F.lit(False))
    return docs.withColumn("kept", F.lit(True) if verdict is None else verdict.otherwise(F.lit(True)))

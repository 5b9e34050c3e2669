"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent one- to three-grams of letters, most
frequent first; words are padded with one blank, and case is folded. A text's
own profile is compared with each language's by the out-of-place distance: the
sum over the text's n-grams of how far apart their ranks are, and the profile's
length for one that the language's profile lacks. The least distance wins,
ties go to the language first in code-point order.

Defined results: null text, and text without a letter, is ``und`` with score
0, and so is any text if no language could be learned. Repeated rows are
predicted alike; ids and further columns play no part, and pass through but
for any named lang_pred or score, which ``identify`` replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import through_arrow

UNDETERMINED = "und"
#: N-grams in a profile; training rows of a language aimed at; code points counted at once.
PROFILE, TRAIN_ROWS, PIECE = 300, 30_000, 1 << 18
BLANK = 32

_letter = np.zeros(0, bool)


def _letters() -> np.ndarray:
    global _letter
    if not len(_letter):
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letter


def _codes(text: str) -> np.ndarray:
    """Folded letters with single blanks between, before and after words; empty without a letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ok = _letters()[c]
    if not ok.any():
        return c[:0]
    c = np.where(ok, c, BLANK)
    c = np.concatenate(([BLANK], c, [BLANK]))
    return c[np.concatenate(([True], (c[1:] != BLANK) | (c[:-1] != BLANK)))]


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.diff(np.concatenate((first, [len(grams)])))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct one- to three-grams of ``text``, 21 bits a character, and their counts."""
    c = _codes(text)
    parts = []
    for at in range(0, len(c), PIECE):
        x = c[at : at + PIECE + 2]
        one, two = x[:PIECE], x[1 : PIECE + 1]
        n2, n3 = len(two), max(0, len(x) - 2)
        pair = (one[:n2] << 21) | two
        three = ((pair[:n3] << 21) | x[2:])[two[:n3] != BLANK]
        parts.append(_counted(np.concatenate((one[one != BLANK], pair, three))))
    return _merged(parts) if parts else (c, c)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, then by value."""
    if len(grams) > size:  # all that may be among them; grams are sorted, and the sort below is stable
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", rows: int = TRAIN_ROWS, size: int = PROFILE) -> dict[str, np.ndarray]:
    """A profile for each non-null ``lang`` of ``docs``, from about ``rows`` rows each.

    A language of no more rows is learned from all of them, however large the
    table; of a larger one a random share of that size is read. The counts are
    summed by the cluster, and ``size`` n-grams a language reach the driver.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if max(n.values(), default=0) > rows:
        known = known.sampleBy("lang", {k: min(1.0, rows / x) for k, x in n.items()}, seed=11)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list] = {}
            for tag, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(tag, []).append(ngrams(t))
            for tag, parts in by.items():
                g, c = _merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([tag] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(c, pa.int64())], ["lang", "gram", "n"])

    sums = through_arrow(known, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("place", place).filter(F.col("place") <= size).select("lang", "gram", "place").toArrow().to_pylist()
    out: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["place"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


class Predictor:
    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.names = size, sorted(profiles)
        order = [np.argsort(profiles[k]) for k in self.names]
        self.known = [(profiles[k][o], o) for k, o in zip(self.names, order, strict=True)]

    def distances(self, own: np.ndarray) -> list[int]:
        out, place = [], np.arange(len(own))
        for grams, rank in self.known:
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            out.append(int(np.where(grams[at] == own, np.minimum(np.abs(rank[at] - place), self.size), self.size).sum()))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngrams(text or "")
        if not len(grams) or not self.names:
            return UNDETERMINED, 0.0
        own = ranked(grams, counts, self.size)
        d = self.distances(own)
        best = min(range(len(d)), key=d.__getitem__)
        return self.names[best], 1.0 - d[best] / (self.size * len(own))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score: 1 less the distance as a share of the largest possible."""
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    schema = docs.selectExpr("*", "'' AS lang_pred", "0D AS score").schema
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Predictor(profiles, size)
        for b in batches:
            got = [p.predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, "lang_pred", "score"])

    return through_arrow(docs, run, schema)

"""Text quality by compression: which of two zstandard dictionaries serves a text better.

One dictionary is built from good, one from bad labelled text. A text is cut
into short pieces, so that it can't serve as its own dictionary, and all of
them are compressed with either. The size difference, as a share of both
sizes, and the size itself, as a share of the text's, are calibrated to a
probability by logistic regression on labelled texts that the dictionaries
have not seen.

The fit uses a bounded sample of labelled rows: ``rows`` a class, and of a text
of over ``longest`` characters as many in pieces spread over the whole of it. A
dictionary is built from up to ``SAMPLES`` pieces, spread over those of its
class. Every text is scored whole.

Defined results: null text is an empty text, which scores the calibrated prior
(the share of label 1 in the calibration rows); so does every text if a class
has no usable label. Repeated rows score alike; ids and further columns play
no part in a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import through_arrow

PIECE, LEVEL, DICTIONARY, SAMPLES = 512, 3, 112_640, 4000
ROWS, LONGEST = 2000, 16_384


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray  # of the constant and the features
    prior: float


def _pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.packers = [self._packer(d) for d in (model.good, model.bad)] if model.good else []

    @staticmethod
    def _packer(raw: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def features(self, raw: bytes) -> list[float]:
        good, bad = (sum(len(p.compress(x)) for x in _pieces(raw)) for p in self.packers)
        size = (good + bad) / (2 * len(raw))
        return [1.0, 2 * (bad - good) / (good + bad), size, size * size]

    def score(self, raw: bytes) -> float:
        m = self.model
        if not raw or not self.packers:
            return m.prior
        return float(1 / (1 + np.exp(-np.clip(np.dot(m.weights, self.features(raw)), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method, on standardised features, given back for raw ones."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0.0, 1.0
    z = (x - mean) / scale
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge * len(y) * np.eye(len(w)), z.T @ (y - p) - ridge * len(y) * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    raw = w / scale
    raw[0] = w[0] - (w[1:] * mean[1:] / scale[1:]).sum()
    return raw


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """A model from labelled texts: two of three build the dictionaries, the third calibrates."""
    texts, labels = [t for t in texts if t], [q for t, q in zip(texts, labels, strict=True) if t]
    prior = sum(labels) / len(labels) if labels else 0.5
    for_dictionary = [i % 3 != 2 for i in range(len(texts))]
    raw = {}
    for q in (1, 0):
        pieces = [p for t, k, d in zip(texts, labels, for_dictionary, strict=True) if k == q and d for p in _pieces(t)]
        pieces = [pieces[i] for i in np.linspace(0, len(pieces) - 1, min(len(pieces), SAMPLES)).astype(int)] if pieces else []
        if len(pieces) < 8:
            return Model(b"", b"", np.zeros(4), prior)
        try:
            raw[q] = zstandard.train_dictionary(DICTIONARY, pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little text to select from: its end serves as the dictionary
            raw[q] = b"".join(pieces)[-DICTIONARY:]
    model = Model(raw[1], raw[0], np.zeros(4), prior)
    scorer = Scorer(model)
    held = [i for i, d in enumerate(for_dictionary) if not d]
    y = np.array([labels[i] for i in held], float)
    if 0 < y.sum() < len(y):
        model.weights = _logistic(np.array([scorer.features(texts[i]) for i in held]), y)
        model.prior = float(y.mean())
    else:
        return Model(b"", b"", np.zeros(4), prior)
    return model


def spread(text: Column, longest: int) -> Column:
    """``text``, or of a longer one pieces from its start to its end, ``longest`` characters in all."""
    n = max(2, longest // PIECE)
    piece = lambda i: F.substring(text, F.floor(i * (F.length(text) - PIECE) / (n - 1)).cast("int") + 1, F.lit(PIECE))
    return F.when(F.length(text) > longest, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), piece), "")).otherwise(text)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", ident: str = "doc_id", text: str = "text", rows: int = ROWS, longest: int = LONGEST) -> Model:
    """A model from up to about ``rows`` rows of ``labels`` a class, chosen by a hash of the id."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(ident).isNotNull()).select(ident, F.col(label).cast("int").alias("__label")).distinct()
    counts = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    share = F.when(F.col("__label") == 1, rows / max(counts.get(1, 0), rows)).otherwise(rows / max(counts.get(0, 0), rows))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(17), ident), F.lit(1 << 20)) < share * (1 << 20))
    found = docs.select(ident, text).join(F.broadcast(chosen), ident).filter(F.col(text).isNotNull()).withColumn(text, spread(F.col(text), longest))
    got = found.select(ident, text, "__label").toArrow().to_pylist()
    got.sort(key=lambda r: (r[ident], r["__label"], r[text]))
    order = np.random.default_rng(6).permutation(len(got))
    return fit([got[i][text].encode() for i in order], [got[i]["__label"] for i in order])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score, from 0 to 1: how likely label 1 is."""
    docs = docs.drop("score")
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in batches:
            got = [s.score(t.as_py() or b"") for t in b.column(at).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*names, "score"])

    return through_arrow(docs, run, docs.selectExpr("*", "0D AS score").schema)

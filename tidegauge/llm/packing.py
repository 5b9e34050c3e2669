"""Packing documents into training sequences by lexical retrieval.

Whole windows are cut off long documents; the rests are packed. Rows of a task
form shards of bounded size, each with a BM25 inverted index over the token
ids of its rests. A seed fills a window first, then its unused neighbours by
score; one that doesn't fit is cut, and what remains of it seeds the next
window. The last window of a shard is cut into power-of-two lengths, so there
is no padding. Document frequencies and the mean length are those of the whole
corpus. All ids are indexed: common ones weigh little, but may be all that a
rest has.

No row is shuffled, so no key can be hot: ids are stored once, and a shard is
a run of stored rows.

Defined results: null text is empty: a piece of just the end id. Rows with an
equal id are packed each on their own. An empty table packs to nothing.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, through_arrow
from .encoding import encoder, vocabulary

WINDOW, SHARD_DOCS, SHARD_TOKENS = 4096, 1024, 4 << 20
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _by_term(rests: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, row and count of each distinct id of each row, by term, then row; one sort for all rows."""
    rows = np.repeat(np.arange(len(rests), dtype=np.int64), [len(r) for r in rests])
    keys = np.concatenate(rests).astype(np.int64) << 32 | rows
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first] >> 32, keys[first] & 0xFFFFFFFF, np.diff(np.concatenate((first, [len(keys)])))


def tokenized(docs: DataFrame, tokenizer: str, kind: str, end: int, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, terms, df, as a stored table.

    ``ids`` are little-endian, unsigned, of 16 bits if the vocabulary allows.
    One row in many also has the document frequencies of the rows around it
    (``terms``, ``df``: long arrays as bytes), so that those of the corpus can
    be summed without reading any ids again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind, end)
        wide = np.uint16 if max(enc.vocabulary, end + 1) <= 1 << 16 else np.uint32
        for b in batches:
            for first, last, ids, offsets in enc.encode(b.column(1)):
                n, ids = last - first, ids.astype(wide)
                raw = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                term, _, _ = _by_term([ids[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                term, df = np.unique(term, return_counts=True)
                held = lambda x, n=n: pa.array([x.astype(np.int64).tobytes(), *[None] * (n - 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), raw, held(term), held(df)], ["doc_id", "ids", "terms", "df"])

    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(through_arrow(rows, run, "doc_id long, ids binary, terms binary, df binary"), "pack-ids", compression="zstd")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, df of a task."""
    df = np.zeros(1, np.int64)
    for b in batches:
        for t, n in zip(b.column(0), b.column(1), strict=True):
            term, count = np.frombuffer(t.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.int64)
            if term[-1] >= len(df):
                df = np.concatenate((df, np.zeros(int(term[-1]) + 1 - len(df), np.int64)))
            df[term] += count
    terms = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df[terms])], ["term", "df"])


def weights(tokens: DataFrame, wide: int) -> tuple[np.ndarray, float]:
    """The idf of each id of the vocabulary (0: held by none) and the mean length of a row."""
    held = tokens.filter("terms IS NOT NULL").select("terms", "df")
    got = through_arrow(held, _frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, df = got.column(0).to_numpy(), got.column(1).to_numpy()
    rows, size = tokens.agg(F.count(F.lit(1)), F.sum(F.octet_length("ids"))).first()
    rows = max(1, rows)
    idf = np.zeros(int(term.max(initial=0)) + 1, np.float32)
    idf[term] = np.log(1 + (rows - df + 0.5) / (df + 0.5))
    return idf, (size or 0) / wide / rows


class Index:
    """BM25 over the rests of a shard."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean: float):
        self.rests, self.idf = rests, idf
        term, doc, n = _by_term(rests)
        known = idf[term] > 0
        term, self.doc, n = term[known], doc[known], n[known]
        size = np.fromiter(map(len, rests), float, len(rests))
        self.weight = idf[term] * n * (K1 + 1) / (n + (K1 * (1 - B + B * size / max(mean, 1.0)))[self.doc])
        self.first = np.searchsorted(term, np.arange(len(idf) + 1))
        self.used = np.zeros(len(rests), bool)

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused rests by falling score, then place."""
        t = np.unique(self.rests[seed])
        t = t[self.idf[t] > 0].astype(np.int64)
        begin, size = self.first[t], self.first[t + 1] - self.first[t]
        upto = np.cumsum(size)
        hits = np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - upto + size, size)
        score = np.bincount(self.doc[hits], self.weight[hits], len(self.used))
        score[self.used] = -1.0
        for few in (32, len(score)):
            best = np.argpartition(-score, few)[:few] if few < len(score) else np.arange(len(score))
            for i in best[np.lexsort((best, -score[best]))].tolist():
                if not self.used[i]:
                    yield i


def _powers(n: int) -> Iterator[int]:
    while n:
        p = 1 << (n.bit_length() - 1)
        yield p
        n -= p


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences count from 0."""
    sequence = 0
    cut = [len(d) // window * window for d in docs]
    for i, whole in enumerate(cut):
        for at in range(0, whole, window):
            yield i, at, window, sequence, 0
            sequence += 1
    of = [i for i, d in enumerate(docs) if len(d) > cut[i]]
    if not of:
        return
    rests = [docs[i][cut[i] :] for i in of]
    index = Index(rests, idf, mean)
    left = sum(map(len, rests))
    place, fresh = 0, 0  # how far the open rest is used; the first that may be unused
    seed = None
    sizes: Iterator[int] = iter(())
    while left:
        room = window if left >= window else next(sizes, 0)
        if not room:
            sizes = _powers(left)
            room = next(sizes)
        filled, near = 0, None
        while filled < room:
            if seed is None:
                if near is None:
                    while index.used[fresh]:
                        fresh += 1
                    seed = fresh
                else:
                    seed = next(near)
                index.used[seed], place = True, 0
            if near is None:
                near = index.neighbours(seed)
            n = min(room - filled, len(rests[seed]) - place)
            yield of[seed], cut[of[seed]] + place, n, sequence, filled
            filled, place = filled + n, place + n
            if place == len(rests[seed]):
                seed = None
        left -= room
        sequence += 1


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end: int = 2, ident: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The pieces of all documents; ``ids`` of a piece as little-endian unsigned 32-bit integers."""
    tokens = tokenized(docs, tokenizer, kind, end, ident, text)
    wide = 2 if max(vocabulary(tokenizer), end + 1) <= 1 << 16 else 4
    idf, mean = weights(tokens, wide)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        names, rows, size = [], [], 0
        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(x.as_buffer(), np.uint16 if wide == 2 else np.uint32)
                if rows and (len(rows) == SHARD_DOCS or size + len(ids) > SHARD_TOKENS):
                    yield names, rows
                    names, rows, size = [], [], 0
                names.append(name)
                rows.append(ids)
                size += len(ids)
        if rows:
            yield names, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 36
        for names, rows in shards(batches):
            got = list(pack_shard(rows, idf, mean, window))
            for at in range(0, len(got), 4096):
                doc, start, length, seq, offset = zip(*got[at : at + 4096], strict=True)
                ids = [rows[d][s : s + n].astype(np.uint32).tobytes() for d, s, n in zip(doc, start, length, strict=True)]
                cols = [[names[d] for d in doc], start, length, [len(rows[d]) for d in doc], [sequence + q for q in seq], offset]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            sequence += got[-1][3] + 1 if got else 0

    return through_arrow(tokens.select("doc_id", "ids"), run, PIECES)

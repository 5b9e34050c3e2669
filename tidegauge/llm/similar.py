"""The exact check behind SimHash candidates: the Jaccard similarity of whole sets of word shingles.

A text is the set of its distinct hashed shingles; texts of equal sets are one
node. Candidates, nodes that share a key, come from elsewhere (``simhash.candidates``).
Every link is confirmed on the whole sets.

In a bucket of candidates, all are first held against the least, then what is
still apart against one drawn by hash. What links have not joined by then meets
in groups of bounded size, where an inverted index counts the shingles that
sets share, and only links that join something leave a group. So a group of
thousands of near copies makes no row for each pair, and no candidate pair is
left out.

Defined results: null text, like text of blanks, has the empty set; a text
shorter than a shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored, through_arrow
from .components import components

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: Rows that leave a worker at once.
ROWS = 100
#: Nodes and shingles aimed at in a block of a bucket.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
SETS = "row long, fp long, n long, prints array<long>"


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The distinct hashed shingles, ascending; bytes.split and .lower know ASCII only, as for SimHash."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    first, last = [0, *(ends[: n - 1] + 1).tolist()], ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, n))


def near(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def sets(docs: DataFrame, row: str, text: str, prints: Callable[[np.ndarray], np.ndarray], width: int = SHINGLE) -> DataFrame:
    """row, fp (a hash of the set), n (its size), prints (its fingerprints) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                found = [shingles(t.as_py() or b"", width) for t in b.column(1).cast(pa.binary())]
                fps = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
                cols = [pa.array(fps), pa.array([len(s) for s in found], pa.int64()), pa.array([prints(s).view(np.int64) for s in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["row", "fp", "n", "prints"])

    return through_arrow(docs.select(F.col(row).alias("row"), F.col(text).alias("text")), run, SETS)


def _confirmed(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sets are similar; ``held`` has (fp, shingles) once a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = ([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(i)] for i in (2, 3))
            b = b.filter(pa.array([near(x, y, least) for x, y in zip(a, c, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"])

    both = pairs.join(held.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u").join(held.select(F.col("fp").alias("v"), F.col("shingles").alias("b")), "v")
    return stored(through_arrow(both.select("u", "v", "a", "b"), run, "u long, v long"), "similar-links")


def _held(texts: DataFrame, width: int) -> DataFrame:
    """fp, shingles of ``texts`` (fp, text), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                raw = [shingles(t.as_py() or b"", width).tobytes() for t in b.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["fp", "shingles"])

    return stored(through_arrow(texts.select("fp", "text"), run, "fp long, shingles binary"), "similar-sets")


def _first(term: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(term)), bool), term[1:] != term[:-1])))


def links_within(found: Sequence[np.ndarray], of: Sequence[int], least: float = LEAST) -> list[tuple[int, int]]:
    """Links that join what is similar among the sets ``found`` and not joined yet; ``of`` has a component for each.

    An inverted index counts what a set shares with all others at once. A set
    of the largest component needs no look: what it should join looks at it.
    """
    if len(found) == 2:
        return [(0, 1)] if of[0] != of[1] and near(*found, least) else []
    size = np.fromiter(map(len, found), np.int64, len(found))
    rows = np.repeat(np.arange(len(found)), size)
    terms = np.concatenate(found) if found else np.zeros(0, np.uint64)
    order = np.argsort(terms, kind="stable")
    rows, first = rows[order], _first(terms[order])
    number = np.empty(len(terms), np.int64)
    many = np.diff(np.concatenate((first, [len(terms)])))
    number[order] = np.repeat(np.arange(len(first)), many)
    upto, at = np.concatenate(([0], np.cumsum(size))), np.concatenate((first, [len(terms)]))
    _, root = np.unique(of, return_inverse=True)
    out = []
    for i in range(len(found)):
        if root[i] == np.bincount(root).argmax():
            continue
        t = number[upto[i] : upto[i + 1]]
        count = many[t]
        hits = np.arange(count.sum()) + np.repeat(at[t] - np.cumsum(count) + count, count)
        both = np.bincount(rows[hits], minlength=len(found))
        for j in np.flatnonzero((both >= least * (size[i] + size - both)) & (root != root[i])).tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def _within_buckets(rest: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Links (u, v) that join similar nodes of a bucket which ``rest`` (key, fp, n, c) has in different components.

    Each two nodes of a bucket meet in one group at least, and only a group's
    links leave it. Buckets of the same nodes count once. A bucket is dealt by
    hash into blocks, of about ``BLOCK`` nodes and ``BLOCK_SHINGLES`` shingles,
    and a group is two blocks, so memory is bounded however large a bucket is.
    """
    same = rest.groupBy("key").agg(F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("s"), F.count("fp").alias("m"), F.sum("n").alias("w"))
    once = same.groupBy("s", "m").agg(F.min("key").alias("key"), F.first("w").alias("w"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("w") / BLOCK_SHINGLES)).cast("int")
    dealt = rest.join(once.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("fp", "key"), "blocks").cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own")))
    dealt = dealt.select("key", "fp", "c", "own", F.explode(others).alias("other"))
    dealt = dealt.select("key", "fp", "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(held, "fp")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        last, held = None, []
        for b in batches:
            of = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            for name, *row in zip(of, b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
                if name != last and held:
                    yield tuple(zip(*held, strict=True))
                    held = []
                last = name
                held.append((row[0], row[1], np.frombuffer(row[2].as_buffer(), np.uint64)))
        if held:
            yield tuple(zip(*held, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, c, found in groups(batches):
            got = links_within(found, c, least)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([fp[i] for i, _ in got], pa.int64()), pa.array([fp[j] for _, j in got], pa.int64())], ["u", "v"])

    group = ["key", "i", "j"]
    dealt = dealt.select(*group, "fp", "c", "shingles").repartition(*group).sortWithinPartitions(*group)
    return stored(through_arrow(dealt, run, "u long, v long"), "similar-links")


def nodes(found: DataFrame) -> DataFrame:
    """fp, row, n, prints: each set of ``found``, as from sets(), once; the empty one is no node."""
    one = found.filter("n > 0").groupBy("fp").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("prints").alias("prints"))
    return stored(one, "similar-nodes")


def joined(one: DataFrame, dealt: DataFrame, texts: DataFrame, width: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """node, component (both fp) for each of the nodes ``one`` that links join to a smaller one.

    ``dealt`` (fp, n, key) has the candidates: nodes that share a key. ``texts`` (row, text) is what ``one`` was made of;
    sets are made again for candidates only, as they are larger than the texts.
    """
    shared = dealt.groupBy("key").count().filter("count > 1").select("key")
    dealt = stored(dealt.join(shared, "key"), "similar-buckets")
    rows = stored(one.select("fp", "row").join(dealt.select("fp").distinct(), "fp", "left_semi"), "similar-rows")
    held = _held(texts.join(small(rows, rows.count()), "row"), width)

    fits = (F.col("n") >= least * F.col("m")) & (F.col("m") >= least * F.col("n"))
    links, rest = None, dealt.withColumn("c", F.col("fp"))
    for pivot in (F.col("fp"), F.xxhash64("fp", "key")):
        least_of = rest.groupBy("key").agg(F.min(F.struct(pivot.alias("o"), F.col("fp").alias("p"), F.col("n").alias("m"), F.col("c").alias("pc"))).alias("x")).select("key", "x.*")
        pairs = rest.join(least_of, "key").filter((F.col("c") != F.col("pc")) & fits)
        more = _confirmed(pairs.select(F.least("fp", "p").alias("u"), F.greatest("fp", "p").alias("v")).distinct(), held, least)
        links = more if links is None else links.union(more)
        of = components(links)
        rest = dealt.join(of, dealt["fp"] == of["node"], "left").select("key", "fp", "n", F.coalesce("component", "fp").alias("c"))
        split = rest.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a <> b").select("key")
        rest = stored(rest.join(split, "key"), "similar-rest")
    return components(links.union(_within_buckets(rest, held, least)))

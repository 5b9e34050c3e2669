"""SimHash near duplicates: fingerprints, and a binary-trie self-join under a Hamming budget.

A fingerprint takes the majority of each bit over the hashes of all word
shingles of a text. Equal fingerprints are one node, so exact copies cost
nothing further. Nodes are dealt out by a quarter of their bits: two that
differ in at most three bits agree in one of four quarters. Within such a
bucket the sorted nodes are an implicit binary trie; pairs of trie nodes are
walked level by level, differing bits add up, and a pair is dropped as soon as
they exceed the budget. A bucket over ``hot`` nodes is dealt out again, by
quarters of its remaining bits, and once more. From each partition only a spanning forest of
its links leaves, so thousands of near copies make thousands of links, not
millions; a star algorithm then joins the forests.

``near_duplicates`` links texts by one fingerprint of equal votes. At a Jaccard
similarity of 0.8 that differs by ten of 64 bits, which no budget tells from
unlike texts, so ``representatives`` takes 22 more, in which few shingles have
most of the votes, each joined by the same trie under the same budget; an exact
check of the candidates follows (``similar.py``).

Defined results: null text, like text of blanks, has no words and fingerprint
zero; such texts link to each other and to any fingerprint of three bits or
fewer. Links join fingerprints, never ids: rows that share an id, or have none,
are apart unless their texts are near. An id only names a component; one without
any id is named null. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import small, stored, through_arrow
from .components import components

SEED, SHINGLE, BUDGET = 42, 3, 3
#: Shingles whose bits are unpacked at once, and trie-node pairs walked at once.
CHUNK, FRONTIER = 1 << 15, 1 << 17
#: Bits of a quarter of all 64 bits, of the 48 that are left, and of the 36 that are left then; rows of a task aimed at.
QUARTERS, TASK_ROWS = (16, 12, 9), 1 << 20
#: Weighted fingerprints of a set, votes that each shingle has in one, votes counted, and a vote's weight by that of the one before.
PRINTS, VOTES, LEAD, FALL = 22, 4, 32, 0.6
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, PRINTS, 1, VOTES), np.uint64) | np.uint64(1)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of UTF-8 ``text``; bytes.split and .lower know ASCII only, as wanted."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(x.astype(">u8")[..., None].view(np.uint8), axis=-1)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1).view(">u8")[..., 0].astype(np.uint64)


def prints(s: np.ndarray) -> np.ndarray:
    """SimHashes of the set ``s`` of hashed shingles: one of equal votes, then ``PRINTS`` of weighted ones.

    For each of these a hash orders the votes, and weights fall by ``FALL``
    from one to the next: sets that share the first few agree in most bits. A
    pair at a Jaccard similarity of 0.8 agrees to three bits in one of them
    with a probability of 0.38 at least, so all miss it three times in 100,000
    at most; one at 0.2 with 0.01 at most. Votes after the first ``LEAD`` weigh too little to count.
    """
    if not len(s):
        return np.zeros(1 + PRINTS, np.uint64)
    equal, first = np.zeros(64, np.int64), np.zeros((PRINTS, 0), np.uint64)
    for at in range(0, len(s), 1 << 12):
        part = s[at : at + (1 << 12)]
        equal += _bits(part).sum(0, dtype=np.int64)
        votes = ((part[:, None] ^ _ODD[1]) * _ODD[0]).reshape(PRINTS, -1)
        first = np.concatenate((first, votes), axis=1)
        if first.shape[1] > LEAD:
            first = np.partition(first, LEAD - 1, axis=1)[:, :LEAD]
    weights = FALL ** np.arange(first.shape[1])
    yes = np.einsum("v,pvb->pb", weights, _bits(_mixed(np.sort(first, axis=1))))
    return np.concatenate((_packed((equal * 2 > len(s))[None]), _packed(yes * 2 > weights.sum())))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        fps = [_signed(fingerprint(t.as_py() or b"")) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a signed long) for each row."""
    return through_arrow(docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")), _fingerprints, "id long, fp long")


class Zeros:
    """How many of the first i rows have a zero at a level of the trie, in a quarter of a byte a row."""

    def __init__(self, bits: np.ndarray, level: int):
        zero = np.packbits((bits >> np.uint64(63 - level)) & np.uint64(1) == 0, bitorder="little")
        self.words = np.concatenate((zero, np.zeros(16 - len(zero) % 8, np.uint8))).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def __call__(self, i: np.ndarray) -> np.ndarray:
        word, mask = self.words[i >> 6], (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(word & mask)


class Forest:
    """Union-find over 0..n-1 by whole arrays: roots are the smallest members."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def trie_links(keys: np.ndarray, bits: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Roots of the links among ``bits`` (uint64) that share a key; both sorted by key, then bits.

    A trie node is a range of rows that share a key and leading bits. The walk
    starts from each key's root paired with itself.
    """
    n = len(bits)
    forest = Forest(n)
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    lo, hi = cut[:-1], cut[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    zeros: dict[int, Zeros] = {}
    # A stack of frontiers: level, both ranges, differing bits so far. Depth first, so memory stays bounded.
    step = max(1, FRONTIER // 4)
    todo = [(0, lo[i : i + step], hi[i : i + step], lo[i : i + step], hi[i : i + step], np.zeros(len(lo[i : i + step]), np.int8)) for i in range(0, len(lo), step)]
    while todo:
        level, a0, a1, b0, b1, err = todo.pop()
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():  # two leaves: what is left of their bits is compared at once
            i, j = a0[single], b0[single]
            near = np.bitwise_count(bits[i] ^ bits[j]) <= budget
            near &= i != j
            forest.link(i[near], j[near])
            a0, a1, b0, b1, err = (x[~single] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        if level == 64:
            raise ValueError("rows of a key must differ")
        if len(a0) > step:
            half = len(a0) // 2
            todo += [(level, a0[:half], a1[:half], b0[:half], b1[:half], err[:half]), (level, a0[half:], a1[half:], b0[half:], b1[half:], err[half:])]
            continue
        if level not in zeros:
            zeros[level] = Zeros(bits, level)
        z = zeros[level]
        am, bm = a0 + z(a1) - z(a0), b0 + z(b1) - z(b0)
        own = (a0 == b0) & (a1 == b1)
        pairs = [(a0, am, b0, bm, err, None), (am, a1, bm, b1, err, None), (a0, am, bm, b1, err + 1, None), (am, a1, b0, bm, err + 1, ~own)]
        found = []
        for p0, p1, q0, q1, e, also in pairs:
            keep = (p1 > p0) & (q1 > q0) & (e <= budget) & ~((p0 == q0) & (p1 - p0 == 1) & (q1 - q0 == 1))
            if also is not None:
                keep &= also
            found.append([x[keep] for x in (p0, p1, q0, q1, e)])
        todo.append((level + 1, *(np.concatenate(x) for x in zip(*found, strict=True))))
    return forest.root


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition: each node to the first that its bucket's forest joins it to."""
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(2)] for b in batches if b.num_rows]
    if not parts:
        return
    key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
    bits = fp.view(np.uint64)
    order = np.lexsort((bits, key))
    order = order[np.concatenate(([True], (np.diff(key[order]) != 0) | (np.diff(fp[order]) != 0)))]
    key, bits, fp = key[order], bits[order], fp[order]
    root = trie_links(key, bits)
    linked = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["u", "v"])


def buckets(nodes: DataFrame, hot: int) -> DataFrame:
    """key, fp: each node once for each of its four 16-bit quarters. Nodes whose ``table``, if they have one, differs share no bucket.

    In buckets of over ``hot`` nodes, each node goes instead to four buckets by
    quarters of the bits that its bucket doesn't share. A key is a hash, and
    two buckets that it should join lose nothing by it.
    """
    table = F.col("table") if "table" in nodes.columns else F.lit(0)
    out, dealt = None, nodes.select("fp", table.cast("long").alias("key"), F.col("fp").alias("left"))
    for width in QUARTERS:
        low = lambda at: F.col("left").bitwiseAND(F.lit((1 << at) - 1).cast("long"))
        high = lambda at: F.shiftrightunsigned("left", at) if at < 64 else F.lit(0).cast("long")
        part = lambda q, w=width: F.shiftrightunsigned("left", w * q).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
        quarter = lambda q, w=width: F.struct(F.xxhash64("key", F.lit(q), part(q)).alias("key"), F.shiftleft(high(w * (q + 1)), w * q).bitwiseOR(low(w * q)).alias("left"))
        dealt = dealt.select("fp", F.explode(F.array(*[quarter(q) for q in range(4)])).alias("x")).select("fp", "x.*")
        done, full = dealt, 0
        if width != QUARTERS[-1]:
            keys = stored(dealt.groupBy("key").count().filter(F.col("count") > hot).select("key", F.lit(True).alias("full")), "simhash-full")
            full = keys.count()
            if full:
                marked = dealt.join(small(keys, full), "key", "left")
                done, dealt = marked.filter("full is null"), marked.filter("full")
        out = done.select("key", "fp") if out is None else out.union(done.select("key", "fp"))
        if not full:
            return out
    return out


def _joined(nodes: DataFrame, hot: int) -> DataFrame:
    """node, component (both fingerprints) for each of ``nodes`` (fp) that links join to a smaller one."""
    dealt = buckets(nodes, hot)
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt.count() // TASK_ROWS)
    return components(stored(through_arrow(dealt.repartition(tasks, "key"), _bucket_links, "u long, v long"), "simhash-links"))


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", hot: int = 50_000) -> DataFrame:
    """id, fp, component (the smallest id reachable by links) for each row."""
    fps = stored(fingerprints(docs, ident, text), "simhash")
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("id")), "simhash-nodes")
    joined = _joined(nodes, hot)
    joined = joined.union(joined.select("component", "component").distinct())
    named = joined.join(nodes, joined["node"] == nodes["fp"]).groupBy("component").agg(F.min("id").alias("name"))
    named = joined.join(named, "component").select("node", "name")
    of = nodes.join(named, nodes["fp"] == named["node"], "left").select("fp", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("name")).alias("component"))
    return fps.join(of, "fp").select("id", "fp", "component")


def candidates(one: DataFrame, hot: int = 50_000) -> DataFrame:
    """fp, n, key for each of the prints of ``one`` (fp, n, prints); what the trie joins in a print has one key."""
    dealt = one.select("fp", "n", F.posexplode("prints").alias("table", "print"))
    joined = _joined(stored(dealt.select("table", F.col("print").alias("fp")).distinct(), "simhash-prints"), hot)
    named = dealt.join(small(joined, joined.count()), dealt["print"] == joined["node"], "left")
    return named.select("fp", "n", F.xxhash64("table", F.coalesce("component", "print")).alias("key"))


def first_rows(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """row of the first of each component: by id, null last, then by what it holds.

    ``rows`` has (row, id, held, fp), ``joined`` (node, component) for each fp that isn't its component's name.
    """
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "held", "row")).alias("first"))
    named = first.join(joined, first["fp"] == joined["node"], "left").select(F.coalesce("component", "fp").alias("component"), "first")
    return named.groupBy("component").agg(F.min("first").alias("first")).select("first.row")


def representatives(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = similar.SHINGLE, least: float = similar.LEAST, hot: int = 50_000) -> DataFrame:
    """One row of ``docs`` of each group of texts whose shingles are similar, that with the least id; ids may repeat or be null.

    Candidates are of the trie, in one of 23 SimHashes; each link is confirmed on the whole sets of shingles.
    """
    names = docs.columns
    held = F.xxhash64(*names).alias("held")
    whole = stored(docs.select(F.struct(*names).alias("d"), F.monotonically_increasing_id().alias("row"), held), "simhash-rows", compression="zstd")
    texts = whole.select("row", F.col("d")[text].alias("text"))
    found = stored(similar.sets(texts, "row", "text", prints, width), "simhash-sets")
    rows = whole.select("row", F.col("d")[ident].cast("long").alias("id"), "held").join(found.select("row", "fp"), "row")
    rows = stored(rows, "simhash-held")
    one = similar.nodes(found)
    joined = similar.joined(one, candidates(one, hot), texts, width, least)
    return without(whole, rows, first_rows(rows, joined)).select("d.*")


def without(whole: DataFrame, rows: DataFrame, first: DataFrame) -> DataFrame:
    """``whole`` but for the ``rows`` that are not ``first``. Few of them are broadcast, so that no text is shuffled."""
    others = stored(rows.select("row").join(first, "row", "left_anti"), "simhash-others")
    return whole.join(small(others, others.count()), "row", "left_anti")

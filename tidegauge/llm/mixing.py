"""Mixing sources to target weights, by hash-threshold histograms.

Only DataFrame operations. Sizes are counted once into a slim table; from it
come the sum of each source, the targets, and for each source a histogram of
sizes over the leading bits of a hash. The bucket in which a source's budget
ends is refined by further bits until it is a single hash; a document is then
taken if its hash lies below its source's threshold. No document is sorted,
and thresholds are nested: a larger budget takes a superset.

Defined results: null or blank texts have size 0; null sources are one source,
ordered last; rows with an equal id hash alike and are taken alike; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, small, stored, word_count

#: Bits of a hash, and how many of them each level of the histogram resolves.
HASH_BITS, LEVELS = 60, (16, 16, 16, 12)


def id_hash(ident: Column) -> Column:
    """60 bits of MD5 of the id's text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """key, source_size, target for each key of ``sizes`` (key, size).

    Weights repeat over the keys in code-point order. ``share`` times the total
    is dealt out by weight; a target stops at ``most`` times its source's size
    and what is over goes to the others by weight. That fixed point is a water
    level: with the sources ordered by cap / weight, those before some place
    are full, and the rest stand at one level.
    """
    wheel = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    src = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy("key"))
    src = src.withColumn("w", F.get(wheel, (place - 1) % len(weights))).withColumn("cap", F.col("source_size") * most)
    src = src.withColumn("fill", F.col("cap") / F.col("w"))
    by_fill = W.orderBy("fill", "key")
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    src = (
        src.withColumn("place", F.row_number().over(by_fill))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()).cast("double") * share)
        .withColumn("level", (F.col("total") - before) / F.sum("w").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
    )
    fits = F.when(F.col("fill") >= F.col("level"), F.col("place"))
    src = src.withColumn("first", F.min(fits).over(W.partitionBy()))
    src = src.withColumn("at", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(W.partitionBy()))
    cap = F.col("cap").cast("double")
    return src.select("key", "source_size", F.coalesce(F.least(cap, F.col("w") * F.col("at")), cap).alias("target"))


def hash_thresholds(sizes: DataFrame, budgets: DataFrame, n_keys: int) -> DataFrame:
    """key, threshold: hashes below it sum up to a key's budget, to within the nearest hash.

    ``sizes`` has (key, size, h), ``budgets`` (key, budget). Each level sums
    sizes by key and the next bits of h, only within the bucket where the
    budget of the level before ended.
    """
    state = budgets.filter("budget > 0").select("key", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    used = 0
    for bits in LEVELS:
        rest = HASH_BITS - used - bits
        inside = sizes.join(small(state, n_keys), "key").filter(F.shiftright("h", HASH_BITS - used) == F.col("prefix"))
        hist = inside.groupBy("key", "budget", "below", F.shiftright("h", rest).alias("bucket")).agg(F.sum("size").alias("s"))
        upto = F.col("below") + F.sum("s").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        hist = hist.withColumn("upto", upto).withColumn("under", F.col("upto") - F.col("s"))
        edge = hist.filter("under < budget and budget <= upto")
        state = edge.select("key", "budget", F.col("bucket").alias("prefix"), F.col("under").alias("below"), "upto")
        used += bits
    whole = (F.col("upto") - F.col("budget")) <= (F.col("budget") - F.col("below"))
    return state.select("key", (F.col("prefix") + whole.cast("long")).alias("threshold"))


def _key(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))


def _copies() -> Column:
    return F.col("whole") + (F.col("h") < F.coalesce(F.col("threshold"), F.lit(0).cast("long"))).cast("long")


def limits(slim: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """key, source_size, target, whole, threshold: how often a source is taken whole, and the hash below which once more.

    ``slim`` has (key, size, h) and is read several times, so it should be stored. The result is made
    once, one row a source, and marked for broadcast if its count allows.
    """
    targets = kept(source_targets(slim, weights, share, most))
    n = targets.count()
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most).cast("long"))).otherwise(0)
    targets = targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    ends = hash_thresholds(slim.select("key", "size", "h"), targets.select("key", "budget"), n)
    return small(kept(targets.join(ends, "key", "left")), n)


def sizes(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(ident), key, size, h of each row, stored: all that the choice needs."""
    return stored(docs.select(F.col(ident), _key(source).alias("key"), word_count(F.col(text)).alias("size"), id_hash(F.col(ident)).alias("h")), "mix-sizes")


def mix(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(ident), size, source_size, target, copies: how often the mix takes each row of ``docs``."""
    slim = sizes(docs, ident, text, source)
    return slim.join(limits(slim, weights, share, most), "key").select(ident, "size", "source_size", "target", _copies().alias("copies"))


def take(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken. Texts are not shuffled."""
    ends = limits(sizes(docs, ident, text, source), weights, share, most)
    rows = docs.select(F.struct(*docs.columns).alias("row"), _key(source).alias("key"), id_hash(F.col(ident)).alias("h")).join(ends, "key")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), _copies().cast("int")))).select("row.*")

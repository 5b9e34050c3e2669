"""Alert states from predicates: gaps and islands over the instants of a history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATES = ("OK", "TRIGGERING", "FIRING", "UNKNOWN")
#: Instants to a stretch; see ``states``.
STRETCH = 4096


def states(rows: DataFrame, scrapes: DataFrame, for_ms: int, series: tuple[str, ...] = ("alert_key", "tags_key")) -> DataFrame:
    """``rows`` (ts, series, triggered: boolean, null for unknown) with start, state and for_ms.

    An alert goes on while what it says stays the same, unknown counting as
    triggered, and while every scrape says something about it; a scrape
    without it ends it. It fires once it has gone on for ``for_ms``.

    A series is cut into stretches of instants, so that a long one is many
    tasks: the beginnings of islands are found within stretches, and only one
    row a stretch carries them on to the next.
    """
    order = scrapes.select("ts").withColumn("place", F.row_number().over(W.orderBy("ts")))
    rows = rows.join(order, "ts").withColumn("says", F.coalesce("triggered", F.lit(True))).withColumn("stretch", F.floor(F.col("place") / STRETCH))
    # the row before is one instant earlier, perhaps in the stretch before: edges of stretches are looked up there
    inner = W.partitionBy(*series, "stretch").orderBy("place")
    rows = rows.withColumn("was", F.lag("says").over(inner)).withColumn("was_at", F.lag("place").over(inner))
    edge = rows.groupBy(*series, "stretch").agg(F.max_by("says", "place").alias("edge_says"), F.max("place").alias("edge_at")).withColumn("stretch", F.col("stretch") + 1)
    rows = rows.join(edge, [*series, "stretch"], "left")
    on = (F.coalesce("was_at", "edge_at") == F.col("place") - 1) & (F.coalesce("was", "edge_says") == F.col("says"))
    rows = rows.withColumn("begin", F.when(~F.coalesce(on, F.lit(False)), F.col("ts")))
    rows = rows.withColumn("own", F.max("begin").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    last = rows.groupBy(*series, "stretch").agg(F.max("begin").alias("last"))
    carried = last.withColumn("carried", F.max("last").over(W.partitionBy(*series).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))).drop("last")
    rows = rows.join(carried, [*series, "stretch"]).withColumn("start", F.coalesce("own", "carried"))
    lasted = F.unix_millis("ts") - F.unix_millis("start")
    state = F.when(F.col("triggered").isNull(), "UNKNOWN").when(F.col("triggered"), F.when(lasted >= for_ms, "FIRING").otherwise("TRIGGERING")).otherwise("OK")
    return rows.withColumn("state", state).withColumn("for_ms", F.lit(for_ms).cast("bigint")).drop("place", "says", "stretch", "was", "was_at", "edge_says", "edge_at", "begin", "own", "carried")

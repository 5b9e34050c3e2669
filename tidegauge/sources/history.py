"""A history: points and scrapes in Parquet, by date.

``append`` adds scrapes, ``compact`` rewrites dates into few sorted files,
``retain`` drops the oldest dates until a size is met. Reading prunes by date
and by statistics. Of groups stored twice for an instant the first is kept;
that takes a shuffle, so whether any append overlapped what was there is
recorded, and a history without overlaps is read as it is.

``compact`` writes the new tables beside the old ones, then a mark that both
are whole, then swaps them; who opens the history later completes a swap that
was broken off.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import POINTS, Dataset
from ..operators import lookback

# The default size of a file, in records.
MAX_RECORDS = 17_280 * 64
COMPRESSION = ("none", "gzip", "snappy", "lzo", "zstd")
_SERIES = ["ts", "group_key", "tags_key"]
SCHEMA = POINTS + ", batch bigint, date date"


class History:
    def __init__(self, spark: SparkSession, path: str, compression: str = "zstd", max_records: int = MAX_RECORDS):
        if compression not in COMPRESSION:
            raise ValueError(f"compression is one of {', '.join(COMPRESSION)}")
        self.spark, self.path = spark, path.rstrip("/")
        self.compression, self.max_records = compression, max_records

    @property
    def points_path(self) -> str:
        return f"{self.path}/points"

    @property
    def scrapes_path(self) -> str:
        return f"{self.path}/scrapes"

    @property
    def exists(self) -> bool:
        self._swap()
        fs, _ = self._fs(self.path)
        return fs.exists(self._path(self.points_path))

    def _dates(self, path: str) -> list[tuple[str, int]]:
        """Each date stored at ``path`` and its bytes, oldest first; only the folder is listed."""
        fs, at = self._fs(path)
        folders = [s.getPath() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []
        return sorted((p.getName().removeprefix("date="), fs.getContentSummary(p).getLength()) for p in folders if p.getName().startswith("date="))

    def newest(self, count: int = 1, before: datetime | None = None) -> list[datetime]:
        """Up to ``count`` of the last instants (before ``before``), last first, from as few of the newest dates as hold them."""
        self._swap()
        dates = [d for d, _ in self._dates(self.scrapes_path) if before is None or d <= str((before + timedelta(days=1)).date())]  # the session may be in another zone
        held = self.spark.read.schema("ts timestamp, date date").parquet(self.scrapes_path) if dates else None
        found, many = [], 1
        while dates and len(found) < count and many < 2 * len(dates):
            rows = held.filter(F.col("date") >= F.lit(dates[-min(many, len(dates))]).cast("date"))
            rows = rows.filter(F.col("ts") < F.lit(before)) if before is not None else rows
            found = [r[0] for r in rows.select("ts").distinct().orderBy(F.desc("ts")).limit(count).collect()]
            many *= 2
        return found

    def append(self, ds: Dataset, batch: int = 0) -> None:
        """Adds all scrapes of ``ds``; ``batch`` orders what is appended later after it."""
        if self.exists:
            newest = self.newest()
            oldest = ds.scrapes.agg(F.min("ts")).first()[0]
            if newest and oldest is not None and oldest <= newest[0]:
                self._mark(True)
        held = ds.points.withColumn("batch", F.lit(batch).cast("bigint")).withColumn("date", F.to_date("ts"))
        order = ["date", "ts", "group_key", "tags_key", "metric_key"]  # ranges, as many as the size asks for, so a date is many tasks
        self._write(held.repartitionByRange(*order).sortWithinPartitions(*order), self.points_path)
        self._write(ds.scrapes.select("ts", F.to_date("ts").alias("date")).coalesce(1), self.scrapes_path)

    @property
    def overlaps(self) -> bool:
        """Whether a scrape may be stored more than once."""
        fs, _ = self._fs(self.path)
        return fs.exists(self._path(f"{self.path}/overlaps"))

    def _mark(self, overlaps: bool) -> None:
        fs, at = self._fs(f"{self.path}/overlaps")
        if overlaps:
            fs.create(at, True).close()
        else:
            fs.delete(at, False)

    @property
    def alerts_path(self) -> str:
        return f"{self.path}/alerts"

    @property
    def has_alerts(self) -> bool:
        fs, _ = self._fs(self.path)
        return fs.exists(self._path(self.alerts_path))

    def append_alerts(self, alerts: DataFrame) -> None:
        self._write(alerts.withColumn("date", F.to_date("ts")).coalesce(1), self.alerts_path)

    def alerts(self, at: datetime) -> DataFrame:
        """The alerts of one scrape."""
        return self.spark.read.parquet(self.alerts_path).filter((F.col("date") == F.to_date(F.lit(at))) & (F.col("ts") == F.lit(at)))

    def _write(self, df: DataFrame, path: str, mode: str = "append") -> None:
        df.write.mode(mode).partitionBy("date").options(compression=self.compression, maxRecordsPerFile=self.max_records).parquet(path)

    def scan(self, begin: datetime | None = None, end: datetime | None = None) -> Dataset:
        """The scrapes in [begin, end], both inclusive; either may be open."""

        self._swap()

        def ranged(df: DataFrame) -> DataFrame:
            if begin is not None:
                df = df.filter((F.col("date") >= F.to_date(F.lit(begin))) & (F.col("ts") >= F.lit(begin)))
            if end is not None:
                df = df.filter((F.col("date") <= F.to_date(F.lit(end))) & (F.col("ts") <= F.lit(end)))
            return df

        points = ranged(self.spark.read.schema(SCHEMA).parquet(self.points_path))
        scrapes = ranged(self.spark.read.schema("ts timestamp, date date").parquet(self.scrapes_path)).select("ts").distinct()
        return Dataset((first_wins(points) if self.overlaps else points).drop("batch", "date"), scrapes)

    def reversed(self, begin: datetime | None = None, end: datetime | None = None) -> DataFrame:
        return self.scan(begin, end).points.orderBy(F.desc("ts"), "group_key", "metric_key")

    def group(self, group_key: str, tags_key: str = "[]", begin: datetime | None = None) -> DataFrame:
        """One group's points in order of time; name and tags are filters that reach the scan."""
        return self.scan(begin).points.filter((F.col("group_key") == group_key) & (F.col("tags_key") == tags_key)).orderBy("ts", "metric_key")

    def stepped(self, step_ms: int, begin: datetime | None = None, end: datetime | None = None) -> Dataset:
        ds = self.scan(begin, end)
        instants = lookback.stepped(ds.scrapes, step_ms)
        return Dataset(ds.points.join(instants, "ts", "left_semi"), instants)

    def catalog(self) -> DataFrame:
        """file, begin, end, points, bytes of each file, by end."""
        self._swap()
        files = self.spark.read.schema(SCHEMA).parquet(self.points_path)
        meta = files.select("ts", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return meta.groupBy("file", "bytes").agg(F.min("ts").alias("begin"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("points")).select("file", "begin", "end", "points", "bytes").orderBy("end", "file")

    def compact(self) -> None:
        """Rewrites the history with points of a series together within a date, in ranges as many as the size asks for."""
        self._swap()
        held = self.spark.read.schema(SCHEMA).parquet(self.points_path)
        held = first_wins(held) if self.overlaps else held
        order = ["date", "group_key", "metric_key", "tags_key", "ts"]
        scrapes = self.spark.read.schema("ts timestamp, date date").parquet(self.scrapes_path).distinct()
        self._write(held.repartitionByRange(*order).sortWithinPartitions(*order), f"{self.path}/.points.new", "overwrite")
        self._write(scrapes.coalesce(1), f"{self.path}/.scrapes.new", "overwrite")
        fs, at = self._fs(f"{self.path}/.swap")
        fs.create(at, True).close()
        self._swap()

    def _swap(self) -> None:
        """Puts compacted tables in place if a mark says that they are whole. May be repeated from any point on."""
        fs, mark = self._fs(f"{self.path}/.swap")
        if not fs.exists(mark):
            return
        for name in ("points", "scrapes"):
            new, old, at = (self._path(f"{self.path}/{x}") for x in (f".{name}.new", f".{name}.old", name))
            if fs.exists(new):
                if fs.exists(at):
                    fs.delete(old, True)
                    fs.rename(at, old)
                if not fs.rename(new, at):
                    raise OSError(f"could not replace {at}")
            fs.delete(old, True)
        self._mark(False)
        fs.delete(mark, False)

    def retain(self, max_bytes: int) -> list[str]:
        """Drops the oldest dates until the points take at most ``max_bytes``; returns the dates dropped. The newest date stays."""
        self._swap()
        fs, _ = self._fs(self.path)
        dates = self._dates(self.points_path)
        total, dropped = sum(n for _, n in dates), []
        for name, n in dates[:-1]:
            if total <= max_bytes:
                break
            for at in (self.points_path, self.scrapes_path):
                fs.delete(self._path(f"{at}/date={name}"), True)
            total -= n
            dropped.append(name)
        return dropped

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        at = self._path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at


def first_wins(points: DataFrame) -> DataFrame:
    """Of a group stored more than once for an instant, the points of the earliest batch."""
    first = points.groupBy(*_SERIES).agg(F.min("batch").alias("batch"))
    return points.join(first, [*_SERIES, "batch"], "left_semi").dropDuplicates([*_SERIES, "metric_key"])


def last_wins(points: DataFrame, order: str = "batch") -> DataFrame:
    """Within one collection, the points of a group's latest occurrence."""
    last = points.groupBy(*_SERIES).agg(F.max(order).alias(order))
    return points.join(last, [*_SERIES, order], "left_semi").dropDuplicates([*_SERIES, "metric_key"])


def convert(source: History, target: History) -> None:
    """Re-encodes a history into another place or compression, in order of time."""
    target.append(source.scan())

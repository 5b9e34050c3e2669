"""Token ids in Parquet list columns, for selective reads of ids and of metadata.

Rows are range-partitioned by id and sorted, so files and rows ascend. The ids
column is dictionary-encoded (a vocabulary fits one dictionary page), the long
columns delta-encoded; row groups, pages and rows a page are limited, and
column and offset indexes let a reader skip to the pages of a few documents.
A row holds its offset within its file; the offsets of files, one row each,
turn that into an offset in the whole corpus.

Defined results: null text is an empty text: just the end id. Null ids come
first. Rows with an equal id stand next to each other, in the order read. An
empty table makes an empty file set. Further columns are not
written.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, small, through_arrow
from .encoding import encoder

SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
#: As written: no id is null, which spares the files a level of each id.
WRITTEN = T.StructType().add("part", "integer").add("doc_id", "long").add("local_start", "long").add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType(), containsNull=False))
LAYOUT = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}


def write(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", end: int = 2, ident: str = "doc_id", text: str = "text") -> None:
    """Write the ids of each row's text, and ``end``, to ``path`` in ascending order of ``ident``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer, kind, end), TaskContext.get().partitionId(), 0
        for b in batches:
            for first, last, ids, offsets in enc.encode(b.column(1)):
                n = last - first
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
                cols = [pa.array(np.full(n, part), pa.int32()), b.column(0).slice(first, n), pa.array(at + offsets[:-1]), pa.array(np.diff(offsets)), lists]
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "local_start", "n_tokens", "ids"])
                at += int(offsets[-1])

    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("at"))
    order = ["doc_id", "at"]  # rows repeated without end still spread over partitions
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    through_arrow(rows, run, WRITTEN).write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of the files at ``path``; columns not asked for are not read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = parts.select("part", before.alias("before"))
    out = files.join(small(parts, len(files.inputFiles())), "part")
    return out.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(b.schema.get_field_index("ids"))
        at = lists.offsets.to_numpy()
        raw = memoryview(lists.values.to_numpy()).cast("B")
        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, counted and summed over the ids themselves."""
    return through_arrow(read_back.select("doc_id", "start", "ids"), _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def corpus_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidegauge/tokens-{uuid.uuid4().hex}"

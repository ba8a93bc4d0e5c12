"""Token ids as Parquet list columns with controlled encodings, row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenotide.llm.common import TEXT_AT_ONCE, text_of
from phenotide.llm.tokens import encoded_slices, flat, lists

#: Bytes of a row group and of a page. Small pages make the page index selective.
ROW_GROUP = 32 << 20
PAGE = 64 << 10
#: What goes to a Python worker at a time, by rows and by bytes: whole texts wait beside sorters and writers.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(8192), "spark.sql.execution.arrow.maxBytesPerBatch": str(TEXT_AT_ONCE)}


def _encoder(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch, encoded in encoded_slices(batches, path):
            ids = [x + end for x in encoded]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = total + np.cumsum(n) - n
            total += int(n.sum())
            columns = [batch.column("_key"), batch.column("_shard"), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), lists(ids)]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "shard", "shard_start", "n_tokens", "ids"])

    return encode


def write_tokens(
    docs: DataFrame,
    folder: str,
    path: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    row_group: int = ROW_GROUP,
    page: int = PAGE,
    delta: tuple[str, ...] = ("shard_start",),
) -> None:
    """Write one row per document in ascending order of its key: shard, key, shard_start, n_tokens, ids.

    Files are ranges of the key, sorted; equal keys are ordered by a digest of their text, nulls come
    first. Ids are dictionary-encoded, the columns in `delta` are delta-encoded (page version 2), and
    pages carry column and offset indexes, so that a reader of a key range or of the numbers alone
    skips the pages of other ids. A null text has the end id alone.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"))
    order = [F.col("_key").asc_nulls_first(), F.xxhash64("_text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_shard", F.spark_partition_id())
    schema = T.StructType(
        [
            T.StructField("_key", kind),
            *(T.StructField(name, kind_) for name, kind_ in (("shard", T.IntegerType()), ("shard_start", T.LongType()), ("n_tokens", T.LongType()))),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )
    tokens = ranged.mapInArrow(_encoder(path, end_id), schema).withColumnRenamed("_key", key)
    writer = tokens.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
    for column in delta:
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    spark = docs.sparkSession
    usual = {name: spark.conf.get(name) for name in BATCH}
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    try:
        writer.option("parquet.block.size", row_group).option("parquet.page.size", page).parquet(folder)
    finally:
        for name, value in usual.items():
            spark.conf.set(name, value)


def read_tokens(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("shard", "doc_id", "shard_start", "n_tokens", "ids")) -> DataFrame:
    """The stored rows; only the pages of the named columns are read."""
    return spark.read.parquet(folder).select(*columns)


def with_start(tokens: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """The rows with start, the number of ids of all documents before: the sum of earlier shards and shard_start.

    The totals come from the number columns alone. There is one total per shard, which is a file of texts
    sorted in one task, so that their running sum is small and is broadcast: the ids are not shuffled for it.
    """
    from pyspark.sql import Window

    totals = spark.read.parquet(folder).groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = tokens.join(F.broadcast(bases), F.col("shard") == F.col("_shard"))
    return joined.withColumn("start", F.col("_base") + F.col("shard_start")).drop("_shard", "_base", "_n")


def crc32_of_ids(ids):
    """Column of the unsigned CRC-32 of a list column's ids as little-endian unsigned 32-bit integers."""
    return _crc32(ids)


@F.arrow_udf(T.LongType())
def _crc32(column: pa.Array) -> pa.Array:
    ends, ids = flat(column)
    raw = memoryview(np.ascontiguousarray(ids, "<i4").view(np.uint8))
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64())

"""Packing by power-of-two decomposition: every piece of a document is a sequence of its own."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenotide.llm.common import text_of
from phenotide.llm.tokens import encoded_slices, lists


def piece_lengths(n: int, longest: int) -> list[int]:
    """n tokens as full pieces and the powers of two of the rest, long ones first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cutter(path: str, end_id: int, longest: int, key_type: pa.DataType):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, encoded in encoded_slices(batches, path, rows=64):
            source, starts, lengths, pieces, sums, totals = [], [], [], [], [], []
            for row, ids in enumerate(encoded):
                ids += end
                at = 0
                for length in piece_lengths(len(ids) // 4, longest):
                    source.append(row)
                    starts.append(at)
                    lengths.append(length)
                    pieces.append(ids[4 * at : 4 * (at + length)])
                    sums.append(zlib.crc32(pieces[-1]))
                    totals.append(len(ids) // 4)
                    at += length
            keys = batch.column("_key").take(pa.array(source, pa.int32())).cast(key_type)
            numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, totals, sums)]
            yield pa.RecordBatch.from_arrays([keys, *numbers, lists(pieces)], ["_key", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    return cut


def pack(docs: DataFrame, path: str, end_id: int, longest: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids, ids_crc32, doc_tokens, bucket, sequence_id and offset.

    longest is a power of two. A document's ids, with end_id behind them, are cut into pieces whose
    lengths are powers of two, so that a sequence never crosses documents and needs no padding; bucket
    is the power, by which pieces of equal length can be batched (write_buckets). ids_crc32 is the unsigned
    checksum of the ids as little-endian unsigned 32-bit integers. sequence_id is unique, offset is always 0.
    Other columns are left out. A null or empty text is the one piece of the end id. Repeated rows and null
    keys are documents of their own. Texts are cut where they lie: no shuffle at all.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"))
    schema = f"_key {kind.simpleString()}, start long, length long, doc_tokens long, ids_crc32 long, ids array<int>"
    from pyspark.sql.pandas.types import to_arrow_type

    pieces = rows.mapInArrow(_cutter(path, end_id, longest, to_arrow_type(kind)), schema)
    return pieces.select(
        F.col("_key").alias(key),
        "start",
        "length",
        "ids",
        "ids_crc32",
        "doc_tokens",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces as Parquet, a folder per length, for batches of equal sequences."""
    pieces.write.partitionBy("bucket").parquet(path)

"""What several operators share: tables, shared storage and batches of rows."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenotide.functions.names import literal_col

#: Rows that a Python worker turns into Python objects at a time.
ROWS_AT_ONCE = 256
#: Bytes of text that a worker takes at a time to encode their distinct words once: more repeat in more text.
TEXT_AT_ONCE = 16 << 20
#: Rows of a table of known size that go to a file.
ROWS_PER_FILE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a session on one machine takes a temporary one, as in tests; on a cluster
    that is an error, as each executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='llm-')}"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows written to the shared folder and read again: cut lineage that outlives executors.

    rows: how many the last step takes, at most, where that is known; it is done in as few tasks as that
    calls for, so that a small table is not dealt out over as many files as there are shuffle partitions.
    """
    path = shared_folder(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text"):
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices_of_text(batches: Iterator[pa.RecordBatch], column: str = "_text", most: int = TEXT_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of about that many bytes of a text column without nulls, each of a row at least."""
    for batch in batches:
        lengths = np.asarray(pc.binary_length(batch.column(column))).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            if end > at:
                yield batch.slice(at, end - at)


def set_aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with every column but the needed ones under a working name, and the way back to their columns.

    An operator between the two cannot clash with the names of columns that are none of its business. The
    way back takes the names of the columns that the operator added; of docs it replaces those of these names.
    """
    working = {c: c if c in needed else f"_own_{i}" for i, c in enumerate(docs.columns)}
    apart = docs.select(*(literal_col(c).alias(w) for c, w in working.items()))

    def back(found: DataFrame, *added: str) -> DataFrame:
        own = [literal_col(w).alias(c) for c, w in working.items() if c not in added]
        return found.select(*own, *(literal_col(c) for c in added))

    return apart, back

"""Sinks. Spark writes one file per task, so a path is a folder of parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(
    df: DataFrame, path: str, only_if_absent: bool = False, partition_by: Sequence[str] = ()
) -> None:
    """Write Parquet; with ``only_if_absent`` data already stored at ``path`` stays as it is.

    ``partition_by`` stores one folder per value, such as ``["chrom"]`` for genotypes.
    """
    df.write.mode(_mode(only_if_absent)).partitionBy(*partition_by).parquet(path)


def write_bucketed(df: DataFrame, table: str, by: Sequence[str], buckets: int, path: str | None = None) -> None:
    """Write a catalog table in ``buckets`` buckets of the columns ``by``, stored as whole numbers, sorted within.

    Tables with the same number of buckets of the same columns are joined on these without a
    shuffle. About as many buckets as the larger table has blocks of 128 MB keep tasks even. Rows are
    brought together by bucket first, so that each is one file. ``path`` makes an external table.
    """
    whole = df.withColumns({name: F.col(name).cast("long") for name in by})
    writer = whole.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by)
    (writer.option("path", path) if path else writer).format("parquet").saveAsTable(table)


def write_csv(df: DataFrame, path: str, only_if_absent: bool = False) -> None:
    """Write comma-separated text with a header and no index column."""
    df.write.mode(_mode(only_if_absent)).csv(path, header=True)


def write_column_dictionary(
    spark: SparkSession, fields: Mapping[str, str], path: str, only_if_absent: bool = False
) -> None:
    """Write the column dictionary of a table: header ``Code``, ``Description``, tab-separated.

    ``fields`` is schema metadata (see ``resolve_fields``); one part keeps its order.
    """
    rows = spark.createDataFrame(list(fields.items()), "Code string, Description string")
    rows.coalesce(1).write.mode(_mode(only_if_absent)).csv(
        path, sep="\t", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def _mode(only_if_absent: bool) -> str:
    return "ignore" if only_if_absent else "overwrite"

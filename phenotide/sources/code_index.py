"""Stored lists of the distinct codes of a table, by which patterns become exact filters."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenotide.functions.codes import contains_any
from phenotide.functions.names import literal_col

#: Codes that a pattern may stand for; a pattern that finds more stays a pattern.
MOST = 10_000


class CodeIndex:
    """The distinct codes of some columns: ``column``, ``code``, ``entries``.

    A vocabulary has far fewer codes than a table has rows, so a pattern is judged once per code, and what it
    finds is an equality filter that a Parquet scan takes. Results are those of the pattern.
    """

    def __init__(self, codes: DataFrame, most: int = MOST):
        self.codes = codes
        self.most = most
        self._found: dict[tuple[str, tuple[str, ...]], list[str] | None] = {}

    @classmethod
    def of(cls, table: DataFrame, columns: Sequence[str], most: int = MOST) -> CodeIndex:
        """The index of a table as it is now."""
        return cls(distinct_codes(table, columns), most)

    def condition(self, column: str, patterns: Sequence[str]) -> Column:
        """True where ``column`` contains a match of any pattern: an equality filter unless too many codes match.

        Looks the codes up at once; at most ``most`` reach the driver. Equality of no code is false.
        """
        codes = self.matching(column, patterns)
        return contains_any(F.col(column), patterns) if codes is None else F.col(column).isin(codes)

    def matching(self, column: str, patterns: Sequence[str]) -> list[str] | None:
        """The codes of a column that any pattern finds, sorted; ``None`` if there are more than ``most``."""
        key = column, tuple(patterns)
        if key not in self._found:
            judged = self.codes.where((F.col("column") == column) & contains_any(F.col("code"), patterns))
            found = sorted(r.code for r in judged.select("code").limit(self.most + 1).collect())
            self._found[key] = found if len(found) <= self.most else None
        return self._found[key]

    def counts(self, column: str, patterns: Sequence[str]) -> DataFrame:
        """How many entries of the table each matching code has, without reading the table."""
        return self.codes.where((F.col("column") == column) & contains_any(F.col("code"), patterns)).select("code", "entries")


def distinct_codes(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``code``, ``entries`` of the given columns in one pass; counts are combined before the shuffle."""
    codes = F.array(*[F.struct(F.lit(name).alias("column"), literal_col(name).cast("string").alias("code")) for name in columns])
    each = table.select(F.inline(codes)).where(F.col("code").isNotNull())
    return each.groupBy("column", "code").agg(F.count("*").alias("entries"))


def write_code_index(table: DataFrame, columns: Sequence[str], path: str) -> None:
    """Store the codes of a stored table, sorted, with a digest of the files they were read from."""
    codes = distinct_codes(table, columns).withColumn("files", F.lit(files_digest(table)))
    codes.repartition(1).sortWithinPartitions("column", "code").write.mode("overwrite").parquet(path)


def read_code_index(spark: SparkSession, path: str, table: DataFrame, most: int = MOST) -> CodeIndex | None:
    """The stored index of a table; ``None`` if there is none or if the table's files are no longer those indexed."""
    try:
        stored = spark.read.schema("column string, code string, entries long, files string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    first = stored.select("files").first()
    if first is None or first.files != files_digest(table):
        return None
    return CodeIndex(stored.drop("files"), most)


def files_digest(table: DataFrame) -> str:
    """Digest of the names of a table's files, which Spark's writers never use twice."""
    return hashlib.sha256("\n".join(sorted(table.inputFiles())).encode()).hexdigest()

"""What the footers of Parquet files tell about stored tables, without reading their data."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenotide.functions.names import literal_col
from phenotide.operators.fields import column_null_profile

# Settings under which Spark answers counts from footers, one task per group of files.
FOOTER_SETTINGS = {
    "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text",
    "spark.sql.parquet.aggregatePushdown": "true",
}
#: Columns counted at a time.
COLUMNS_AT_ONCE = 512


def stored_null_profile(spark: SparkSession, path: str) -> DataFrame:
    """Nulls (and NaN) per column of a stored table: ``column``, ``nulls``, as ``column_null_profile``.

    Footers are read at once, by tasks; one number per column comes back. They do not tell NaN, so
    floating-point columns are scanned, as are partition columns and every column of a table with
    nested ones or with footers that lack a count. Only the scanned columns are read, and lazily.
    """
    table = spark.read.parquet(path)
    entries, known = footer_counts(spark, path)
    told = spark.createDataFrame([(name, entries - n) for name, n in known.items()], "column string, nulls long")
    rest = [name for name in table.columns if name not in known]
    return told.unionByName(column_null_profile(table.select(*[literal_col(name) for name in rest]))) if rest else told


def drop_all_null_stored(spark: SparkSession, path: str) -> DataFrame:
    """A stored table without the columns that hold no value at all."""
    table = spark.read.parquet(path)
    entries = table.count()
    empty = {r.column for r in stored_null_profile(spark, path).where(F.col("nulls") == entries).collect()}
    return table.select(*[literal_col(name) for name in table.columns if name not in empty])


def footer_counts(spark: SparkSession, path: str) -> tuple[int, dict[str, int]]:
    """The rows of a stored table, and the entries that are not null of each column whose footers tell them."""
    own = spark.newSession()
    for name, value in FOOTER_SETTINGS.items():
        own.conf.set(name, value)
    files = own.read.option("recursiveFileLookup", "true").parquet(path)  # without partition columns
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for f in files.schema):
        return 0, {}
    names = [f.name for f in files.schema if not isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    entries, known = 0, {}
    for first in range(0, len(names), COLUMNS_AT_ONCE):
        some = names[first : first + COLUMNS_AT_ONCE]
        counts = files.agg(F.count(F.lit(1)), *[F.count(literal_col(name)) for name in some])
        if not _from_footers(counts):
            return 0, {}
        try:
            entries, *found = [n or 0 for n in counts.first()]  # null without any rows
        except (PySparkException, Py4JJavaError) as error:
            if FOOTER_LACKS in str(error):
                return 0, {}
            raise
        known |= dict(zip(some, found))
    return entries, known


# Fixed value: what Spark says of a footer without the number of nulls.
FOOTER_LACKS = "spark.sql.parquet.aggregatePushdown"


def _from_footers(counts: DataFrame) -> bool:
    """Whether the plan takes the counts from footers."""
    return "PushedAggregation: [COUNT" in counts._jdf.queryExecution().executedPlan().toString()

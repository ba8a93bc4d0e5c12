"""Text sources: tab-separated tables, code lists, headerless tables, reports, score files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: name of the code column in trait lists and column dictionaries.
CODE = "Code"


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Tab-separated table with a header, no quoting; all text unless a DDL ``schema`` is given."""
    return _table(spark, path, schema, sep="\t", header=True, quote="", enforceSchema=False)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Comma-separated table with a header; all text unless a DDL ``schema`` is given."""
    return _table(spark, path, schema, header=True, enforceSchema=False)


def read_headerless_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated table without a header; ``schema`` names and types its columns."""
    return _table(spark, path, schema, header=False)


def _table(spark: SparkSession, path: str, schema: str | None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_trait_list(spark: SparkSession, path: str) -> DataFrame:
    """A trait list: a tab-separated table if its first line holds a tab, else one code per line.

    Reads the first line at once, as it decides the schema.
    """
    first = spark.read.text(path).first()
    if first is not None and "\t" in first.value:
        return read_tsv(spark, path)
    return spark.read.text(path).select(F.col("value").alias(CODE))


def read_report(spark: SparkSession, path: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns of a report with a header line and columns separated by any run of blanks.

    ``columns`` maps a header name to (new name, type). The header is read by the query itself: no job
    runs while the plan is built, and a name that it lacks is an error when rows are read.
    """
    first = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''").limit(1)
    header = F.split(first.scalar(), r"\s+")
    return _blank_separated(spark, path).select(
        *[_named_field(header, name).cast(kind).alias(new) for name, (new, kind) in columns.items()]
    )


def _named_field(header: Column, name: str) -> Column:
    place = F.array_position(header, name)
    absent = F.raise_error(F.lit(f"the report has no column {name!r}")).cast("string")
    return F.when(place == 0, absent).otherwise(F.get("fields", (place - 1).cast("int")))


def _blank_separated(spark: SparkSession, path: str) -> DataFrame:
    """The lines but for the header, split at blanks as ``fields``.

    Only the first line of a file is its header; an equal line further on is data.
    """
    # One column that no separator splits; the reader leaves the first line out.
    lines = _table(spark, path, "value string", sep="\x01", quote="", header=True)
    return lines.where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("fields"))


def read_score_report(spark: SparkSession, path: str) -> DataFrame:
    """``eid`` and ``score`` of a scoring report (header names are fixed values)."""
    return read_report(spark, path, {"FID": ("eid", "long"), "SCORE": ("score", "double")})


def read_score_file(spark: SparkSession, path: str) -> DataFrame:
    """Score weights: one header line, then chromosome, position, other allele, effect allele, weight.

    Text that is no number, such as a chromosome X, becomes null.
    """
    types = {"chrom": "int", "pos": "long", "other_allele": "string", "effect_allele": "string", "weight": "double"}
    lines = _blank_separated(spark, path)
    return lines.select(*[F.get("fields", i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(types.items())])


def read_column_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Column names and titles (``name``, ``title``) of a stored table."""
    return read_tsv(spark, path).select(F.col(CODE).alias("name"), F.col("Description").alias("title"))

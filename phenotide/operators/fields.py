"""Field lookup, column extraction and column profiles of wide tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenotide.functions.logic import any_of
from phenotide.functions.names import base_field, field_pattern, literal_col, natural_keys

KEY = "eid"
# Columns counted by one aggregate: expressions of many more take minutes to compile.
COLUMNS_AT_ONCE = 128


def fields_for_id(dictionary: DataFrame, field_id: str | int) -> DataFrame:
    """Dictionary rows (name, title) of a field's instance and array columns, in natural order."""
    return _in_natural_order(dictionary.where(F.col("name").rlike(field_pattern(str(field_id)))))


def fields_by_title_keyword(dictionary: DataFrame, keyword: str) -> DataFrame:
    """Dictionary rows whose title contains ``keyword`` in any case, in natural order."""
    return _in_natural_order(dictionary.where(_title_contains(keyword)))


def field_names_for_id(dictionary: DataFrame, field_id: str | int) -> DataFrame:
    return fields_for_id(dictionary, field_id).select("name")


def field_names_by_title_keyword(dictionary: DataFrame, keyword: str) -> DataFrame:
    return fields_by_title_keyword(dictionary, keyword).select("name")


def field_titles_by_title_keyword(dictionary: DataFrame, keyword: str) -> DataFrame:
    return fields_by_title_keyword(dictionary, keyword).select("title")


def _title_contains(keyword: str) -> Column:
    return F.lower("title").contains(keyword.lower())


def _in_natural_order(fields: DataFrame) -> DataFrame:
    keys = natural_keys(F.col("name"))
    return fields.select("name", "title", *keys).orderBy("stem", "field", "instance", "array", "name").drop("stem")


def resolve_fields(
    dictionary: DataFrame,
    columns: Sequence[str],
    codes: Sequence[str],
    search_terms: Sequence[str] = (),
) -> dict[str, str]:
    """Name -> title of the requested fields, in the order of ``columns``.

    A code is a column name or a field number, which stands for all its instance and array columns.
    This is schema metadata: at most one dictionary row per column reaches the driver.
    """
    listed = [str(code) for code in codes]
    wanted = [F.col("name").isin(listed), base_field(F.col("name")).isin(listed)] if listed else []
    wanted += [_title_contains(term) for term in search_terms]
    if not wanted:
        return {}
    present = dictionary.where(F.col("name").isin(list(columns)) & any_of(wanted))
    titles = {row.name: row.title for row in present.groupBy("name").agg(F.min("title").alias("title")).collect()}
    return {name: titles[name] for name in columns if name in titles}


def extract_fields(
    df: DataFrame,
    dictionary: DataFrame,
    codes: Sequence[str],
    search_terms: Sequence[str] = (),
    use_descriptions: bool = False,
) -> DataFrame:
    """The requested columns of a wide table, in table order, on request renamed to their titles."""
    fields = resolve_fields(dictionary, df.columns, codes, search_terms)
    chosen = df.select(*[literal_col(name) for name in fields])
    return rename_to_titles(chosen, fields) if use_descriptions else chosen


def rename_to_titles(df: DataFrame, titles: Mapping[str, str]) -> DataFrame:
    """Rename columns to their titles; the participant key keeps its name."""
    renames = {name: title for name, title in titles.items() if name != KEY and name in df.columns}
    names = [renames.get(name, name) for name in df.columns]
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise ValueError(f"several columns would be called {repeated}")
    return df.withColumnsRenamed(renames)


def append_fields(
    existing: DataFrame, df: DataFrame, names: Sequence[str], titles: Mapping[str, str] | None = None
) -> DataFrame:
    """``existing`` plus those columns ``names`` of ``df`` it does not hold, matched by participant.

    With ``titles`` the added columns get their titles, and a column held under its title counts as held.
    """
    titles = titles or {}
    held = set(existing.columns)
    new = [name for name in dict.fromkeys(names) if name not in held and titles.get(name) not in held]
    if not new:
        return existing
    added = df.select(KEY, *[literal_col(name) for name in new])
    return existing.join(rename_to_titles(added, titles), KEY, "left")


def column_null_profile(df: DataFrame) -> DataFrame:
    """Nulls (and NaN) per column: ``column``, ``nulls``.

    Columns are counted in groups of bounded size, each of which reads its own columns alone. Columns of
    a table without rows have 0 nulls. Of a stored table, ``sources.footers`` counts without reading data.
    """
    names = F.array(*[F.lit(name) for name in df.columns])
    return _null_counts(df).select(F.get(names, "position").alias("column"), "nulls")


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value at all.

    The schema depends on the data, so this runs at once; one small row per column reaches the driver. A
    table without rows loses every column, as each of them has as many nulls as rows.
    """
    found = _null_counts(df).where(F.col("nulls") < F.col("entries")).select("position")
    kept = {row.position for row in found.collect()}
    return df.select(*[literal_col(name) for i, name in enumerate(df.columns) if i in kept])


def _null_counts(df: DataFrame) -> DataFrame:
    """For each position of a column its missing entries and all its entries."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    kinds = [field.dataType for field in df.schema]
    parts = []
    for first in range(0, len(kinds), COLUMNS_AT_ONCE):
        own = range(first, min(first + COLUMNS_AT_ONCE, len(kinds)))
        present = plain.agg(F.count(F.lit(1)).alias("entries"), *[F.count(_known(f"c{i}", kinds[i])).alias(f"n{i}") for i in own])
        rows = F.array(*[F.struct(F.lit(i).alias("position"), (F.col("entries") - F.col(f"n{i}")).alias("nulls"), "entries") for i in own])
        parts.append(present.select(F.inline(rows)))
    empty = df.sparkSession.createDataFrame([], "position int, nulls long, entries long")
    return reduce(DataFrame.unionByName, parts) if parts else empty


def _known(name: str, kind: T.DataType) -> Column:
    """The column, null where it is NaN."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.nanvl(F.col(name), F.lit(None).cast(kind))
    return F.col(name)

"""Column names: literal access, instances of a field, natural order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a field's columns are p<field>, then an optional instance, then an optional array index.
FIELD_COLUMN = r"^p{field}(_i\d+)?(_a\d+)?$"


def literal_name(name: str) -> str:
    """A column name that Spark takes as it is, also when it holds dots or spaces."""
    return "`" + name.replace("`", "``") + "`"


def literal_col(name: str) -> Column:
    return F.col(literal_name(name))


def field_pattern(field: str) -> str:
    return FIELD_COLUMN.format(field=field)


def base_field(name: Column) -> Column:
    """The field of an instance or array column (``31`` of ``p31_i0``), empty for other names."""
    return F.regexp_extract(name, field_pattern(r"(\d+)"), 1)


def instance_columns(df: DataFrame, base: str, exact_field: bool = False) -> list[str]:
    """Columns that start with ``base``; with ``exact_field`` only those of that field (p31, not p310)."""
    if exact_field:
        pattern = re.compile(field_pattern(base.removeprefix("p")))
        return [name for name in df.columns if pattern.match(name)]
    return [name for name in df.columns if name.startswith(base)]


def _number_after(name: Column, marker: str) -> Column:
    return F.nullif(F.regexp_extract(name, marker + r"(\d+)", 1), F.lit("")).try_cast("int")


def natural_keys(name: Column) -> list[Column]:
    """Sort keys that put p5_i2 before p5_i10 and a bare field before its instances."""
    return [
        F.regexp_extract(name, r"^([^0-9]*)", 1).alias("stem"),
        _number_after(name, "^[^0-9]*").alias("field"),
        _number_after(name, "_i").alias("instance"),
        _number_after(name, "_a").alias("array"),
    ]

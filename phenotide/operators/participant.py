"""Selections on the wide participant table (one row per participant, p<field>_i<instance>_a<array>)."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenotide.functions.codes import as_code_list, contains_any, keep_values
from phenotide.functions.logic import any_of, balanced
from phenotide.functions.names import instance_columns, literal_col
from phenotide.operators.records import Codes

# Column prefixes of the self-reported items.
CANCER = "p20001_i"
ILLNESS = "p20002_i"
TREATMENT = "p20003_i"
OPERATION = "p20004_i"
_PATTERN = "_pattern"


def any_instance(
    df: DataFrame, base: str, condition: Callable[[Column], Column], exact_field: bool = False
) -> Column | None:
    """``condition`` on any column of ``base``; ``None`` if there is no such column."""
    names = instance_columns(df, base, exact_field)
    return any_of(condition(literal_col(name)) for name in names) if names else None


def filter_by_criteria(
    df: DataFrame,
    criteria: Sequence[tuple[str, Callable[[Column], Column]]],
    exact_field: bool = False,
) -> DataFrame:
    """Rows that meet every criterion in at least one of its columns.

    A criterion without columns is left out with a warning.
    """
    hits = []
    for base, condition in criteria:
        hit = any_instance(df, base, condition, exact_field)
        if hit is None:
            warnings.warn(f"no column starts with {base!r}", stacklevel=2)
        else:
            hits.append(hit)
    return df.where(balanced(and_, hits)) if hits else df


def selfreport_illness(participants: DataFrame, codes: Codes = None, **options) -> DataFrame:
    """Participants with a self-reported non-cancer illness; see ``selfreport`` for the options."""
    return selfreport(participants, ILLNESS, codes, **options)


def selfreport_cancer(participants: DataFrame, codes: Codes = None, **options) -> DataFrame:
    """Participants with a self-reported cancer; see ``selfreport`` for the options."""
    return selfreport(participants, CANCER, codes, **options)


def selfreport_treatment(participants: DataFrame, codes: Codes = None, **options) -> DataFrame:
    """Participants with a self-reported treatment; see ``selfreport`` for the options."""
    return selfreport(participants, TREATMENT, codes, **options)


def selfreport(participants: DataFrame, prefix: str, codes: Codes = None, **options) -> DataFrame:
    """Wide rows of participants with any ``prefix`` column that matches any code (regular expressions).

    Options: ``names`` (column -> new name; the key is never renamed), ``filter_column`` and
    ``filter_values``, ``on_no_match`` (``'all'`` returns the whole table when nobody matches,
    ``'empty'`` returns no row), ``one_row_per_participant``.
    """
    codes = as_code_list(codes)
    hit = any_instance(participants, prefix, lambda column: contains_any(column, codes)) if codes else None
    return _selected(participants, hit, bool(codes), **options)


def selfreport_operation(
    participants: DataFrame, coding: DataFrame, codes: Codes = None, **options
) -> DataFrame:
    """Participants with a self-reported operation, given as numbers of the coding table.

    The table holds decoded texts, so each code stands for its first ``meaning`` (smallest text if
    a code has several), searched as a regular expression. Options as for ``selfreport``.
    """
    codes = as_code_list(codes)
    if not codes:
        return _selected(participants, None, False, **options)
    # One pattern for all codes, from at most one row per requested code; null if none is known.
    meanings = (
        coding.where((F.col("coding") > 1) & F.col("coding").isin([int(code) for code in codes]))
        .groupBy("coding")
        .agg(F.min("meaning").alias("meaning"))
    )
    one_of = F.array_join(F.collect_list(F.concat(F.lit("(?:"), "meaning", F.lit(")"))), "|")
    pattern = meanings.agg(F.nullif(one_of, F.lit(""))).scalar()
    searched = participants.withColumn(_PATTERN, pattern)
    # regexp_instr keeps the compiled pattern between rows; rlike compiles a non-literal one per row.
    hit = any_instance(searched, OPERATION, lambda column: F.regexp_instr(column, F.col(_PATTERN)) > 0)
    return _selected(searched, hit, True, **options).drop(_PATTERN)


def _selected(
    participants: DataFrame,
    hit: Column | None,
    has_codes: bool,
    names: Mapping[str, str] | None = None,
    filter_column: str | None = None,
    filter_values: Sequence | None = None,
    on_no_match: str = "all",
    one_row_per_participant: bool = True,
) -> DataFrame:
    if on_no_match not in ("all", "empty"):
        raise ValueError(f"on_no_match must be 'all' or 'empty', not {on_no_match!r}")
    chosen = participants
    if has_codes:
        hit = F.lit(False) if hit is None else F.coalesce(hit, F.lit(False))
        chosen = _matched(participants, hit, on_no_match == "all", one_row_per_participant)
    kept = keep_values(chosen, filter_column, filter_values)
    renames = {old: new for old, new in (names or {}).items() if old != "eid"}
    return (
        kept.withColumn("eid", F.col("eid").cast("long"))
        .withColumnsRenamed(renames)
        .withColumn("source", F.lit("Self"))
    )


def _matched(participants: DataFrame, hit: Column, all_if_none: bool, one_row: bool) -> DataFrame:
    # The subquery stops at the first match, so the fallback costs a full scan only if it applies.
    nobody = ~participants.where(hit).exists()
    if one_row:
        return participants.where(hit | nobody if all_if_none else hit)
    ids = participants.where(hit).select("eid").distinct()
    matched = participants.join(ids, "eid", "left_semi").select(*participants.columns)
    return matched.unionByName(participants.where(nobody)) if all_if_none else matched

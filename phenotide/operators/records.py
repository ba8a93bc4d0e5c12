"""Coded events from primary care, operations and hospital admissions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenotide.functions.codes import Index, keep_codes, keep_values
from phenotide.functions.dates import add_days, parse_date, parse_dates, subtract_days

Codes = str | Iterable[str] | None

# Column names and texts of the result tables.
DIAGNOSIS_COLUMNS = ("dnx_hesin_diag_id", "eid", "ins_index", "arr_index", "level", "diag_icd9", "diag_icd10")
ICD9_COLUMNS = (
    "dnx_hesin_diag_id", "eid", "ins_index", "arr_index", "classification",
    "diag_icd9", "diag_icd9_add", "diag_icd10", "diag_icd10_add",
)
EPISODE_KEYS = ("eid", "ins_index")
NO_EPISODE_DATES = "Invalid epistart and epiend"
BACK_CALCULATED = " (back-calculated)"


def gp_records(
    clinical: DataFrame,
    codes: Codes = None,
    filter_column: str | None = None,
    filter_values: Sequence | None = None,
    match: str = "exact",
) -> DataFrame:
    """Primary-care events whose ``read_3`` or ``read_2`` is in ``codes`` (all events without codes).

    Every repeat measurement stays, for longitudinal use.
    """
    events = keep_values(keep_codes(clinical, ["read_3", "read_2"], codes, match), filter_column, filter_values)
    return _flag_missing(parse_dates(events, "event_dt"), "event_dt").withColumns(
        {
            **{name: F.col(name).try_cast("double") for name in ("value1", "value2", "value3")},
            "source": F.lit("GP"),
        }
    )


def opcs_records(
    operations: DataFrame,
    codes: Codes = None,
    filter_column: str | None = None,
    filter_values: Sequence | None = None,
    match: str = "regex",
    index: Index | None = None,
) -> DataFrame:
    """Operations whose ``oper3`` or ``oper4`` matches ``codes``; ``index``: that of the table's codes, if there is one."""
    kept = keep_values(keep_codes(operations, ["oper3", "oper4"], codes, match, index=index), filter_column, filter_values)
    whole_numbers = ("eid", "ins_index", "arr_index", "posopdur", "preopdur")
    typed = kept.withColumns(
        {**{name: F.col(name).cast("long") for name in whole_numbers}, "opdate": parse_date(kept, "opdate")}
    )
    return _flag_missing(typed, "opdate").withColumn("source", F.lit("OPCS")).drop("dnx_hesin_oper_id")


def icd10_records(
    diagnoses: DataFrame,
    episodes: DataFrame,
    codes: Codes = None,
    filter_column: str | None = None,
    filter_values: Sequence | None = None,
    match: str = "regex",
    index: Index | None = None,
) -> DataFrame:
    """Hospital diagnoses by ICD-10 code with the dates of their episode.

    No row is marked for exclusion, also when both episode dates are missing.

    Tables stored by ``sinks.write_bucketed`` are joined without a shuffle. Otherwise the settings of
    ``build_session`` let Spark filter large episode tables by the selected keys before it shuffles them.
    """
    kept = keep_codes(diagnoses, ["diag_icd10"], codes, match, index=index).select(*DIAGNOSIS_COLUMNS)
    joined = keep_values(_with_episode(kept, episodes), filter_column, filter_values)
    return _hospital_dates(joined, "HES_ICD10", exclude=False, reason="")


def icd9_records(
    diagnoses: DataFrame,
    episodes: DataFrame,
    codes: Codes = None,
    filter_column: str | None = None,
    filter_values: Sequence | None = None,
    match: str = "regex",
    index: Index | None = None,
) -> DataFrame:
    """Hospital diagnoses by ICD-9 code; rows without any episode date are marked for exclusion.

    The nine diagnosis columns are named by position.
    """
    named = diagnoses.toDF(*ICD9_COLUMNS).drop("diag_icd9_add", "diag_icd10_add")
    kept = keep_codes(named, ["diag_icd9"], codes, match, index=index)
    joined = keep_values(_with_episode(kept, episodes), filter_column, filter_values)
    return _hospital_dates(joined, "HES_ICD9", exclude=True, reason=NO_EPISODE_DATES)


def _flag_missing(df: DataFrame, date: str) -> DataFrame:
    missing = F.col(date).isNull()
    return df.withColumns(
        {"exclude": missing, "exclude_reason": F.when(missing, f"Missing {date}").otherwise("")}
    )


def _with_episode(diagnoses: DataFrame, episodes: DataFrame) -> DataFrame:
    """Diagnoses joined to their episode; a column both sides have is taken from the diagnosis."""
    as_long = {key: F.col(key).cast("long") for key in EPISODE_KEYS}
    extra = [name for name in episodes.columns if name not in diagnoses.columns]
    numbered = episodes.withColumns(as_long).select(*EPISODE_KEYS, *extra)
    return diagnoses.withColumns(as_long).join(numbered, list(EPISODE_KEYS))


def _hospital_dates(df: DataFrame, source: str, exclude: bool, reason: str) -> DataFrame:
    """Parse episode dates, fill a missing one from the other and the duration, add the flags."""
    absent = [name for name in ("epistart", "epiend") if name not in df.columns]
    df = df.withColumns({name: F.lit(None).cast("string") for name in absent})
    start, end, days = F.col("epistart"), F.col("epiend"), F.col("epidur")
    dated = start.isNotNull() | end.isNotNull()
    return (
        parse_dates(df, "epistart", "epiend")
        .withColumn("epidur", days.try_cast("long"))
        .withColumns(
            {
                "epistart": F.coalesce(start, subtract_days(end, days)),
                "epiend": F.coalesce(end, add_days(start, days)),
            }
        )
        .withColumns(
            {
                "exclude": F.when(dated, False).otherwise(exclude),
                "exclude_reason": F.when(dated, reason + BACK_CALCULATED).otherwise(reason),
                "bedyear": F.col("bedyear").cast("long"),
                "source": F.lit(source),
            }
        )
        .drop("dnx_hesin_diag_id", "dnx_hesin_id")
    )

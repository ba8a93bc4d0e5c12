"""One timeline per participant: merged records, first occurrence, age groups."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenotide.functions.dates import parse_date, years_between
from phenotide.functions.names import literal_col

# Columns that can date a record, the first one present counts; result column.
DATE_COLUMNS = ("event_dt", "date", "opdate", "epistart")
DIAGNOSIS_AGE = "Diagnosis Age"
# Order that decides between records of the same day; the remaining columns follow in frame order.
TIE_BREAK = ("source", "read_2", "read_3", "diag_icd10", "diag_icd9", "oper4", "oper3")


def with_diag_date(records: DataFrame) -> DataFrame:
    """Add ``diag_date`` from the first date column present; without any, leave the frame as it is."""
    for name in DATE_COLUMNS:
        if name in records.columns:
            return records.withColumn("diag_date", parse_date(records, name))
    return records


def order_participant_records(*frames: DataFrame, sort: bool = True) -> DataFrame:
    """Full outer join of record frames, first on participant and date, else on participant only.

    Of a column that several frames have, the first frame's values stay. A missing date equals no
    other. A day with several records in both frames yields every combination of them, so for "what
    came first" over many large sources ``first_occurrence`` is the cheaper question.

    Spark cannot split a key of a full outer join. So a left outer join, which it can split, is
    followed by the right rows without a partner; their keys are compared with the distinct keys of the
    frames on the left, not with the merged rows. ``sort=False`` saves the global sort.
    """
    dated = [with_diag_date(frame) for frame in frames]
    merged = dated[0]
    for position, right in enumerate(dated[1:], start=1):
        both_dated = "diag_date" in merged.columns and "diag_date" in right.columns
        keys = ["eid", "diag_date"] if both_dated else ["eid"]
        new = [literal_col(name) for name in right.columns if name not in merged.columns]
        right = right.select(*keys, *new)
        alone = right.join(_distinct_keys(dated[:position], keys), keys, "left_anti")
        merged = merged.join(right, keys, "left").unionByName(alone, allowMissingColumns=True)
    if not sort:
        return merged
    order = [name for name in ("eid", "diag_date") if name in merged.columns]
    # The hash lets the sort spread records of one participant and day over several tasks.
    rest = F.xxhash64(*[literal_col(name) for name in merged.columns if name not in order])
    return merged.orderBy(*order, rest)


def _distinct_keys(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The keys that rows of ``frames`` can be matched by: those without a missing part."""
    rows = [frame.select(*keys) for frame in frames if set(keys) <= set(frame.columns)]
    return reduce(DataFrame.unionByName, rows).dropna().distinct()


def first_record(records: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """The earliest record of each participant, with the first date and the age at that date.

    Undated records sort first, so a participant with one gets it; ``min_diag_date`` is the first
    known date. ``baseline`` supplies ``dob`` unless the records hold it.

    The minimum of a row struct is combined before the shuffle, so a participant with very many
    records sends one row per input partition. Rows are sorted by participant for that, on both
    sides; select the columns you need beforehand. Records of nothing but participant and
    ``diag_date`` are hashed instead, so that a task holds its participants, not its rows.
    """
    if "diag_date" not in records.columns:
        records = with_diag_date(records)
    order = ["diag_date", *[name for name in TIE_BREAK if name in records.columns]]
    order += [name for name in records.columns if name not in order and name != "eid"]
    least = F.min(F.struct(*[literal_col(name) for name in order]))
    if order == ["diag_date"]:
        least = F.struct(F.when(F.bool_and(F.col("diag_date").isNotNull()), F.min("diag_date")).alias("diag_date"))
    first = (
        records.groupBy("eid")
        .agg(least.alias("first"), F.min("diag_date").alias("min_diag_date"))
        .select("eid", "first.*", "min_diag_date")
        .drop("date")
    )
    if baseline is not None:
        births = baseline.select("eid", parse_date(baseline, "dob").alias("dob"))
        first = first.drop("dob").join(births, "eid", "left")
    return first.withColumn(DIAGNOSIS_AGE, F.round(years_between(F.col("diag_date"), F.col("dob"))))


def first_occurrence(sources: Mapping[str, DataFrame]) -> DataFrame:
    """First date of a phenotype over several record sources, and the source it came from.

    ``sources`` maps a source name to its records. Undated records are ignored. On the same day the
    source that is first by name counts. One shuffle by participant: each source contributes to its
    own minimum, which is combined before the shuffle.
    """
    names = sorted(sources)
    dates = [f"date_{i}" for i in range(len(names))]
    stacked = reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True),
        [
            _dated(sources[name]).select("eid", F.col("diag_date").alias(date))
            for name, date in zip(names, dates)
        ],
    )
    firsts = stacked.groupBy("eid").agg(*[F.min(date).alias(date) for date in dates])
    earliest = F.least(*dates) if len(dates) > 1 else F.col(dates[0])
    return firsts.select(
        "eid",
        earliest.alias("diag_date"),
        F.coalesce(*[F.when(F.col(date) == earliest, name) for name, date in zip(names, dates)]).alias("source"),
    )


def _dated(records: DataFrame) -> DataFrame:
    if "diag_date" not in records.columns:
        records = with_diag_date(records)
    return records.where(F.col("diag_date").isNotNull())


def age_group_counts(records: DataFrame, bin_size: int = 10, age: str = DIAGNOSIS_AGE) -> DataFrame:
    """Participants per age group ``[lo, lo + bin_size)``, empty groups included, in order of age.

    The last group ends at the first multiple of ``bin_size`` that is not below the oldest age, so
    an oldest age that is such a multiple is outside of it, as are negative and missing ages.
    """
    ages = records.groupBy("eid").agg(F.min(literal_col(age)).alias("age")).where(F.col("age").isNotNull())
    lo = (F.floor(F.col("age") / bin_size) * bin_size).cast("long")
    counts = ages.groupBy(lo.alias("lo")).agg(F.count("*").alias("n"), F.max("age").alias("oldest"))
    # One row with a count per occurring group: a few entries, as ages span a few decades.
    summary = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("lo", "n"))).alias("counts"),
        F.max("oldest").cast("long").alias("top"),
    ).where(F.col("top") >= 1)
    first, step = F.lit(0).cast("long"), F.lit(bin_size).cast("long")
    groups = summary.select("counts", F.explode(F.sequence(first, F.col("top") - 1, step)).alias("lo"))
    label = F.concat(F.col("lo").cast("string"), F.lit("-"), (F.col("lo") + bin_size - 1).cast("string"))
    n = F.coalesce(F.col("counts")[F.col("lo")], F.lit(0))
    return groups.select(label.alias("age_group"), "lo", n.alias("n")).orderBy("lo")

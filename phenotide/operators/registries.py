"""Prescriptions, deaths and cancer registrations."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenotide.functions.codes import as_code_list, keep_codes, match_column
from phenotide.functions.dates import is_before, parse_dates, years_between
from phenotide.operators.participant import any_instance
from phenotide.operators.records import Codes

# Result column -> prefix of its instance columns in the wide cancer table.
CANCER_FIELDS = {
    "reg_date": "p40005_i",
    "site": "p40006_i",
    "age": "p40008_i",
    "histology": "p40011_i",
    "behaviour": "p40012_i",
}


def gp_scripts(scripts: DataFrame, codes: Codes) -> DataFrame:
    """Prescriptions whose ``dmd_code``, ``read_2`` or ``bnf_code`` equals a code; no codes, no rows.

    A row appears once per match: twice if two of its columns hold a requested code.
    """
    columns = ["dmd_code", "read_2", "bnf_code"]
    kept = parse_dates(keep_codes(scripts, columns, codes, "exact", on_empty="none"), "issue_date")
    if not as_code_list(codes):
        return kept
    matches = reduce(add, [_times_listed(F.col(name), as_code_list(codes)) for name in columns])
    return kept.withColumn("match", F.explode(F.array_repeat(F.lit(1), matches))).drop("match")


def _times_listed(column: Column, codes: list[str]) -> Column:
    by_count: dict[int, list[str]] = {}
    for code, count in Counter(codes).items():
        by_count.setdefault(count, []).append(code)
    return reduce(add, [F.when(column.isin(same), n).otherwise(0) for n, same in by_count.items()])


def death_records(
    causes: DataFrame, deaths: DataFrame, baseline: DataFrame, codes: Codes, match: str = "prefix"
) -> DataFrame:
    """Deaths by cause, with the age at death and whether it was before the assessment."""
    kept = keep_codes(causes, ["cause_icd10"], codes, match, on_empty="none")
    joined = parse_dates(kept.join(deaths, ["eid", "ins_index"]), "date_of_death")
    return joined.join(_baseline_dates(baseline), "eid").withColumns(
        {
            "death_age": years_between(F.col("date_of_death"), F.col("dob")),
            "prev": is_before(F.col("date_of_death"), F.col("assess_date")),
        }
    )


def cancer_registrations(registry: DataFrame, codes: Codes, match: str = "regex") -> DataFrame:
    """The wide cancer table as one row per registration whose site matches ``codes``."""
    codes = as_code_list(codes)
    sites = CANCER_FIELDS["site"]
    instances = sorted(int(name.removeprefix(sites)) for name in registry.columns if name.startswith(sites))
    rows = F.array(
        *[
            F.struct(*[F.col(f"{prefix}{i}").alias(name) for name, prefix in CANCER_FIELDS.items()])
            for i in instances
        ]
    )

    def matches(column: Column) -> Column:
        return match_column(column, codes, match) if codes else F.lit(False)

    # Participants without a matching site leave before their row is multiplied.
    some = registry.where(any_instance(registry, sites, matches))
    return parse_dates(some.select("eid", F.inline(rows)).where(matches(F.col("site"))), "reg_date")


def cancer_registry(
    registry: DataFrame, baseline: DataFrame, histologies: DataFrame, codes: Codes, match: str = "regex"
) -> DataFrame:
    """Cancer registrations with the age at diagnosis, the ICD-O-3 code and its description.

    ``histologies`` has a text ``histology`` for each ``code``, which is histology and behaviour; of a
    code with several texts the smallest counts, an unknown one has none.
    """
    texts = histologies.groupBy("code").agg(F.min("histology").alias("description"))
    return (
        cancer_registrations(registry, codes, match)
        .join(_baseline_dates(baseline), "eid")
        .withColumns(
            {
                "diag_age": years_between(F.col("reg_date"), F.col("dob")),
                "prev": is_before(F.col("reg_date"), F.col("assess_date")),
                "code": F.concat("histology", F.lit("/"), "behaviour"),
            }
        )
        .join(texts, "code", "left")
    )


def _baseline_dates(baseline: DataFrame) -> DataFrame:
    return parse_dates(baseline.select("eid", "dob", "assess_date"), "dob", "assess_date")

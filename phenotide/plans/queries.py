"""Registered queries: every operator on record tables derived from the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenotide.functions.dates import years_between
from phenotide.operators import fields, genetics, participant, power, records, registries, timeline
from phenotide.plans import stored
from phenotide.plans.fixtures import Tables
from phenotide.sources import footers
from phenotide.sources.code_index import CodeIndex

Query = Callable[[SparkSession, str], DataFrame]

# Code lists of the queries.
FROZEN_SHOULDER_GP = ["N210.", "XE1FL", "XE1Hm"]
DIABETES_ICD10 = ["E10", "E11"]
# What an age at the first record is computed from; only these columns of merged records are read and shuffled.
AGED_BY = ("eid", "diag_date")
# What the tests' selections rename: titles without blanks, so that they read well in SQL.
NAMES = {"eid": "participant", "p31": "segment", "p20002_i0_a0": "illness_0_0"}


def gp_by_codes(t: Tables) -> DataFrame:
    return records.gp_records(t.gp_clinical, FROZEN_SHOULDER_GP)


def gp_all(t: Tables) -> DataFrame:
    return records.gp_records(t.gp_clinical, [], filter_column="data_provider", filter_values=[1, 2])


def gp_longitudinal(t: Tables) -> DataFrame:
    return records.gp_records(t.gp_clinical, ["22K.."])


def opcs_by_codes(t: Tables) -> DataFrame:
    return records.opcs_records(t.hesin_oper, ["W78", "81"])


def icd10_by_codes(t: Tables) -> DataFrame:
    return records.icd10_records(t.hesin_diag, t.hesin, DIABETES_ICD10)


def icd10_by_prefix(t: Tables) -> DataFrame:
    return records.icd10_records(t.hesin_diag, t.hesin, ["E11.3", "M75.0"], match="prefix")


def icd10_by_code_index(t: Tables) -> DataFrame:
    """The patterns are judged on the distinct codes of the table."""
    index = CodeIndex.of(t.hesin_diag, ["diag_icd10"])
    return records.icd10_records(t.hesin_diag, t.hesin, ["E1[01]", "^C5.$"], index=index)


def opcs_code_counts(t: Tables) -> DataFrame:
    return CodeIndex.of(t.hesin_oper, ["oper3", "oper4"]).counts("oper4", ["W7[0-4]", "9$"])


def icd9_by_codes(t: Tables) -> DataFrame:
    return records.icd9_records(t.hesin_diag, t.hesin, ["250"])


def selfreport_illness(t: Tables) -> DataFrame:
    return participant.selfreport_illness(t.selfreport_participant, ["1222"], names=NAMES)


def selfreport_no_match(t: Tables) -> DataFrame:
    return participant.selfreport_illness(t.selfreport_participant, ["9999"], names=NAMES)


def selfreport_cancer(t: Tables) -> DataFrame:
    return participant.selfreport_cancer(t.selfreport_participant, ["1002"], names=NAMES)


def selfreport_treatment(t: Tables) -> DataFrame:
    return participant.selfreport_treatment(t.selfreport_participant, ["2003"], names=NAMES)


def selfreport_operation(t: Tables) -> DataFrame:
    return participant.selfreport_operation(t.selfreport_participant, t.coding, [2, 17], names=NAMES)


def criteria_any_all(t: Tables) -> DataFrame:
    return participant.filter_by_criteria(
        t.selfreport_participant,
        [("p20002_i", lambda column: column == "1222"), ("p31", lambda column: column == "BUILDING")],
    )


def gp_scripts_by_codes(t: Tables) -> DataFrame:
    return registries.gp_scripts(t.gp_scripts, ["3000", "3003", "f4...", "06.01.03"])


def death_by_codes(t: Tables) -> DataFrame:
    return registries.death_records(t.death_cause, t.death, t.baseline, ["E10"])


def cancer_registry(t: Tables) -> DataFrame:
    return registries.cancer_registry(t.cancer_participant, t.baseline, t.icdo3, ["C61", "C5"])


def ordered_records(t: Tables) -> DataFrame:
    return timeline.order_participant_records(
        records.gp_records(t.gp_clinical, ["22K..", "XE2eD"]),
        records.opcs_records(t.hesin_oper, ["W78"]),
        records.icd10_records(t.hesin_diag, t.hesin, ["M750"]),
        participant.selfreport_illness(t.selfreport_participant, ["1222"], names=NAMES),
    )


def first_occurrence_records(t: Tables) -> DataFrame:
    return timeline.first_record(records.gp_records(t.gp_clinical), t.baseline)


def first_occurrence_sources(t: Tables) -> DataFrame:
    return timeline.first_occurrence(
        {
            "GP": records.gp_records(t.gp_clinical, FROZEN_SHOULDER_GP),
            "OPCS": records.opcs_records(t.hesin_oper, ["W78"]),
            "ICD10": records.icd10_records(t.hesin_diag, t.hesin, ["M750"]),
            "cancer": registries.cancer_registrations(t.cancer_participant, ["C61"]).withColumnRenamed(
                "reg_date", "diag_date"
            ),
        }
    )


def age_groups(t: Tables) -> DataFrame:
    age = F.round(years_between(F.col("assess_date"), F.col("dob")))
    return timeline.age_group_counts(t.baseline.select("eid", age.alias(timeline.DIAGNOSIS_AGE)))


def diagnosis_age_groups(t: Tables) -> DataFrame:
    diabetes = timeline.with_diag_date(records.icd10_records(t.hesin_diag, t.hesin, DIABETES_ICD10))
    return timeline.age_group_counts(timeline.first_record(diabetes.select(*AGED_BY), t.baseline), bin_size=5)


def timeline_age_groups(t: Tables) -> DataFrame:
    merged = timeline.order_participant_records(
        records.gp_records(t.gp_clinical, FROZEN_SHOULDER_GP),
        records.opcs_records(t.hesin_oper, ["W78"]),
        records.icd10_records(t.hesin_diag, t.hesin, ["M750"]),
        sort=False,
    )
    return timeline.age_group_counts(timeline.first_record(merged.select(*AGED_BY), t.baseline))


def genetic_score(t: Tables) -> DataFrame:
    # The weights are n/64 and the means that count are whole, so the sums are exact.
    return genetics.genetic_score(t.genotypes, t.score_file)


def genetic_score_drop_missing(t: Tables) -> DataFrame:
    # The weights are n/64, so the sums are exact.
    return genetics.genetic_score(t.genotypes, t.score_file, missing="drop")


def source_case_rates(t: Tables) -> DataFrame:
    participants = t.selfreport_participant
    return power.source_case_rates(
        {
            "HES": (records.icd10_records(t.hesin_diag, t.hesin, ["C54"]), t.hesin),
            "OPCS": (records.opcs_records(t.hesin_oper, ["W789"]), t.hesin_oper),
            "Self": (participant.selfreport_cancer(participants, ["1002"], on_no_match="empty"), participants),
            "Death": (registries.death_records(t.death_cause, t.death, t.baseline, ["E10"]), t.death),
        },
        distinct="words",
    )


def source_case_rates_by_row(t: Tables) -> DataFrame:
    diabetes = records.icd10_records(t.hesin_diag, t.hesin, DIABETES_ICD10)
    return power.source_case_rates({"HES": (diabetes, t.hesin), "GP": (records.gp_records(t.gp_clinical, FROZEN_SHOULDER_GP), t.gp_clinical)}, distinct="rows")


def association_power(t: Tables) -> DataFrame:
    grid = power.association_power(t.variants, source_case_rates(t).drop("case_rate"))
    return grid.withColumn("power", F.round("power", 6))


def association_power_multiplied(t: Tables) -> DataFrame:
    grid = power.association_power(
        t.variants, source_case_rates(t).drop("case_rate"), odds_ratios=(0.5, 1.2, 4.0), alpha=0.05, effect="multiply"
    )
    return grid.withColumn("power", F.round("power", 6))


def association_solve(t: Tables) -> DataFrame:
    """The cases, the odds ratio and the level that a test needs, one after the other."""
    sources = source_case_rates(t).drop("case_rate")
    solved = reduce(
        DataFrame.unionByName,
        [
            power.association_solve(t.variants, sources, "cases", odds_ratios=(0.5, 1.5), alphas=(1e-9, 0.05), powers=(0.8, 0.06)),
            power.association_solve(t.variants, sources, "odds_ratio", alphas=(5e-8, 0.05), powers=(0.9,)),
            power.association_solve(t.variants, sources, "alpha", odds_ratios=(1.01, 2.0), powers=(0.8,)),
        ],
    )
    digits = {"odds_ratio": 6, "alpha": 9, "power": 6, "cases": 3, "n": 3}
    return solved.withColumns({name: F.round(name, n) for name, n in digits.items()})


def extract_fields(t: Tables) -> DataFrame:
    dictionary = t.field_dictionary.withColumn("title", F.concat(F.lit("Title of "), "name"))
    return fields.extract_fields(
        t.selfreport_participant, dictionary, ["eid", "20002"], ["OF P20003"], use_descriptions=True
    )


def append_fields(t: Tables) -> DataFrame:
    participants = t.selfreport_participant
    stored = participants.select("eid", "p31", "p20002_i0_a0")
    return fields.append_fields(stored, participants, ["eid", "p31", "p20001_i0_a0", "p20004_i0_a0"])


def fields_for_id(t: Tables) -> DataFrame:
    return fields.fields_for_id(t.field_dictionary, 20001)


def fields_by_keyword(t: Tables) -> DataFrame:
    return fields.fields_by_title_keyword(t.field_dictionary, "WIDGET array")


def null_profile(t: Tables) -> DataFrame:
    return fields.column_null_profile(t.selfreport_participant)


def null_profile_stored(t: Tables) -> DataFrame:
    """Of a table as it is stored: counts from its footers, and from data for its floating-point columns."""
    return footers.stored_null_profile(t.spark, f"{t.sf_dir}/lineitem.parquet")


def drop_all_null(t: Tables) -> DataFrame:
    return fields.drop_all_null_columns(t.hesin_diag)


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    query.__name__: query
    for query in (
        gp_by_codes,
        gp_all,
        gp_longitudinal,
        opcs_by_codes,
        icd10_by_codes,
        icd10_by_prefix,
        icd10_by_code_index,
        opcs_code_counts,
        icd9_by_codes,
        selfreport_illness,
        selfreport_no_match,
        selfreport_cancer,
        selfreport_treatment,
        selfreport_operation,
        criteria_any_all,
        gp_scripts_by_codes,
        death_by_codes,
        cancer_registry,
        ordered_records,
        first_occurrence_records,
        first_occurrence_sources,
        age_groups,
        diagnosis_age_groups,
        timeline_age_groups,
        genetic_score,
        genetic_score_drop_missing,
        source_case_rates,
        source_case_rates_by_row,
        association_power,
        association_power_multiplied,
        association_solve,
        extract_fields,
        append_fields,
        fields_for_id,
        fields_by_keyword,
        null_profile,
        null_profile_stored,
        drop_all_null,
    )
}


def registered() -> dict[str, Query]:
    """Query name -> function of (spark, folder of test tables)."""
    return {name: _bind(query) for name, query in (QUERIES | stored.QUERIES).items()}


def _bind(query: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(Tables(spark, sf_dir))

"""Physical plans: what reaches the scan, what is shuffled, what stays out."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phenotide.operators import genetics, participant, records, timeline
from phenotide.plans import queries
from phenotide.plans.fixtures import Tables
from phenotide.sources.sinks import write_bucketed, write_parquet

SF_DIR = "/root/testdata/sf0.001"
QUERIES = queries.registered()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path, name, df):
    """A Parquet copy, so that the scan sees the record columns themselves."""
    df.write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_join_no_global_window(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "Window"):
        assert word not in text, word


def test_exact_codes_reach_the_scan(spark, tables, tmp_path):
    clinical = stored(spark, tmp_path, "gp", tables.gp_clinical)
    text = plan(records.gp_records(clinical, ["N210.", "XE1FL"], "data_provider", [1, 2]).select("eid", "event_dt"))
    pushed = re.search(r"PushedFilters: \[(.*)\], ReadSchema", text).group(1)
    assert "Or(In(read_3, [N210.,XE1FL]),In(read_2, [N210.,XE1FL]))" in pushed
    assert "In(data_provider, [1,2])" in pushed
    schema = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert sorted(field.split(":")[0] for field in schema.split(",")) == [
        "data_provider", "eid", "event_dt", "read_2", "read_3",
    ]


def test_code_prefixes_reach_the_scan(spark, tables, tmp_path):
    diagnoses = stored(spark, tmp_path, "diag", tables.hesin_diag)
    text = plan(records.icd10_records(diagnoses, tables.hesin, ["E11.3", "M75"], match="prefix"))
    assert "Or(StringStartsWith(diag_icd10,E113),StringStartsWith(diag_icd10,M75))" in text


@pytest.fixture()
def long_plans(spark):
    key = "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "100000")
    yield
    spark.conf.set(key, before)


def test_any_number_of_prefixes_reaches_the_scan(spark, tables, tmp_path, long_plans):
    diagnoses = stored(spark, tmp_path, "diag", tables.hesin_diag)
    codes = [f"E1{i}.{j}" for i in range(10) for j in range(30)] + ["E10.11"]
    text = plan(records.icd10_records(diagnoses, tables.hesin, codes, match="prefix"))
    pushed = re.findall(r"StringStartsWith\(diag_icd10,(\w+)\)", text)
    assert set(pushed) == {f"E1{i}{j}" for i in range(10) for j in range(10)}


def test_first_record_combines_before_its_only_shuffle(tables):
    text = plan(timeline.first_record(records.gp_records(tables.gp_clinical).withColumn("dob", F.current_date())))
    assert text.count("Exchange hashpartitioning(eid") == 1
    assert "partial_min(struct(" in text


def test_case_rates_and_ages_sort_no_rows_for_their_aggregates(spark, tables):
    """Beside the joins nothing holds the rows of a task, and only what an age needs is merged."""
    names = ("source_case_rates", "association_power", "association_power_multiplied", "association_solve", "timeline_age_groups", "diagnosis_age_groups")
    for name in names:
        assert "SortAggregate" not in plan(queries.QUERIES[name](tables)), name
    text = plan(queries.timeline_age_groups(tables))
    assert "read_2 AS" not in text and "l_partkey % 9" not in text


def test_first_occurrence_uses_hash_aggregation_and_one_shuffle(tables):
    gp, scripts = records.gp_records(tables.gp_clinical), tables.gp_scripts
    frames = {"GP": gp, "scripts": scripts.withColumnRenamed("issue_date", "date")}
    text = plan(timeline.first_occurrence(frames))
    assert text.count("Exchange") == 1
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_genotypes_are_not_shuffled_for_the_join(spark, tables, tmp_path):
    genotypes = stored(spark, tmp_path, "genotypes", tables.genotypes)
    scores = stored(spark, tmp_path, "scores", tables.score_file)
    text = plan(genetics.genetic_score(genotypes, scores, missing="drop"))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    assert text.count("Exchange hashpartitioning(eid") == text.count("Exchange hashpartitioning") == 1
    assert "LessThanOrEqual(chrom,22)" in text
    schema = re.search(r"ReadSchema: struct<eid[^>]*>", text).group(0)
    assert "allele1_count" in schema


def test_only_autosomes_of_partitioned_genotypes_are_read(spark, tables, tmp_path):
    write_parquet(tables.genotypes, f"{tmp_path}/genotypes", partition_by=["chrom"])
    text = plan(genetics.genetic_score(spark.read.parquet(f"{tmp_path}/genotypes"), tables.score_file))
    pruned = [filters for filters in re.findall(r"PartitionFilters: \[([^\]]*)", text) if "chrom" in filters]
    assert len(pruned) >= 2 and all("<= 22" in filters for filters in pruned)


def test_genotypes_are_not_shuffled_for_a_large_score(spark, tables, tmp_path):
    genotypes = stored(spark, tmp_path, "genotypes", tables.genotypes)
    scores = spark.range(600_000).selectExpr(
        "CAST(id % 22 + 1 AS INT) AS chrom", "1000 + id * 10 AS pos", "'A' AS effect_allele", "0.5 AS weight"
    )
    for limit, joins in ((256 << 20, 1), (8 << 20, 8)):
        text = plan(genetics.genetic_score(genotypes, scores, missing="drop", max_broadcast_bytes=limit))
        assert text.count("BroadcastHashJoin") == joins and "SortMergeJoin" not in text
        assert text.count("Exchange hashpartitioning(eid") == text.count("Exchange hashpartitioning") == 1


def test_merge_runs_nothing_and_has_no_full_outer_join(spark, tables, tmp_path):
    gp = records.gp_records(stored(spark, tmp_path, "gp", tables.gp_clinical))
    opcs = records.opcs_records(stored(spark, tmp_path, "opcs", tables.hesin_oper))
    spark.sparkContext.setJobGroup("merge", "plan")
    text = plan(timeline.order_participant_records(gp, opcs, sort=False))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("merge") == []
    spark.sparkContext.setJobGroup("", "")
    assert "FullOuter" not in text and text.count("LeftOuter") == text.count("LeftAnti") == 1


@pytest.fixture()
def no_automatic_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_bucketed_tables_are_joined_without_a_shuffle(spark, tables, no_automatic_broadcast):
    keys = list(records.EPISODE_KEYS)
    for name, df in (("bucketed_diag", tables.hesin_diag), ("bucketed_episodes", tables.hesin)):
        write_bucketed(df, name, keys, 4)
    try:
        diagnoses, episodes = spark.table("bucketed_diag"), spark.table("bucketed_episodes")
        found = records.icd10_records(diagnoses, episodes, ["E10"])
        assert "Exchange" not in plan(found) and "SortMergeJoin" in plan(found)
        expected = records.icd10_records(tables.hesin_diag, tables.hesin, ["E10"])
        assert Counter(found.select(*expected.columns).collect()) == Counter(expected.collect()) != Counter()
    finally:
        spark.sql("DROP TABLE bucketed_diag")
        spark.sql("DROP TABLE bucketed_episodes")


def test_large_episode_tables_are_filtered_by_the_selected_keys(spark, tables, tmp_path, no_automatic_broadcast):
    diagnoses = stored(spark, tmp_path, "diag", tables.hesin_diag)
    episodes = stored(spark, tmp_path, "episodes", tables.hesin)
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        assert "might_contain" in plan(records.icd10_records(diagnoses, episodes, ["C54"], match="prefix"))
    finally:
        spark.conf.set(key, before)


def test_conditions_of_many_columns_reach_the_scan(spark, tmp_path, long_plans):
    spark.range(3).selectExpr(*[f"CAST(id + {i} AS STRING) AS p1_i{i}" for i in range(130)]).write.parquet(f"{tmp_path}/wide")
    wide = spark.read.parquet(f"{tmp_path}/wide")
    text = plan(participant.filter_by_criteria(wide, [("p1_i", lambda column: column == "7")]))
    assert text.split("PushedFilters:")[1].count("EqualTo(p1_i") == 130

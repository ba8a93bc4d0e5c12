"""Polygenic scores, case rates, power."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from phenotide.functions.normal import normal_cdf
from phenotide.functions.sizes import Slice, position_slices, table_bytes
from phenotide.operators import genetics, power

GENOTYPES = "eid long, chrom int, pos long, allele1 string, allele2 string, allele1_count int"
SCORES = "chrom int, pos long, other_allele string, effect_allele string, weight double"


def brute_force(genotypes, scores, missing):
    weights = {(c, p): (effect, w) for c, p, _, effect, w in scores if 1 <= c <= 22}
    calls = []
    for eid, chrom, pos, a1, a2, count in genotypes:
        effect, weight = weights.get((chrom, pos), (None, None))
        if effect in (a1, a2):
            dose = None if count is None else count if effect == a1 else 2 - count
            calls.append((eid, (chrom, pos), weight, dose))
    known = defaultdict(list)
    for _, variant, _, dose in calls:
        if dose is not None:
            known[variant].append(dose)
    total, n = defaultdict(float), defaultdict(int)
    for eid, variant, weight, dose in calls:
        if dose is None:
            if missing == "drop":
                continue
            dose = sum(known[variant]) / len(known[variant]) if known[variant] else 0
        total[eid] += weight * dose
        n[eid] += 1
    return {eid: total[eid] / (2 * n[eid]) for eid in n}


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    variants = [(rng.randint(1, 23), 100 + i) for i in range(20)]
    genotypes = [
        (eid, c, p, "A", "G", rng.choice([0, 1, 2, None]) if p != 104 else None)
        for eid in range(12)
        for c, p in variants
    ]
    scores = [(c, p, "A", rng.choice("AGGT"), rng.randint(-20, 20) / 64) for c, p in variants[:15]]
    return genotypes, scores


@pytest.mark.parametrize("missing", ["impute", "drop"])
@pytest.mark.parametrize("max_broadcast_bytes", [1 << 20, 300, 1])
def test_score_equals_brute_force(spark, data, missing, max_broadcast_bytes):
    genotypes, scores = spark.createDataFrame(data[0], GENOTYPES), spark.createDataFrame(data[1], SCORES)
    rows = genetics.genetic_score(genotypes, scores, missing, max_broadcast_bytes).collect()
    expected = brute_force(*data, missing)
    assert {r.eid for r in rows} == set(expected)
    for r in rows:
        assert r.score == pytest.approx(expected[r.eid], abs=1e-12)


def test_score_is_linear_in_the_weights(spark, data):
    genotypes, scores = spark.createDataFrame(data[0], GENOTYPES), spark.createDataFrame(data[1], SCORES)
    once = {r.eid: r.score for r in genetics.genetic_score(genotypes, scores).collect()}
    doubled = scores.withColumn("weight", F.col("weight") * 2)
    assert {r.eid: r.score / 2 for r in genetics.genetic_score(genotypes, doubled).collect()} == pytest.approx(once)


def test_large_score_table_is_not_broadcast(spark, data):
    genotypes, scores = spark.createDataFrame(data[0], GENOTYPES), spark.createDataFrame(data[1], SCORES)

    def hinted(limit):
        plan = genetics.genetic_score(genotypes, scores, "drop", limit)._jdf.queryExecution().analyzed().toString()
        return "strategy=broadcast" in plan

    assert hinted(1000) and not hinted(3)


def test_unknown_missing_mode(spark, data):
    with pytest.raises(ValueError, match="guess"):
        genetics.genetic_score(spark.createDataFrame(data[0], GENOTYPES), spark.createDataFrame(data[1], SCORES), "guess")


def test_normal_cdf(spark):
    points = [i / 16 for i in range(-700, 700)]
    df = spark.createDataFrame([(x,) for x in points], "x double")
    for row in df.select("x", normal_cdf("x").alias("p")).collect():
        exact = math.erfc(-row.x / math.sqrt(2)) / 2
        assert row.p == pytest.approx(exact, rel=1e-7, abs=1e-15)
        if abs(row.x) < 7:
            assert row.p == pytest.approx(exact, rel=1e-12, abs=2e-15)


def expected_power(maf, cases, n, ratio, alpha, effect):
    spread = math.sqrt(2 * maf * (1 - maf))
    size = math.log(ratio) / spread if effect == "divide" else math.log(ratio) * spread
    x = size / math.sqrt(1 / cases + 1 / (n - cases))
    c = NormalDist().inv_cdf(1 - alpha / 2)
    return NormalDist().cdf(x - c) + NormalDist().cdf(-c - x)


@pytest.mark.parametrize("effect", ["divide", "multiply"])
@pytest.mark.parametrize("alpha", [1e-9, 0.05])
def test_power(spark, effect, alpha):
    variants = spark.createDataFrame([(i, i / 100) for i in range(1, 40, 3)], "variant_id long, maf double")
    sources = spark.createDataFrame([("GP", 20, 150), ("HES", 300, 4000)], "source string, cases long, n long")
    rows = power.association_power(variants, sources, (0.5, 1.5, 3), alpha, effect).collect()
    assert len(rows) == 13 * 2 * 3
    sizes = {"GP": (20, 150), "HES": (300, 4000)}
    for r in rows:
        expected = expected_power(r.maf, *sizes[r.source], r.odds_ratio, alpha, effect)
        assert r.power == pytest.approx(expected, rel=1e-6, abs=1e-12)


def test_standard_grid_has_full_power(spark):
    """Rare variants get the larger effect, so with the cohort sizes of the grid all power is 1."""
    variants = spark.range(1, 31).select((F.col("id") / 1000).alias("maf"))
    sources = spark.createDataFrame([("GP", 8793, 209832), ("HES", 2998, 451229)], "source string, cases long, n long")
    rows = power.association_power(variants, sources).collect()
    assert len(rows) == 180 and {r.power for r in rows} == {1.0}


def test_undefined_power_is_null(spark):
    variants = spark.createDataFrame([("ok", 0.1), ("none", 0.0), ("all", 1.0), ("?", None)], "id string, maf double")
    sources = spark.createDataFrame(
        [("some", 5, 100), ("no cases", 0, 100), ("no controls", 7, 7), ("empty", 0, 0)], "source string, cases long, n long"
    )
    rows = power.association_power(variants, sources, [2]).collect()
    assert len(rows) == 16
    assert {(r.id, r.source) for r in rows if r.power is not None} == {("ok", "some")}


def test_any_number_of_sources(spark):
    variants = spark.createDataFrame([(0.1,)], "maf double")
    sources = spark.createDataFrame([(str(i), 5, 100) for i in range(1001)], "source string, cases long, n long")
    assert power.association_power(variants, sources).count() == 3003


def test_lines_and_calls_of_other_chromosomes_are_left_out(spark):
    genotypes = spark.createDataFrame([(1, "1", 5, "A", "G", 2), (1, "X", 5, "A", "G", 2), (1, "23", 5, "A", "G", 2)], GENOTYPES.replace("chrom int", "chrom string"))
    lines = [(chrom, 5, "G", "A", weight) for chrom, weight in (("1", 0.5), ("X", 9.0), ("Y", 9.0), ("23", 9.0))]
    scores = spark.createDataFrame(lines, SCORES.replace("chrom int", "chrom string"))
    assert [r.score for r in genetics.genetic_score(genotypes, scores).collect()] == [0.5]
    assert genetics.genetic_score(genotypes, scores.limit(0)).count() == 0


def score_rows(spark, rows):
    return spark.createDataFrame([(c, p, "A", 1.0) for c, p in rows], "chrom int, pos long, effect_allele string, weight double")


def test_slices_keep_below_the_limit_and_hold_every_row_once(spark):
    rng = random.Random(5)
    rows = [(c, p) for c, most in ((1, 300_000_000), (2, 50), (3, 10**9), (4, 10)) for p in rng.sample(range(most), min(most, 400))]
    rows += [(3, 5_000_000 + i) for i in range(600)]  # a dense stretch
    scores = score_rows(spark, set(rows))
    row_bytes = scores.limit(1).agg(table_bytes(scores)).first()[0]
    limit = 70 * row_bytes
    sets = position_slices(scores, limit)
    held = [[(c, p) for c, p in set(rows) if any(s.chrom == c and s.low <= p <= s.high for s in slices)] for slices, _ in sets]
    assert sorted(x for own in held for x in own) == sorted(set(rows))
    assert all(small and 0 < len(own) * row_bytes <= limit for (_, small), own in zip(sets, held))
    assert len(sets) < 3 * len(set(rows)) * row_bytes / limit


def test_small_chromosomes_share_a_set(spark):
    scores = score_rows(spark, [(1, 5), (1, 900), (2, 7), (22, 1)])
    assert position_slices(scores, 1 << 20) == [([Slice(1, 5, 900), Slice(2, 7, 7), Slice(22, 1, 1)], True)]
    assert position_slices(scores.limit(0), 1 << 20) == []
    assert [small for _, small in position_slices(scores, 1)] == [False] * 4


@pytest.mark.parametrize("missing", ["impute", "drop"])
def test_genotypes_are_neither_shuffled_nor_read_beyond_a_slice(spark, tmp_path, missing):
    """A chromosome beyond the limit is sent in slices; a table sorted by position is pruned to each."""
    positions = range(0, 40_000, 10)
    scores = spark.createDataFrame([(1, p, "G", "A", (p % 64) / 64) for p in positions], SCORES)
    calls = spark.range(0, 40_000, 10).selectExpr("explode(array(1L, 2L, 3L)) eid", "1 AS chrom", "id AS pos", "'A' AS allele1", "'G' AS allele2", "CAST((id DIV 10 + 1) % 3 AS INT) AS allele1_count")
    calls.repartitionByRange(4, "chrom", "pos").sortWithinPartitions("chrom", "pos").write.parquet(f"{tmp_path}/genotypes")
    genotypes = spark.read.parquet(f"{tmp_path}/genotypes")
    found = genetics.genetic_score(genotypes, scores, missing, max_broadcast_bytes=100_000)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan
    assert "GreaterThanOrEqual(pos," in plan and "LessThanOrEqual(pos," in plan and "EqualTo(chrom,1)" in plan
    whole = genetics.genetic_score(genotypes, scores, missing).collect()
    assert {r.eid: r.score for r in found.collect()} == {r.eid: r.score for r in whole} and len(whole) == 3


def people_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "eid long")


def test_bitmaps_count_numbers_of_any_size(spark):
    ids = [0, 1, -1, 32768, 32769, 32767, -32768, 2**40, -(2**40), 2**62, 5, 5, None, 10**12 + 3]
    frames = {"a": (people_of(spark, ids), people_of(spark, ids * 2)), "b": (people_of(spark, []), people_of(spark, [2**62]))}
    for distinct in ("bitmap", "rows"):
        assert {tuple(r) for r in power.source_case_rates(frames, distinct).collect()} == {("a", 12, 12, 1.0), ("b", 0, 1, 0.0)}
    with pytest.raises(ValueError, match="distinct"):
        power.source_case_rates(frames, "sketch")


def test_only_bitmaps_are_shuffled(spark):
    frames = {"a": (people_of(spark, range(10)), people_of(spark, range(100)))}
    plan = power.source_case_rates(frames)._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in plan
    first = plan[plan.rindex("partial_bitmap_construct_agg") :]
    assert "Exchange" not in first  # nothing is dealt out below the partial bitmaps


def test_words_count_numbers_of_any_size(spark):
    ids = [0, 1, -1, 63, 64, 65, -63, -64, -65, 2**40, -(2**40), 2**62, 2**63 - 1, -(2**63), 5, 5, None, 10**12 + 3]
    frames = {"a": (people_of(spark, ids), people_of(spark, ids * 2)), "b": (people_of(spark, []), people_of(spark, [2**62])), "c": (people_of(spark, []),) * 2}
    found = power.source_case_rates(frames, "words").collect()
    assert {tuple(r) for r in found} == {("a", 16, 16, 1.0), ("b", 0, 1, 0.0), ("c", 0, 0, None)} and len(found) == 3


def test_words_are_hashed_where_rows_are_read(spark):
    frames = {"a": (people_of(spark, range(10)), people_of(spark, range(100)))}
    plan = power.source_case_rates(frames, "words")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan  # a task holds no row, only words
    assert "Exchange" not in plan[plan.rindex("partial_bit_or") :]


@pytest.mark.parametrize("distinct", ["bitmap", "rows"])
def test_case_rates(spark, distinct):
    def people(*ids):
        return spark.createDataFrame([(i,) for i in ids], "eid long")

    rates = power.source_case_rates(
        {
            "GP": (people(1, 1, 2), people(1, 2, 2, 3, 4)),
            "HES": (people(), people(5, None)),
            "OPCS": (people(9), people()),
            "Death": (people(), people()),
        },
        distinct,
    )
    assert {tuple(r) for r in rates.collect()} == {("GP", 2, 4, 0.5), ("HES", 0, 1, 0.0), ("OPCS", 1, 0, None), ("Death", 0, 0, None)}

"""Inverse normal, roots, and the test's unknowns from the others."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from phenotide.functions.normal import cdf_of, crossing, quantile_of
from phenotide.operators import power

NORMAL = NormalDist()


def test_quantile_over_the_whole_range(spark):
    ps = [10.0**-k for k in range(1, 300, 7)] + [k / 200 for k in range(1, 200)] + [1 - 10.0**-k for k in range(2, 15)]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", quantile_of(F.col("p")).alias("x"), cdf_of(quantile_of(F.col("p"))).alias("back")).collect()
    for r in rows:
        assert math.isclose(r.x, NORMAL.inv_cdf(r.p), rel_tol=1e-14, abs_tol=1e-15)
        assert math.isclose(r.back, r.p, rel_tol=1e-7)


def test_quantile_outside_of_its_range_is_null(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (-0.5,), (2.0,), (None,)], "p double").select(quantile_of(F.col("p")).alias("x")).collect()
    assert [r.x for r in rows] == [None] * 5


def test_crossing(spark):
    df = spark.createDataFrame([(2.0, 0.0, 2.0), (9.0, 0.0, 9.0), (2.0, None, 2.0)], "a double, low double, high double")
    found = [r.x for r in df.select(crossing(F.col("low"), F.col("high"), lambda x: x * x < F.col("a")).alias("x")).collect()]
    assert found[0] == pytest.approx(math.sqrt(2), rel=1e-15) and found[1] == pytest.approx(3, rel=1e-15) and found[2] is None


@pytest.fixture(scope="module")
def tables(spark):
    variants = spark.createDataFrame([(1, 0.01), (2, 0.3), (3, 0.0), (4, None)], "variant_id long, maf double")
    sources = spark.createDataFrame([("GP", 8793, 209832), ("small", 3, 40), ("none", 0, 10), ("all", 5, 5)], "source string, cases long, n long")
    return variants, sources


def direct(ratio, alpha, maf, cases, n, effect):
    spread = math.sqrt(2 * maf * (1 - maf))
    size = abs(math.log(ratio)) / spread if effect == "divide" else abs(math.log(ratio)) * spread
    t, c = size * math.sqrt(cases * (n - cases) / n), -NORMAL.inv_cdf(alpha / 2)
    return NORMAL.cdf(t - c) + NORMAL.cdf(-c - t)


@pytest.mark.parametrize("unknown", ["power", "alpha", "cases", "odds_ratio"])
@pytest.mark.parametrize("effect", ["divide", "multiply"])
def test_what_is_found_gives_the_power(tables, unknown, effect):
    rows = power.association_solve(*tables, unknown, odds_ratios=(0.7, 1.05), alphas=(1e-9, 0.05), powers=(0.8, 0.1), effect=effect).collect()
    sizes = {"odds_ratio": 2, "alpha": 2, "power": 2}
    sizes.pop(unknown, None)
    assert len(rows) == 4 * 4 * math.prod(sizes.values())
    seen = 0
    for r in rows:
        if r.maf and r.source in ("GP", "small"):
            seen += 1
            if r.alpha < 1e-250:  # so strong a test reaches the power at any level
                continue
            assert math.isclose(direct(r.odds_ratio, r.alpha, r.maf, r.cases, r.n, effect), r.power, rel_tol=1e-8, abs_tol=1e-12)
            if unknown == "cases":
                assert math.isclose(r.cases / r.n, {"GP": 8793 / 209832, "small": 3 / 40}[r.source], rel_tol=1e-12)
            if unknown == "odds_ratio":
                assert r.odds_ratio > 1
        else:
            assert r[unknown] is None
    assert seen == len(rows) // 4


def test_power_solved_equals_the_power_operator(tables):
    solved = power.association_solve(*tables, "power", odds_ratios=(1.5, 3.0)).collect()
    known = power.association_power(*tables, odds_ratios=(1.5, 3.0)).collect()
    by = {(r.variant_id, r.source, r.odds_ratio): r.power for r in known}
    for r in solved:
        expected = by[r.variant_id, r.source, r.odds_ratio]
        assert (r.power is None) == (expected is None) and (expected is None or math.isclose(r.power, expected, rel_tol=1e-9))


def test_impossible_designs_are_null(tables):
    rows = power.association_solve(*tables, "cases", odds_ratios=(1.0, 2.0), alphas=(0.05, 0.0, 1.5), powers=(0.05, 0.01, 0.9, 1.0)).collect()
    for r in rows:
        possible = r.odds_ratio == 2.0 and r.alpha == 0.05 and r.power == 0.9 and r.maf and r.source in ("GP", "small")
        assert (r.cases is not None) == bool(possible)


def test_roots_are_found_once_per_design(tables):
    """The expression that halves brackets lies in a subquery over the designs, not above the variants."""
    plan = power.association_solve(*tables, "cases")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(sequence" not in plan.split("scalar-subquery")[0]


def test_wrong_names_are_refused(tables):
    with pytest.raises(ValueError, match="unknown"):
        power.association_solve(*tables, "maf")
    with pytest.raises(ValueError, match="effect"):
        power.association_solve(*tables, "cases", effect="add")



"""Hard negatives against brute force: small shards, blocks and pages, hot copies, ties and awkward rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phenotide.llm import hard_negatives as H


def brute(rows, every, positives=5, negatives=5):
    """rows: (id, label, vector) without nulls."""
    rows, out = sorted({(i, str(x), tuple(v)) for i, x, v in rows if None not in (i, x, v)}), Counter()
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, x, v in rows:
        if i % every:
            continue
        near = sorted((-score(v, w), j, y) for j, y, w in rows if len(w) == len(v))
        for p, j, _ in [n for n in near if n[2] == x and n[1] != i][:positives]:
            fits = [n for n in near if n[2] != x and 80 * -p <= 100 * -n[0] <= 100 * -p]
            for rank, (s, m, _) in enumerate(fits[:negatives], 1):
                out[i, j, rank, m, -p, -s] += 1
    return out


def mined(spark, rows, every, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    return Counter(tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0, **options).collect())


def vectors(n, size, seed, labels=3, reach=60):
    rng = random.Random(seed)
    centres = [[rng.randint(-reach, reach) for _ in range(size)] for _ in range(4)]
    return [(i, rng.randrange(labels), [c + rng.randint(-20, 20) for c in rng.choice(centres)]) for i in range(n)]


SMALL = {"shard": 16, "block": 4, "page": 2, "codes": 3, "sample": 50}


@pytest.mark.parametrize("size", [1, 2, 7, 16])
def test_small_shards_equal_brute_force(spark, size):
    rows = vectors(150, size, size)
    found = mined(spark, rows, 5, **SMALL)
    assert found == brute(rows, 5) and found


def test_one_shard_equals_brute_force(spark):
    rows = vectors(300, 8, 9)
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_hot_copies_ties_and_repeated_rows(spark):
    hot = [(i, i % 2, [30, 40, 10, 5]) for i in range(100, 180)]
    rows = hot + vectors(60, 4, 3) + hot[:5] + [(300 + i, 0, [30, 40, 10, 4]) for i in range(5)]
    found = mined(spark, rows, 20, **SMALL)
    assert found == brute(rows, 20) and found


def test_awkward_rows(spark):
    rows = vectors(40, 6, 4) + [(None, 1, [1] * 6), (1000, None, [1] * 6), (1010, 1, None), (1020, 1, []), (1030, 2, []), (1040, 1, [3, 4]), (1050, 2, [3, 4]), (1060, 1, [3, 4]), (10, 2, [5] * 6), (10, 1, [5] * 6)]
    assert mined(spark, rows, 10, **SMALL) == brute(rows, 10)


def test_scores_beyond_doubles(spark):
    rows = [(i, i % 2, [2**29 + i, 2**29 - i * 3]) for i in range(30)]
    assert mined(spark, rows, 10, **SMALL) == brute(rows, 10)


def test_empty_table_and_other_columns(spark):
    assert mined(spark, [], 5) == Counter()
    rows = vectors(50, 4, 6)
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, label int, vector array<long>, shard int, rank string")
    assert Counter(tuple(r) for r in H.mine(df, F.col("vec_id") % 5 == 0, **SMALL).collect()) == brute(rows, 5)


def test_far_shards_are_not_met(spark):
    """Clusters far apart: a block meets few shards, and a heap opens few cells."""
    rows = [(i, i % 3, [1000 * (c == i % 8) + (i * 7 + c) % 5 for c in range(8)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label string, vector array<long>").withColumns({"dimension": F.size("vector"), "anchor": F.col("vec_id") % 10 == 0})
    index = H.Index(df, shard=32, page=2, codes=8, sample=400)
    blocks = index.blocks(8).collect()
    import pickle

    shards = index.shards.collect()
    for b in blocks:
        ids, labels, rows_, asked = pickle.loads(b.anchors)
        served = [s.shard for s in shards if pickle.loads(s.summary).can_serve(asked, [(900_000, H.inf)] * len(asked))]
        assert 0 < len(served) < len(shards) / 2
    whole = next(pickle.loads(s.rows) for s in shards)
    best = H.Best(-H.inf, H.inf, 2)
    query = whole.rows[:1]
    bounds = [(top[0], least[0]) for top, least in whole.bounds(query)]
    score = whole.scorer(query)
    assert whole.visit(bounds, whole.ids >= 0, [best], lambda at: score(at, 0)) <= len(whole.spans)
    scores = sorted(((-int(x), int(i)) for x, i in zip(whole.rows @ query[0], whole.ids)))
    assert best.rows == scores[:2]

"""The Merkle manifest against a plain tree, on awkward rows, hot groups and several rounds."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from phenotide.llm import merkle_manifest as M


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Levels of digests, three nodes to a parent."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def siblings(levels, i):
    path = []
    for level in levels[:-1]:
        first = i // 3 * 3
        path.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return path


def brute(rows):
    """rows: (key, group, leaf) -> multiset of (key, leaf, subroot, root, path)."""
    groups = defaultdict(list)
    for key, group, leaf in rows:
        groups[group].append((key is not None, key or 0, leaf, key))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names]
    outer = plain_tree([t[-1][0] for t in trees]) if trees else []
    out = Counter()
    for place, (g, tree) in enumerate(zip(names, trees)):
        for i, (_, _, leaf, key) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            out[key, leaf, tree[-1][0], outer[-1][0], tuple(siblings(tree, i) + siblings(outer, place))] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in df.collect())


SCHEMA = "doc_id long, source string, leaf string, root string, path string, _row long"


def leaves(spark, rows):
    return spark.createDataFrame([(k, g, x, "r", "p", 1) for k, g, x in rows], SCHEMA)


AWKWARD = [(5, "b", digest("5")), (None, "b", digest("n")), (5, "b", digest("5")), (5, "b", digest("other")), (1, None, digest("1")), (2, "", digest("2")), (3, "é", digest("3")), (3, "z", digest("3")), (None, None, digest("x"))]


@pytest.mark.parametrize("rows", [[], [(1, "a", digest("1"))], AWKWARD], ids=["none", "one", "awkward"])
def test_awkward_rows(spark, rows):
    assert found(M.prove(leaves(spark, rows), "doc_id", "source", "leaf")) == brute(rows)


@pytest.mark.parametrize("height", [1, 2])
def test_several_rounds_and_a_hot_group(spark, monkeypatch, height):
    monkeypatch.setattr(M, "HEIGHT", height)
    monkeypatch.setattr(M, "BLOCK", 3**height)
    rows = [(i * 7 % 101, "hot" if i % 3 else f"s{i % 40}", digest(str(i % 90))) for i in range(150)]
    assert found(M.prove(leaves(spark, rows), "doc_id", "source", "leaf")) == brute(rows)


def test_repeated_rows_beyond_a_block(spark):
    rows = [(1, "a", digest("same"))] * 500 + [(2, "b", digest("b"))]
    assert found(M.prove(leaves(spark, rows), "doc_id", "source", "leaf")) == brute(rows)


def test_leaf_of_any_values(spark):
    rows = [(1, None, "", "ünï\n", -5), (None, "a", None, "x", 10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long")
    made = df.select(M.leaf_of(*(F.col(c) for c in df.columns)).alias("leaf")).collect()
    assert Counter(r.leaf for r in made) == Counter(encoded(*r) for r in rows)


def test_folding_finds_what_was_changed(spark):
    rows = [(i, f"s{i % 3}", digest(str(i))) for i in range(20)]
    proven = M.prove(leaves(spark, rows), "doc_id", "source", "leaf", carry=("_row",))
    folded = proven.select("doc_id", "_row", "root", M.fold(F.col("leaf"), F.col("path")).alias("right"), M.fold(F.lit(digest("no")), F.col("path")).alias("wrong"), M.proof_digest(F.col("path")).alias("proof"), "path")
    for r in folded.collect():
        assert r.right == r.root != r.wrong and r._row == 1
        assert r.proof == digest("".join(s.left + s.right for s in r.path))


def test_columns_of_the_result_are_not_carried(spark):
    with pytest.raises(ValueError, match="path"):
        M.prove(leaves(spark, AWKWARD), "doc_id", "source", "leaf", carry=("path",))

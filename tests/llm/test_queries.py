"""Queries with SQL against it, row by row and type by type; the others against brute force over the whole tables."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken
from test_operators import brute_components, brute_counts, brute_fingerprint, brute_verdict, library
from test_suffix_dedup import brute as brute_removal

from phenotide.llm import byte_bpe, queries, toxicity

SF_DIR = "/root/testdata/sf0.01"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    sql = queries.oracle_sql()[name]
    df = queries.registered()[name](spark, SF_DIR)
    kinds = {r[0]: r[1] for r in connection.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    columns = sorted(df.columns)
    expected = connection.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert found and sorted(found) == sorted(expected)


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()


def run(spark, name, **types):
    """The query's rows; its columns begin with those of the contract, of the given types."""
    df = queries.registered()[name](spark, SF_DIR)
    assert dict(df.dtypes) | types == dict(df.dtypes) and list(types) == df.columns[: len(types)]
    return df.collect()


LONGS = lambda *names: dict.fromkeys(names, "bigint")


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_op2(spark, documents):
    rows = run(spark, "op2_packing", **LONGS("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    encode, expected = library(P.path("word_bpe_49k.json")), {}
    for d in documents:
        expected[d["doc_id"]] = [*encode(d["text"] or ""), 1]
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = expected[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(expected[r.doc_id]) and r.ids_crc32 == zlib.crc32(packed(ids))
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, pieces in covered.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == len(expected[i])
    assert set(covered) == set(expected)
    for pieces in sequences.values():
        total = sum(n for _, n in pieces)
        assert [a for a, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
        assert total <= 2048 and total & (total - 1) == 0


def test_op3(spark, documents):
    rows = run(spark, "op3_token_counts", doc_id="bigint", n_bytes="bigint", n_tokens="bigint", over_limit="boolean")
    encode = library(P.path("byte_bpe_50k.json"))
    assert Counter(map(tuple, rows)) == Counter((d["doc_id"], len((d["text"] or "").encode()), n := len(encode(d["text"] or "")), n > 512) for d in documents)


def test_op4(spark, documents):
    rows = run(spark, "op4_quality_rules", **LONGS("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), base_failed="boolean")
    by = {r.doc_id: r for r in rows}
    counts = [brute_counts(d["text"] or "") for d in documents]
    kept = brute_verdict([(d["lang"], d["source"], *c) for d, c in zip(documents, counts)])[1]
    for d, c, k in zip(documents, counts, kept):
        r = by[d["doc_id"]]
        assert tuple(r)[1:6] == c and r.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0]) and r.kept == k
    assert len(rows) == len(documents)


def test_op5(spark, documents):
    rows = run(spark, "op5_simhash", doc_id="bigint", fingerprint="string", component_id="bigint")
    prints = [brute_fingerprint(d["text"] or "") for d in documents]
    label, least = brute_components(prints), {}
    for d, p in zip(documents, prints):
        least[label[p]] = min(least.get(label[p], d["doc_id"]), d["doc_id"])
    assert Counter(map(tuple, rows)) == Counter((d["doc_id"], f"{p:016x}", least[label[p]]) for d, p in zip(documents, prints))


def test_op6(spark, documents):
    rows = run(spark, "op6_suffix_dedup", doc_id="bigint", n_bytes="bigint", n_removed="bigint", n_spans="bigint", kept_sha256="string")
    found = brute_removal([d["text"] or "" for d in documents], 200)
    assert Counter(map(tuple, rows)) == Counter((d["doc_id"], *f[:-1], hashlib.sha256(f[-1]).hexdigest()) for d, f in zip(documents, found))
    assert any(r.n_removed for r in rows)


def test_op8(spark, documents):
    rows = run(spark, "op8_byte_bpe", doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    made = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expected = Counter()
    for d in documents:
        ids = made.encode_ordinary(d["text"] or "")
        expected[d["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == expected


def test_op9(spark, documents):
    """Scores in plain Python from the same weights; labelled documents are told apart."""
    rows = run(spark, "op9_toxicity", doc_id="bigint", expected_severity="double", p_toxic="double", grade="int", kept="boolean")
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    by = {r.doc_id: r for r in rows}
    for d in documents:
        words = (d["text"] or "").lower().split()
        score = sum((1 + math.log(n)) * sum(model.weights.get(i, 0) for i in toxicity.features_of(w)) for w, n in Counter(words).items()) / max(1, len(words)) ** toxicity.POWER
        reached = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        r = by[d["doc_id"]]
        assert r.expected_severity == pytest.approx(sum(reached), abs=1e-9) and r.kept == (reached[0] < 0.2)
    toxic = [r.doc_id for r in labels.where("toxic = 1").collect() if r.doc_id in by]
    clean = [r.doc_id for r in labels.where("toxic = 0").collect() if r.doc_id in by]
    assert np.mean([not by[i].kept for i in toxic]) > 0.95 and np.mean([by[i].kept for i in clean]) > 0.95


def test_op9_is_a_minimum(spark):
    """The conditions that only a minimiser of the penalised likelihood meets."""
    rng = np.random.default_rng(1)
    x = (rng.random((300, 25)) < 0.2) * rng.random((300, 25)).round(2)
    score = x[:, 0] * 6 + x[:, 1] * 4 - x[:, 2] * 3
    grades = np.searchsorted([1.0, 2.5], score + rng.logistic(0, 0.4, 300))
    rows = [np.flatnonzero(r) for r in x]
    penalty = 2e-3
    model = toxicity.fit(toxicity.Features(rows, [r[i] for r, i in zip(x, rows)]), grades, penalty=penalty, rounds=5000, tolerance=1e-9)
    weights = np.array([model.weights.get(i, 0.0) for i in range(25)])
    x = x.astype(np.float32).astype(float)

    def cost(w, t):
        above = np.concatenate([np.ones((300, 1)), 1 / (1 + np.exp(np.array(t)[None] - (x @ w)[:, None])), np.zeros((300, 1))], axis=1)
        own = above[np.arange(300), grades] - above[np.arange(300), grades + 1]
        return -np.log(own).mean()

    step, t = 1e-6, np.array(model.thresholds)
    for j in range(25):
        e = np.eye(25)[j] * step
        slope = (cost(weights + e, t) - cost(weights - e, t)) / (2 * step)
        assert abs(slope + penalty * np.sign(weights[j])) < 1e-5 if weights[j] else abs(slope) <= penalty + 1e-5
    for j in range(len(t)):
        e = np.eye(len(t))[j] * step
        assert abs(cost(weights, t + e) - cost(weights, t - e)) / (2 * step) < 1e-5
    assert 0 < np.count_nonzero(weights) < 25


def test_op10(spark, documents):
    rows = run(spark, "op10_token_files", **LONGS("doc_id", "start", "n_tokens", "ids_crc32"))
    encode, at, expected = library(P.path("word_bpe_49k.json")), 0, Counter()
    for d in sorted(documents, key=lambda d: d["doc_id"]):
        ids = [*encode(d["text"] or ""), 2]
        expected[d["doc_id"], at, len(ids), zlib.crc32(packed(ids))] += 1
        at += len(ids)
    assert Counter(map(tuple, rows)) == expected


def test_every_query_is_tested():
    named = {f"op{n}" for n in (2, 3, 4, 5, 6, 8, 9, 10, 12)} | {name.split("_")[0] for name in queries.oracle_sql()}
    assert {name.split("_")[0] for name in queries.registered()} == named

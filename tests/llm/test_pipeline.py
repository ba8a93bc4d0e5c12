"""The pipeline against brute-force versions of its stages, and on awkward and empty tables."""

import math
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_operators import brute_components, brute_counts, brute_fingerprint, brute_verdict, library
from test_suffix_dedup import brute as brute_removal

import corpus_pipeline
from phenotide.llm import packing, toxicity

WORDS = P.path("word_bpe_49k.json")


def brute_run(spark, docs, labels):
    """docs: rows (doc_id, text, lang, source). The model is fitted by the operator; the rest is plain Python."""
    verdicts = brute_verdict([(lang, source, *brute_counts(text or "")) for _, text, lang, source in docs])[1]
    docs = [d for d, kept in zip(docs, verdicts) if kept]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    model = toxicity.train(frame, labels)
    fine = []
    for d in docs:
        words = d[1].lower().split()
        score = sum((1 + math.log(n)) * sum(model.weights.get(i, 0) for i in toxicity.features_of(w)) for w, n in Counter(words).items())
        score /= max(1, len(words)) ** toxicity.POWER
        if not model.thresholds or 1 / (1 + math.exp(model.thresholds[0] - score)) < 0.2:
            fine.append(d)
    prints = [brute_fingerprint(d[1]) for d in fine]
    label, kept = brute_components(prints), {}
    for d, p in zip(fine, prints):
        kept[label[p]] = min(kept.get(label[p], d), d, key=lambda x: (x[0] is None, x[0] or 0))
    docs = list(kept.values())
    cut = [left.decode("utf-8", "ignore") for *_, left in brute_removal([d[1] for d in docs], 200)]
    encode, out = library(WORDS), Counter()
    for d, text in zip(docs, cut):
        ids, at = [*encode(text), 1], 0
        for n in packing.piece_lengths(len(ids), 2048):
            out[d[0], at, tuple(ids[at : at + n])] += 1
            at += n
    return out


def run(spark, folder):
    return Counter((r.doc_id, r.start, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(folder)).collect())


def test_run_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]
    expected = brute_run(spark, docs, spark.read.parquet(f"{folder}/labels.parquet"))
    found = run(spark, folder)
    assert found == expected and len({k[0] for k in found}) > 50


@pytest.fixture()
def folder(tmp_path):
    def write(rows, labels):
        names = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64(), "kept": pa.string(), "fingerprint": pa.string(), "n_words": pa.int64()}
        pq.write_table(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(names.items())}), tmp_path / "documents.parquet")
        pq.write_table(pa.table({n: pa.array([x[i] for x in labels], pa.int64()) for i, n in enumerate(("doc_id", "quality", "toxic"))}), tmp_path / "labels.parquet")
        return str(tmp_path)

    return write


def fresh(i):
    return " ".join(f"w{(i * 7919 + j * 104729) % 10007}" for j in range(60 + i))


def test_awkward_rows_and_clashing_columns(spark, folder):
    row = lambda i, text, lang="en", source="s": (i, text, lang, source, len(text or ""), "own", "f", 7)
    texts = [row(i, fresh(i)) for i in range(30)]
    rows = [*texts, row(100, fresh(3)), row(101, fresh(4)), row(None, fresh(50), None, None), row(None, fresh(50)), row(200, None), row(201, ""), row(202, fresh(9) + " more")]
    rows += [row(300, fresh(60)), row(300, fresh(60)), row(None, None)]
    path = folder(rows, [(1, 1, 0), (1, None, None), (None, 1, 1)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, path)
        assert after.columns == docs.columns
        assert {(r.kept, r.fingerprint, r.n_words) for r in after.collect()} == {("own", "f", 7)}, name
    ids = Counter(k[0] for k in run(spark, path) if k[1] == 0)
    assert ids == Counter([*range(30), 202, 300, None])


def test_empty_table(spark, folder):
    assert run(spark, folder([], [])) == Counter()


def test_columns_between_the_stages(spark, folder):
    path = folder([(1, fresh(1), "en", "s", 5, "k", "f", 1)], [(1, 1, 0)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).dtypes == docs.dtypes

"""Operators on awkward rows: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phenotide.llm import byte_bpe, common, components, kd_search, lookup_sharding, packing, quality_rules, simhash, suffix_dedup, text_statistics, token_counts, token_files, toxicity
from phenotide.llm.common import shared_folder

WORDS, BYTES, RANKS = (P.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, ids string, fingerprint string, n_words string, score string"
LONG = "Once upon a time there was a very long text, no doubt. " * 3000


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, 0, "k", "i", "f", "w", "s")


ROWS = [row(3, "Hello there, world!"), row(1, None), row(None, "A null key"), row(2, ""), row(5, " \n\t"), row(4, LONG), row(6, "Hello there, world!"), row(6, "Hello there, world!"), row(7, "ünïcode 日本語 \U0001f642 ½", None, None), row(8, "x" * 5000)]


@pytest.fixture(params=["rows", "none"])
def docs(spark, request):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def library(path):
    made = Tokenizer.from_file(path)
    return lambda text: made.encode(text, add_special_tokens=False).ids


def test_token_counts_and_their_cache(spark, docs):
    cache, encode = shared_folder(spark, "cache"), library(BYTES)
    for _ in range(2):
        found = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("x")), cache, BYTES, limit=5)
        expected = Counter((i, len(t.encode()), n := len(encode(t)), n > 5) for i, t in texts(docs))
        assert Counter(tuple(r) for r in found.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == expected
        assert set(docs.columns) < set(found.columns)
        assert spark.read.parquet(cache).count() == len({t for _, t in texts(docs)})


def test_cached_counts_of_another_version_do_not_count(spark):
    docs = spark.createDataFrame(ROWS[:1], SCHEMA)
    cache = shared_folder(spark, "cache")
    digest = hashlib.sha256(ROWS[0][1].encode()).hexdigest()
    spark.createDataFrame([(digest, "old", 99)], token_counts.CACHE_SCHEMA).write.parquet(cache)
    assert token_counts.count_tokens(docs, cache, BYTES).first().n_tokens != 99
    spark.createDataFrame([(digest, token_counts.tokenizer_digest(WORDS), 77)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert token_counts.count_tokens(docs, cache, WORDS).first().n_tokens == 77  # a stored count is taken, not encoded again


def test_packing(docs):
    encode, by = library(WORDS), defaultdict(list)
    rows = packing.pack(docs, WORDS, end_id=1, longest=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        assert r.length == 1 << r.bucket <= 64 and len(r.ids) == r.length and r.offset == 0
        by[r.doc_id, r.doc_tokens].append(r)
    expected = Counter((i, tuple([*encode(t), 1])) for i, t in texts(docs))
    whole = Counter()
    for (key, n), pieces in by.items():
        starts = Counter(p.start for p in pieces)
        for at in range(starts[0]):  # repeated rows have the same pieces
            own = {p.start: p for p in sorted(pieces, key=lambda p: (p.start, p.sequence_id))[at :: starts[0]]}
            ids = [x for s in sorted(own) for x in own[s].ids]
            assert len(ids) == n
            whole[key, tuple(ids)] += 1
    assert whole == expected


def test_packing_needs_a_power_of_two(docs):
    with pytest.raises(ValueError):
        packing.pack(docs, WORDS, 1, longest=100)


def test_piece_lengths():
    assert packing.piece_lengths(2048 + 5, 2048) == [2048, 4, 1]
    assert [sum(packing.piece_lengths(n, 8)) for n in range(40)] == list(range(40))


def test_buckets_are_stored_by_length(spark, docs):
    folder = shared_folder(spark, "buckets")
    pieces = packing.pack(docs, WORDS, end_id=1, longest=64)
    packing.write_buckets(pieces, folder)
    assert spark.read.parquet(folder).count() == pieces.count() if pieces.count() else True


def test_token_files(spark, docs):
    folder, encode = shared_folder(spark, "files"), library(WORDS)
    token_files.write_tokens(docs, folder, WORDS, end_id=2)
    found = token_files.with_start(token_files.read_tokens(spark, folder), spark, folder)
    rows = found.select("doc_id", "start", "n_tokens", token_files.crc32_of_ids(F.col("ids")).alias("crc")).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    ids = [(i, [*encode(t), 2]) for i, t in texts(docs)]
    assert Counter((r.doc_id, r.n_tokens, r.crc) for r in rows) == Counter((i, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, x in ids)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in ids), key=lambda i: (i is not None, i))


def test_token_files_have_the_chosen_layout(spark):
    folder = shared_folder(spark, "files")
    docs = spark.createDataFrame([row(i, f"text number {i} " * 40) for i in range(3000)], SCHEMA)
    token_files.write_tokens(docs.coalesce(1), folder, WORDS, end_id=2, row_group=1 << 16, page=1 << 12)
    path = next(f for f in spark.read.parquet(folder).inputFiles()).removeprefix("file://")
    meta = pq.ParquetFile(path).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["shard_start"].encodings
    assert any("DICTIONARY" in x for x in columns["ids.list.element"].encodings)
    assert columns["ids.list.element"].has_offset_index and columns["doc_id"].has_column_index
    narrow = token_files.read_tokens(spark, folder, ("doc_id", "n_tokens"))
    assert "ids" not in narrow._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_starts_are_added_without_a_shuffle_of_ids(spark):
    folder, limit = shared_folder(spark, "files"), "spark.sql.autoBroadcastJoinThreshold"
    token_files.write_tokens(spark.createDataFrame([row(i, f"text {i}") for i in range(50)], SCHEMA), folder, WORDS, end_id=2)
    usual = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        found = token_files.with_start(token_files.read_tokens(spark, folder), spark, folder)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, usual)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_slices_of_text_keep_every_row_and_to_their_size():
    column = pa.array(["", "a" * 5, "", "b" * 30, "c", "", "d" * 4, "e" * 9])
    batch = pa.RecordBatch.from_arrays([column, pa.array(range(8))], ["_text", "row"])
    found = list(common.slices_of_text([batch, batch.slice(0, 0), batch.slice(3, 2)], most=10))
    assert [x for s in found for x in s.column("row").to_pylist()] == [*range(8), 3, 4]
    assert len(found) > 3 and all(sum(map(len, s.column("_text").to_pylist()[:-1])) < 10 for s in found)


def test_two_tier_encoding(docs):
    made = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    found = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in found.collect()) == Counter((i, tuple(made.encode_ordinary(t)), t.encode()) for i, t in texts(docs))
    assert found.columns[-1] == "decoded" and set(docs.columns) < set(found.columns)


def brute_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_text_statistics(spark):
    more = ["a b c d e f g h " * 3, "x\nx\n\n\ny\nx", "one two three four five six seven eight nine\none two three four five six seven eight", "a\xa0b # $%\x1cé", "\x0b\x0c"]
    docs = spark.createDataFrame([*ROWS, *(row(20 + i, t) for i, t in enumerate(more))], SCHEMA)
    found = text_statistics.with_statistics(docs).select("doc_id", *text_statistics.COUNTS).collect()
    assert Counter(tuple(r) for r in found) == Counter((i, *brute_counts(t)) for i, t in texts(docs))


def brute_verdict(rows, core=0.75, steps=8, tail=1e-9, prior=50):
    """Minimum determinants with sorted arrays. rows: (lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    dims, scales = 4, np.array(quality_rules.SCALES)
    floor = np.diag(scales**2)
    base = np.array([r[2] < 20 or 100 * r[6] > 30 * r[2] for r in rows], bool)
    parts = [(math.log((r[3] + 1) / max(1, r[2])), math.log1p(100 * r[4] / max(1, r[2])), math.log1p(100 * r[5] / max(1, r[2])), math.sqrt(r[6] / max(1, r[2]))) for r in rows]
    x = np.array([[math.floor(1024 * v + 0.5) / 1024 for v in p] for p in parts]).reshape(-1, dims)
    pools = defaultdict(list)
    for i, r in enumerate(rows):
        if not base[i]:
            for name in (r[:2], r[:1], ()):
                pools[name].append(x[i])
    q = quality_rules._quantile(core, dims)
    factor = core / quality_rules._chi2(q, dims + 2)
    now = {}
    for name, own in pools.items():
        own = pools[name] = np.array(own)
        middle, (low, high) = np.median(own, axis=0), np.quantile(own, [0.25, 0.75], axis=0)
        spread = ((high - low) / 1.349) ** 2 + scales**2
        units = (own - middle) / np.sqrt(spread)
        length = np.linalg.norm(units, axis=1, keepdims=True)
        signs = np.divide(units, length, out=np.zeros_like(units), where=length > 0)
        signs = np.sign(signs) * np.floor(np.abs(1024 * signs) + 0.5) / 1024
        turned = (dims * np.cov(signs.T, bias=True) + floor) * np.outer(np.sqrt(spread), np.sqrt(spread))
        for start, (mean, scatter) in enumerate([(middle, np.diag(spread)), (own.mean(axis=0), np.cov(own.T, bias=True) + floor), (middle, turned)]):
            now[name, start] = mean, scatter, math.inf
    for _ in range(steps):
        moved = False
        for (name, start), (mean, scatter, old) in now.items():
            own = pools[name]
            bins = np.floor(48 * np.log2(1 + np.maximum(0, np.einsum("ni,ij,nj->n", own - mean, np.linalg.inv(scatter), own - mean))))
            near = own[np.array([(bins < b).sum() < core * len(own) for b in bins])]
            scatter = factor * np.cov(near.T, bias=True) + floor
            logdet = np.linalg.slogdet(scatter)[1]
            moved |= abs(logdet - old) > quality_rules.SETTLED
            now[name, start] = near.mean(axis=0), scatter, logdet
        if not moved:
            break
    best = {name: min((round(now[name, s][2], 9), s) for s in range(3))[1] for name in pools}
    distance = []
    for i, r in enumerate(rows):
        mean = scatter = None
        for name in ((), r[:1], r[:2]):
            if name in pools:
                own_mean, own_scatter, _ = now[name, best[name]]
                w = 1 if mean is None else len(pools[name]) / (len(pools[name]) + prior)
                mean = own_mean if mean is None else w * own_mean + (1 - w) * mean
                scatter = own_scatter if scatter is None else w * own_scatter + (1 - w) * scatter
        distance.append(None if mean is None else float((x[i] - mean) @ np.linalg.inv(scatter) @ (x[i] - mean)))
    cut = quality_rules._quantile(1 - tail, dims)
    return distance, [not b and not (d is not None and d > cut) for b, d in zip(base.tolist(), distance)]


def judged_rows(found):
    return [(r.lang, r.source, *(r[c] for c in text_statistics.COUNTS)) for r in found]


def test_quality_rules_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted = text_statistics.with_statistics(docs).drop("text")
    found = quality_rules.with_verdict(counted).orderBy("doc_id").collect()
    distance, kept = brute_verdict(judged_rows(found))
    assert [r.kept for r in found] == kept
    assert all(math.isclose(r.distance, d, rel_tol=1e-6, abs_tol=1e-9) for r, d in zip(found, distance))
    assert {r.doc_id for r in found if not r.base_failed and not r.kept}


def test_smallest_determinant_of_the_starts(spark):
    """Two clusters: what is kept has no larger determinant than any start's own end."""
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(0, 30, (300, 4)), rng.normal(400, 90, (120, 4))]).round().astype(int)
    rows = spark.createDataFrame([("g", *map(int, p)) for p in points], "_group string, _x0 long, _x1 long, _x2 long, _x3 long")
    best = quality_rules._smallest_determinants(rows, 0.6, 8).first()
    ends = quality_rules._starts(rows)
    factor = 0.6 / quality_rules._chi2(quality_rules._quantile(0.6, 4), 6)
    for _ in range(8):
        ends = common.stored(quality_rules._step(rows, ends, 0.6, factor), "ends")
    dets = {r._start: r._logdet for r in ends.collect()}
    assert len(dets) == 3
    assert np.linalg.slogdet(np.array(best._scatter).reshape(4, 4))[1] == pytest.approx(min(dets.values()), abs=1e-3)
    assert np.abs(np.array(best._mean)).max() < 0.05


def test_judgement_does_not_jump_with_the_size_of_a_group(spark):
    rng = np.random.default_rng(6)
    stats = lambda r: (int(n := r.integers(80, 200)), int(n * r.uniform(4, 5)), int(r.integers(0, 3)), 0, 0)
    large = [("en", "large", *stats(rng)) for _ in range(400)]
    small = [("en", "small", *stats(rng)) for _ in range(104)]
    odd = ("en", "small", 100, 800, 30, 2, 0)
    schema = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    distances = []
    for n in (99, 100, 101):
        table = spark.createDataFrame([*large, *small[:n], odd], schema)
        distances.append(next(r.distance for r in quality_rules.with_verdict(table).collect() if r.n_symbols == 30))
    assert max(distances) / min(distances) < 1.3


def test_quality_rules_find_planted_outliers_in_groups_with_nulls(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    fine = [row(2000 + i, " ".join(word() for _ in range(rng.integers(60, 300))), None if i % 2 else "en", None) for i in range(300)]
    bad = [row(1000 + i, " ".join(word() + "###" for _ in range(100)), None, None) for i in range(20)]
    found = quality_rules.judge(spark.createDataFrame([*fine, *bad, *ROWS], SCHEMA)).collect()
    verdict = {r.doc_id: r.kept for r in found}
    assert len(found) == 320 + len(ROWS)
    assert all(verdict[r[0]] for r in fine) and not any(verdict[r[0]] for r in bad)
    assert not verdict[1] and not verdict[2]


def test_quality_rules_judge_small_groups_by_language_then_table(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    fine = lambda i, lang, source: row(i, " ".join(word() for _ in range(rng.integers(60, 300))), lang, source)
    bad = lambda i, lang, source: row(i, " ".join(word() + "###" for _ in range(100)), lang, source)
    good = [*(fine(1000 + i, "en", "large") for i in range(300)), *(fine(2000 + i, "en", "small") for i in range(5)), *(fine(3000 + i, "es", None) for i in range(5))]
    junk = [bad(4000, "en", "small"), bad(4001, "es", None), bad(4002, "fr", "lone"), bad(4003, None, "lone")]
    short = [row(5000, "too short", "de", "none pass")]
    found = quality_rules.judge(spark.createDataFrame([*good, *junk, *short], SCHEMA)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in [*good, *junk, *short])
    assert all(r.distance is not None for r in found)
    assert {r.doc_id for r in found if not r.kept} == {4000, 4001, 4002, 4003, 5000}


def test_estimates_lie_in_few_files(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)) for _ in range(120)]
    docs = spark.createDataFrame([row(i, x, f"l{i % 5}", f"s{i % 3}") for i, x in enumerate(texts)], SCHEMA)
    files = Counter()

    def counted(df, name, rows=None):
        made = common.stored(df, name, rows)
        files[name] = max(files[name], len(made.inputFiles()))
        return made

    monkeypatch.setattr(quality_rules, "stored", counted)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = quality_rules.judge(docs).select("doc_id", "kept").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == len(texts) and all(r.kept for r in found)
    assert files.pop("statistics") and max(files.values()) <= 3 and set(files) >= {"quartiles", "estimates", "best", "drawn"}


def test_quality_rules_of_nothing(spark):
    assert quality_rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=2):
    own = sorted(set(prints))
    array, label = np.array(own, np.uint64), list(range(len(own)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(own)):
        for j in np.flatnonzero(np.bitwise_count(array[i] ^ array[i + 1 :]) <= distance):
            a, b = find(i), find(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    return {p: find(i) for i, p in enumerate(own)}


def test_simhash(spark, docs):
    printed = simhash.with_fingerprint(docs)
    found = simhash.with_component(printed).select("doc_id", simhash.hex_of(F.col("fingerprint")).alias("f"), "component_id").collect()
    expected = [(i, brute_fingerprint(t)) for i, t in texts(docs)]
    label = brute_components([p for _, p in expected])
    least = {c: min((i for i, p in expected if label[p] == c and i is not None), default=None) for c in set(label.values())}
    assert Counter((r.doc_id, r.f, r.component_id) for r in found) == Counter((i, f"{p:016x}", least[label[p]]) for i, p in expected)


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_fingerprints_link_at_the_distance(spark, distance):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 40, np.uint64)
    prints = list(centres)
    for c in centres:  # chains, and a crowd around the first
        for _ in range(300 if c == centres[0] else 6):
            base = prints[-1] if rng.random() < 0.4 else c
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                base = base ^ (np.uint64(1) << np.uint64(bit))
            prints.append(base)
    signed = np.array(prints).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    roots = {r.fingerprint: r.root for r in simhash.roots(table, distance).collect()}
    label = brute_components(np.array(prints).tolist(), distance)
    groups = defaultdict(set)
    for p, s in zip(np.array(prints).tolist(), signed):
        groups[label[p]].add(s)
    assert roots == {s: min(g) for g in groups.values() for s in g}


def test_words_of_the_code_share_a_key_one_bit_apart():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**64, 500, np.uint64)
    for a in range(65):
        for b in (a, 64, 17):
            other = prints.copy()
            for bit in {a, b} - {64}:
                other = other ^ (np.uint64(1) << np.uint64(bit))
            (e, k), (f, m) = (simhash.keys_of(x.view(np.int64)) for x in (prints, other))
            assert all(set(k[e[i] : e[i + 1]]) & set(m[f[i] : f[i + 1]]) for i in range(len(prints)))


def test_keep_one(spark, docs):
    expected = [(i, brute_fingerprint(t), t) for i, t in texts(docs)]
    label = brute_components([p for _, p, _ in expected])
    kept = {c: min((i is None, i or 0) for i, p, _ in expected if label[p] == c) for c in set(label.values())}
    found = simhash.keep_one(docs).select("doc_id").collect()
    assert Counter(r.doc_id for r in found) == Counter(None if n else i for n, i in kept.values())


def test_small_tables_are_not_dealt_out_over_all_shuffle_partitions(spark, monkeypatch):
    """Each file costs a task and, on a local disk, several processes; rounds of known size go to as few as they call for."""
    written = []
    monkeypatch.setattr(quality_rules, "stored", lambda *a, f=common.stored, **b: written.append((a[1], f(*a, **b))) or written[-1][1])
    links = spark.range(500).selectExpr("id AS u", "id + 1 AS v")
    counted = spark.range(4000).selectExpr("50 + id % 7 AS n_words", "250 + id % 11 AS word_chars", "id % 3 AS n_symbols", "id % 2 AS n_dup_lines", "0L AS n_repeat_words", "concat('l', id % 40) AS lang", "'s' AS source")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        found = components.components(links)
        assert quality_rules.with_verdict(counted).count() == 4000
    finally:
        spark.conf.set(key, "true")
    assert found.count() == 500 and len(found.inputFiles()) == 1
    assert all(len(df.inputFiles()) <= 2 for name, df in written if name == "best")
    rows = spark.range(1000).repartition(8)
    for bound, files in ((10, 1), (3 * common.ROWS_PER_FILE, 3), (10**9, 8), (None, 8)):
        kept = common.stored(rows, "rows", bound)
        assert len(kept.inputFiles()) == files and kept.agg(F.sum("id")).first()[0] == 499_500


def test_components_of_long_chains_and_stars(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 500 + i) for i in range(1, 60)]
    loose = [(int(a), int(b)) for a, b in rng.integers(1000, 1100, (70, 2))]
    links = [*chain, *star, *loose, (7, 7)]
    found = {r.u: r.v for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    label = {x: x for pair in links for x in pair}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {k: v for k, v in label.items() if k != v}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lookup_table_is_even_and_moves_little():
    shards = [f"n{i}" for i in range(13)]
    table = lookup_sharding.lookup_table(shards, 4093)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = lookup_sharding.lookup_table(shards[:-1], 4093)
    assert sum(a != b for a, b in zip(table, fewer)) < 0.25 * 4093
    for bad in ((shards, 4095), ([], 7), (["a", "a"], 7), (shards, 11)):
        with pytest.raises(ValueError):
            lookup_sharding.lookup_table(*bad)


def test_turns_of_the_lookup_table():
    shards, slots = ["a", "b", "c"], 11
    orders = [[(lookup_sharding._digest(x, "offset") + j * (lookup_sharding._digest(x, "step") % (slots - 1) + 1)) % slots for j in range(slots)] for x in shards]
    owner, turn = {}, 0
    while len(owner) < slots:
        owner[next(s for s in orders[turn % 3] if s not in owner)] = turn % 3
        turn += 1
    assert lookup_sharding.lookup_table(shards, slots) == [owner[s] for s in range(slots)]


def test_placement(spark, docs):
    shards = ["a", "b", "c"]
    owners = lookup_sharding.lookup_table(shards, 101)
    placed = lookup_sharding.place(docs.withColumn("shard", F.lit(1)), shards, slots=101)
    rows = placed.collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts(docs))
    for r in rows:
        name = "null" if r.doc_id is None else f"={r.doc_id}"
        slot = int(hashlib.md5(name.encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, shards[owners[slot]])


def brute_search(vectors, queries, k):
    out = Counter()
    for q, v in {(q, tuple(v)) for q, v in queries if q is not None and v is not None}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i is not None and w is not None and i != q and len(w) == len(v))
        for r, (s, i) in enumerate(scored[:k]):
            out[q, r + 1, i, max(-(2**63 - 1), min(2**63 - 1, -s))] += 1
    return out


@pytest.mark.parametrize("top", [3, 40, 2**30])
def test_search(spark, top):
    rng = np.random.default_rng(top)
    vectors = [(int(i), rng.integers(-top, top + 1, 6).tolist()) for i in range(700)]
    vectors += [(i + 700, [1, 1, 1, 1, 1, 1]) for i in range(300)] + [(5, [1, 2]), (9, [3, 4]), (11, [0, 1])]
    vectors += [(None, [1] * 6), (2000, None), (2001, []), (2002, []), (13, vectors[13][1]), (14, [top] * 6)]
    queries = [x for x in vectors if x[0] is None or x[0] % 10 == 0 or x[0] in (5, 9, 14)]
    frames = [spark.createDataFrame(x, "vec_id long, vector array<long>") for x in (vectors, queries)]
    found = kd_search.top_k(*frames, k=4, shard=150, block=40).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute_search(vectors, queries, 4)


def test_search_of_nothing(spark):
    some, none = (spark.createDataFrame(x, "vec_id long, vector array<long>") for x in ([(1, [1])], []))
    assert kd_search.top_k(some, none).count() == kd_search.top_k(none, some).count() == kd_search.top_k(some, some).count() == 0


@pytest.mark.parametrize("n, asked", [(120, 700), (700, 120)])
def test_search_in_cells_of_several_trees_and_blocks(spark, monkeypatch, n, asked):
    monkeypatch.setattr(kd_search, "HELD", 600)
    monkeypatch.setattr(kd_search, "SPREAD", 2)
    rng = np.random.default_rng(n)
    vectors, queries = ([(int(i), rng.integers(-9, 10, 6).tolist()) for i in range(x)] for x in (n, asked))
    frames = [spark.createDataFrame(x, "vec_id long, vector array<long>") for x in (vectors, queries)]
    found = kd_search.top_k(*frames, k=4, shard=50, block=7).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute_search(vectors, queries, 4)


def test_search_among_scores_below_a_long(spark):
    vectors, queries = [(i, [-(2**62)] * 3) for i in range(60)], [(100, [2**62] * 3)]
    frames = [spark.createDataFrame(x, "vec_id long, vector array<long>") for x in (vectors, queries)]
    found = kd_search.top_k(*frames, k=3, shard=10).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute_search(vectors, queries, 3)


def test_search_broadcasts_neither_trees_nor_blocks(spark):
    """Of repeated vectors even the files of trees are far below the size up to which Spark broadcasts."""
    vectors = spark.range(4000).selectExpr("id AS vec_id", "transform(sequence(0, 15), x -> (id % 40) * x - 100) AS vector")
    found = kd_search.top_k(vectors, vectors.where("vec_id % 10 = 0"), shard=200, block=50)
    assert found.count() == 2000 and len(found.collect()) == 2000
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    sent = re.findall(r"\) BroadcastExchange\nInput \[\d+\]: \[(.*)\]", found._jdf.queryExecution().explainString(mode))
    assert sent and not [x for x in sent if re.search("tree#|queries#", x)]


def test_vectors_of_a_length_are_dealt_by_shard(spark):
    rows = spark.createDataFrame([(i, [i], 1) for i in range(90)], "vec_id long, vector array<long>, dimension int")
    plan = kd_search._parts(rows, 10, "shard").groupBy("dimension", "shard").count()._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(dimension#\d+, shard#\d+", plan)
    assert plan.count("hashpartitioning(dimension#") == 2


def test_scaling(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [float("nan")]), (5, [float("inf")]), (6, []), (7, [1e300])]
    found = spark.createDataFrame(rows, "i int, v array<double>").select("i", kd_search.scaled(F.col("v")).alias("s")).collect()
    assert {r.i: r.s for r in found} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: [], 7: [2**62]}


def test_toxicity_on_held_out_texts(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    even = labels.where("doc_id % 2 = 0")
    model = toxicity.train(docs, even, sample=2500)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 3
    held = toxicity.with_severity(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), model)
    counts = {(r.toxic, r.kept): r["count"] for r in held.groupBy("toxic", "kept").count().collect()}
    assert counts[1, False] > 0.95 * (counts[1, False] + counts.get((1, True), 0))
    assert counts.get((0, False), 0) < 0.01 * counts[0, True]
    mean = {r.toxic: r.m for r in held.groupBy("toxic").agg(F.avg("expected_severity").alias("m")).collect()}
    assert mean[1] > 1 > 0.2 > mean[0]


def test_toxicity_where_toxic_labels_are_common(spark):
    rng = np.random.default_rng(6)

    def text(toxic):
        words = [f"{a}{b}" for a, b in zip(rng.choice(list("abcdefghijkl"), 40), rng.integers(10000, 10400, 40))]
        telling = [w for w in ("vexgrunt", "zorkblat", "quimsnar") if rng.random() < 0.7] or ["zorkblat"]
        return " ".join([*words, *telling] if toxic else words)

    flags = [int(i % 20 < 9) for i in range(1600)]
    docs = spark.createDataFrame([(i, text(f)) for i, f in enumerate(flags)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, f) for i, f in enumerate(flags) if i < 800], "doc_id long, toxic int"))
    held = toxicity.with_severity(docs.where("doc_id >= 800"), model).collect()
    caught = sum(not r.kept for r in held if flags[r.doc_id])
    assert caught > 0.98 * sum(flags[800:])
    assert sum(not r.kept for r in held if not flags[r.doc_id]) < 0.02 * (800 - sum(flags[800:]))


def test_toxicity_counts_repeated_rows_of_a_key_once(spark, monkeypatch):
    folder, sizes, fit = "/root/testdata/sf0.01", [], toxicity.fit
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    monkeypatch.setattr(toxicity, "fit", lambda features, grades: (sizes.append(len(grades)), fit(features, grades))[1])
    hot = labels.where("toxic = 1").orderBy(F.xxhash64("doc_id")).first().doc_id
    repeats = docs.where(F.col("doc_id") == hot).crossJoin(spark.range(500)).drop("id")
    once = toxicity.train(docs, labels, sample=150)
    assert toxicity.train(docs.unionByName(repeats), labels, sample=150) == once and max(sizes) <= 150
    other = docs.limit(50).withColumn("doc_id", F.lit(hot))  # several texts under a key are one row, in any order
    both = [toxicity.train(x, labels) for x in (docs.unionByName(other), other.unionByName(docs).repartition(7))]
    assert both[0] == both[1] and sizes[-1] == sizes[-2] == labels.where("toxic IS NOT NULL").select("doc_id").distinct().join(docs, "doc_id").count()


def test_toxicity_is_fitted_on_6000_labelled_texts(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(toxicity, "fit", lambda features, grades: sizes.append(len(grades)) or toxicity.Model())
    docs = spark.range(6100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    toxicity.train(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert sizes == [6000]


def test_toxicity_of_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 1), (4, 0), (4, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.with_severity(docs, model).collect()
    assert len(found) == docs.count()
    nothing = toxicity.Model()
    assert all(r.kept and r.expected_severity == 0 for r in toxicity.with_severity(docs, nothing).collect())
    assert toxicity.train(docs, labels.limit(0)).thresholds == []


def test_ordinal_fit_recovers_weights_and_ordered_thresholds():
    rng = np.random.default_rng(0)
    ids, values, grades = [], [], []
    for _ in range(3000):
        own = np.sort(rng.choice(np.arange(1, 25), 3, replace=False))
        load = rng.random(3)
        score = 6 * sum(load[own <= 6]) + rng.logistic(0, 0.5)
        ids.append(own)
        values.append(load)
        grades.append(int(np.searchsorted([2, 4, 6], score)))
    grades = np.array(grades)
    model = toxicity.fit(toxicity.Features(ids[:2000], values[:2000]), grades[:2000], penalty=1e-4, rounds=300)
    assert len(model.thresholds) == 3 and model.thresholds == sorted(model.thresholds)
    assert min(model.weights.get(i, 0) for i in range(1, 7)) > 2 * max(abs(model.weights.get(i, 0)) for i in range(7, 25))
    scores = np.array([sum(model.weights.get(int(i), 0) * v for i, v in zip(a, b)) for a, b in zip(ids[2000:], values[2000:])])
    expected = model.severity(scores)
    assert np.corrcoef(expected, grades[2000:])[0, 1] > 0.85


WORKING = ("_x0", "_mean", "_full", "_group", "_inverse", "_n", "_text", "_key", "_spans", "_score", "_digest", "_statistics", "_t", "root", "fingerprint", "kept", "n_words", "gram")


@pytest.mark.parametrize(
    "operator",
    [
        lambda docs: quality_rules.judge(docs),
        lambda docs: toxicity.with_severity(docs, toxicity.Model([0.5], {1: 1.0})),
        lambda docs: simhash.keep_one(docs),
        lambda docs: suffix_dedup.remove_repeats(docs),
        lambda docs: token_counts.count_tokens(docs, shared_folder(docs.sparkSession, "cache"), BYTES),
        lambda docs: text_statistics.with_statistics(docs),
    ],
    ids=["judge", "with_severity", "keep_one", "remove_repeats", "count_tokens", "with_statistics"],
)
def test_columns_of_any_name_stay(spark, operator):
    names = ["doc_id", "text", "lang", "source", *WORKING, "a.b"]
    rows = [(i, f"some words of text number {i} that goes on for a little while, and then some more words up to twenty of them", "en", "s", *(f"own {c} {i}" for c in WORKING), "dot") for i in range(3)]
    found = operator(spark.createDataFrame(rows, names))
    new = set(found.columns) - set(names)
    replaced = {"kept"} if "expected_severity" in new or "distance" in new else set()
    replaced |= {"n_words"} if "word_chars" in new else set()
    assert len(found.columns) == len(set(found.columns))
    for r in found.collect():
        for c in set(WORKING) - replaced:
            assert r[c] == f"own {c} {r['doc_id']}", c
        assert r["a.b"] == "dot"


@pytest.mark.parametrize("flagged", [1, 2, 3, 4, 5, 10])
def test_grades_at_few_flagged_rows(flagged):
    """More of what is typical of flagged texts is never a lower grade; equal texts have equal grades."""
    bad, plain = list(range(10)), list(range(100, 160))
    rng = np.random.default_rng(flagged)
    ids = [sorted([*bad[: 1 + i], *rng.choice(plain, 8, replace=False).tolist()]) for i in range(flagged)] + [sorted(rng.choice(plain, 12, replace=False).tolist()) for _ in range(60)]
    features = toxicity.Features(ids, [[1.0] * len(x) for x in ids])
    flags = np.array([1] * flagged + [0] * 60)
    grades = toxicity.grades_from_flags(features, flags)
    assert set(grades[flagged:]) == {0} and all(1 <= g <= 3 for g in grades[:flagged])
    assert len(set(grades[:flagged].tolist())) == min(3, {1: 1, 2: 2}.get(flagged, 3))
    assert np.diff(grades[:flagged]).min(initial=0) >= 0
    same = toxicity.Features(ids[:1] * 4 + ids[flagged:], [[1.0] * len(x) for x in ids[:1] * 4 + ids[flagged:]])
    assert toxicity.grades_from_flags(same, np.array([1] * 4 + [0] * 60)).tolist() == [2] * 4 + [0] * 60


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Cluster, "x")


def test_normal_forms_keep_the_count(spark):
    odd = ["Ünï  CODE\n x", "<|ENDOFTEXT|> a", "É<|endoftext|>", "ﬁ ½ K", "a\tb", "İstanbul", "  x  "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, *(x.upper() for x in odd), *(x.lower() for x in odd)])], "doc_id long, text string")
    cache, encode = shared_folder(spark, "cache"), library(WORDS)
    found = token_counts.count_tokens(docs, cache, WORDS).collect()
    assert all(r.n_tokens == len(encode(r.text)) and r.n_bytes == len(r.text.encode()) for r in found)
    assert spark.read.parquet(cache).count() < len({r.text for r in found})


@pytest.mark.parametrize("most_sent", [0, 10**6])
def test_misses_are_fetched_either_way(spark, docs, most_sent):
    cache, encode = shared_folder(spark, "cache"), library(BYTES)
    token_counts.append_misses(docs, cache, BYTES, most_sent=most_sent)
    stored = {r.content_digest: r.n_tokens for r in spark.read.parquet(cache).collect()}
    assert stored == {hashlib.sha256(t.encode()).hexdigest(): len(encode(t)) for _, t in texts(docs)}
    assert spark.read.parquet(cache).count() == len(stored)

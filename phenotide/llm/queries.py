"""Registered queries of the numbered operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenotide.llm import (
    byte_bpe,
    hard_negatives,
    kd_search,
    license_scan,
    lookup_sharding,
    merkle_manifest,
    packing,
    quality_rules,
    simhash,
    suffix_dedup,
    text_statistics,
    token_counts,
    token_files,
    toxicity,
)
from phenotide.llm.common import shared_folder, stored, table

WORDS = vocabularies.path("word_bpe_49k.json")
BYTES = vocabularies.path("byte_bpe_50k.json")
RANKS = vocabularies.path("byte_bpe_multi_50k.tiktoken")


#: Shards of the sharding query.
SHARDS = [f"shard-{i:02d}" for i in range(64)]


def op1_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", kd_search.scaled(F.col("embedding")).alias("vector"))
    return kd_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORDS, end_id=1)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache starts empty in a folder of its own, so that every distinct text is encoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, shared_folder(spark, "token-counts"), BYTES)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counted = stored(text_statistics.with_statistics(docs).drop("text"), "statistics")
    return quality_rules.with_verdict(counted).select("doc_id", *text_statistics.COUNTS, "base_failed", "distance", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of three words; fingerprints link at two or fewer differing bits."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    printed = stored(simhash.with_fingerprint(docs, width=3).drop("text"), "fingerprints")
    found = simhash.with_component(printed, distance=2)
    return found.select("doc_id", simhash.hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return found.select("doc_id", "removed.n_bytes", "removed.n_removed", "removed.n_spans", F.sha2("removed.kept", 256).alias("kept_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return lookup_sharding.place(docs, SHARDS).select("doc_id", "source", "slot", "shard")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, vocabularies.PATTERN), RANKS, vocabularies.PATTERN)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_severity(docs, model).select("doc_id", "expected_severity", "p_toxic", "grade", "kept")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, WORDS, end_id=2)
    rows = token_files.with_start(token_files.read_tokens(spark, folder), spark, folder)
    return rows.select("doc_id", "start", "n_tokens", token_files.crc32_of_ids(F.col("ids")).alias("ids_crc32"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is proven; those with an even crc32 of their key are checked without their line breaks."""
    docs = table(spark, sf_dir, "documents")
    values = ("doc_id", "source", "lang", "n_chars")
    without_breaks = merkle_manifest.leaf_of(*values_of(values), F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, without_breaks)
    leaves = docs.select("doc_id", "source", merkle_manifest.leaf_of(*values_of(values), F.col("text")).alias("leaf"), tampered.alias("tampered"))
    proven = merkle_manifest.prove(leaves, "doc_id", "source", "leaf", carry=("tampered",))
    checked = proven.withColumn("folded_root", merkle_manifest.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    proof = merkle_manifest.proof_digest(F.col("path")).alias("proof_sha256")
    return checked.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.with_licenses(docs)
    return found.select("doc_id", *(f"licenses.{c}" for c in license_scan.RESULT.names if c != "detections"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh key are moved on by one before anything else."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), kd_search.scaled(F.col("embedding")).alias("vector"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def values_of(names: tuple[str, ...]) -> list:
    return [F.col(x) for x in names]


def op7_sql() -> str:
    """Placement in SQL. The lookup table is part of the text: one number per slot."""
    owners = ", ".join(map(str, lookup_sharding.lookup_table(SHARDS)))
    hexed = "('0x' || substr(md5('=' || doc_id), 1, 15))::BIGINT"
    return f"""
        WITH owners AS (SELECT unnest([{owners}]) AS owner, generate_subscripts([{owners}], 1) - 1 AS slot),
        placed AS (SELECT doc_id, source, CAST({hexed} % {lookup_sharding.SLOTS} AS INTEGER) AS slot FROM documents)
        SELECT doc_id, source, slot, 'shard-' || lpad(CAST(owner AS VARCHAR), 2, '0') AS shard
        FROM placed JOIN owners USING (slot)
    """


OP1_SQL = """
    WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
    ),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
               CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
        WHERE q.vec_id % 50 = 0
    ),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: A tree of digests per source and one over the sources, level by level; `sides` are a node's siblings.
OP11_SQL = """
    WITH RECURSIVE docs AS (
        SELECT doc_id, source, concat_ws('', {fields}) AS head, text, xor(list_reduce(
            list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
        ), 4294967295) % 2 = 0 AS even
        FROM documents
    ),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
        FROM (SELECT *, sha256(head || {text}) AS leaf, sha256(head || {cut}) AS broken FROM docs)
    ),
    inner_tree AS (
        SELECT source, 0 AS level, i, n, leaf AS h FROM leaves
        UNION ALL
        SELECT source, level + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM inner_tree WHERE n > 1 GROUP BY source, level, i // 3
    ),
    subroots AS (
        SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS place, count(*) OVER () AS sources
        FROM inner_tree WHERE n = 1
    ),
    outer_tree AS (
        SELECT 0 AS level, place AS i, sources AS n, subroot AS h FROM subroots
        UNION ALL
        SELECT level + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM outer_tree WHERE n > 1 GROUP BY level, i // 3
    ),
    inner_sides AS (
        SELECT t.source, t.level, t.i, any_value(t.n) AS n, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i < t.i), '') AS l,
               coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i > t.i), '') AS r
        FROM inner_tree t JOIN inner_tree o ON t.source IS NOT DISTINCT FROM o.source AND t.level = o.level AND t.i // 3 = o.i // 3
        GROUP BY t.source, t.level, t.i
    ),
    outer_sides AS (
        SELECT t.level, t.i, any_value(t.n) AS n, coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i < t.i), '') AS l,
               coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i > t.i), '') AS r
        FROM outer_tree t JOIN outer_tree o ON t.level = o.level AND t.i // 3 = o.i // 3
        GROUP BY t.level, t.i
    ),
    climb AS (
        SELECT source, i AS row, 0 AS level, i, CASE WHEN even THEN broken ELSE leaf END AS h, '' AS proof FROM leaves
        UNION ALL
        SELECT c.source, c.row, c.level + 1, c.i // 3, sha256(s.l || c.h || s.r), c.proof || s.l || s.r
        FROM climb c JOIN inner_sides s ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level AND c.i = s.i
        WHERE s.n > 1
    ),
    tops AS (
        SELECT c.source, c.row, c.h, c.proof, u.place
        FROM climb c JOIN inner_sides s ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level AND c.i = s.i AND s.n = 1
        JOIN subroots u ON c.source IS NOT DISTINCT FROM u.source
    ),
    rise AS (
        SELECT source, row, 0 AS level, place AS i, h, proof FROM tops
        UNION ALL
        SELECT c.source, c.row, c.level + 1, c.i // 3, sha256(s.l || c.h || s.r), c.proof || s.l || s.r
        FROM rise c JOIN outer_sides s ON c.level = s.level AND c.i = s.i
        WHERE s.n > 1
    )
    SELECT l.doc_id, l.leaf, u.subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
    FROM leaves l JOIN subroots u ON l.source IS NOT DISTINCT FROM u.source
    JOIN rise c ON c.source IS NOT DISTINCT FROM l.source AND c.row = l.i
    JOIN outer_tree t ON t.n = 1 AND c.level = t.level
"""


OP13_SQL = """
    WITH whole AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
    ),
    scored AS (
        SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
               CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM whole a JOIN whole c ON a.vec_id <> c.vec_id
        WHERE a.vec_id % 100 = 0
    ),
    positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5
"""


def op11_sql() -> str:
    def field(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    fields = ", ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    return OP11_SQL.format(fields=fields, text=field("text"), cut=field("replace(text, chr(10), '')"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_kd_search,
        op2_packing,
        op3_token_counts,
        op4_quality_rules,
        op5_simhash,
        op6_suffix_dedup,
        op7_sharding,
        op8_byte_bpe,
        op9_toxicity,
        op10_token_files,
        op11_merkle_manifest,
        op12_license_scan,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """Those queries that SQL expresses over whole tables; the others are tested against brute force."""
    return {"op1_kd_search": OP1_SQL, "op7_sharding": op7_sql(), "op11_merkle_manifest": op11_sql(), "op13_hard_negatives": OP13_SQL}

"""Token counts with a digest cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenotide.llm.common import set_aside, slices, stored, text_of
from phenotide.llm.tokens import tokenizer

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"
#: Misses up to which their digests, of 80 bytes each at most, are sent to the texts.
MOST_SENT = 200_000


def tokenizer_digest(path: str) -> str:
    """Digest of the library's version, the tokenizer file and how texts are encoded."""
    import tokenizers

    settings = f"tokenizers {tokenizers.__version__}; no added special tokens; no truncation; no padding; "
    return hashlib.sha256(settings.encode() + Path(path).read_bytes()).hexdigest()


def normal_form(path: str, text: Column) -> Column:
    """A form of the text that has the same tokens: what the tokenizer's own normaliser makes of it.

    A tokenizer without a normaliser takes texts as they are. A text that holds an added token, or
    would hold one once normalised, is its own normal form, as the tokenizer looks for these first; so is
    one that normalising again would change.
    """
    if tokenizer(path).normalizer is None:
        return text

    def normalised(column: pa.Array) -> pa.Array:
        return pa.array([tokenizer(path).normal_form(x) for x in column.to_pylist()], pa.string())

    normalised.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(normalised, T.StringType())(text)


def _normalises(path: str) -> bool:
    return tokenizer(path).normalizer is not None


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = [len(x) // 4 for x in tokenizer(path).packed_all(batch.column("_text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_digest"), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

    return encode


def read_cache(spark, cache: str) -> DataFrame:
    """The stored counts; empty where none are stored yet. A count stored twice is read once."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).groupBy("content_digest", "tokenizer_digest").agg(F.max("n_tokens").alias("n_tokens"))


def append_misses(docs: DataFrame, cache: str, path: str, text: str = "text", most_sent: int = MOST_SENT) -> None:
    """Encode every distinct text that the cache lacks once, and append the counts to it.

    Digests alone are made distinct and held against the cache. One text is fetched per miss: misses are
    sent to the texts if they are few, and otherwise copies of a text are dropped before texts are shuffled.
    """
    version = tokenizer_digest(path)
    texts = docs.select(text_of(text).alias("_raw"))
    known = read_cache(docs.sparkSession, cache).where(F.col("tokenizer_digest") == version).select(F.col("content_digest").alias("_digest"))
    if _normalises(path):
        texts = texts.join(known.withColumnRenamed("_digest", "_own"), F.sha2("_raw", 256) == F.col("_own"), "left_anti")
    texts = texts.select(normal_form(path, F.col("_raw")).alias("_text"))
    texts = texts.select(F.sha2("_text", 256).alias("_digest"), "_text")
    misses = stored(texts.select("_digest").distinct().join(known, "_digest", "left_anti"), "misses")
    if misses.count() <= most_sent:
        fetched = texts.join(F.broadcast(misses), "_digest", "left_semi").dropDuplicates(["_digest"])
    else:
        fetched = texts.dropDuplicates(["_digest"]).join(misses, "_digest", "left_semi")
    counts = fetched.mapInArrow(_encoder(path), "content_digest string, n_tokens long")
    counts.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Every row of docs with n_bytes, n_tokens and over_limit (more than limit tokens).

    cache: folder of a Parquet table that all executors reach; it gets the counts of texts it lacks, by
    the digests of their normal forms and of the tokenizer; a count that is stored for a text as it is
    is taken as well, and before that of its normal form. A null text counts as the empty one, which has
    no bytes and no tokens; n_bytes is that of the text as it is. Repeated texts are encoded once, rows are
    never merged. Columns of docs called n_bytes, n_tokens or over_limit are replaced, others stay.
    """
    append_misses(docs, cache, path, text)
    rows, back = set_aside(docs, text)
    counts = read_cache(docs.sparkSession, cache).where(F.col("tokenizer_digest") == tokenizer_digest(path))
    counts = counts.select(F.col("content_digest").alias("_digest"), "n_tokens")
    counted = (
        rows.withColumn("_digest", F.sha2(normal_form(path, text_of(text)), 256))
        .withColumn("n_bytes", F.octet_length(text_of(text)).cast("long"))
        .join(counts, "_digest", "left")
    )
    if _normalises(path):
        own = counts.select(F.col("_digest").alias("_own"), F.col("n_tokens").alias("_own_tokens"))
        counted = counted.join(own, F.sha2(text_of(text), 256) == F.col("_own"), "left").withColumn("n_tokens", F.coalesce("_own_tokens", "n_tokens"))
    counted = counted.withColumn("over_limit", F.col("n_tokens") > limit)
    return back(counted, "n_bytes", "n_tokens", "over_limit")

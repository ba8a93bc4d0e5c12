"""A cleaning pipeline over documents: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next one. All but the last return the columns of documents; extra columns
stay. Rows are judged one by one, so repeated rows and null keys are documents of their own.
"""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenotide.llm import packing, quality_rules, simhash, suffix_dedup, toxicity
from phenotide.llm.common import set_aside, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and are no outliers of their language and source."""
    rows, back = set_aside(docs, "text", "lang", "source")
    return back(quality_rules.judge(rows).where("kept"))


def nontoxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones among them does not take for toxic."""
    rows, back = set_aside(docs, "doc_id", "text")
    model = toxicity.train(rows, table(spark, sf_dir, "labels"))
    return back(toxicity.with_severity(rows, model).where("kept"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of three words, two differing bits."""
    rows, back = set_aside(docs, "doc_id", "text")
    return back(simhash.keep_one(rows, width=3, distance=2))


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur elsewhere among them.

    A character that loses some of its bytes goes as a whole. n_chars is that of the new text; a
    document of which nothing is left stays, with an empty text, and so does a null text.
    """
    rows, back = set_aside(docs, "text", "n_chars")
    found = suffix_dedup.remove_repeats(rows, length=200, as_text=True)
    cut = F.col("removed.n_removed") > 0
    found = found.withColumn("text", F.when(cut, F.col("removed.kept")).otherwise(F.col("text")))
    kind = docs.schema["n_chars"].dataType
    return back(found.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars"))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, each of one document."""
    return packing.pack(docs, vocabularies.path("word_bpe_49k.json"), end_id=1, longest=2048)


STAGES = [
    ("quality rules", quality),
    ("toxicity", nontoxic),
    ("simhash near-dedup", distinct),
    ("suffix-array dedup", without_passages),
    ("packing", packed),
]

#: SQL cannot express the stages; run() is tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

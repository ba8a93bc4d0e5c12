"""Polygenic scores from a long genotype table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenotide.functions.sizes import MAX_BROADCAST_BYTES, Slice, in_slices, position_slices

# Fixed value: autosomes only.
LAST_AUTOSOME = 22
_VARIANT = ["chrom", "pos"]


def genetic_score(
    genotypes: DataFrame,
    scores: DataFrame,
    missing: str = "impute",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Average weight of the effect alleles a participant carries: ``eid``, ``score``.

    ``genotypes``  eid, chrom, pos, allele1, allele2, allele1_count; one row per participant and
                   variant, a missing call has a null count
    ``scores``     chrom, pos, effect_allele, weight; one row per variant
    ``missing``    ``'impute'`` counts a missing call as the variant's mean, ``'drop'`` leaves it out

    A variant whose effect allele is neither allele, or whose chromosome is no number from 1 to 22, is
    left out. The score table is measured at once and broadcast in as few slices of positions as keep
    below ``max_broadcast_bytes`` each, so that genotypes are never shuffled, however many variants are
    weighted: only sums per participant are. Each slice reads the genotypes of its
    positions; of a table sorted by chromosome and position, these are a few row groups. Imputation reads
    them twice rather than keep every call of a variant or a participant together.
    """
    if missing not in ("impute", "drop"):
        raise ValueError(f"missing must be 'impute' or 'drop', not {missing!r}")
    weights = _autosomes(scores).select(*_VARIANT, "effect_allele", "weight").where(F.col("pos").isNotNull())
    parts = [_scored(genotypes, weights, slices, small, missing) for slices, small in position_slices(weights, max_broadcast_bytes)]
    scored = reduce(DataFrame.unionByName, parts or [_scored(genotypes, weights, [], True, missing)])
    return scored.groupBy("eid").agg((F.sum(F.col("weight") * F.col("count")) / (2 * F.count("*"))).alias("score"))


def _scored(genotypes: DataFrame, weights: DataFrame, slices: list[Slice], small: bool, missing: str) -> DataFrame:
    """The calls of one set of slices that count, with their weights."""
    own = in_slices(slices) if slices else F.lit(False)
    calls = _effect_counts(genotypes, weights, own, small)
    if missing == "drop":
        return calls.where(F.col("count").isNotNull()).select("eid", "weight", "count")
    # One number more per row of ``weights`` at most, which the sizes allow for.
    means = calls.groupBy(*_VARIANT, "effect_allele", "weight").agg(F.avg("count").alias("mean"))
    imputed = F.coalesce("count", "mean", F.lit(0.0)).alias("count")
    return _effect_counts(genotypes, means, own, small).select("eid", "weight", imputed)


def _autosomes(df: DataFrame) -> DataFrame:
    """Rows of the numbered chromosomes; the scan sees the filter if chromosomes are stored as numbers."""
    return df.withColumn("chrom", F.col("chrom").try_cast("int")).where(F.col("chrom").between(1, LAST_AUTOSOME))


def _effect_counts(genotypes: DataFrame, weights: DataFrame, own: Column, small: bool) -> DataFrame:
    """Genotype rows of the weighted variants of a set with the number of effect alleles as ``count``."""
    effect, some = F.col("effect_allele"), weights.where(own)
    return (
        _autosomes(genotypes)
        .where(own)
        .join(F.broadcast(some) if small else some, _VARIANT)
        .where(effect.isin(F.col("allele1"), F.col("allele2")))
        .withColumn(
            "count",
            F.when(effect == F.col("allele1"), F.col("allele1_count")).otherwise(2 - F.col("allele1_count")),
        )
        .drop("allele1", "allele2", "allele1_count")
    )

"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenotide.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """From links (u, v) of long ids one row (u, v) for each node but the smallest of its component, v being that smallest one.

    Both stars shuffle links by node after a partial minimum; each round is written to the shared
    folder. The number of rounds grows with the logarithm of the number of nodes.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    links = stored(links.where("u != v").select(high, low).distinct(), "links")
    before, now = None, _state(links)
    while now != before:
        # Each link is moved or gives a node its smallest neighbour, or both.
        links = stored(_small_star(_large_star(links)), "links", rows=2 * now[0])
        before, now = now, _state(links)
    return links

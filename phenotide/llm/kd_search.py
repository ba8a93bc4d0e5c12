"""Exact top-k search with a KD-tree per shard of vectors.

Vectors are cut into shards of bounded size, each of which becomes one row with a KD-tree: splits at
the median of the widest side, tight boxes, leaves of some hundred vectors. Queries are cut into blocks
too. A query goes through a tree best first, by the greatest score that a box allows, and stops at a
box that cannot reach the k-th score known so far. First each block meets a single tree; the k-th scores
found there go with the block to all trees, and within a task on from tree to tree.

Groups of trees and groups of blocks, of bounded size, form a grid, and a task takes its cells one by one.
So a tree is sent once per group of blocks, a block once per group of trees, and no pair of the two. Trees
and blocks are shuffled, never broadcast: their files are small, they are not.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenotide.llm.common import stored

SHARD = 8192
BLOCK = 1024
LEAF = 256
#: Whole numbers up to here are exact as doubles.
EXACT = 2**53
_LONG = 2**63 - 1
#: Numbers of vectors on either side of a cell of the grid.
HELD = 2**23
#: Groups of trees that there are at least, if there are as many trees.
SPREAD = 48


def scaled(vector, factor: int = 256):
    """Column of floor(factor * x) for each component; null for vectors that are null or hold null, NaN or infinity. Beyond 2^62 it is cut."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(as_double, lambda x: F.floor(F.greatest(F.least(x * factor, F.lit(2.0**62)), F.lit(-(2.0**62)))))
    return F.when(fine, whole)


class Tree:
    """A KD-tree over the rows of a matrix, for inner products."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(ids))
        self.low, self.high, self.span, self.child = [], [], [], []

        def grow(first: int, stop: int) -> int:
            own, node = rows[order[first:stop]], len(self.span)
            self.low.append(own.min(axis=0))
            self.high.append(own.max(axis=0))
            self.span.append((first, stop))
            self.child.append((-1, -1))
            sides = self.high[node].astype(np.float64) - self.low[node]
            if stop - first > leaf and sides.max(initial=0) > 0:
                side, middle = int(np.argmax(sides)), (first + stop) // 2
                order[first:stop] = order[first:stop][np.argpartition(own[:, side], middle - first)]
                self.child[node] = (grow(first, middle), grow(middle, stop))
            return node

        grow(0, len(ids))
        self.ids, self.rows = ids[order], rows[order]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, best: list[list[tuple[int, int]]]) -> None:
        """Better each query's heap of (score, -id) in place; rows of a query's own id do not count."""
        most = max(int(np.abs(x).max(initial=0)) for x in (queries, self.rows))
        kind = np.float64 if most * most * max(1, queries.shape[1]) < EXACT else object
        rows, asked = self.rows.astype(kind), queries.astype(kind)
        bounds = np.maximum(asked, 0) @ np.array(self.high).astype(kind).T + np.minimum(asked, 0) @ np.array(self.low).astype(kind).T
        for q, own in enumerate(best):
            bound, me = bounds[q], int(query_ids[q])
            waiting = [(-bound[0], 0)]
            while waiting:
                top, node = heappop(waiting)
                if len(own) == k and -top < own[0][0]:
                    break
                left, right = self.child[node]
                if left >= 0:
                    heappush(waiting, (-bound[left], left))
                    heappush(waiting, (-bound[right], right))
                    continue
                first, stop = self.span[node]
                scores, ids = rows[first:stop] @ asked[q], self.ids[first:stop]
                able = ids != me if len(own) < k else (scores >= own[0][0]) & (ids != me)
                for found in sorted(((int(scores[i]), -int(ids[i])) for i in np.flatnonzero(able)), reverse=True)[:k]:
                    if len(own) < k:
                        heappush(own, found)
                    elif found > own[0]:
                        heapreplace(own, found)


def _matrix(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows, in the smallest type whose numbers can change sign."""
    rows = np.stack([np.asarray(x, np.int64) for x in vectors])
    kinds = [x for x in (np.int16, np.int32) if rows.size and rows.min() > np.iinfo(x).min and rows.max() <= np.iinfo(x).max]
    return rows.astype(kinds[0]) if kinds else rows


def _grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    tree = Tree(frame["vec_id"].to_numpy(np.int64), _matrix(frame["vector"]))
    return pd.DataFrame({"dimension": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree)]})


def _gather(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """A block: ids, numbers of the rows, vectors, k-th scores as far as they are known."""
    rows = (frame["vec_id"].to_numpy(np.int64), frame["row"].to_numpy(np.int64), _matrix(frame["vector"]), None)
    return pd.DataFrame({"dimension": [key[0]], "block": [key[1]], "queries": [pickle.dumps(rows)]})


def _begin(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The blocks of a cell of one tree, or of none, with the k-th score of each query that finds as many there."""

    def begin(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        begun = []
        for asked in blocks["queries"]:
            ids, numbers, rows, _ = pickle.loads(asked.as_py())
            best: list[list[tuple[int, int]]] = [[] for _ in ids]
            for pickled in trees["tree"]:
                pickle.loads(pickled.as_py()).search(ids, rows, k, best)
            begun.append(pickle.dumps((ids, numbers, rows, [own[0][0] if len(own) == k else None for own in best])))
        return pa.table([blocks["dimension"], blocks["block"], pa.array(begun, pa.binary())], ["dimension", "block", "queries"])

    return begin


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What the queries of a cell find in all of its trees: at most k rows each, none below their known k-th score."""

    def search(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        found = [_FOUND.empty_table()]
        for asked in blocks["queries"]:
            ids, numbers, rows, floors = pickle.loads(asked.as_py())
            best = [[] if x is None else [(x, -_LONG - 1)] * k for x in floors]
            for pickled in trees["tree"]:
                pickle.loads(pickled.as_py()).search(ids, rows, k, best)
            out = [(query, number, max(-_LONG, min(_LONG, s)), -v) for query, number, own in zip(ids.tolist(), numbers.tolist(), best) for s, v in own if v >= -_LONG]
            found.append(pa.table([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 4, _FOUND))
        return pa.concat_tables(found)

    return search


_FOUND = pa.schema([(x, pa.int64()) for x in ("query_id", "row", "score", "vec_id")])
_BLOCK = "dimension int, block int, queries binary"


def _cells(trees: DataFrame, blocks: DataFrame, shard: int, block: int) -> DataFrame:
    """A row per dimension that has both: how many trees and blocks, how many groups of them, and blocks per group."""
    counts = [x.groupBy("dimension").agg((F.max(n) + 1).alias(f"{n}s")) for x, n in ((trees, "shard"), (blocks, "block"))]
    held = [F.greatest(F.lit(1), F.floor(HELD / (F.greatest(F.lit(1), F.col("dimension")) * size))) for size in (shard, block)]
    return counts[0].join(counts[1], "dimension").select(
        "*",
        F.greatest(F.ceil(F.col("shards") / held[0]), F.least(F.col("shards"), F.lit(SPREAD))).alias("tree_groups"),
        F.ceil(F.col("blocks") / held[1]).alias("block_groups"),
        held[1].alias("per_group"),
    )


def _meet(trees: DataFrame, blocks: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """meet(trees, blocks) of each cell: a dimension, a group of trees and one of blocks."""
    trees, blocks = (x.groupBy("dimension", "tree_group", "block_group") for x in (trees, blocks))
    return trees.cogroup(blocks).applyInArrow(meet, schema)


def _parts(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows with their dimension and a part of about `size` rows of it, by a hash of the row."""
    counts = rows.groupBy("dimension").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    return rows.join(F.broadcast(counts), "dimension").withColumn(name, F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")).cast("int"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "vector", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The k rows of vectors with the greatest inner product for each query: query_id, rank, vec_id, score.

    Both tables have a long key and a list of longs (see scaled). Ties go to the smaller key. Rows of
    the query's own key do not count, nor vectors of another length. Rows with a null key or vector take
    no part. Repeated query rows are one query; different ones of a key are answered each; each vector
    row is a candidate. Scores are exact; beyond the range of a long they are cut to its ends.
    """
    rows = [x.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL") for x in (vectors, queries)]
    shards = _parts(stored(rows[0].withColumn("dimension", F.size("vector")), "vectors"), shard, "shard")
    trees = stored(shards.groupBy("dimension", "shard").applyInPandas(_grow, "dimension int, shard int, tree binary"), "trees")
    asked = rows[1].dropDuplicates().withColumn("dimension", F.size("vector")).withColumn("row", F.xxhash64("vec_id", "vector"))
    blocks = _parts(stored(asked, "queries"), block, "block").groupBy("dimension", "block").applyInPandas(_gather, _BLOCK)
    blocks = stored(blocks, "blocks")
    # One row per length of vector; the joins send nothing else to the driver.
    cells = F.broadcast(stored(_cells(trees, blocks, shard, block), "cells"))
    once = trees.join(cells, "dimension").where("shard < blocks")
    once = once.selectExpr("dimension", "bigint(shard) AS tree_group", "explode(sequence(0L, floor((blocks - 1) / shards / per_group))) AS block_group", "tree")
    at_once = blocks.join(cells, "dimension")
    at_once = at_once.selectExpr("dimension", "bigint(block % shards) AS tree_group", "floor(floor(block / shards) / per_group) AS block_group", "block", "queries")
    begun = _meet(once, at_once, _begin(k), _BLOCK)
    spread = trees.join(cells, "dimension")
    spread = spread.selectExpr("dimension", "shard % tree_groups AS tree_group", "explode(sequence(0L, block_groups - 1)) AS block_group", "tree")
    asking = begun.join(cells, "dimension")
    asking = asking.selectExpr("dimension", "explode(sequence(0L, tree_groups - 1)) AS tree_group", "block % block_groups AS block_group", "queries")
    found = _meet(spread, asking, _search(k), "query_id long, row long, score long, vec_id long")
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

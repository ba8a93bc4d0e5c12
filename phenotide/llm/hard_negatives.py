"""Hard negatives by an inverted multi-index: rows of another label whose score lies just below a positive's.

Each half of a vector has a codebook of its own; a pair of codes is a cell. The score of a half lies
within radius times length of the score of its code, so the greatest and the least score of a cell
are sums of two numbers. Cells lie in shards of bounded size, a hot cell in several; anchors lie in
blocks of neighbours. In a shard a heap visits the cells in the order of their summed bounds, radii
included, and stops as soon as every window is certified: no cell left can hold a better row. Pages of
shard summaries are searched first, so that a block meets only shards that can still serve it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from heapq import heappop, heappush
from math import inf

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenotide.functions.names import literal_col
from phenotide.llm.common import slices, stored

#: Rows of a shard, anchors of a block, shards of a page, about.
SHARD = 8192
BLOCK = 256
PAGE = 64
#: Codes of a half, the rows they are fitted on at most (those whose hashes are lowest), and rounds.
CODES = 16
SAMPLE = 4096
ROUNDS = 8
#: Bounds are computed as doubles and widened by this share of what was added up.
SLACK = 1e-9
#: Whole numbers up to here are exact as doubles.
EXACT = 2**53
#: Scores are cut to this range.
GREATEST = 2**62

Codebooks = dict[int, tuple[np.ndarray, np.ndarray]]


def fit_codes(rows: np.ndarray, codes: int = CODES, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of k-means, begun at rows far apart; up to `codes` different rows are the centres themselves."""
    points = np.unique(rows.astype(np.float64), axis=0)
    if len(points) <= codes:
        return points
    begun, away = [points[0]], np.full(len(points), np.inf)
    while len(begun) < codes:
        away = np.minimum(away, np.square(points - begun[-1]).sum(axis=1))
        begun.append(points[int(np.argmax(away))])
    centres = np.array(begun)
    for _ in range(rounds):
        own = nearest(points, centres)
        for i in range(codes):
            if (own == i).any():
                centres[i] = points[own == i].mean(axis=0)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    away = np.square(centres).sum(axis=1) - 2 * (rows.astype(np.float64) @ centres.T)
    return np.argmin(away, axis=1)


def fit(vectors: DataFrame, codes: int = CODES, sample: int = SAMPLE) -> Codebooks:
    """Two codebooks for each length of vectors, from at most `sample` rows in all, which is what reaches the driver."""
    lowest = vectors.orderBy(F.xxhash64("vec_id", "vector")).select("vector").limit(sample).toPandas()
    by_length: dict[int, list[np.ndarray]] = {}
    for x in lowest["vector"]:
        by_length.setdefault(len(x), []).append(np.asarray(x, np.float64))
    return {n: (fit_codes(np.stack(x)[:, : n // 2], codes), fit_codes(np.stack(x)[:, n // 2 :], codes)) for n, x in by_length.items() if n > 1}


def _books(books: Codebooks, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks of a length; one that was not fitted has the origin as its only code."""
    return books.get(n) or (np.zeros((1, n // 2)), np.zeros((1, n - n // 2)))


def _codes(books: Codebooks, rows: np.ndarray) -> list[np.ndarray]:
    split = rows.shape[1] // 2
    return [nearest(part, centres) for part, centres in zip((rows[:, :split], rows[:, split:]), _books(books, rows.shape[1]))]


def _cell(books: Codebooks):
    """Column of the cell of a vector: a number per pair of codes."""

    def cells(vectors: pa.Array) -> pa.Array:
        lists, out = vectors.to_pylist(), np.zeros(len(vectors), np.int32)
        lengths = np.array([len(x) for x in lists])
        for n in set(lengths.tolist()):
            own = np.flatnonzero(lengths == n)
            first, second = _codes(books, _matrix([lists[i] for i in own]))
            out[own] = first * len(_books(books, n)[1]) + second
        return pa.array(out)

    cells.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(cells, T.IntegerType())("vector")


def _matrix(vectors) -> np.ndarray:
    """Rows of equal length as a matrix of whole numbers."""
    lists = [np.asarray(x, np.int64) for x in vectors]
    return np.concatenate(lists).reshape(len(lists), len(lists[0]))


class Best:
    """The best `k` rows of a window (greater score first, then smaller id)."""

    __slots__ = ("low", "high", "k", "rows")

    def __init__(self, low: float, high: float, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.rows: list[tuple[int, int]] = []  # (-score, id), ascending

    def floor(self) -> float:
        """What a row must reach to count."""
        return -self.rows[-1][0] if len(self.rows) == self.k else self.low

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= self.floor()) & (scores <= self.high))
        if len(fits) > 4 * self.k:  # ids ascend, so that a stable sort keeps the smaller of equals first
            fits = fits[np.argsort(-scores[fits], kind="stable")[: self.k]]
        if len(fits):
            self.rows = sorted([*self.rows, *((-int(scores[i]), int(ids[i])) for i in fits)])[: self.k]


class Summary:
    """What is known of a shard without its rows: codes in use, their radii, and which pairs of them are cells."""

    def __init__(self, centres: list[np.ndarray], radii: list[np.ndarray], pairs: np.ndarray) -> None:
        self.centres, self.radii, self.pairs = centres, radii, pairs

    def bounds(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half the greatest and the least score that any row of a code can have: (vectors, codes) each."""
        split, out = self.centres[0].shape[1], []
        for part, centres, radii in zip((vectors[:, :split], vectors[:, split:]), self.centres, self.radii):
            part = part.astype(np.float64)
            size = np.sqrt(np.square(part).sum(axis=1))[:, None]
            middle = part @ centres.T
            reach = size * radii * (1 + SLACK) + SLACK * (size * (1 + np.sqrt(np.square(centres).sum(axis=1))) + 1)
            out.append((middle + reach, middle - reach))
        return out

    def can_serve(self, vectors: np.ndarray, windows: list[tuple[float, float]]) -> bool:
        """Whether a cell can hold a row in any vector's range of scores."""
        (top0, low0), (top1, low1) = self.bounds(vectors)
        i, j = self.pairs.T
        least, most = np.array(windows, np.float64).reshape(-1, 2).T[:, :, None]
        return bool(((top0[:, i] + top1[:, j] >= least) & (low0[:, i] + low1[:, j] <= most)).any())


class Shard(Summary):
    """The rows of a shard by cell."""

    def __init__(self, books: Codebooks, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        split, centres, radii, own = rows.shape[1] // 2, [], [], []
        for part, book, codes in zip((rows[:, :split], rows[:, split:]), _books(books, rows.shape[1]), _codes(books, rows)):
            used, code = np.unique(codes, return_inverse=True)
            away = np.sqrt(np.square(part - book[codes]).sum(axis=1))
            farthest = np.zeros(len(used))
            np.maximum.at(farthest, code, away)
            centres.append(book[used])
            radii.append(farthest)
            own.append(code)
        order = np.lexsort((ids, own[1], own[0]))
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        pairs, starts = np.unique(np.stack(own, axis=1)[order], axis=0, return_index=True)
        super().__init__(centres, radii, pairs)
        stops = np.append(starts[1:], len(ids))
        self.spans = {(i, j): (a, b) for (i, j), a, b in zip(pairs.tolist(), starts.tolist(), stops.tolist())}

    def summary(self) -> Summary:
        return Summary(self.centres, self.radii, self.pairs)

    def scorer(self, vectors: np.ndarray):
        """Exact scores of a slice of rows with a vector, as doubles where these are exact, and as whole numbers cut to the range otherwise."""
        most = [int(np.abs(x.astype(np.float64)).max(initial=0)) for x in (vectors, self.rows)]
        if most[0] * most[1] * max(1, vectors.shape[1]) < EXACT:
            rows, asked = self.rows.astype(np.float64), vectors.astype(np.float64)
            return lambda at, q: rows[at] @ asked[q]
        rows, asked = self.rows.astype(object), vectors.astype(object)
        return lambda at, q: np.array([max(-GREATEST, min(GREATEST, sum(x * y for x, y in zip(r, asked[q])))) for r in rows[at]], object)

    def visit(self, bounds: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, windows: list[Best], scores) -> int:
        """Better the windows by the wanted rows; returns how many cells were opened.

        bounds: of a vector, for each half (greatest, least) by code. The heap holds the frontier of the
        pairs of codes, each half in descending order, and gives the pair of greatest sum.
        """
        order = [np.argsort(-top, kind="stable") for top, _ in bounds]
        tops = [top[o].tolist() for (top, _), o in zip(bounds, order)]
        codes = [o.tolist() for o in order]
        waiting, met, opened = [(-(tops[0][0] + tops[1][0]), 0, 0)], {(0, 0)}, 0
        while waiting:
            bound, i, j = heappop(waiting)
            able = [w for w in windows if -bound >= w.floor()]
            if not able:
                break
            for a, b in ((i + 1, j), (i, j + 1)):
                if (a, b) not in met and a < len(tops[0]) and b < len(tops[1]):
                    met.add((a, b))
                    heappush(waiting, (-(tops[0][a] + tops[1][b]), a, b))
            cell = codes[0][i], codes[1][j]
            if cell not in self.spans or bounds[0][1][cell[0]] + bounds[1][1][cell[1]] > max(w.high for w in able):
                continue
            first, stop = self.spans[cell]
            at = first + np.flatnonzero(wanted[first:stop])
            if len(at):
                opened += 1
                found = scores(at)
                for w in able:
                    w.offer(found, self.ids[at])
        return opened


def _grow(books: Codebooks):
    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(books, frame["vec_id"].to_numpy(np.int64), frame["label"].to_numpy(), _matrix(frame["vector"]))
        return pd.DataFrame({"dimension": [key[0]], "shard": [key[1]], "rows": [pickle.dumps(shard)], "summary": [pickle.dumps(shard.summary())]})

    return grow


def _gather(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["vec_id", "row"])
    asked = (frame["vec_id"].tolist(), frame["label"].tolist(), frame["row"].tolist(), _matrix(frame["vector"]))
    return pd.DataFrame({"dimension": [key[0]], "block": [key[1]], "home": [int(frame["shard"].iloc[0])], "anchors": [pickle.dumps(asked)]})


def _page(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dimension": [key[0]], "page": [key[1]], "summaries": [pickle.dumps(list(zip(frame["shard"].tolist(), frame["summary"])))]})


def _pack(rows: DataFrame) -> DataFrame:
    """Windows (block, row, window, low, high) as one value per block; null limits are none."""

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        windows: dict[int, list] = {}
        for row, window, low, high in zip(frame["row"].tolist(), frame["window"].tolist(), frame["low"], frame["high"]):
            windows.setdefault(row, []).append((window, -inf if low is None else int(low), inf if high is None else int(high)))
        return pd.DataFrame({"block": [key[0]], "windows": [pickle.dumps(windows)]})

    # Decimals reach pandas as objects: no rounding, and null stays null.
    exact = rows.withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("low", "high")})
    return stored(exact.groupBy("block").applyInPandas(pack, "block long, windows binary"), "windows")


_FOUND = "block long, row long, window int, anchor_id long, vec_id long, score long"


def _search(k: int, same: bool):
    """Pairs of a block and a shard -> what the shard adds to the windows of the block's anchors."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in slices(batches, 1):
            block, packed, anchors, windows = (pair.column(c)[0].as_py() for c in ("block", "rows", "anchors", "windows"))
            shard: Shard = pickle.loads(packed)
            (ids, labels, rows, vectors), wanted = pickle.loads(anchors), pickle.loads(windows)
            bounds, score, out = shard.bounds(vectors), shard.scorer(vectors), []
            for q, (me, label, row) in enumerate(zip(ids, labels, rows)):
                asked = [(i, Best(low, high, k)) for i, low, high in wanted.get(row, ())]
                if asked:
                    fits = (shard.labels == label) & (shard.ids != me) if same else shard.labels != label
                    shard.visit([(top[q], least[q]) for top, least in bounds], fits, [w for _, w in asked], lambda at, q=q: score(at, q))
                    out += [(block, row, i, me, v, -s) for i, w in asked for s, v in w.rows]
            names = ("block", "row", "window", "anchor_id", "vec_id", "score")
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 6, kinds)], list(names))

    return search


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block and a page -> the page's shards, but for the block's own, that can serve it."""
    for pair in slices(batches, 1):
        block, home, anchors, windows, summaries = (pair.column(c)[0].as_py() for c in ("block", "home", "anchors", "windows", "summaries"))
        (_, _, rows, vectors), wanted = pickle.loads(anchors), pickle.loads(windows)
        asking = [q for q, row in enumerate(rows) if row in wanted]
        ranges = [(min(w[1] for w in wanted[rows[q]]), max(w[2] for w in wanted[rows[q]])) for q in asking]
        met = [s for s, packed in pickle.loads(summaries) if s != home and asking and pickle.loads(packed).can_serve(vectors[asking], ranges)]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(met), pa.int64()), pa.array(met, pa.int64())], ["block", "shard"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block", "row", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """Stored shards of all rows, with their codebooks and pages of summaries.

    rows: vec_id, label, vector, dimension, anchor. Rows of a cell spread over its places by a hash.
    """

    def __init__(self, rows: DataFrame, shard: int = SHARD, page: int = PAGE, codes: int = CODES, sample: int = SAMPLE) -> None:
        books = fit(rows, codes, sample)
        coded = stored(rows.withColumn("cell", _cell(books)), "vectors")
        before = Window.partitionBy("dimension").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = coded.groupBy("dimension", "cell").agg(F.count(F.lit(1)).alias("size"))  # at most codes * codes per length
        cells = cells.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        row = F.xxhash64("vec_id", "label", "vector")
        dealt = coded.join(cells, ["dimension", "cell"]).withColumn("row", row)
        self.rows = dealt.withColumn("shard", F.floor((F.col("start") + F.pmod("row", "size")) / shard)).drop("size", "start")
        self.shards = stored(self.rows.groupBy("dimension", "shard").applyInPandas(_grow(books), "dimension int, shard long, rows binary, summary binary"), "shards")
        pages = self.shards.select("dimension", "shard", "summary", F.floor(F.col("shard") / page).alias("page"))
        self.pages = stored(pages.groupBy("dimension", "page").applyInPandas(_page, "dimension int, page long, summaries binary"), "pages")

    def blocks(self, block: int = BLOCK) -> DataFrame:
        """The anchors in blocks of one shard each, their home."""
        asked = self.rows.where("anchor")
        sizes = asked.groupBy("dimension", "shard").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
        named = asked.join(sizes, ["dimension", "shard"]).withColumn("block", F.xxhash64("dimension", "shard", F.pmod("row", "parts")))
        packed = named.groupBy("dimension", "block").applyInPandas(_gather, "dimension int, block long, home long, anchors binary")
        return stored(packed, "blocks")

    def search(self, blocks: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """The best k rows of each window: block, row, window, anchor_id, vec_id, score, rank.

        windows: block, row (of an anchor), window, low, high. Every block meets its home first. What
        it finds there lifts the floors of its windows before it is held against the pages.
        """
        home = blocks.join(_pack(windows), "block").join(self.shards.withColumnRenamed("shard", "home"), ["dimension", "home"])
        begun = stored(home.mapInArrow(_search(k, same), _FOUND), "begun")
        full = _ranked(begun, k).where(F.col("rank") == k).select("block", "row", "window", F.col("score").alias("floor"))
        lifted = windows.join(full, ["block", "row", "window"], "left").withColumn("low", F.coalesce("floor", "low"))
        asking = stored(blocks.join(_pack(lifted), "block"), "asking")
        counts = self.pages.groupBy("dimension").agg(F.max("page").alias("last"))
        held = asking.join(counts, "dimension").withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        met = held.join(self.pages, ["dimension", "page"]).mapInArrow(_meeting, "block long, shard long")
        others = asking.join(met, "block").join(self.shards, ["dimension", "shard"])
        return _ranked(begun.unionByName(others.mapInArrow(_search(k, same), _FOUND)), k)


def mine(
    rows: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    shard: int = SHARD,
    block: int = BLOCK,
    page: int = PAGE,
    codes: int = CODES,
    sample: int = SAMPLE,
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: condition on rows. The score is the inner product of two lists of longs (see
    kd_search.scaled); greater ones come first, ties by smaller key. An anchor's positives are its best
    `positives` other rows of the same label; a positive's negatives are the best `negatives` rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score, rank from 1. A
    positive without one has no row, so a negative positive_score never has any where low < high.

    Every row is indexed and results are exact; only the codebooks are fitted on a sample, which sets
    the speed. Rows with a null key, label or vector take no part, rows of another length none for an
    anchor. Repeated rows (key, label and vector) are one; rows of an anchor's own key are no
    positives. Scores are cut at 2^62 either way. Other columns are left out; an empty table gives no rows.
    """
    own = [literal_col(key).cast("long").alias("vec_id"), literal_col(label).cast("string").alias("label"), literal_col(vector).alias("vector")]
    whole = rows.select(*own, F.coalesce(anchors, F.lit(False)).alias("anchor")).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    distinct = whole.groupBy("vec_id", "label", "vector").agg(F.max("anchor").alias("anchor")).withColumn("dimension", F.size("vector"))
    index = Index(stored(distinct, "vectors"), shard, page, codes, sample)
    blocks = index.blocks(block)
    open_ = F.lit(None).cast("long")
    everything = _members(blocks).select("block", "row", F.lit(0).alias("window"), open_.alias("low"), open_.alias("high"))
    found = index.search(blocks, everything, positives, same=True)
    positive = stored(found.select("block", "row", F.col("rank").alias("window"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    exact = F.col("positive_score").cast("decimal(20,0)")
    limits = positive.select("block", "row", "window", F.ceil(low * exact / 100).alias("low"), F.floor(high * exact / 100).alias("high"))
    found = index.search(blocks, limits, negatives, same=False)
    negative = found.select("block", "row", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positive.join(negative, ["block", "row", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _members(blocks: DataFrame) -> DataFrame:
    """block, row: the anchors of each block."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in slices(batches, 1):
            rows = pickle.loads(one.column("anchors")[0].as_py())[2]
            yield pa.RecordBatch.from_arrays([pa.array([one.column("block")[0].as_py()] * len(rows), pa.int64()), pa.array(rows, pa.int64())], ["block", "row"])

    return blocks.select("block", "anchors").mapInArrow(unpack, "block long, row long")

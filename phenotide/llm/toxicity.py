"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the words of a text and their first four and five letters, hashed. A word counts 1 plus
the logarithm of its occurrences; the sum is divided by a power of the number of words. One weight per feature is shared by all grades, which
differ in ordered thresholds alone: P(grade >= k) = logistic(score - threshold k). Expected severity is the sum
of these probabilities. Weights have an L1 penalty, so that common words weigh nothing and long texts
gather no noise.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from math import log
from operator import mul

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenotide.llm.common import ROWS_AT_ONCE, set_aside, text_of
from phenotide.llm.tokens import Remembering

BUCKETS = 1 << 22
PREFIXES = (4, 5)
#: Labelled texts that the model is fitted on, at most: those whose ids hash lowest.
SAMPLE = 6000
#: Counts are divided by this power of the number of words.
POWER = 0.35

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def features_of(word: str) -> list[int]:
    """Buckets of a lower-case word and its beginnings; marks around it do not count."""
    core = _EDGES.sub("", word)
    if not core:
        return []
    names = [f"={core}", *(f"{n}{core[:n]}" for n in PREFIXES if len(core) >= n)]
    return [xxhash.xxh64_intdigest(x.encode()) % BUCKETS for x in names]


def _counted(text: str) -> tuple[dict[str, float], float]:
    """The damped occurrences of each word, and what they are divided by."""
    counts = Counter(text.lower().split())
    return {x: 1 + log(n) for x, n in counts.items()}, max(1, sum(counts.values())) ** POWER


def _sparse(column: pa.Array) -> pa.Array:
    ids, values = [], []
    remembered = Remembering(lambda words: [features_of(x) for x in words])
    for at in range(0, len(column), ROWS_AT_ONCE):
        for text in column.slice(at, ROWS_AT_ONCE).to_pylist():
            counts, n = _counted(text)
            loads: dict[int, float] = defaultdict(float)
            for own, value in zip(remembered.values(list(counts)), counts.values()):
                for i in own:
                    loads[i] += value / n
            ids.append(sorted(loads))
            values.append([loads[i] for i in ids[-1]])
    return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["ids", "values"])


_sparse.__annotations__ = {"column": pa.Array, "return": pa.Array}
_SPARSE = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))])


@dataclass
class Model:
    """Ordered thresholds, one per grade above the lowest, and the weights that are not zero by bucket."""

    thresholds: list[float] = field(default_factory=list)
    weights: dict[int, float] = field(default_factory=dict)

    def severity(self, scores: np.ndarray) -> np.ndarray:
        """Expected grade."""
        return sum((_logistic(scores - t) for t in self.thresholds), np.zeros_like(scores))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Features:
    """Sparse rows: where each begins and ends, and the buckets and values of all."""

    def __init__(self, ids: list, values: list) -> None:
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        self.ids = np.concatenate([np.asarray(x, np.int32) for x in ids]) if len(ids) else np.zeros(0, np.int32)
        self.values = np.concatenate([np.asarray(x, np.float32) for x in values]) if len(ids) else np.zeros(0, np.float32)

    @staticmethod
    def of_column(column: pa.StructArray) -> Features:
        found = Features([], [])
        ids, values = column.field("ids"), column.field("values")
        found.ends = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))]).astype(np.int64)
        found.ids, found.values = np.asarray(ids.flatten()), np.asarray(values.flatten())
        return found

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends) - 1, dtype=np.int32), np.diff(self.ends))


class _Rows:
    """Features with the buckets in use numbered from 0."""

    def __init__(self, features: Features) -> None:
        self.n = len(features.ends) - 1
        number = np.zeros(BUCKETS, np.int32)
        self.buckets = np.flatnonzero(np.bincount(features.ids, minlength=BUCKETS))
        number[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        self.rows, self.values, self.columns = features.rows(), features.values, number[features.ids]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * weights[self.columns], self.n)

    def back(self, slopes: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * slopes[self.rows], len(self.buckets))


def _settled(thresholds: np.ndarray, scores: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """The likeliest thresholds for these scores: Newton steps, halved until they stay in order and gain.

    A row of grade k costs softplus(t(k) - score) + softplus(score - t(k + 1)) - log(1 - exp(t(k) - t(k + 1))).
    """
    top = len(thresholds)
    at, over = grades[:, None] == np.arange(1, top + 1), grades[:, None] == np.arange(top)
    between = np.maximum(np.bincount(grades, minlength=top + 1)[1:top], 1e-3)  # an empty grade still has its place

    def cost(t: np.ndarray) -> float:
        away = scores[:, None] - t
        return (at * np.logaddexp(0, -away)).sum() + (over * np.logaddexp(0, away)).sum() - (between * np.log(-np.expm1(-np.diff(t)))).sum()

    now = cost(thresholds)
    for _ in range(20):
        reached = _logistic(scores[:, None] - thresholds)
        narrow = 1 / np.expm1(np.diff(thresholds))
        pull = (at * (1 - reached) - over * reached).sum(axis=0)
        pull[:-1] += between * narrow
        pull[1:] -= between * narrow
        bend = between * narrow * (1 + narrow)
        curve = np.diag(((at | over) * reached * (1 - reached)).sum(axis=0) + 1e-6) - np.diag(bend, 1) - np.diag(bend, -1)
        curve += np.diag(np.append(bend, 0) + np.append(0, bend))
        move = np.linalg.solve(curve, pull)
        for halving in range(40):
            new = thresholds - move / 2**halving
            if (np.diff(new) > 0).all() and (then := cost(new)) < now:
                break
        else:
            break
        thresholds, now = new, then
        if np.abs(move).max() < 1e-6:
            break
    return thresholds


def fit(features: Features, grades: np.ndarray, penalty: float = 1e-4, rounds: int = 400, tolerance: float = 1e-4) -> Model:
    """Proximal gradient steps with momentum on the mean negative log-likelihood; grades are 0, 1, 2 and so on.

    Thresholds are solved for at each step, whatever the share of each grade. With fewer than two grades
    there is nothing to tell apart: the model has no thresholds and gives 0. Every feature takes part;
    the penalty decides which weigh. Steps end when no weight moves by `tolerance`, or after `rounds`.
    """
    top = int(grades.max(initial=0))
    if not top or not len(grades[grades < top]):
        return Model()
    x = _Rows(features)
    share = [np.clip((grades >= k).mean(), 1e-6, 1 - 1e-6) for k in range(1, top + 1)]
    thresholds = np.array([np.log((1 - p) / p) for p in share]) + 1e-3 * np.arange(top)
    step = 1 / (0.5 * x.back(x.scores(np.ones(len(x.buckets)))) / x.n + 1e-9)  # of each weight; their bounds majorise the curvature
    weights = ahead = np.zeros(len(x.buckets))
    momentum, every = 1.0, np.arange(x.n)
    for _ in range(rounds):
        scores = x.scores(ahead)
        thresholds = _settled(thresholds, scores, grades)
        above = np.ones((x.n, top + 2))
        above[:, 1:-1] = _logistic(scores[:, None] - thresholds[None, :])
        above[:, -1] = 0
        slope = (above[every, grades] + above[every, grades + 1] - 1) / x.n
        moved = ahead - step * x.back(slope)
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + (momentum - 1) / following * (new - weights)
        moved_by = np.abs(new - weights).max(initial=0)
        weights, momentum = new, following
        if moved_by < tolerance:
            break
    thresholds = _settled(thresholds, x.scores(weights), grades)
    some = np.flatnonzero(weights)
    return Model(thresholds.tolist(), dict(zip(x.buckets[some].tolist(), weights[some].tolist())))


def grades_from_flags(features: Features, flags: np.ndarray, grades: int = 3) -> np.ndarray:
    """Grades of texts that are only flagged: 0 without the flag; flagged ones in `grades` parts by rank of their load.

    The load adds up what features say for the flag: their smoothed log-odds less two standard errors, where
    that is positive, so that a rare feature says little without any limit on its count. Equal loads share
    their middle rank, so that equal texts have equal grades, however few are flagged.
    """
    flags = flags.astype(bool)
    if not flags.any():
        return np.zeros(len(flags), np.int64)
    rows = features.rows()
    with_flag, without = (np.bincount(features.ids[own[rows]], minlength=BUCKETS) + 0.5 for own in (flags, ~flags))
    odds = np.log(with_flag / (flags.sum() + 1)) - np.log(without / ((~flags).sum() + 1))
    sure = np.maximum(0, odds - 2 * np.sqrt(1 / with_flag + 1 / without))
    load = np.round(np.bincount(rows, features.values * sure[features.ids], len(flags))[flags], 9)
    ordered = np.sort(load)
    middle = (np.searchsorted(ordered, load, "left") + np.searchsorted(ordered, load, "right")) / 2 / len(load)
    out = np.zeros(len(flags), np.int64)
    out[flags] = 1 + np.minimum(grades - 1, np.floor(grades * middle)).astype(np.int64)
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", flag: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled texts, those whose keys hash lowest; labels are 0 or 1 in `flag`.

    Rows without key or label do not count; a key labelled several times has its highest label, and one
    of several rows or texts counts once, with the text whose hash is lowest. The sample's size bounds
    what is sent to the texts and what comes back to the driver.
    """
    known = labels.where(F.col(flag).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(flag).cast("int")).alias("_flag"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(sample)
    texts = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text"))
    one = F.min(F.struct(F.xxhash64("_text").alias("_hash"), "_text")).alias("_one")
    rows = texts.join(F.broadcast(chosen), "_key").groupBy("_key", "_flag").agg(one)
    found = rows.select("_key", "_flag", F.arrow_udf(_sparse, _SPARSE)("_one._text").alias("_x")).toArrow().sort_by("_key")
    if not found.num_rows:
        return Model()
    features = Features.of_column(found.column("_x").combine_chunks())
    return fit(features, grades_from_flags(features, np.asarray(found.column("_flag"))))


def with_severity(docs: DataFrame, model: Model, text: str = "text", reject: float = 0.2) -> DataFrame:
    """Every row with expected_severity, p_toxic (probability of any grade above 0), grade and kept (p_toxic below `reject`).

    grade is the number of grades more likely reached than not. Whole texts count; a null or empty one has
    the score 0. Without a fitted threshold everything has severity 0 and is kept. Columns of these
    names are replaced.
    """
    weights, thresholds = model.weights, model.thresholds

    def score(column: pa.Array) -> pa.Array:
        weigh = Remembering(lambda words: [sum(weights.get(i, 0.0) for i in features_of(x)) for x in words])
        out = []
        for at in range(0, len(column), ROWS_AT_ONCE):
            for x in column.slice(at, ROWS_AT_ONCE).to_pylist():
                counts, n = _counted(x)
                out.append(sum(map(mul, weigh.values(list(counts)), counts.values())) / n)
        return pa.array(out, pa.float64())

    score.__annotations__ = {"column": pa.Array, "return": pa.Array}
    reached = [1 / (1 + F.exp(F.lit(t) - F.col("_score"))) for t in thresholds]
    rows, back = set_aside(docs, text)
    scored = rows.withColumn("_score", F.arrow_udf(score, T.DoubleType())(text_of(text)))
    first = reached[0] if reached else F.lit(0.0)
    found = scored.withColumns(
        {
            "expected_severity": sum(reached, F.lit(0.0)),
            "p_toxic": first,
            "grade": sum([(p >= 0.5).cast("int") for p in reached], F.lit(0)),
            "kept": first < reject,
        }
    )
    return back(found, "expected_severity", "p_toxic", "grade", "kept")

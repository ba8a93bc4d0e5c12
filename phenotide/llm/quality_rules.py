"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Location and scatter are minimum-covariance-determinant estimates: from several deterministic starts,
concentration steps keep the share `core` of the rows that lie nearest by the current Mahalanobis
distance, until the determinant settles; of the starts the one of smallest determinant counts. A step
is one aggregation for all groups and starts: rows are summed per distance bin, and the bins up to the
wanted share are added up. Statistics are whole numbers, so that sums do not depend on their order. Every
row takes part; a hot group sends one row per bin and task. The estimates of a group are drawn towards
those of its language and of the table, the more so the fewer rows it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenotide.functions.names import literal_col
from phenotide.llm.common import ROWS_PER_FILE, set_aside, stored
from phenotide.llm.text_statistics import COUNTS, with_statistics

#: Steps of a statistic per unit.
GRID = 1024
#: Bins of distance per doubling.
BINS = 48
#: What the statistics vary by within good text, below which no deviation counts: log of the mean
#: word length, log of symbols per 100 words, log of repeated lines per 100 words, root of the share
#: of repeated words.
SCALES = (0.05, 0.3, 0.35, 0.15)
DIMENSIONS = len(SCALES)
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
#: Starts of the concentration steps: quartiles without correlation, all rows, directions from the medians.
STARTS = ("quartiles", "all", "signs")
#: Concentration steps at most; they end sooner once no log determinant moves by SETTLED.
STEPS = 8
SETTLED = 1e-3
#: Rows that a group needs to weigh as much as its language, and a language as the table.
PRIOR = 50

_ESTIMATE = "_group string, _start int, _size long, _mean array<double>, _scatter array<double>, _inverse array<double>, _logdet double, _moved double"


def _chi2(x: float, dof: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def _quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2(middle, dof) < p else (low, middle)
    return high


def base_failed(min_words: int = 20, repeat_percent: int = 30):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def _vector() -> list:
    words = F.greatest(F.col("n_words"), F.lit(1))
    parts = (
        F.log((F.col("word_chars") + 1) / words),
        F.log1p(100 * F.col("n_symbols") / words),
        F.log1p(100 * F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    )
    return [F.round(GRID * x).cast("long").alias(f"_x{i}") for i, x in enumerate(parts)]


def _moments() -> list:
    """Number, sums and sums of products of rows."""
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(f"_x{i}").alias(f"s{i}") for i in range(DIMENSIONS))]
    return sums + [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"p{i}_{j}") for i, j in PAIRS]


MOMENTS = ("n", *(f"s{i}" for i in range(DIMENSIONS)), *(f"p{i}_{j}" for i, j in PAIRS))


def _estimates(factor: float):
    """From moments of core rows (_group, _start, _size, _old): mean, scatter times factor above the floor, its inverse, log determinant and how far that moved."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = np.diag(np.square(SCALES))
        for frame in frames:
            means, scatters, inverses, logs = [], [], [], []
            for row in frame.to_dict("records"):
                n, scatter = int(row["n"]), np.zeros((DIMENSIONS, DIMENSIONS))
                for i, j in PAIRS:
                    exact = n * int(row[f"p{i}_{j}"]) - int(row[f"s{i}"]) * int(row[f"s{j}"])
                    scatter[i, j] = scatter[j, i] = exact / (n * n) / GRID**2
                whole = factor * scatter + floor
                means.append([int(row[f"s{i}"]) / n / GRID for i in range(DIMENSIONS)])
                scatters.append(whole.ravel().tolist())
                inverses.append(np.linalg.inv(whole).ravel().tolist())
                logs.append(float(np.linalg.slogdet(whole)[1]))
            found = {"_mean": means, "_scatter": scatters, "_inverse": inverses, "_logdet": logs, "_moved": np.abs(np.array(logs) - frame["_old"].to_numpy())}
            yield pd.DataFrame({"_group": frame["_group"], "_start": frame["_start"], "_size": frame["_size"], **found})

    return solve


def _distance():
    """Squared Mahalanobis distance of a row from the estimate joined to it."""
    away = [F.col(f"_x{i}") / GRID - F.col("_mean")[i] for i in range(DIMENSIONS)]
    terms = [F.col("_inverse")[DIMENSIONS * i + j] * away[i] * away[j] * (1 if i == j else 2) for i, j in PAIRS]
    return sum(terms[1:], terms[0])


def _few(groups: DataFrame, rows: int) -> DataFrame:
    """A small table of at most so many rows in as few partitions as that calls for; what made it keeps its own tasks."""
    return groups.repartition(max(1, -(-rows // ROWS_PER_FILE)))


def _step(rows: DataFrame, estimates: DataFrame, core: float, factor: float, most: int = ROWS_PER_FILE) -> DataFrame:
    """The estimates from the share `core` of each group's rows that lie nearest by the old ones, for each start; whole bins, so rather more.

    There are `most` estimates at most.
    """
    near = rows.join(estimates.select("_group", "_start", "_mean", "_inverse", F.col("_logdet").alias("_old")), "_group")
    near = near.withColumn("_bin", F.floor(BINS * F.log2(1 + F.greatest(_distance(), F.lit(0.0)))))
    whole = Window.partitionBy("_group", "_start")
    before = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = near.groupBy("_group", "_start", "_old", "_bin").agg(*_moments())
    bins = bins.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("_size", F.sum("n").over(whole))
    kept = bins.where(F.col("_before") < core * F.col("_size")).groupBy("_group", "_start", "_old", "_size").agg(*(F.sum(c).alias(c) for c in MOMENTS))
    return _few(kept, most).mapInPandas(_estimates(factor), _ESTIMATE)


def _starts(rows: DataFrame, most: int = ROWS_PER_FILE) -> DataFrame:
    """The starting estimates of each group, by number of the start; `most` groups at most."""
    quartiles = rows.groupBy("_group").agg(*(F.percentile(f"_x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(DIMENSIONS)), F.count(F.lit(1)).alias("_size"))
    quartiles = stored(_few(quartiles, most), "quartiles")
    spread = [F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / (1.349 * GRID), F.lit(2)) + SCALES[i] ** 2 for i in range(DIMENSIONS)]
    middle = F.array(*(F.col(f"q{i}")[1] / GRID for i in range(DIMENSIONS)))

    def diagonal(values: list):
        return F.array(*(values[i] if i == j else F.lit(0.0) for i in range(DIMENSIONS) for j in range(DIMENSIONS)))

    first = quartiles.select("_group", F.lit(0).alias("_start"), "_size", middle.alias("_mean"), diagonal(spread).alias("_scatter"), diagonal([1 / s for s in spread]).alias("_inverse"), F.lit(math.inf).alias("_logdet"), F.lit(math.inf).alias("_moved"))
    every = rows.groupBy("_group").agg(*_moments()).withColumns({"_start": F.lit(1), "_size": F.col("n"), "_old": F.lit(math.inf)})
    # Each row as a direction of length GRID from the medians, in units of the spread, which is put back below.
    units = [(F.col(f"_x{i}") / GRID - F.col("_mean")[i]) / F.sqrt(F.col("_scatter")[(DIMENSIONS + 1) * i]) for i in range(DIMENSIONS)]
    placed = rows.join(first, "_group").select("_group", "_size", *(u.alias(f"u{i}") for i, u in enumerate(units)))
    length = F.sqrt(sum((F.pow(F.col(f"u{i}"), F.lit(2)) for i in range(DIMENSIONS)), F.lit(0.0)))
    signs = placed.withColumn("_length", length).select("_group", "_size", *(F.coalesce(F.round(GRID * F.try_divide(F.col(f"u{i}"), F.col("_length"))), F.lit(0)).cast("long").alias(f"_x{i}") for i in range(DIMENSIONS)))
    signs = signs.groupBy("_group", "_size").agg(*_moments()).withColumns({"_start": F.lit(2), "_old": F.lit(math.inf)})
    scattered = _few(signs, most).mapInPandas(_estimates(DIMENSIONS), _ESTIMATE).select("_group", "_scatter")
    directed = first.withColumnRenamed("_scatter", "_spread").join(scattered, "_group").mapInPandas(_directed, _ESTIMATE)
    return first.unionByName(_few(every, most).mapInPandas(_estimates(1.0), _ESTIMATE)).unionByName(directed)


def _directed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The scatter of directions stretched to the spread of each statistic."""
    for frame in frames:
        scatters, inverses = [], []
        for spread, scatter in zip(frame["_spread"], frame["_scatter"]):
            sides = np.sqrt(np.asarray(spread).reshape(DIMENSIONS, DIMENSIONS).diagonal())
            whole = np.asarray(scatter).reshape(DIMENSIONS, DIMENSIONS) * np.outer(sides, sides)
            scatters.append(whole.ravel().tolist())
            inverses.append(np.linalg.inv(whole).ravel().tolist())
        found = {"_mean": frame["_mean"], "_scatter": scatters, "_inverse": inverses, "_logdet": math.inf, "_moved": math.inf}
        yield pd.DataFrame({"_group": frame["_group"], "_start": 2, "_size": frame["_size"], **found})


def _smallest_determinants(rows: DataFrame, core: float, steps: int, most: int = ROWS_PER_FILE) -> DataFrame:
    """The estimates of each group of rows, `most` at most, from the start that ends with the smallest determinant."""
    factor = core / _chi2(_quantile(core, DIMENSIONS), DIMENSIONS + 2)
    now = stored(_starts(rows, most), "estimates")
    several = now.count()
    for _ in range(steps):
        now = stored(_step(rows, now, core, factor, several), "estimates")
        if now.where(F.col("_moved") > SETTLED).isEmpty():
            break
    estimate = F.struct("_size", "_mean", "_scatter")
    best = now.groupBy("_group").agg(F.min_by(estimate, F.struct(F.round("_logdet", 9), "_start")).alias("_best"))
    return stored(best.select("_group", "_best.*"), "best", rows=several)


def _name(*columns: str):
    """A group's name; null is a value of its own."""
    return F.concat_ws("\x01", *(F.coalesce(F.concat(F.lit("="), literal_col(c).cast("string")), F.lit("null")) for c in columns))


def _drawn(groups: DataFrame, best: DataFrame, prior: int) -> DataFrame:
    """Mean and inverse scatter of each group, drawn to those of its language, which are drawn to those of the table.

    groups: _full, _language. An estimate from n rows weighs n / (n + prior); one of no rows weighs nothing.
    """

    def renamed(name: str, key: str) -> DataFrame:
        return best.select(F.col("_group").alias(key), F.struct("_size", "_mean", "_scatter").alias(name))

    table = best.where("_group = ''").select(F.struct("_size", "_mean", "_scatter")).scalar()
    named = groups.join(renamed("_own", "_full"), "_full", "left").join(renamed("_of_language", "_language"), "_language", "left")

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            means, inverses = [], []
            for levels in zip(frame["_of_table"], frame["_of_language"], frame["_own"]):
                mean = scatter = None
                for level in levels:
                    if level is None:
                        continue
                    own, spread = np.asarray(level["_mean"]), np.asarray(level["_scatter"]).reshape(DIMENSIONS, DIMENSIONS)
                    weight = 1.0 if mean is None else level["_size"] / (level["_size"] + prior)
                    mean = own if mean is None else weight * own + (1 - weight) * mean
                    scatter = spread if scatter is None else weight * spread + (1 - weight) * scatter
                means.append(None if mean is None else mean.tolist())
                inverses.append(None if mean is None else np.linalg.inv(scatter).ravel().tolist())
            yield pd.DataFrame({"_full": frame["_full"], "_mean": means, "_inverse": inverses})

    drawn = named.withColumn("_of_table", table).select("_full", "_own", "_of_language", "_of_table")
    return drawn.mapInPandas(draw, "_full string, _mean array<double>, _inverse array<double>")


def with_verdict(counted: DataFrame, language: str = "lang", source: str = "source", core: float = 0.75, steps: int = STEPS, tail: float = 1e-9, prior: int = PRIOR) -> DataFrame:
    """Every row of a stored table with statistics, with base_failed, distance and kept.

    kept is false if the fixed rules fail, or if the squared distance from the row's group lies beyond
    the chi-square quantile that good text passes with probability `tail`. Groups are language and
    source, null being a value. The estimates of a group of n rows that pass the fixed rules weigh
    n / (n + prior), the rest comes from all such rows of its language, whose estimates are drawn to those of
    the whole table in the same way: there is no size at which the judgement changes. distance is null only
    if no row of the table passes the fixed rules. counted is read several times. Repeated rows count as
    often as they occur; columns of the new names are replaced, all others stay, whatever they are called.
    """
    rows, back = set_aside(counted, *COUNTS, language, source)
    rows = rows.withColumns({"base_failed": base_failed(), "_full": _name(language, source), "_language": F.concat(F.lit("*"), _name(language))})
    rows = rows.select("*", *_vector())
    vector = [f"_x{i}" for i in range(DIMENSIONS)]
    pools = F.explode(F.array("_full", "_language", F.lit(""))).alias("_group")
    fine = rows.where(~F.col("base_failed")).select(pools, *vector)
    groups = rows.select("_full", "_language").distinct()
    known = groups.count()
    best = _smallest_determinants(fine, core, steps, most=2 * known + 1)  # each with its language, and the table
    judged = rows.join(stored(_drawn(_few(groups, known), best, prior), "drawn"), "_full", "left").withColumn("distance", _distance())
    far = F.coalesce(F.col("distance") > _quantile(1 - tail, DIMENSIONS), F.lit(False))
    return back(judged.withColumn("kept", ~F.col("base_failed") & ~far), "base_failed", "distance", "kept")


def judge(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """Every row of docs with its statistics and verdict. An empty or null text fails the fixed rules."""
    return with_verdict(stored(with_statistics(docs, text), "statistics"), language, source)


def statistics_names() -> list[str]:
    return [*COUNTS, "base_failed", "distance", "kept"]

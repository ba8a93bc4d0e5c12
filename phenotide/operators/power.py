"""Case rates of record sources and the power of association tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenotide.functions.normal import cdf_of, crossing, normal_cdf, quantile_of

# Significance level and odds ratios of the standard grid.
ALPHA = 1e-9
ODDS_RATIOS = (1.5, 2.0, 3.0)
POWER = 0.8
# A far tail below this share of the power does not change it.
NEGLIGIBLE = 1e-18


def source_case_rates(sources: Mapping[str, tuple[DataFrame, DataFrame]], distinct: str = "bitmap") -> DataFrame:
    """Cases, cohort size and case rate of each source, from its (cases, cohort) frames.

    Participants are counted exactly, in one of three ways; each spreads a source that holds most rows over
    all tasks. ``distinct='words'`` marks them in words of 64 consecutive numbers, which a task combines by
    hashing: it holds a word per 64 numbers of its cohort, however many rows it reads, and sends as much.
    ``'bitmap'`` marks them in bitmaps of 32,768 numbers, so that a source sends least (4 KB per range of
    numbers and task); Spark combines bitmaps of sorted rows only, so a task sorts all it reads. ``'rows'``
    makes participants distinct as rows first, for numbers spread over the whole range, such as hashes. A
    source without participants has no cases, a cohort of 0 and no rate.
    """
    if distinct not in ("bitmap", "words", "rows"):
        raise ValueError(f"distinct must be 'bitmap', 'words' or 'rows', not {distinct!r}")
    named = [(name, kind) for name in sources for kind in ("cases", "n")]
    frames = [frame for pair in sources.values() for frame in pair]
    # A participant carries the number of the frame, not two names: what a task holds stays narrow.
    parts = [frame.select(F.lit(i).alias("frame"), F.col("eid").cast("long").alias("eid")) for i, frame in enumerate(frames)]
    stacked = reduce(DataFrame.unionByName, parts).where(F.col("eid").isNotNull())
    if distinct == "bitmap":
        counts = _counted_by_bitmap(stacked, len(frames))
    else:
        counts = (_counted_by_word if distinct == "words" else _counted_by_row)(stacked)
    empty = parts[0].sparkSession.createDataFrame([(i, 0) for i in range(len(frames))], "frame int, n long")
    source, kind = (F.array(*map(F.lit, names))[F.col("frame")] for names in zip(*named))
    counts = counts.unionByName(empty).select(source.alias("source"), kind.alias("kind"), "n")
    sums = [F.sum(F.when(F.col("kind") == kind, F.col("n"))).alias(kind) for kind in ("cases", "n")]
    rates = counts.groupBy("source").agg(*sums)
    return rates.withColumn("case_rate", F.try_divide("cases", "n"))


def _counted_by_bitmap(participants: DataFrame, frames: int) -> DataFrame:
    """Range and frame make one number, as partial bitmaps are made from sorted rows: rows of two numbers, sorted by one."""
    place = F.bitmap_bucket_number("eid") * F.lit(frames) + F.col("frame")
    marked = participants.groupBy(place.alias("place"))
    bitmaps = marked.agg(F.bitmap_construct_agg(F.bitmap_bit_position("eid")).alias("bitmap"))
    frame = F.pmod(F.col("place"), F.lit(frames)).cast("int").alias("frame")
    return bitmaps.groupBy(frame).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def _counted_by_word(participants: DataFrame) -> DataFrame:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("eid").bitwiseAND(63).cast("int"))
    words = participants.groupBy("frame", F.shiftright("eid", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("frame").agg(F.sum(F.bit_count("bits")).alias("n"))


def _counted_by_row(participants: DataFrame) -> DataFrame:
    return participants.distinct().groupBy("frame").agg(F.count("*").alias("n"))


def association_power(
    variants: DataFrame,
    sources: DataFrame,
    odds_ratios: Sequence[float] = ODDS_RATIOS,
    alpha: float = ALPHA,
    effect: str = "divide",
) -> DataFrame:
    """Power of a two-sided normal test for each variant, source and odds ratio.

    ``variants`` holds ``maf`` and whatever names the variant; ``sources`` holds source, cases, n.
    ``effect='divide'`` takes log(odds ratio) / sqrt(2 maf (1 - maf)); ``'multiply'`` multiplies, so
    that rarer variants have less power. Power is null where it is undefined: no cases, no
    controls, or a frequency outside (0, 1).

    Every variant row carries the list of sources and odds ratios and is expanded in place: no join.
    The list has one entry per record source, as many as the plan of ``source_case_rates`` names.
    """
    if effect not in ("divide", "multiply"):
        raise ValueError(f"effect must be 'divide' or 'multiply', not {effect!r}")
    critical = -NormalDist().inv_cdf(alpha / 2)
    maf, cases, n = F.col("maf"), F.col("cases").cast("double"), F.col("n").cast("double")
    ratio = F.col("odds_ratio")
    spread = F.sqrt(2 * maf * (1 - maf))
    size = F.log(ratio) / spread if effect == "divide" else F.log(ratio) * spread
    defined = (cases > 0) & (cases < n) & (maf > 0) & (maf < 1)
    statistic = F.when(defined, size * F.sqrt(cases * (n - cases) / n))
    return (
        variants.select("*", F.inline(_as_array(sources)))
        .select("*", F.explode(F.array(*[F.lit(float(r)) for r in odds_ratios])).alias("odds_ratio"))
        .withColumn("statistic", statistic)
        .withColumns({"upper": F.col("statistic") - critical, "lower": -critical - F.col("statistic")})
        .withColumn("power", normal_cdf("upper") + normal_cdf("lower"))
        .drop("cases", "n", "statistic", "upper", "lower")
    )


def association_solve(
    variants: DataFrame,
    sources: DataFrame,
    unknown: str,
    odds_ratios: Sequence[float] = ODDS_RATIOS,
    alphas: Sequence[float] = (ALPHA,),
    powers: Sequence[float] = (POWER,),
    effect: str = "divide",
) -> DataFrame:
    """Any one of ``power``, ``alpha``, ``cases`` and ``odds_ratio`` of the two-sided normal test from the others.

    One row for each variant (``maf`` and whatever names it), source (source, cases, n) and combination
    of the given odds ratios, levels and powers: the columns of ``variants``, source, odds_ratio, alpha,
    power, cases, n. The list of what is unknown is not used. Unknown cases keep the source's case rate, so
    that n changes with them; they are the least number, not rounded, that reaches the power. An unknown
    odds ratio is the one above 1. ``effect`` is as for ``association_power``.

    The test's strength (its expected statistic) and its critical value decide everything. For unknown
    cases and odds ratios the strength depends on level and power alone, so that the root is found once
    per pair of these; for an unknown level it is found once per row, where the far tail counts at all.
    What cannot be is null: frequencies, rates, levels or powers outside (0, 1), a power not above its
    level, no effect where cases are asked for.
    """
    given = {"odds_ratio": odds_ratios, "alpha": alphas, "power": powers}
    if unknown not in (*given, "cases"):
        raise ValueError(f"unknown must be one of {sorted((*given, 'cases'))}, not {unknown!r}")
    if effect not in ("divide", "multiply"):
        raise ValueError(f"effect must be 'divide' or 'multiply', not {effect!r}")
    given.pop(unknown, None)
    rows = [tuple(map(float, row)) for row in product(*given.values())]
    designs = variants.sparkSession.createDataFrame(rows, ", ".join(f"{name} double" for name in given))
    if "alpha" in given:
        designs = designs.withColumn("critical", -quantile_of(F.col("alpha") / 2))
    if unknown in ("cases", "odds_ratio"):
        designs = designs.withColumn("strength", _strength_for(F.col("critical"), F.col("alpha"), F.col("power")))
    grid = variants.select("*", F.inline(_as_array(sources))).select("*", F.inline(_as_array(designs, designs.columns)))
    maf, cases, n = F.col("maf"), F.col("cases").cast("double"), F.col("n").cast("double")
    spread = F.sqrt(2 * maf * (1 - maf))
    defined = (cases > 0) & (cases < n) & (maf > 0) & (maf < 1)
    grid = grid.withColumns({"cases": F.when(defined, cases), "n": F.when(defined, n), "spread": F.when(defined, spread)})
    effective, rate = F.col("cases") * (F.col("n") - F.col("cases")) / F.col("n"), F.col("cases") / F.col("n")
    per_root = 1 / F.col("spread") if effect == "divide" else F.col("spread")
    size = F.abs(F.log("odds_ratio")) * per_root
    if unknown == "cases":
        needed = F.pow(F.col("strength") / F.nullif(size, F.lit(0.0)), F.lit(2)) / (1 - rate)
        solved = grid.withColumns({"cases": needed, "n": needed / rate})
    elif unknown == "odds_ratio":
        solved = grid.withColumn("odds_ratio", F.exp(F.col("strength") / (per_root * F.sqrt(effective))))
    elif unknown == "power":
        strong = grid.withColumn("strength", size * F.sqrt(effective))
        solved = strong.withColumn("power", _two_sided(F.col("strength"), F.col("critical")))
    else:
        strong = grid.withColumn("strength", size * F.sqrt(effective)).withColumn("critical", _critical_for(F.col("strength"), F.col("power")))
        solved = strong.withColumn("alpha", 2 * cdf_of(-F.col("critical")))
    names = [*variants.columns, "source", "odds_ratio", "alpha", "power", "cases", "n"]
    return solved.select(*names)


def _two_sided(strength: Column, critical: Column) -> Column:
    return cdf_of(strength - critical) + cdf_of(-critical - strength)


def _strength_for(critical: Column, alpha: Column, power: Column) -> Column:
    """The strength that reaches a power: the near tail alone would need more, twice the near tail less."""
    low, high = F.greatest(critical + quantile_of(power / 2), F.lit(0.0)), critical + quantile_of(power)
    return F.when(power > alpha, crossing(low, high, lambda x: _two_sided(x, critical) < power))


def _critical_for(strength: Column, power: Column) -> Column:
    """The critical value at which a strength has a power, bracketed in the same way."""
    near = strength - quantile_of(power)
    low, high = F.greatest(near, F.lit(0.0)), strength - quantile_of(power / 2)
    whole = crossing(low, high, lambda x: _two_sided(strength, x) > power)
    return F.when(cdf_of(-near - strength) < NEGLIGIBLE * power, near).otherwise(whole)


def _as_array(table: DataFrame, names: Sequence[str] = ("source", "cases", "n")) -> Column:
    return table.agg(F.collect_list(F.struct(*names)).alias("rows")).scalar()

"""Size checks in front of a broadcast."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenotide.functions.logic import any_of

# A broadcast of this size fits every executor; a row counts with what a hash table adds to it.
MAX_BROADCAST_BYTES = 256 << 20
_ROW, _FIELD = 48, 8
# Zones that a range of positions is measured in at a time.
ZONES = 4096


def table_bytes(df: DataFrame) -> Column:
    """Aggregate: the bytes that rows of ``df`` take in a hash table, one more number per row allowed for."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    return F.sum(sum(texts, F.lit(_ROW + _FIELD * (len(df.columns) + 1)))).cast("long")


class Slice(NamedTuple):
    """Positions ``low`` to ``high`` of a chromosome."""

    chrom: int
    low: int
    high: int


def position_slices(df: DataFrame, limit: int) -> list[tuple[list[Slice], bool]]:
    """Sets of slices of a table with ``chrom`` and ``pos`` that take less than ``limit`` bytes each, in order.

    Every set is measured, not estimated: a table that is too large is measured by zones, and a zone that
    is still too large by zones of its own, down to single positions. One of these above the limit is a set
    of its own, marked False. At most ``ZONES`` numbers a measured range reach the driver.
    """
    measured = df.groupBy("chrom").agg(table_bytes(df).alias("bytes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    pieces = [(Slice(r.chrom, r.low, r.high), r.bytes) for r in measured.where("low IS NOT NULL").collect()]
    while large := [piece for piece, size in pieces if size > limit and piece.low < piece.high]:
        pieces = [x for x in pieces if x[0] not in set(large)] + _by_zone(df, large)
    sets: list[tuple[list[Slice], bool]] = []
    room = -1
    for piece, size in sorted(pieces):
        if size > limit:
            sets.append(([piece], False))
            room = -1
        elif size <= room:
            _append(sets[-1][0], piece)
            room -= size
        else:
            sets.append(([piece], True))
            room = limit - size
    return sets


def _append(pieces: list[Slice], piece: Slice) -> None:
    """Neighbours on a chromosome become one slice."""
    if pieces[-1].chrom == piece.chrom:
        piece = Slice(piece.chrom, pieces.pop().low, piece.high)
    pieces.append(piece)


def _by_zone(df: DataFrame, ranges: list[Slice]) -> list[tuple[Slice, int]]:
    """The occupied zones of ranges with their bytes."""
    found = []
    for chrom, low, high in ranges:
        width = -(-(high - low + 1) // ZONES)
        zone = F.floor((F.col("pos") - low) / width).cast("long")
        inside = df.where((F.col("chrom") == chrom) & F.col("pos").between(low, high))
        for r in inside.groupBy(zone.alias("zone")).agg(table_bytes(df).alias("bytes")).collect():
            first = low + r.zone * width
            found.append((Slice(chrom, first, min(high, first + width - 1)), r.bytes))
    return found


def in_slices(slices: list[Slice]) -> Column:
    """Rows of the slices; reaches a Parquet scan as ranges of ``chrom`` and ``pos``."""
    inside = [(F.col("chrom") == s.chrom) & (F.col("pos") >= s.low) & (F.col("pos") <= s.high) for s in slices]
    return any_of(inside)

"""Combinations of many conditions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from operator import or_

from pyspark.sql import Column


def balanced(combine: Callable[[Column, Column], Column], columns: Iterable[Column]) -> Column:
    """Combine any number of columns in pairs, so that the depth grows with the logarithm of their number."""
    level = list(columns)
    while len(level) > 1:
        pairs = [combine(left, right) for left, right in zip(level[::2], level[1::2])]
        level = pairs + level[len(level) // 2 * 2 :]
    return level[0]


def any_of(conditions: Iterable[Column]) -> Column:
    return balanced(or_, conditions)

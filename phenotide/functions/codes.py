"""Predicates that compare columns with a list of clinical codes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenotide.functions.logic import any_of

# A code of these characters means the same as a regular expression and as a plain text.
_PLAIN = re.compile(r"[A-Za-z0-9_/ -]+")


class Index(Protocol):
    """What turns the patterns for a column into a condition; see ``sources.code_index``."""

    def condition(self, column: str, patterns: Sequence[str]) -> Column: ...


def as_code_list(codes: str | Iterable[str] | None) -> list[str]:
    """``None`` and ``''`` mean no codes; a single text is one code."""
    if not codes:
        return []
    if isinstance(codes, str):
        return [codes]
    return [str(code) for code in codes]


def contains_any(column: Column, patterns: Sequence[str]) -> Column:
    """True where ``column`` contains a match of any of the regular expressions.

    One search, whose time hardly depends on the number of plain codes.
    """
    if not all(_PLAIN.fullmatch(pattern) for pattern in patterns):
        return column.rlike("|".join(patterns))
    return column.rlike(shared_pattern(patterns))


def shortest_prefixes(prefixes: Iterable[str]) -> list[str]:
    """The prefixes that do not begin with another one of them, sorted."""
    kept: list[str] = []
    for prefix in sorted(set(prefixes)):
        if not kept or not prefix.startswith(kept[-1]):
            kept.append(prefix)
    return kept


def shared_pattern(texts: Iterable[str]) -> str:
    """One regular expression for many texts that spells common beginnings once.

    The time to search it hardly depends on the number of texts. A text that begins with another
    one is left out, as the shorter one finds it.
    """
    rests: dict[str, set[str]] = {}
    for text in sorted(set(texts)):
        if not text:
            return ""
        rests.setdefault(text[0], set()).add(text[1:])
    heads = [re.escape(head) for head in rests]
    if all("" in rest for rest in rests.values()):
        return heads[0] if len(heads) == 1 else "[" + "".join(heads) + "]"
    branches = [head + shared_pattern(rest) for head, rest in zip(heads, rests.values())]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def match_column(column: Column, codes: Sequence[str], match: str = "regex") -> Column:
    """True where ``column`` matches any of ``codes``.

    ``regex``   unanchored regular expressions: ``E10`` also hits ``XE109``
    ``exact``   equality; reaches the Parquet scan as an IN filter
    ``prefix``  code and sub-codes, dots in the code ignored; reaches the scan as a prefix filter
    """
    if match == "regex":
        return contains_any(column, codes)
    if match == "exact":
        return column.isin(list(codes))
    if match == "prefix":
        prefixes = shortest_prefixes(code.replace(".", "") for code in codes)
        return any_of(column.startswith(prefix) for prefix in prefixes)
    raise ValueError(f"match must be 'regex', 'exact' or 'prefix', not {match!r}")


def match_codes(columns: Sequence[str], codes: Sequence[str], match: str = "regex", index: Index | None = None) -> Column:
    """True where any of ``columns`` matches any of ``codes``; see ``match_column``.

    With the index of the table's codes, regular expressions become equality filters.
    """
    if index is not None and match == "regex":
        return any_of(index.condition(name, codes) for name in columns)
    return any_of(match_column(F.col(name), codes, match) for name in columns)


def keep_codes(
    df: DataFrame,
    columns: Sequence[str],
    codes: str | Iterable[str] | None,
    match: str = "regex",
    on_empty: str = "all",
    index: Index | None = None,
) -> DataFrame:
    """Rows of ``df`` that match; an empty code list keeps all rows or none (``on_empty``)."""
    codes = as_code_list(codes)
    if codes:
        return df.where(match_codes(columns, codes, match, index))
    return df if on_empty == "all" else df.where(F.lit(False))


def keep_values(df: DataFrame, column: str | None, values: Sequence | None) -> DataFrame:
    """The optional second filter of the readers: ``column`` holds one of ``values``."""
    return df.where(F.col(column).isin(list(values))) if column and values else df

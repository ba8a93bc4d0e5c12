"""Word, symbol and repetition counts of whole texts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenotide.llm.common import ROWS_AT_ONCE, set_aside, text_of

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Words of a window.
WINDOW = 8

_FACTORS = np.random.default_rng(5).integers(1, 2**63, WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window that occurs twice or more."""
    windows = list(zip(*(words[i:] for i in range(window))))
    often = Counter(windows)
    total, end = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + window - max(i, end)
            end = i + window
    return total


def _with_twins(texts: list[list[bytes]]) -> set[int]:
    """Texts that may hold a window twice: those with two equal hashes of windows (and hardly any others)."""
    lengths = np.array([len(x) for x in texts], np.int64)
    if lengths.max(initial=0) <= WINDOW:
        return set()
    hashed = np.fromiter((hash(w) for words in texts for w in words), np.int64, int(lengths.sum())).view(np.uint64)
    hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    n = len(hashed) - WINDOW + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        mixed += (hashed[i : i + n] ^ (hashed[i : i + n] >> np.uint64(32))) * _FACTORS[i]
    owner = np.repeat(np.arange(len(texts)), lengths)
    whole = owner[:n] == owner[WINDOW - 1 :]
    owner = owner[:n][whole].astype(np.uint64)
    mixed = np.sort(mixed[whole] * np.uint64(0x9E3779B97F4A7C15) & np.uint64(0xFFFFFFFFFFFF0000) | owner)
    twins = mixed[1:] == mixed[:-1]
    return set((mixed[1:][twins] & np.uint64(0xFFFF)).tolist())


def _counts(texts: list[str]) -> list[np.ndarray]:
    raw = [x.encode() for x in texts]
    words = [x.split() for x in raw]
    twins = _with_twins(words)
    columns = [np.zeros(len(texts), np.int64) for _ in COUNTS]
    for i, (text, own) in enumerate(zip(raw, words)):
        columns[0][i] = len(own)
        columns[1][i] = len(texts[i]) - (len(text) - len(text.translate(None, SPACES)))
        columns[2][i] = len(text) - len(text.translate(None, SYMBOLS))
        lines = [x for x in text.split(b"\n") if x.strip()]
        columns[3][i] = len(lines) - len(set(lines))
        if i in twins:
            columns[4][i] = repeated_words(own)
    return columns


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in COUNTS]))
def _statistics(column: pa.Array) -> pa.Array:
    parts = []
    for at in range(0, len(column), ROWS_AT_ONCE):
        parts.append(_counts(column.slice(at, ROWS_AT_ONCE).to_pylist()))
    joined = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(x) for x in joined], list(COUNTS))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with the counts of its whole text; a null text counts as empty. Columns of those names are replaced.

    Words are runs between ASCII white space; n_symbols counts characters of #*$%&|<>; n_dup_lines
    lines with a word that equal an earlier line; n_repeat_words words in an eight-word window that
    occurs twice or more.
    """
    rows, back = set_aside(docs, text)
    counted = rows.withColumn("_statistics", _statistics(text_of(text))).select("*", "_statistics.*")
    return back(counted, *COUNTS)

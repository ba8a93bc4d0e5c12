"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has three segments (22, 21 and 21 bits). If two fingerprints differ in at most two
bits, then for one of the cyclic pairs of segments the first is equal and the second differs in at
most one bit. The second, a word of 23 bits, is decoded by the perfect binary Golay code: its keys
are the nearest codeword and, where that is three bits away, the five codewords four bits away. Words
one bit apart share a key. A bucket is a segment and a key of the next; links in it are verified by the bit
distance, and a bucket hands on a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenotide.llm.common import ROWS_AT_ONCE, set_aside, stored, text_of
from phenotide.llm.components import components

SEED = 42
#: Bits of the segments, and the greatest distance for which the keys find every link.
SEGMENTS = (22, 21, 21)
REACH = 2
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the code of 23 bits.
GENERATOR = 0b110001110101
#: Buckets up to this size are compared pair by pair, larger ones by the words near their members.
PAIRWISE = 48
#: Words that are sorted at a time for a larger bucket.
WORDS_AT_ONCE = 4_000_000


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the 23 single bits, and for each remainder the one or six error patterns to the near codewords."""
    single = [_remainder(1 << bit) for bit in range(23)]
    errors: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome, pattern = 0, 0
            for bit in bits:
                syndrome ^= single[bit]
                pattern |= 1 << bit
            own = errors[syndrome]
            if weight < 4 or own[0].bit_count() == 3:
                own.append(pattern)
    counts = np.array([len(x) for x in errors])
    padded = np.array([x + [0] * (6 - len(x)) for x in errors], np.int64)
    return np.array(single, np.int64), counts, padded


_SINGLE, _N_ERRORS, _ERRORS = _tables()


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def _hashes(text: str, width: int) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(x) + 1 for x in words])
    starts = [0, *ends[:-1].tolist()] if len(words) >= width else [0]
    stops = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, stops)]


def _fingerprints(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    each = [np.array(_hashes(x, width), np.uint64) for x in texts]
    full = [i for i, x in enumerate(each) if len(x)]
    if full:
        together = np.concatenate([each[i] for i in full])
        sizes = np.array([len(each[i]) for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        found = np.zeros(len(full), np.uint64)
        for bit in range(64):
            set_ = (together >> np.uint64(bit) & np.uint64(1)).astype(np.int32)
            found |= (2 * np.add.reduceat(set_, starts) > sizes).astype(np.uint64) << np.uint64(bit)
        out[full] = found
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """Every row with fingerprint, a long: the SimHash of its shingles of `width` words; 0 without words (null, empty)."""

    def hashed(column: pa.Array) -> pa.Array:
        parts = [_fingerprints(column.slice(at, ROWS_AT_ONCE).to_pylist(), width) for at in range(0, len(column), ROWS_AT_ONCE)]
        return pa.array(np.concatenate(parts).view(np.int64) if parts else [], pa.int64())

    hashed.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return docs.withColumn("fingerprint", F.arrow_udf(hashed, T.LongType())(text_of(text)))


def hex_of(fingerprint):
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of each fingerprint: offsets, and the keys one after another."""
    own = fingerprints.view(np.uint64)
    at, segments = 0, []
    for bits in SEGMENTS:
        segments.append((own >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    keys, counts = [], []
    for i, exact in enumerate(segments):
        word = segments[(i + 1) % len(segments)]
        syndrome = np.zeros_like(word)
        for bit in range(23):
            syndrome ^= (word >> bit & 1) * _SINGLE[bit]
        codewords = (word[:, None] ^ _ERRORS[syndrome]) >> 11
        keys.append((i << 34 | exact << 12)[:, None] | codewords)
        counts.append(_N_ERRORS[syndrome])
    keys, counts = np.stack(keys, 1), np.stack(counts, 1)
    used = np.arange(6)[None, None, :] < counts[:, :, None]
    return np.concatenate([[0], np.cumsum(counts.sum(axis=1))]), keys[used]


def _keys_column(column: pa.Array) -> pa.Array:
    ends, keys = keys_of(np.asarray(column).astype(np.int64))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.int64()))


def _words_of(own: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions that hang together, in parts of bounded size."""
    if distance == 1:
        order = np.argsort(own)
        for bit in range(64):
            other = own ^ (np.uint64(1) << np.uint64(bit))
            at = np.minimum(np.searchsorted(own, other, sorter=order), len(own) - 1)
            found = np.flatnonzero(own[order[at]] == other)
            yield found, order[at[found]]
    elif distance == 2:
        flips = [np.uint64(0), *(np.uint64(1) << np.uint64(b) for b in range(64))]
        parts = np.uint64(max(1, len(flips) * len(own) // WORDS_AT_ONCE))
        for part in range(int(parts)):
            words, members = [], []
            for flip in flips:
                word = own ^ flip
                mine = np.flatnonzero((word * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % parts == part)
                words.append(word[mine])
                members.append(mine)
            together, at = np.concatenate(words), np.concatenate(members)
            order = np.argsort(together, kind="stable")
            together, at = together[order], at[order]
            same = np.flatnonzero(together[1:] == together[:-1])
            yield at[same], at[same + 1]


def forest(fingerprints: np.ndarray, distance: int = REACH) -> np.ndarray:
    """For each of the distinct fingerprints the position of the first that it hangs together with, over links of at most `distance` bits.

    Two fingerprints differ in at most two bits if and only if some word lies within one bit of both. So
    the words within one bit of the members are sorted, and the members of a word are linked; the work
    grows with the number of members, not of pairs.
    """
    label = np.arange(len(fingerprints))
    for a, b in _words_of(fingerprints.view(np.uint64), distance):
        while True:
            least, old = np.minimum(label[a], label[b]), label.copy()
            np.minimum.at(label, old[a], least)
            np.minimum.at(label, old[b], least)
            label = label[label]
            if (label == old).all():
                break
    return label


def _links(distance: int):
    def of(keys: np.ndarray, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        small = np.repeat(sizes <= PAIRWISE, sizes)
        found = []
        for gap in range(1, min(PAIRWISE, int(sizes.max(initial=1)))):
            at = np.flatnonzero((keys[gap:] == keys[:-gap]) & small[gap:])
            if not len(at):
                break
            near = np.bitwise_count((prints[at] ^ prints[at + gap]).view(np.uint64)) <= distance
            found.append((prints[at + gap][near], prints[at][near]))
        for i in np.flatnonzero(sizes > PAIRWISE).tolist():
            own = prints[starts[i] : starts[i] + sizes[i]]
            label = forest(own, distance)
            at = np.flatnonzero(label != np.arange(len(own)))
            found.append((own[at], own[label[at]]))
        return found

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            found = of(keys, prints)
            columns = [pa.array(np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64)) for i in range(2)]
            return pa.RecordBatch.from_arrays(columns, ["u", "v"])

        for batch in batches:  # sorted; the last bucket may go on in the next batch
            if not batch.num_rows:
                continue
            keys, prints = (np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "fingerprint"))
            cut = int(np.searchsorted(keys, keys[-1]))
            if held and (cut or held[-1][0][-1] != keys[0]):
                whole = [np.concatenate([*(x[i] for x in held), part]) for i, part in enumerate((keys[:cut], prints[:cut]))]
                held = []
                yield out(*whole)
            elif cut:
                yield out(keys[:cut], prints[:cut])
            held.append((keys[cut:], prints[cut:]))
        if held:
            yield out(*(np.concatenate([x[i] for x in held]) for i in range(2)))

    return link


def linked(prints: DataFrame, distance: int = REACH) -> DataFrame:
    """From distinct fingerprints the links (u, v) that hold together those within `distance` bits."""
    if not 0 <= distance <= REACH:
        raise ValueError(f"the keys find distances up to {REACH}")
    keys = F.arrow_udf(_annotated(_keys_column), T.ArrayType(T.LongType()))
    buckets = prints.select(F.explode(keys("fingerprint")).alias("key"), "fingerprint")
    sorted_ = buckets.repartition("key").sortWithinPartitions("key", "fingerprint")
    return sorted_.mapInArrow(_links(distance), "u long, v long")


def _annotated(f):
    f.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return f


def roots(prints: DataFrame, distance: int = REACH) -> DataFrame:
    """From rows with a fingerprint one row for each distinct one with root, the smallest fingerprint of its component."""
    distinct = prints.select("fingerprint").distinct()
    found = components(linked(distinct, distance)).select(F.col("u").alias("fingerprint"), F.col("v").alias("root"))
    return distinct.join(found, "fingerprint", "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"))


def with_component(printed: DataFrame, key: str = "doc_id", distance: int = REACH) -> DataFrame:
    """Every row of a stored table with fingerprints, with component_id: the smallest key in its component, null keys aside.

    Rows link if their fingerprints differ in at most `distance` bits, so copies and repeated rows
    always do. Links are found between distinct fingerprints. component_id is null where a component
    has null keys alone.
    """
    per_print = printed.groupBy("fingerprint").agg(F.min(key).alias("_least"))
    rooted = stored(per_print.join(roots(printed, distance), "fingerprint"), "roots")
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return printed.drop("component_id").join(named, "fingerprint")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = REACH) -> DataFrame:
    """The rows of docs without near copies: of each component the row of the smallest key stays, null keys last.

    Rows of the same key are told apart by their text; of rows equal in both, any one stays.
    """
    apart, back = set_aside(docs, key, text)
    printed = stored(with_fingerprint(apart, text, width), "fingerprints")
    rows = printed.select("fingerprint", F.col(key).alias("_key"), F.xxhash64(text_of(text)).alias("_text"))
    counted = rows.groupBy("fingerprint", "_key", "_text").agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct(F.col("_key").isNull().alias("a"), F.col("_key").alias("b"), F.col("_text").alias("c"), F.col("fingerprint").alias("d"))
    first = counted.join(roots(printed, distance), "fingerprint").groupBy("root").agg(F.min_by(F.struct("fingerprint", "_key", "_text", "_n"), order).alias("_kept"))
    first = stored(first.select("_kept.*"), "kept")
    kept = _matching(printed, first, key, text)
    single = kept.where("_n = 1")
    several = kept.where("_n > 1").dropDuplicates(["fingerprint"])
    return back(single.unionByName(several))


def _matching(printed: DataFrame, first: DataFrame, key: str, text: str) -> DataFrame:
    marked = printed.withColumn("_text", F.xxhash64(text_of(text)))
    right = first.select(F.col("fingerprint").alias("_f"), F.col("_key").alias("_k"), F.col("_text").alias("_t"), "_n")
    match = (F.col("fingerprint") == F.col("_f")) & F.col(key).eqNullSafe(F.col("_k")) & (F.col("_text") == F.col("_t"))
    return marked.join(right, match)

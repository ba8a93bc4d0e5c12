"""Repeated passages by the common-prefix interval trees of enhanced suffix arrays.

Every byte string of `length` bytes has an anchor: the place, within it, of the `gram` bytes with the
smallest hash. Equal strings have equal anchors, so only suffixes that start at anchors are sorted, in
one suffix array per gram; each is held with the bytes before it, as far as the strings reach that
have this anchor. Places whose whole surroundings are equal are one entry. In a gram's array a stack
scan over the common prefixes of neighbours yields the tree of intervals. Entries of an interval
that also agree to the left, so far that the whole is long enough, are scanned by their common
left extensions in the same way: each such interval that cannot be extended further to the left (its
extensions differ) nor to the right (it spans several children) is a maximal repeat, reported with all
its occurrences. Repeats longer than an anchor's surroundings are reported piece by piece, anchor by
anchor; the spans that they cover are then merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenotide.llm.common import set_aside, slices, stored, text_of

LENGTH = 200
GRAM = 48
#: Bytes that are hashed at a time; longer texts are taken in overlapping parts.
PART = 1 << 19
#: Parts that places known to repeat are dealt to, so that a passage of many texts does not meet in one task.
SALTS = 64
#: Entries of a suffix array that one task sorts; more are counted window by window instead.
ENTRIES = 20_000

_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, 2 * PART + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), 2 * PART + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(parts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each run of strings with one anchor: part, first and last start, anchor (places in the part), hash of the gram, hash of the surroundings."""
    buffer = np.frombuffer(b"".join(parts), np.uint8)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_VALUES[buffer] * _UP[: len(buffer)], out=sums[1:])
    n = len(buffer) - gram + 1
    grams = _mix((sums[gram:] - sums[:-gram]) * _DOWN[:n])
    ranked = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)  # the leftmost of equals
    at = (_sliding_least(ranked, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum([len(x) for x in parts])
    part = np.searchsorted(ends, np.arange(len(at)), side="right")
    inside = np.flatnonzero(np.arange(len(at)) + length <= ends[part])
    at, part = at[inside], part[inside]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])])) if len(at) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    low, high, anchor, part = inside[first], inside[last], at[first], part[first]
    shape = (high - low).astype(np.uint64) * np.uint64(1_000_003) + (anchor - low).astype(np.uint64)
    around = _mix((sums[high + length] - sums[low]) * _DOWN[low] + _mix(shape))
    base = (ends - [len(x) for x in parts])[part]
    return part, low - base, high - base, anchor - base, grams[anchor], around


def _salts(grams: np.ndarray, around: np.ndarray) -> np.ndarray:
    """0 for the first two places with the same surroundings; further ones, which repeat for certain, are dealt out from 1 on."""
    order = np.lexsort((around, grams))
    new = np.concatenate([[True], (grams[order][1:] != grams[order][:-1]) | (around[order][1:] != around[order][:-1])])[: len(order)]
    at = np.arange(len(order))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.zeros(len(order), np.int32)
    out[order] = np.where(nth < 2, 0, 1 + at % SALTS)
    return out


def _finder(length: int, gram: int):
    names = ["key", "gram", "around", "salt", "low", "high", "anchor"]

    def emit(held: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        part, low, high, anchor, grams, around = anchors([x[2] for x in held], length, gram)
        base = np.array([x[1] for x in held], np.int64)[part]
        keys = pa.array([x[0] for x in held], pa.binary()).take(pa.array(part))
        places = [pa.array(x + base) for x in (low, high, anchor)]
        salt = pa.array(_salts(grams, around))
        return pa.RecordBatch.from_arrays([keys, pa.array(grams.view(np.int64)), pa.array(around.view(np.int64)), salt, *places], names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        held, size = [], 0
        for batch in slices(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode()
                seen[key] += 1
                if len(raw) < length or seen[key] > 2:  # two copies tell all that more would
                    continue
                for at in range(0, len(raw) - length + 1, PART):
                    held.append((key, at, raw[at : at + PART + length - 1]))
                    size += len(held[-1][2])
                    if size > PART // 2:
                        yield emit(held)
                        held, size = [], 0
        if held:
            yield emit(held)

    return find


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes before and from each wanted anchor."""
    for batch in slices(batches, 64):
        out = [[] for _ in range(6)]
        for key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "wanted"))):
            raw = text.encode()
            for w in wanted:
                for column, value in zip(out, (w["gram"], key, w["anchor"], w["twice"], raw[w["low"] : w["anchor"]], raw[w["anchor"] : w["stop"]])):
                    column.append(value)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["gram", "key", "anchor", "twice", "left", "right"])


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """The inner nodes (common prefix, first, last) of the interval tree over n entries with n - 1 common prefixes of neighbours, by a stack scan."""
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*common, -1]):
        first = i
        while stack and stack[-1][0] > value:
            depth, first = stack.pop()
            yield depth, first, i
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def maximal_repeats(entries: list[tuple[bytes, bytes]], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Bytes before and from the anchor, and the entries, of each maximal repeat of at least `length` bytes among distinct (left, right) entries of one gram."""
    order = sorted(range(len(entries)), key=lambda i: entries[i][1])
    rights = [entries[i][1] for i in order]
    lefts = [entries[i][0][::-1] for i in order]
    prefix = [_common(a, b) for a, b in zip(rights, rights[1:])]
    for depth, first, last in intervals(prefix):
        need = max(0, length - depth)
        classes: dict[bytes, list[int]] = defaultdict(list)
        for i in range(first, last + 1):
            if len(lefts[i]) >= need:
                classes[lefts[i][:need]].append(i)
        child = None
        for members in classes.values():
            if len(members) < 2:
                continue
            if child is None:  # which child of the interval an entry belongs to
                child = np.concatenate([[0], np.cumsum(np.array(prefix[first:last]) == depth)])
            members.sort(key=lefts.__getitem__)
            extension = [_common(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
            for before, p, q in intervals(extension):
                own = members[p : q + 1]
                if len({child[i - first] for i in own}) > 1:
                    yield before, depth, [order[i] for i in own]


def _by_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each gram; they come sorted."""
    held: list[tuple] = []
    for batch in slices(batches, 4096):
        for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "key", "anchor", "twice", "left", "right"))):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _coverer(length: int):
    """Spans that maximal repeats cover, for entries that occur once."""

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        for rows in _by_gram(batches):
            reach: dict[int, list[int]] = {}
            for before, after, members in maximal_repeats([x[4:6] for x in rows], length):
                for i in members:
                    if not rows[i][3]:
                        own = reach.setdefault(i, [0, 0])
                        own[0], own[1] = max(own[0], before), max(own[1], after)
            for i, (before, after) in reach.items():
                for column, value in zip(out, (rows[i][1], rows[i][2] - before, rows[i][2] + after)):
                    column.append(value)
            if len(out[0]) > 10_000:
                yield _spans_batch(out)
                out = [[], [], []]
        yield _spans_batch(out)

    return cover


def _spans_batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.binary(), pa.int64(), pa.int64()))], ["key", "start", "stop"])


def _grouper(length: int):
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_gram(batches):
            out: list[list] = [[] for _ in range(6)]
            found = list(maximal_repeats([x[4:6] for x in rows], length))
            found += [(len(x[4]), len(x[5]), [i]) for i, x in enumerate(rows) if x[3]]
            for number, (before, after, members) in enumerate(found):
                for i in members:
                    for column, value in zip(out, (rows[i][0], number, before, after, rows[i][1], rows[i][2])):
                        column.append(value)
            kinds = (*[pa.int64()] * 4, pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["gram", "number", "before", "after", "key", "anchor"])

    return group


def _windows(length: int):
    """Hashes of each string of `length` bytes around an anchor."""
    import hashlib

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 256):
            out: list[list] = [[], [], [], [], []]
            for key, gram, anchor, left, right in zip(*(rows.column(c).to_pylist() for c in ("key", "gram", "anchor", "left", "right"))):
                raw = left + right
                for at in range(len(raw) - length + 1):
                    digest = hashlib.blake2b(raw[at : at + length], digest_size=16).digest()
                    for column, value in zip(out, (key, gram, anchor, anchor - len(left) + at, digest)):
                        column.append(value)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["key", "gram", "anchor", "start", "digest"])

    return windows


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.unhex(F.md5(text_of(text))).alias("key"), text_of(text).alias("text"))


def _places(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """Anchors whose gram occurs elsewhere: with twice (so do their whole surroundings), first (the entry of equal surroundings) and entries (of the gram)."""
    if not 0 < gram <= length:
        raise ValueError("the gram lies within the length")
    schema = "key binary, gram long, around long, salt int, low long, high long, anchor long"
    found = _keyed(docs, text).mapInArrow(_finder(length, gram), schema).repartition("gram", "salt")
    same = Window.partitionBy("gram", "salt", "around")
    whole = Window.partitionBy("gram", "salt")
    sure = F.col("salt") > 0
    found = found.select(
        "*",
        F.count(F.lit(1)).over(whole).alias("_n"),
        ((F.count(F.lit(1)).over(same) > 1) | sure).alias("twice"),
        ((F.row_number().over(same.orderBy("key", "anchor")) == 1) & ~sure).alias("first"),
    ).where("_n > 1 OR salt > 0")
    entries = F.sum(F.col("first").cast("int")).over(whole).alias("entries")
    return stored(found.select("key", "gram", "around", "low", "high", "anchor", "twice", "first", entries), "places")


def _entries(docs: DataFrame, text: str, places: DataFrame, length: int) -> DataFrame:
    """One row per entry of the given places, with the bytes around the anchor."""
    wanted = F.struct("gram", "anchor", "low", (F.col("high") + length).alias("stop"), "twice")
    per_text = places.where("first").groupBy("key").agg(F.collect_list(wanted).alias("wanted"))
    texts = _keyed(docs, text).dropDuplicates(["key"])
    schema = "gram long, key binary, anchor long, twice boolean, left binary, right binary"
    return texts.join(per_text, "key").select("key", "text", "wanted").mapInArrow(_cut, schema)


def _arrays(entries: DataFrame) -> DataFrame:
    return entries.repartition("gram").sortWithinPartitions("gram", "key", "anchor")


def _spans(docs: DataFrame, text: str, length: int, gram: int, most: int) -> DataFrame:
    """Spans (key, start, stop) of texts that repeats cover; they overlap and repeat."""
    places = _places(docs, text, length, gram)
    known = places.where("twice").select("key", F.col("low").alias("start"), (F.col("high") + length).alias("stop"))
    unsure = places.where("entries > 1")
    arrays = _arrays(_entries(docs, text, unsure.where(F.col("entries") <= most), length))
    spans = known.unionByName(arrays.mapInArrow(_coverer(length), "key binary, start long, stop long"))
    large = unsure.where(F.col("entries") > most)
    if large.isEmpty():
        return spans
    schema = "key binary, gram long, anchor long, start long, digest binary"
    each = _entries(docs, text, large, length).mapInArrow(_windows(length), schema)
    often = each.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("gram", "digest"))).where("_n > 1")
    return spans.unionByName(often.groupBy("key", "anchor").agg(F.min("start").alias("start"), (F.max("start") + length).alias("stop")).drop("anchor"))


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs, and what is left."""
    kept, removed, runs, at = [], 0, 0, 0
    last = -1
    for start, stop in sorted(spans):
        if start > last:
            kept.append(raw[max(at, 0) : start])
            runs += 1
            removed += stop - start
            last = at = stop
        elif stop > last:
            removed += stop - last
            last = at = stop
    kept.append(raw[at:])
    return removed, runs, b"".join(kept)


def _remover(as_text: bool):
    kind = pa.string() if as_text else pa.binary()

    def remove(texts: pa.Array, spans: pa.Array) -> pa.Array:
        sizes, removed, runs, kept = [], [], [], []
        for at in range(0, len(texts), 256):
            for text, own in zip(texts.slice(at, 256).to_pylist(), spans.slice(at, 256).to_pylist()):
                raw = text.encode()
                n, r, left = kept_bytes(raw, [(x["start"], x["stop"]) for x in own]) if own else (0, 0, raw)
                left = left.decode("utf-8", "ignore") if as_text else left
                for column, value in zip((sizes, removed, runs, kept), (len(raw), n, r, left)):
                    column.append(value)
        numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)]
        return pa.StructArray.from_arrays([*numbers, pa.array(kept, kind)], ["n_bytes", "n_removed", "n_spans", "kept"])

    remove.__annotations__ = {"texts": pa.Array, "spans": pa.Array, "return": pa.Array}
    numbers = [T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")]
    return F.arrow_udf(remove, T.StructType([*numbers, T.StructField("kept", T.StringType() if as_text else T.BinaryType())]))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = ENTRIES, as_text: bool = False) -> DataFrame:
    """Every row of docs with removed: n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that are left).

    A byte goes if a string of `length` bytes over it starts anywhere else in the texts, in the same
    one or another, each row being a text of its own; strings are judged on the texts as given. Texts
    are UTF-8 bytes, a null text is empty; shorter texts stay as they are. All copies of a text go, also
    where rows repeat. A column called removed is replaced. With as_text, kept is text
    without the characters that lost some of their bytes.
    """
    spans = _spans(docs, text, length, gram, most).groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))
    rows, back = set_aside(docs, text)
    joined = rows.withColumn("_key", F.unhex(F.md5(text_of(text)))).join(spans.withColumnRenamed("key", "_key"), "_key", "left")
    return back(joined.withColumn("removed", _remover(as_text)(text_of(text), F.col("_spans"))), "removed")


def repeat_groups(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Maximal repeats with all their occurrences: group, n_bytes, text_md5 and start.

    A group is a string of n_bytes bytes; its occurrences are places in distinct texts (text_md5), and
    those of a text that occurs in several rows count for each. Repeats reach as far as the
    surroundings of their anchor. For arrays of any number of entries; one is sorted by one task.
    """
    places = _places(docs, text, length, gram)
    schema = "gram long, number long, before long, after long, key binary, anchor long"
    found = _arrays(_entries(docs, text, places, length)).mapInArrow(_grouper(length), schema)
    first = places.where("first").select("gram", "around", "key", "anchor")
    occurrences = places.select("gram", "around", F.col("key").alias("text_md5"), F.col("anchor").alias("at")).distinct()
    joined = found.join(first, ["gram", "key", "anchor"]).join(occurrences, ["gram", "around"])
    return joined.select(
        F.concat_ws("-", F.hex("gram"), "number").alias("group"),
        (F.col("before") + F.col("after")).alias("n_bytes"),
        F.lower(F.hex("text_md5")).alias("text_md5"),
        (F.col("at") - F.col("before")).alias("start"),
    )

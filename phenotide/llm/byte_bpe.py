"""Byte-level BPE with two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenotide.llm.common import slices, text_of
from phenotide.llm.tokens import REMEMBERED, Remembering, flat, lists, spaced_chunks

#: Keys per bucket of the perfect hash, on average.
BUCKET = 3

#: Patterns that try contractions, then a run of letters, of digits and of other marks, each with a space before it or not.
_WORDS_THEN_MARKS = re.compile(r"(?:'\w+\|)*" + re.escape(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"))
#: A word in letters of Latin-1 and ASCII marks behind it; an apostrophe may begin a contraction.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class PerfectHash:
    """Minimal perfect hash by hashing and displacing: a bucket of keys has the first displacement that sends all to free slots, a lone key any free slot."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.buckets = max(1, len(keys)), max(1, -(-len(keys) // BUCKET))
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[(h >> 32) % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.key_at: list[bytes | None] = [None] * self.n
        taken = bytearray(self.n)
        for bucket in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = [hashes[i] for i in members[bucket]]
            if len(own) < 2:
                break
            d = 0
            while True:
                slots = [self._slot(h, d) for h in own]
                if not any(map(taken.__getitem__, slots)) and len(set(slots)) == len(own):
                    break
                d += 1
            self.shift[bucket] = d
            for i, s in zip(members[bucket], slots):
                taken[s] = 1
                self.key_at[s] = keys[i]
        free = (s for s in range(self.n) if not taken[s])
        for bucket in range(self.buckets):  # a lone key names its slot
            if len(members[bucket]) == 1:
                s = next(free)
                self.shift[bucket] = ~s
                self.key_at[s] = keys[members[bucket][0]]

    def _slot(self, h: int, d: int) -> int:
        return ((h ^ d * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 >> 24 & 0xFFFFFFFFFF) % self.n

    def slot(self, key: bytes) -> int:
        """The slot of the key, or -1 if it is none of the keys."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[(h >> 32) % self.buckets]
        s = ((h ^ d * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 >> 24 & 0xFFFFFFFFFF) % self.n if d >= 0 else ~d  # _slot, without a call
        return s if self.key_at[s] == key else -1


class ByteBpe:
    """Ids of texts by ranks of byte strings, and texts of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self._pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self._hash = PerfectHash(list(ranks))
        self._packed_at = [struct.pack("<I", ranks[k]) if k is not None else b"" for k in self._hash.key_at]
        self._byte_ids = [ranks.get(bytes([b]), -1) for b in range(256)]
        # The rank of two neighbouring parts by their ids: every way to cut an entry into two entries.
        self._joined: list[dict[int, int]] = [{} for _ in range(max(ranks.values(), default=0) + 1)]
        for k, r in ranks.items():
            for i in range(1, len(k)):
                if (left := ranks.get(k[:i])) is not None and (right := ranks.get(k[i:])) is not None:
                    self._joined[left][right] = r
        self._merged = Remembering(self._encode_pieces, REMEMBERED // 8)
        self._bare = Remembering(self._encode_chunks, REMEMBERED // 8)
        self._spaced = Remembering(self._encode_spaced)
        # Whether a word is one match with the space before it, and the marks behind it are another.
        self._plain_words = bool(_WORDS_THEN_MARKS.match(pattern))
        top = max(ranks.values(), default=-1) + 1
        self._bytes = [b""] * top
        for k, i in ranks.items():
            self._bytes[i] = k
        self._lengths = np.array([len(x) for x in self._bytes], np.int64)
        self._starts = np.concatenate([[0], np.cumsum(self._lengths)])
        self._all = np.frombuffer(b"".join(self._bytes), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Join the pair of lowest rank, the leftmost of equals, until no pair has a rank.

        Parts are linked by their starts and hold their ids, which are the ranks of their bytes. The heap
        holds a pair as its rank and start; it is stale unless `now` still has that rank for that start.
        """
        n, joined = len(piece), self._joined
        part = [self._byte_ids[b] for b in piece]
        now = [joined[a].get(b, -1) for a, b in zip(part, part[1:])]
        now.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        shift = n.bit_length()
        start_of = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        while heap:
            top = heap[0]
            i = top & start_of
            r = now[i]
            if top >> shift != r:
                heappop(heap)
                continue
            j = after[i]
            after[i] = k = after[j]
            now[j] = now[i] = -1
            part[i] = r
            q = -1
            if k < n:
                before[k] = i
                q = joined[r].get(part[k], -1)
            if q >= 0:
                now[i] = q
                heapreplace(heap, q << shift | i)
            else:
                heappop(heap)
            if i:
                h = before[i]
                now[h] = q = joined[part[h]].get(r, -1)
                if q >= 0:
                    heappush(heap, q << shift | h)
        out, i = [], 0
        while i < n:
            out.append(part[i])
            i = after[i]
        return out

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces that are no whole entries of the vocabulary."""
        out = []
        for piece in pieces:
            ids = self.merge(piece.encode())
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _encode_words(self, words: set[str], chunks: dict) -> dict[str, bytes]:
        """Words with a space before them, each of them one match. Those that are chunks as well are remembered by the caller."""
        known, slot, new = {}, self._hash.slot, []
        for word in words:
            if (s := slot(b" " + word.encode())) >= 0:
                known[word] = self._packed_at[s]
            elif (ids := self._spaced.met(word)) is not None:
                known[word] = ids
            else:
                new.append(word)
        known.update(zip(new, self._encode_pieces([" " + x for x in new])))
        within = [x for x in new if x not in chunks]
        self._spaced.remember(within, [known[x] for x in within])
        return known

    def _encode_spaced(self, chunks: list[str]) -> list[bytes]:
        """Chunks that follow a space or start with a line break. Words, with or without marks behind them, need no search for matches."""
        out, rest = {}, chunks
        if self._plain_words:
            parts = {x: m.groups() for x in chunks if (m := _WORD.fullmatch(x))}
            words = self._encode_words({word for word, _ in parts.values()}, parts)
            distinct = list({marks for _, marks in parts.values()})
            ends = dict(zip(distinct, self._bare.values(distinct)))
            out = {x: words[word] + ends[marks] for x, (word, marks) in parts.items()}
            rest = [x for x in chunks if x not in out]
        out.update(zip(rest, self._encode_chunks([x if x[:1] == "\n" else " " + x for x in rest])))
        return list(map(out.__getitem__, chunks))

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The matches of all chunks at once: those the hash knows, then those met before, then the others, each distinct one merged once.

        A space and a word is what a chunk in front of a space is encoded as, so it is remembered there.
        """
        split = [self._pattern.findall(x) for x in chunks]
        known, slot, new, words = {}, self._hash.slot, [], []
        for piece in {x for pieces in split for x in pieces}:
            if (s := slot(piece.encode())) >= 0:
                known[piece] = self._packed_at[s]
                continue
            word = piece[0] == " " and piece[1:].isalpha()
            ids = self._spaced.met(piece[1:]) if word else self._merged.met(piece)
            if ids is not None:
                known[piece] = ids
            else:
                (words if word else new).append(piece)
        for pieces, memory, cut in ((words, self._spaced, 1), (new, self._merged, 0)):
            values = self._encode_pieces(pieces)
            memory.remember([x[cut:] for x in pieces], values)
            known.update(zip(pieces, values))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        first, rest = spaced_chunks(text)
        return b"".join(self._bare.values([first])) + b"".join(self._spaced.values(rest))

    def decode(self, ends: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The bytes of each row's ids, gathered at once."""
        lengths = self._lengths[ids]
        stops = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self._starts[ids] - stops[:-1], lengths) + np.arange(stops[-1])
        offsets = stops[ends].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self._all[at].tobytes())])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBpe:
    """One coder per vocabulary file and worker process."""
    return ByteBpe(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Every row of docs with ids, the list of its text's ids; a null text has none.

    path: a file of ranks, found on every executor. Each match of pattern is encoded apart; special
    strings are ordinary text. Other columns pass through; one called ids is replaced.
    """

    def ids_of(column: pa.Array) -> pa.Array:
        own, out = coder(path, pattern), []
        for at in range(0, len(column), 256):
            out.append(lists([own.encode(x) for x in column.slice(at, 256).to_pylist()]))
        return pa.concat_arrays(out) if out else lists([])

    ids_of.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return docs.withColumn("ids", F.arrow_udf(ids_of, T.ArrayType(T.IntegerType()))(text_of(text)))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Every row with decoded, the bytes of its ids; null ids have none."""

    def bytes_of(column: pa.Array) -> pa.Array:
        own, out = coder(path, pattern), []
        for at in range(0, len(column), 256):
            out.append(own.decode(*flat(column.slice(at, 256))))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    bytes_of.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return encoded.withColumn("decoded", F.arrow_udf(bytes_of, T.BinaryType())(F.col(ids)))

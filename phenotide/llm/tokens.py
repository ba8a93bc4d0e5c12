"""Token ids of whole texts by the tokenizers library, each distinct chunk of text encoded once.

A text may be cut before a space between two other visible characters without changing its ids: both
kinds of tokenizers used here start a new pre-token there. A word tokenizer encodes the distinct words of
a few MB of texts at a time, and goes through these texts in small parts, before and after: what it needs besides
their words is that of a part. Of a byte-level one a worker remembers the chunks, so that most are looked up.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from phenotide.llm.common import ROWS_AT_ONCE, slices, slices_of_text

#: Bytes of the chunks that a worker remembers of a kind, with their values, about. Longer chunks are not remembered.
REMEMBERED = 192 << 20
LONGEST = 64
#: What an entry takes besides its characters and its value.
ENTRY = 200

#: What makes a text odd, besides white space at its ends: other white space than spaces and line breaks, and two in a row.
_ODD_ASCII = (*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f", "  ", "\n\n", " \n", "\n ")
_ODD_OTHERS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Words in plain lower-case letters, which are one pre-token each, and how many go to the library at a time.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
WORDS_AT_ONCE = 4096
#: Bytes of the texts that are split into words, or put together from their ids, at a time.
PART = 1 << 20


def _kinds(code_points: int) -> np.ndarray:
    """2: letters and digits, 1: ASCII marks but for the apostrophe, 0: the rest, all that is beyond the code points included."""
    table = np.zeros(256, np.uint8)
    table[[x for x in range(code_points) if chr(x).isalnum()]] = 2
    table[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'"]] = 1
    return table


#: By encoding. A byte of UTF-8 is a character only if it is ASCII.
_KINDS = {"latin-1": _kinds(256), "utf-8": _kinds(128)}

#: Byte-level vocabularies name a byte by its character if that is printable, else by one from 256 on. Spaces stay, between words.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = dict(zip((b for b in range(256) if b not in _PRINTABLE), range(256, 512))) | {32: 32}
_BYTE_NAMES = "".join(chr(_OTHERS.get(b, b)) for b in range(256))


def marks_apart(texts: list[str], encoding: str) -> list[str]:
    """Texts without line breaks, with a space wherever a letter or digit meets an ASCII mark other than an apostrophe.

    A word tokenizer starts a pre-token at each such place anyway, and no normal form joins the two.
    """
    raw = np.frombuffer("\n".join(texts).encode(encoding), np.uint8)
    kind = _KINDS[encoding][raw]
    at = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1
    return np.insert(raw, at, ord(" ")).tobytes().decode(encoding).split("\n")


def spaced_chunks(text: str) -> tuple[str, list[str]]:
    """The first chunk, and the further ones; a further one that does not start with a line break follows a space."""
    if text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _ODD_ASCII) or not text.isascii() and any(x in text for x in _ODD_OTHERS):
        parts = _CUT.split(text)
        return parts[0], parts[1:]
    parts = text.replace("\n", " \n").split(" ")
    return parts[0], parts[1:]


class Remembering:
    """Maps chunks to values and remembers the values of short ones.

    There are two generations, each of half the room. A chunk that is met again moves to the young one; when
    that is full it becomes the old one, and what was not met since goes.
    """

    def __init__(self, compute, room: int = REMEMBERED) -> None:
        self._compute, self._most = compute, room // 2
        self.known: dict[str, object] = {}
        self._before: dict[str, object] = {}
        self._held = 0

    def values(self, chunks: list[str]) -> list:
        """The value of each chunk, in order. No value is None."""
        self._turn()
        known, before = self.known, self._before
        found = list(map(known.get, chunks))
        if None not in found:
            return found
        new = {x for x, value in zip(chunks, found) if value is None}
        made = {x: value for x in new if (value := before.get(x)) is not None} if before else {}
        known.update(made)
        self._held += ENTRY * len(made)
        new.difference_update(made)
        if new:
            short = [x for x in new if len(x) <= LONGEST]
            values = self._compute(short)
            fresh = dict(zip(short, values))
            known.update(fresh)
            made.update(fresh)
            self._held += ENTRY * len(short)
            if values and isinstance(values[0], bytes):
                self._held += sum(map(len, values))
            if len(short) < len(new):
                long = [x for x in new if len(x) > LONGEST]
                made.update(zip(long, self._compute(long)))
        return [made[x] if value is None else value for x, value in zip(chunks, found)]

    def _turn(self) -> None:
        if self._held > self._most:
            self._before, self.known, self._held = self.known, {}, 0

    def met(self, chunk: str):
        """The value of a chunk, None if it is not remembered."""
        value = self.known.get(chunk)
        return self._before.get(chunk) if value is None else value

    def remember(self, chunks: list[str], values: list) -> None:
        """Values that were computed elsewhere."""
        self._turn()
        self.known.update((x, v) for x, v in zip(chunks, values) if len(x) <= LONGEST)
        self._held += ENTRY * len(chunks)


class Tokenizer:
    """Ids of whole texts as the library gives them, without special tokens at the ends.

    drops_space: white space makes no tokens and separates pre-tokens (word tokenizers); otherwise the
    tokenizer is byte-level and a space belongs to the word after it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self._library = Library.from_file(path)
        self.drops_space = self._library.model.end_of_word_suffix is not None
        self.normalizer = self._library.normalizer
        added = [x.content for x in self._library.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._bare = Remembering(self._whole)
        self._spaced = Remembering(lambda chunks: self._whole([x if x[:1] == "\n" else " " + x for x in chunks]))
        if self.drops_space:
            self._words = Library(self._library.model)
            self._words.pre_tokenizer = WhitespaceSplit()
            vocabulary = self._words.get_vocab()
            self._is_end = np.zeros(1 + max(vocabulary.values()), bool)
            self._is_end[[i for token, i in vocabulary.items() if token.endswith(self._library.model.end_of_word_suffix)]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self._library.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def _plain_ids(self, words: list[str]) -> pa.ListArray:
        """Ids of words that are one pre-token: the library's model takes many at once, the token at a word's end says so."""
        named = codecs.charmap_decode(" ".join(words).encode(), "strict", _BYTE_NAMES)[0]
        ids = np.array(self._words.encode_batch_fast([named], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self._is_end[ids]) + 1
        if len(ends) != len(words):  # characters that the vocabulary lacks
            return lists(self._whole(words))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))

    def _distinct_ids(self, words: list[str]) -> tuple[pa.ListArray, np.ndarray]:
        """Ids of different words, and the row of each word among them."""
        plain = [i for i, x in enumerate(words) if x.isalpha() and _PLAIN.fullmatch(x)]
        others = np.ones(len(words), bool)
        others[plain] = False
        others = np.flatnonzero(others).tolist()
        parts = [self._plain_ids([words[i] for i in plain[at : at + WORDS_AT_ONCE]]) for at in range(0, len(plain), WORDS_AT_ONCE)]
        parts += [lists(self._whole([words[i] for i in others[at : at + WORDS_AT_ONCE]])) for at in range(0, len(others), WORDS_AT_ONCE)]
        row = np.empty(len(words), np.int64)
        row[plain + others] = np.arange(len(words))
        return pa.concat_arrays(parts), row

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.packed_all([text])[0]

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """packed of each text."""
        return list(chain.from_iterable(self.packed_parts(pa.array(texts, pa.large_string()))))

    def packed_parts(self, column: pa.Array) -> Iterator[list[bytes]]:
        """packed of each text of a column without nulls, in order, for a part of the texts at a time.

        A word tokenizer encodes each distinct word of the whole column once.
        """
        parts = [x.column(0) for x in slices_of_text([pa.RecordBatch.from_arrays([column], ["_text"])], most=PART)]
        if self.drops_space:
            yield from self._by_words(parts)
            return
        for part in parts:
            yield [self._whole([x])[0] if self._added is not None and self._added.search(x) else self._by_chunks(x) for x in part.to_pylist()]

    def _by_chunks(self, text: str) -> bytes:
        first, rest = spaced_chunks(text)
        return b"".join(self._bare.values([first])) + b"".join(self._spaced.values(rest))

    def _split(self, texts: list[str]) -> tuple[list[int], np.ndarray, pa.DictionaryArray]:
        """The texts that words can be encoded of, by their places, where the words of each begin and end, and all words.

        The others have an added token in them, or what would become one.
        """
        rows: dict[str, list[int]] = {x: [] for x in _KINDS}
        spread: dict[str, list[str]] = {x: [] for x in _KINDS}
        for i, text in enumerate(texts):
            lowered, encoding = text, "utf-8"
            try:
                text.encode("latin-1")
                lowered, encoding = text.lower(), "latin-1"  # here as the library does, which puts upper case into lower case itself
            except UnicodeEncodeError:
                pass
            if self._added is None or not self._added.search(lowered):
                rows[encoding].append(i)
                spread[encoding].append(lowered.replace("\n", " "))
        apart = [x for encoding, own in spread.items() if own for x in marks_apart(own, encoding)]
        words = pc.split_pattern(pa.array(apart, pa.large_string()), " ")
        return [i for own in rows.values() for i in own], words.offsets.to_numpy(), words.flatten().dictionary_encode()

    def _by_words(self, parts: list[pa.Array]) -> Iterator[list[bytes]]:
        split = [self._split(x.to_pylist()) for x in parts]
        words = pa.chunked_array([coded for _, _, coded in split], pa.dictionary(pa.int32(), pa.large_string())).unify_dictionaries()
        split = [(at, ends, coded.indices) for (at, ends, _), coded in zip(split, words.chunks)]
        known = words.chunk(0).dictionary if split else []
        del words
        if len(known):
            distinct = pa.ListArray.from_arrays([0, len(known)], known)
            ids, row = self._distinct_ids(pc.binary_join(distinct, pa.scalar(" ", pa.large_string()))[0].as_py().split(" "))
        for part, (at, ends, indices) in zip(parts, split):
            out: list[bytes | None] = [None] * len(part)
            if at:
                ends_of_words, found = flat(ids.take(pa.array(row[indices.to_numpy()])))
                ends = ends_of_words[ends].tolist()
                for i, start, end in zip(at, ends, ends[1:]):
                    out[i] = found[start:end].tobytes()
            yield [self._whole([part[i].as_py()])[0] if x is None else x for i, x in enumerate(out)]

    def normal_form(self, text: str) -> str:
        """What the normaliser makes of a text, if that has the same tokens; see token_counts.normal_form."""
        made = self.normalizer.normalize_str(text)
        if self._added is not None and (self._added.search(text) or self._added.search(made)):
            return text
        return made if self.normalizer.normalize_str(made) == made else text

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer per file and worker process."""
    return Tokenizer(path)


def encoded_slices(batches: Iterator[pa.RecordBatch], path: str, rows: int = ROWS_AT_ONCE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A few rows at a time, with the ids of their texts; words are encoded once for many rows."""
    for texts in slices_of_text(batches):
        at = 0
        for part in tokenizer(path).packed_parts(texts.column("_text")):
            encoded = iter(part)
            for batch in slices([texts.slice(at, len(part))], rows):
                yield batch, list(islice(encoded, batch.num_rows))
            at += len(part)


def lists(packed: list[bytes]) -> pa.ListArray:
    """Packed ids as a column of integer lists."""
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ends and values of a list column (nulls: empty): offsets of n + 1 rows, and all ids."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), np.asarray(column.flatten())

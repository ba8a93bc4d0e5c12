"""Chunked encoding and the two-tier coder against the libraries."""

import random
import tracemalloc
from functools import cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from phenotide.llm import packing, token_files, tokens
from phenotide.llm.byte_bpe import ByteBpe, PerfectHash, coder, read_ranks
from phenotide.llm.tokens import ENTRY, Remembering, Tokenizer, tokenizer

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "The", "don't", "we'll", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "​", ".", "...", ",", "'s", "'S", "é", "é", "Über", "ß", "ΣΑΣ", "12", "3", "½", "日本", "🙂", "_", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|StartofText|>x", "<|endoftext", "|>", "heonanin", "THERE!!", "﻿", "İ"]
mixed = st.lists(st.sampled_from(PIECES) | st.text(max_size=4), max_size=30).map("".join)


@cache
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(MULTI), special_tokens={})


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return {name: Tokenizer.from_file(P.path(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=150, deadline=None)
@given(text=mixed)
def test_ids_equal_the_librarys_on_the_whole_text(reference, name, text):
    assert tokenizer(P.path(name)).ids(text).tolist() == reference[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=100, deadline=None)
@given(texts=st.lists(mixed | st.text("aZé'\u2019,.=_-3²ªµ«\u0301\u0338 \n", max_size=12), max_size=6))
def test_ids_of_many_texts_equal_the_librarys(reference, name, texts):
    found = [np.frombuffer(x, "<u4").tolist() for x in tokenizer(P.path(name)).packed_all(texts)]
    assert found == [reference[name].encode(x, add_special_tokens=False).ids for x in texts]


def test_words_of_many_texts_are_encoded_once(monkeypatch):
    own, met = Tokenizer(P.path("word_bpe_49k.json")), []
    monkeypatch.setattr(own, "_plain_ids", lambda words, f=own._plain_ids: met.extend(words) or f(words))
    texts = ["Qwzu, qwzu (qwzu) blé...", "blé qwzu; blé!", "“qwzu” QWZU. naïve\nqwzu"]
    assert [len(x) > 0 for x in own.packed_all(texts)] == [True] * 3
    assert sorted(x for x in met if x == "qwzu" or x == "blé") == ["blé", "qwzu"]


def test_words_are_encoded_once_across_parts(reference, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 20)
    own, met = Tokenizer(P.path("word_bpe_49k.json")), []
    monkeypatch.setattr(own, "_plain_ids", lambda words, f=own._plain_ids: met.extend(words) or f(words))
    texts = ["qwzu " * 9, "", "<|endoftext|> qwzu", "日 qwzu, blé", "Blé", "", "qwzu!\nqwzu"]
    parts = list(own.packed_parts(pa.array(texts)))
    assert len(parts) > 2 and sorted(met) == sorted({*met}) and "qwzu" in met
    found = [np.frombuffer(x, "<u4").tolist() for part in parts for x in part]
    assert found == [reference["word_bpe_49k.json"].encode(x, add_special_tokens=False).ids for x in texts]
    assert list(own.packed_parts(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("encode", ["packing", "token_files"])
def test_encoding_many_texts_takes_little_more_than_the_texts(encode):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([0] * 2000), pa.array([" ".join(rng.choices(words, k=600)) for _ in range(2000)])], ["_key", "_shard", "_text"])
    path = P.path("word_bpe_49k.json")
    run = packing._cutter(path, 1, 2048, pa.int64()) if encode == "packing" else token_files._encoder(path, 1)
    list(run(iter([batch.slice(0, 2)])))  # the tokenizer stays
    tracemalloc.start()
    try:
        assert sum(x.num_rows for x in run(iter([batch]))) >= 2000
        assert tracemalloc.get_traced_memory()[1] < 3 * batch.column("_text").nbytes
    finally:
        tracemalloc.stop()


def test_a_vocabulary_that_lacks_characters_is_asked_word_by_word():
    from tokenizers import Tokenizer as Library

    own = Tokenizer(P.path("word_bpe_49k.json"))
    own._is_end = np.zeros_like(own._is_end)  # no word ends are found
    text = "plain words, and more words"
    assert own.ids(text).tolist() == Library.from_file(P.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(text=mixed)
def test_two_tier_ids_equal_the_librarys_and_decode_to_the_text(text):
    own = coder(MULTI, P.PATTERN)
    ids = np.frombuffer(own.encode(text), "<u4")
    assert ids.tolist() == library().encode_ordinary(text)
    assert own.decode(np.array([0, len(ids)]), ids).to_pylist() == [text.encode()]


def test_very_long_pre_token():
    text = "".join(random.Random(4).choices("abcdeéß", k=30_000))
    assert np.frombuffer(coder(MULTI, P.PATTERN).encode(text), "<u4").tolist() == library().encode_ordinary(text)


def test_words_with_marks_behind_them_need_no_search_for_matches():
    own = ByteBpe(read_ranks(MULTI), P.PATTERN)
    searched = []
    own._pattern = type("Counting", (), {"findall": lambda self, x, f=own._pattern.findall: searched.append(x) or f(x)})()
    text = "Start qwzürk, qwzürk qwzürk!! ÀÉx_ a`b| Zzqwx... don't 'tis x'"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library().encode_ordinary(text)
    assert not any("qw" in x for x in searched)
    assert own._spaced.met("qwzürk") and " don't" in searched


@settings(max_examples=60, deadline=None)
@given(text=mixed)
def test_other_patterns_are_searched_for(text):
    pattern = r" ?\p{L}{1,3}|'s| ?\p{N}+| ?[^\s\p{L}\p{N}]|\s+(?!\S)|\s+"
    made = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(MULTI), special_tokens={})
    assert np.frombuffer(coder(MULTI, pattern).encode(text), "<u4").tolist() == made.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(chunks=st.lists(st.lists(st.sampled_from(["a", "b", "c" * 100, "d" * 70, "", "e", "f"]), max_size=8), max_size=12))
def test_remembered_values_are_those_computed(chunks):
    memory = Remembering(lambda new: [x.encode() * 2 for x in new], 4 * ENTRY)  # so small that words are forgotten
    for own in chunks:
        assert list(memory.values(own)) == [x.encode() * 2 for x in own]


def test_perfect_hash_is_minimal_and_knows_its_keys():
    keys = [f"k{i}".encode() for i in range(5000)]
    found = PerfectHash(keys)
    assert sorted(found.slot(k) for k in keys) == list(range(5000))
    assert found.slot(b"none") == -1
    assert PerfectHash([]).slot(b"x") == -1


@pytest.mark.parametrize("text", ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "É <|Startoftext|>É", "日 <|ENDOFTEXT|>", "<|endoftext|> <|ENDOFTEXT|>"])
def test_special_strings_in_capitals_are_text(reference, text):
    for name, library_ in reference.items():
        assert tokenizer(P.path(name)).ids(text).tolist() == library_.encode(text, add_special_tokens=False).ids


def test_remembering_keeps_to_its_room_and_what_is_met_again():
    computed = []

    def compute(chunks):
        computed.extend(chunks)
        return [x.encode() for x in chunks]

    own = Remembering(compute, room=40 * (ENTRY + 4))
    for i in range(300):
        assert list(own.values(["often", f"w{i}", "often", "x" * 100])) == [b"often", f"w{i}".encode(), b"often", b"x" * 100]
        assert len(own.known) + len(own._before) <= 42
    assert computed.count("often") == 1 and computed.count("w7") == 1

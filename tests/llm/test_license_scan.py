"""License scans against plain matching of word lists, and the rules on real sentences."""

import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from phenotide.llm import license_scan as L
from phenotide.llm import queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    words, places = plain_words(text), []
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def brute_labels(text):
    """Every rule on every text, and every pair of detections compared."""
    words = [w.encode() for w in plain_words(text)]
    found = L.detect(words, range(len(L.rules())))

    def suppressed(d):
        for e in found:
            if e is not d and e.start <= d.start and e.stop >= d.stop:
                same = (e.start, e.stop) == (d.start, d.stop)
                if e.rule.tier < d.rule.tier or e.rule.tier == d.rule.tier and (not same or e.order < d.order):
                    return True
        return False

    return {d for d in found if not suppressed(d)}


PIECES = ["GNU General Public License", "version 3", "or later", "Apache License, Version 2.0", "CC-BY", "CC BY-SA 4.0", "cc", "by", "MIT License", "the", "licensed under the", "SPDX-License-Identifier:", "GPL-3.0-or-later", "public domain", "All rights reserved.", "ünï", "https://www.gnu.org/licenses/gpl-3.0.html", "Creative Commons Attribution-ShareAlike 4.0", "MIT", "license", "GNU Lesser General Public License version 2.1", "\n", "_", "x"]


@pytest.mark.parametrize("seed", range(60))
def test_scan_equals_brute_force(seed):
    rng = random.Random(seed)
    text = " ".join(rng.choices(PIECES, k=rng.randrange(0, 40)))
    n_words, n_base, first, last, base, labels, score, spans = L.scan(text)
    assert (n_words, n_base, first, last, base) == brute_base(text)
    kept = brute_labels(text)
    assert set(L.keep(L.detect(L.words_of(text)))) == kept
    assert set(filter(None, labels.split(","))) == {d.rule.label for d in kept} | set(filter(None, base.split(",")))
    assert 0 <= score <= 1 and (score > 0) == bool(labels) and len(spans) == len(kept)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published", "gpl"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
        ("released under the Mozilla Public License 2.0", "mpl"),
        ("see https://creativecommons.org/licenses/by-nc-sa/3.0/", "cc-by-nc-sa-3.0"),
        ("This is free and unencumbered software released into the public domain.", "public-domain"),
        ("GNU Lesser General Public License", "lgpl"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided", "bsd"),
        ("The Unlicense", "unlicense"),
    ],
)
def test_labels(text, label):
    assert label in L.scan(text)[5].split(",")


def test_a_contained_detection_of_a_lower_tier_goes():
    labels = [s["label"] for s in L.scan("licensed under the GNU Lesser General Public License version 2.1")[7]]
    assert labels == ["lgpl"]


def test_plain_prose_has_no_label():
    assert L.scan("We went by the river, and the cc of the letter was by the door. It may rain for days.")[1:6] == (0, None, None, "", "")


def test_hundreds_of_rules_each_with_words_that_its_matches_contain():
    assert len(L.rules()) > 300 and all(rule.words and all(rule.words) for rule in L.rules())
    own = L.program()
    for i, rule in enumerate(own.rules):  # a gate may not name a word that the pattern does not hold
        for group in rule.words:
            assert any(w in rule.pattern or w.rstrip("0123456789") in rule.pattern or w[:4] in rule.pattern for w in group), rule
    for text in (L.LICENSES, L.NOTICES, L.ADDRESSES, L.NAMES, L.HINTS):
        assert all(len(line.split("|")) >= 3 for line in text.strip().splitlines())


ROWS = [(1, "MIT License"), (2, None), (None, ""), (3, "x " * 50_000 + "CC BY " * 3000), (1, "MIT License"), (4, "\x00日本 cc  by")]


@pytest.mark.parametrize("rows", [ROWS, []], ids=["rows", "none"])
def test_awkward_rows_and_clashing_columns(spark, rows):
    docs = spark.createDataFrame([(*r, "own", 7) for r in rows], "doc_id long, text string, labels string, n_words int")
    found = L.with_licenses(docs)
    assert found.columns == ["doc_id", "text", "labels", "n_words", "licenses"]
    got = Counter((r.doc_id, r.labels, r.n_words, *[r.licenses[c] for c in L.RESULT.names[:5]]) for r in found.collect())
    assert got == Counter((i, "own", 7, *brute_base(t)) for i, t in rows)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    df = queries.registered()["op12_license_scan"](spark, folder)
    assert dict(df.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
    rows = df.collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter((d["doc_id"], *brute_base(d["text"])) for d in docs)
    by = {d["doc_id"]: d["text"] for d in docs}
    for r in rows:
        base = {x for x in r.base_labels.split(",") if x}
        assert {x for x in r.labels.split(",") if x} == base | {d.rule.label for d in brute_labels(by[r.doc_id])}
        assert 0 <= r.score <= 1 and r.labels == ",".join(sorted(set(r.labels.split(","))))
    assert any(r.n_base for r in rows)

"""Pieces against one pass over the whole text, templates against regular expressions."""

from __future__ import annotations

import random
import re

import pytest
from lodestone.llm import licenses, pieces
from lodestone.llm.queries import _template_rx

TEXTS = [None, "", " ", "a", "  two  spaces ", "Hello world", "ünïcödé \U0001f600 text", "x" * 300, "word and another " * 40, "tab\tand\nline", " lead"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.read_vocabulary()


@pytest.mark.parametrize("chunk", [8, 64, pieces.CHUNK])
def test_chunks_give_the_pieces_of_the_whole(spark, vocabulary, chunk):
    docs = spark.createDataFrame([(n, t, 1) for n, t in enumerate(TEXTS)] * 2, "doc_id long, text string, k int")
    got = pieces.decode(pieces.encode(docs, vocabulary, chunk=chunk), vocabulary).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        assert r.piece_ids == (None if r.text is None else pieces.encode_text(r.text, vocabulary)), (chunk, r.text)
        assert r.decoded == r.text


def test_the_best_segmentation_is_found():
    v = pieces.Vocabulary({"▁": (0, -1.0), "a": (1, -2.0), "b": (2, -2.0), "ab": (3, -3.5), "▁a": (4, -1.5), "bab": (5, -2.5)}, {}, ["▁", "a", "b", "ab", "▁a", "bab"], 9)
    best = {}

    def score(rest):
        if not rest:
            return 0.0
        if rest not in best:
            best[rest] = max(s + score(rest[len(p) :]) for p, (_, s) in v.pieces.items() if rest.startswith(p))
        return best[rest]

    for text in ("ab", "abab", "a b ab", "babab ab"):
        ids = pieces.encode_text(text, v)
        assert "".join(v.names[i] for i in ids) == pieces.normalise(text)
        assert sum(v.pieces[v.names[i]][1] for i in ids) == pytest.approx(score(pieces.normalise(text)))


def test_ids_are_those_of_sentencepiece(spark, vocabulary):
    import sentencepiece
    from lodestone.llm.common import table

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(5)
    odd = ["".join(rng.choices("  abcdetheringo\u2581\n\x00é文字梦日本хо\U0001f600ﬁ=-_/#01", k=rng.randrange(1, 90))) for _ in range(300)]
    odd += [c * n for c in "a =-_梦0" for n in (2, 33, 3000)] + ["and pour", "https://www.example.com/a_long/path?query=internationalization" * 20]
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    for chunk in (64, pieces.CHUNK):
        for r in pieces.encode(docs, vocabulary, chunk=chunk).collect():
            assert r.piece_ids == (None if r.text is None else model.encode(r.text)), (chunk, r.text)


@pytest.mark.parametrize("chunk", [8, 64])
def test_chunks_of_a_unigram_vocabulary(spark, chunk):
    names = ["▁", "a", "b", "ab", "▁a", "bab", "d▁w"]
    scores = [-1.03, -2.11, -2.27, -3.59, -1.71, -2.83, -4.19]  # no two ways tie
    v = pieces.Vocabulary({p: (n, scores[n]) for n, p in enumerate(names)}, {}, [*names, "<unk>"], len(names))
    docs = spark.createDataFrame([(t,) for t in TEXTS + ["ab" * 50, "abab bab a" * 20]], "text string")
    for r in pieces.encode(docs, v, chunk=chunk).collect():
        assert r.piece_ids == (None if r.text is None else pieces.encode_text(r.text, v)), r.text


def chunked(text: str, size: int, v) -> list[pieces.Chunk]:
    whole, reach = pieces.normalise(text), v.longest
    m = -(-len(whole) // size)
    return [pieces.Chunk(whole[max(0, k * size - reach) : (k + 1) * size + reach], min(reach, k * size), min(size, len(whole) - k * size), k, m) for k in range(m)]


def test_matrices_combine_in_any_grouping(vocabulary):
    rng = random.Random(8)
    for text in ("internationalisation" * 9, "".join(rng.choices("etaoin shrdlu\n", k=300)), "=" * 170, "梦日a" * 40):
        chunks = chunked(text, 16, vocabulary)
        matrices = [pieces.transfer_matrix(c, vocabulary) for c in chunks]
        cut = rng.randrange(1, len(matrices))
        ends = [pieces.product(x) for x in (matrices, [pieces.product(matrices[:cut]), pieces.product(matrices[cut:])])]
        assert ends[0][:2] == ends[1][:2] and (ends[0][2] == ends[1][2]).all()
        assert (ends[0][2] > pieces.LOW).sum() == 1, "one path is left"
        ways = pieces.route(matrices, 0, None)
        assert all(a[1] == b[0] for a, b in zip(ways, ways[1:]))
        assert [i for ids in pieces.chunk_ids(chunks, ways, vocabulary) for i in ids.tolist()] == pieces.encode_text(text, vocabulary)


def test_empty_tables_clashing_columns_and_odd_ids(spark, vocabulary):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decode(pieces.encode(none, vocabulary), vocabulary).columns == ["doc_id", "text", "piece_ids", "decoded"]
    assert pieces.encode(none, vocabulary).count() == 0
    odd = spark.createDataFrame([("a b " * 60, 1, 2, [3]), (None, 3, 4, None)], "text string, piece_row int, row int, piece_ids array<int>")
    got = pieces.encode(odd, vocabulary, chunk=32).orderBy("piece_row").collect()
    assert [(r.piece_row, r.row, r.piece_ids) for r in got] == [(1, 2, pieces.encode_text("a b " * 60, vocabulary)), (3, 4, None)]
    ids = spark.createDataFrame([([None, 3 + 0xE2, vocabulary.pieces["\u2581"][0], 3 + 0x41],), ([],), (None,)], "piece_ids array<int>")
    assert [r.decoded for r in pieces.decode(ids, vocabulary).collect()] == ["\ufffd A", "", None]


NOTICES = [
    "", "Licensed under the Apache License, Version 2.0 (the License)", "licensed under the apache license 3", "This code is released under the terms of the MIT License.", "under the MIT license! UNDER the mit, license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software) to deal in the Software without restriction",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 2 of the License or at your option any other version",
    "licensed under a Creative Commons Attribution 4 0 International License", "under cc-by-nc sa 4 0 license", "no notice", "licensed under the gnu general public license version 3 or at your option any later version",
]


def test_templates_accept_what_their_expressions_match():
    for text in NOTICES:
        words = licenses.WORD.findall(text.lower())
        want = {label for label, t in licenses.TEMPLATES if re.search(_template_rx(t), f" {' '.join(words)} ")}
        assert {label for _, _, label in licenses.template_spans(words)} == want, text


def test_scan_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, NOTICES[4]), (3, NOTICES[4])]
    got = [r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [(x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in got] == [(0, 0, None, None, ""), (0, 0, None, None, ""), (8, 2, 0, 4, "mit"), (8, 2, 0, 4, "mit")]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_template_accepts_its_own_wording_and_long_texts_are_read_whole(spark):
    for label, markup in licenses.TEMPLATES:
        words = re.sub(r"<<any \d+>>|<<optional>>.*?<</optional>>", " ", markup).split()
        assert label in {x for _, _, x in licenses.template_spans(words)}, markup
        broken = [w for i, w in enumerate(words) if i != len(words) // 2]
        assert len(broken) < 3 or (0, len(broken), label) not in licenses.template_spans(broken)
    text = "filler " * 200_000 + "Licensed under the Apache License, Version 2.0"
    (r,) = licenses.scan(spark.createDataFrame([(text, 1)], "text string, license int")).collect()
    assert (r.license.n_words, r.license.first_word, r.license.labels) == (200_008, 200_003, "apache-2")

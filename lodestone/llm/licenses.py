"""License scans: phrases, and templates whose markup is compiled to token automata.

A template is plain text with two kinds of markup.  <<optional>> ... <</optional>> may be there or not, and
<<any N>> stands for up to N words of any kind.  All other words are mandatory and must match exactly, one after
another.  A template compiles to an automaton over words; a text is accepted where a run of its words leads from
the start to the end.  Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z, so
punctuation, spacing and letter case never decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words, and phrases with the label that each gives.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Markup templates of well-known notices, by label.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>>the software<</optional>> to deal in the software without restriction"),
    ("mit", "<<optional>>this <<any 4>> is<</optional>> <<optional>>licensed<</optional>> <<optional>>released<</optional>> <<optional>>distributed<</optional>> under the <<optional>>terms of the<</optional>> mit license"),
    ("apache-2", "licensed under the apache license <<optional>>version<</optional>> 2 <<optional>>0<</optional>> <<optional>>the license<</optional>>"),
    ("cc-by-nc", "<<optional>>licensed<</optional>> under <<optional>>the<</optional>> <<optional>>a<</optional>> cc by nc <<optional>>sa<</optional>> <<optional>>nd<</optional>> <<any 2>> <<optional>>license<</optional>>"),
    ("cc-by-nc", "creative commons attribution noncommercial <<any 3>> license"),
    ("cc-by", "licensed under <<optional>>the<</optional>> <<optional>>a<</optional>> creative commons attribution <<any 2>> international license"),
    ("gpl-3", "licensed under the gnu general public license <<optional>>as published by the free software foundation either<</optional>> version 3 <<optional>>or <<any 6>> later version<</optional>>"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or <<optional>>at your option<</optional>> any later version"),
    ("gpl-2", "licensed under the gnu general public license <<optional>>as published by the free software foundation either<</optional>> version 2 <<optional>>or <<any 6>> later version<</optional>>"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "permission to use copy modify and <<optional>>or<</optional>> distribute this software <<optional>>and its documentation<</optional>> for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1<</optional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>>2<</optional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "<<optional>>3<</optional>> neither the name of <<any 12>> nor the names of <<any 2>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<any 8>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "is free software you can redistribute it and or modify it under the terms of the gnu <<optional>>library<</optional>> <<optional>>lesser<</optional>> general public license as published by the free software foundation either version <<any 2>> of the license or at your option any later version"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or <<optional>>at your option<</optional>> any later version"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc0", "to the extent possible under law <<any 12>> has waived all copyright and related or neighboring rights to <<any 8>> <<optional>>this work is published from<</optional>>"),
    ("cc-by-sa", "licensed under <<optional>>the<</optional>> <<optional>>a<</optional>> creative commons attribution sharealike <<any 2>> international license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license <<optional>>v<</optional>> <<any 2>> which accompanies this distribution"),
)


@dataclass(frozen=True)
class Automaton:
    """From each state: steps on a word, steps on any word, free steps.  The last state accepts."""

    on_word: tuple[dict[str, tuple[int, ...]], ...]
    on_any: tuple[tuple[int, ...], ...]
    free: tuple[tuple[int, ...], ...]
    first_words: frozenset[str]
    #: A word that every accepted text holds.
    anchor: str

    def closure(self, states) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def longest(self, words: list[str], start: int) -> int | None:
        """The end of the longest accepted run of words from start."""
        states, end, at = self.closure((0,)), None, start
        accept = len(self.on_word) - 1
        while states:
            if accept in states:
                end = at
            if at == len(words):
                break
            step = {t for s in states for t in (*self.on_word[s].get(words[at], ()), *self.on_any[s])}
            states, at = self.closure(step), at + 1
        return end


def compile_template(markup: str) -> Automaton:
    on_word, on_any, free, open_at, mandatory = [{}], [[]], [[]], [], []

    def state() -> int:
        on_word.append({})
        on_any.append([])
        free.append([])
        return len(on_word) - 1

    for token in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
        here = len(on_word) - 1
        if token == "<<optional>>":
            open_at.append(here)
        elif token == "<</optional>>":
            free[open_at.pop()].append(here)
        elif m := re.fullmatch(r"<<any (\d+)>>", token):
            states = [here, *(state() for _ in range(int(m[1])))]
            for a, b in zip(states, states[1:]):
                on_any[a].append(b)
                free[a].append(states[-1]) if a != states[-1] else None
        else:
            to = state()
            on_word[here].setdefault(token, []).append(to)
            if not open_at:
                mandatory.append(token)
    made = Automaton(tuple({w: tuple(t) for w, t in x.items()} for x in on_word), tuple(map(tuple, on_any)), tuple(map(tuple, free)), frozenset(), "")
    firsts = frozenset(w for s in made.closure((0,)) for w in made.on_word[s])
    return Automaton(made.on_word, made.on_any, made.free, firsts, max(mandatory, key=len))


@cache
def automata() -> tuple[tuple[str, Automaton], ...]:
    return tuple((label, compile_template(t)) for label, t in TEMPLATES)


_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD_BYTE = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _WORD_BYTE[_a:_b] = True
_PHRASE_WORDS = tuple((p.split(), label) for p, label in PHRASES.items())


def count_words(text: str) -> int:
    """Words of a text: starts of runs of word bytes, since all bytes of non-ASCII characters are word bytes."""
    inside = _WORD_BYTE[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    return int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())


def phrase_places(words: list[str]) -> list[tuple[int, str]]:
    """(start, label) wherever a phrase's words stand one after another."""
    out = []
    for phrase, label in _PHRASE_WORDS:
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(phrase)] == phrase:
                out.append((at, label))
    return sorted(out)


def template_spans(words: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, label) of accepted runs, the longest from each start; a run inside the previous one of its label is left out."""
    have, out = set(words), []
    for label, automaton in automata():
        if automaton.anchor not in have:
            continue
        done = 0
        for at, w in enumerate(words):
            if at >= done and w in automaton.first_words and (end := automaton.longest(words, at)) is not None:
                out.append((at, end, label))
                done = end
    return sorted(set(out))


def scan_text(text: str) -> dict:
    """What scan() reports about one whole text."""
    n, low = count_words(text), text.translate(_LOWER)
    base, spans = [], []
    if any(a.anchor in low for _, a in automata()) or any(all(w in low for w in p) for p, _ in _PHRASE_WORDS):
        words = WORD.findall(low)
        base, spans = phrase_places(words), template_spans(words)
    base_labels = sorted({x for _, x in base})
    labels = sorted({*base_labels, *(x for _, _, x in spans)})
    sure = {x for _, _, x in spans}
    return {
        "n_words": n, "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(base_labels), "labels": ",".join(labels),
        "score": (len(sure) + 0.5 * (len(labels) - len(sure))) / len(labels) if labels else 0.0,
        "spans": [{"start": a, "end": b, "label": x} for a, b, x in spans],
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string>>"


def scan(docs: DataFrame, *, text_col: str = "text", to: str = "license") -> DataFrame:
    """docs with a struct `to` of what scan_text says about the whole text; a column of that name is replaced.

    A null text counts as empty: no words, no labels, score 0.  The score is the share of a text's labels that a
    template accepts, where a label of phrases alone counts half.  Repeated rows get equal results.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(SCHEMA)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([scan_text(t) for t in texts.fillna("")], columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn(to, scanned(F.col(text_col)))

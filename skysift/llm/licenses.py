"""License scans by a generalised suffix automaton over the words of license texts.

The automaton of all templates is built on the driver; its size follows from the
templates alone.  A document's words stream through it: at each word it holds
the longest run of words ending there that any template contains.  Runs that
cannot be extended are matches; matches in the same order in a template and in
the document are chained, and a template that a chain covers well is found.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skysift.llm.common import map_rows

#: Phrases and the labels they give wherever their words stand consecutively.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public license texts and usual notices.  A label may have several templates.
TEMPLATES = [
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-text", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("mit-notice", "released under the MIT License"),
    ("mit-notice", "licensed under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]

#: Bytes to words: A-Z lower-cased, other ASCII that is neither digit nor letter as space.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split() if text else []


class Automaton:
    """Generalised suffix automaton of token sequences.

    Per state: next states, suffix link, longest length, and for each template
    the places at which the state's strings end.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[dict[int, set[int]]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token, own)
                own[last].setdefault(number, set()).add(place)
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            for number, places in own[state].items():
                own[self.link[state]].setdefault(number, set()).update(places)
        self.ends = [{n: sorted(p) for n, p in x.items()} for x in own]

    def _state(self, length: int, follow: dict[int, int], link: int, own: list) -> int:
        self.next.append(dict(follow))
        self.length.append(length)
        self.link.append(link)
        own.append({})
        return len(self.next) - 1

    def _split(self, above: int, token: int, own: list) -> int:
        """The state of above's strings with the token, made apart from longer strings if need be."""
        state = self.next[above][token]
        if self.length[state] == self.length[above] + 1:
            return state
        clone = self._state(self.length[above] + 1, self.next[state], self.link[state], own)
        self.link[state] = clone
        while above >= 0 and self.next[above].get(token) == state:
            self.next[above][token] = clone
            above = self.link[above]
        return clone

    def _extend(self, last: int, token: int, own: list) -> int:
        if token in self.next[last]:
            return self._split(last, token, own)
        new = self._state(self.length[last] + 1, {}, 0, own)
        above = last
        while above >= 0 and token not in self.next[above]:
            self.next[above][token] = new
            above = self.link[above]
        if above >= 0:
            self.link[new] = self._split(above, token, own)
        return new

    def matches(self, tokens: list[int], least: int) -> list[tuple[int, int, int]]:
        """(last place, length, state) of the longest runs that no further word extends."""
        out, state, n = [], 0, 0
        for i, token in enumerate(tokens):
            was = (i - 1, n, state)
            while state and token not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                n += 1
            if was[1] >= least and n <= was[1]:
                out.append(was)
        if n >= least:
            out.append((len(tokens) - 1, n, state))
        return out


class Scanner:
    """least: words of the shortest match; gap: words of the document between chained matches at most; share: of a template's words, those that a chain must cover."""

    def __init__(self, least: int = 3, gap: int = 20, share: float = 0.6):
        self.least, self.gap, self.share = least, gap, share
        words = [words_of(t) for _, t in TEMPLATES]
        self.vocab = {w: i for i, w in enumerate(sorted({w for t in words for w in t} | {w.encode() for p in PHRASES for w in p.split()}))}
        self.labels = [label for label, _ in TEMPLATES]
        self.sizes = [len(t) for t in words]
        self.automaton = Automaton([[self.vocab[w] for w in t] for t in words])
        self.phrases = [([self.vocab[w.encode()] for w in p.split()], label) for p, label in PHRASES.items()]

    def phrases_in(self, ids: np.ndarray) -> list[tuple[int, str]]:
        out = []
        for phrase, label in self.phrases:
            hit = np.ones(max(0, len(ids) - len(phrase) + 1), bool)
            for k, token in enumerate(phrase):
                hit &= ids[k : k + len(hit)] == token
            out += [(int(i), label) for i in np.flatnonzero(hit)]
        return out

    def spans(self, ids: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, covered share) of each chain."""
        known = np.flatnonzero(ids >= 0)
        if len(known) < self.least:
            return []
        runs = np.split(known, np.flatnonzero(np.diff(known) > 1) + 1)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for run in runs:
            if len(run) >= self.least:
                for end, n, state in self.automaton.matches(ids[run].tolist(), self.least):
                    for template, places in self.automaton.ends[state].items():
                        for place in places:
                            found.setdefault(template, []).append((int(run[0]) + end, place, n))
        out = []
        for template, matches in found.items():
            matches.sort()
            best: list[tuple[int, int]] = []  # words covered by the chain up to each match, and where it starts
            for i, (end, place, n) in enumerate(matches):
                covered, start = n, end - n + 1
                for j in range(i - 1, -1, -1):
                    e, p, m = matches[j]
                    if end - n - e > self.gap + max(self.sizes):
                        break
                    if -1 < end - n - e <= self.gap and p <= place - n and best[j][0] + n > covered:
                        covered, start = best[j][0] + n, best[j][1]
                best.append((covered, start))
            out += [(template, start, matches[i][0], covered / self.sizes[template]) for i, (covered, start) in enumerate(best)]
        return out

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        places, spans = self.phrases_in(ids), self.spans(ids)
        base = sorted({label for _, label in places})
        good = [s for s in spans if s[3] >= self.share]
        labels = sorted({*base, *(self.labels[s[0]] for s in good)})
        score = max([s[3] for s in spans] + [0.5] * bool(places) + [0.0])
        best: dict[int, tuple] = {}
        for s in good:
            best[s[0]] = max(best.get(s[0], s), s, key=lambda x: x[3])
        starts = [p for p, _ in places]
        cover = [{"label": self.labels[t], "first": a, "last": b, "share": float(c)} for t, a, b, c in sorted(best.values())]
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), float(min(1.0, score)), cover


@lru_cache(maxsize=4)
def scanner(least: int, gap: int, share: float) -> Scanner:
    return Scanner(least, gap, share)


def scan(docs: DataFrame, least: int = 3, gap: int = 20, share: float = 0.6) -> DataFrame:
    """Scans whole texts for license phrases and license texts.

    Returns doc_id, n_words, n_base (places of the phrases), first_word and
    last_word (their smallest and largest start; else null), base_labels,
    labels (with those of templates covered to ``share``), score (the largest
    share of a template covered, 0.5 at least where a phrase stands) and spans
    (per template found, its best span).  Null and empty texts have no words;
    repeated rows are scanned each alike; other columns don't matter.
    """
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), spans]
    schema = pa.schema([("doc_id", pa.int64()), *zip(names, kinds, strict=True)])

    def run(rows: dict[str, list]) -> dict[str, list]:
        got = [scanner(least, gap, share).scan(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"]} | {n: [g[i] for g in got] for i, n in enumerate(names)}

    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,share:double>>"
    return map_rows(docs.select(docs["doc_id"].cast("long"), "text"), run, schema, ddl)

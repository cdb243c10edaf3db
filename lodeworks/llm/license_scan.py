"""License scans: a generalised suffix automaton over the tokens of licence templates, streamed over files.

Templates are short wordings (each of LEADS with each of NAMES), notices and operative parts (TEMPLATES) and whole licence texts (licenses/*.txt, one file a label).

The automaton is built once a worker for all templates (some 40,000 tokens, configuration) and walked with a file's words; at each word it gives the length
of the longest suffix of what was read that occurs in some template: the matching statistics. Matches of at least MIN_MATCH words
(or a whole shorter template) that can't be extended are seeds; seeds of one template are chained in increasing order of place in file and
template, and the words they cover in the template over its length is its coverage. A template adds its label if its coverage is that of its
length in COVERAGES and, from LONG words on (a shorter one must be complete, its name included), if its NEEDS stand word by word in what it matched, and if none of its
UNLESS stands in the file. A notice that lies within a whole
text that is found (the texts end with their own notices) adds none.

Only runs of words that templates use are walked, because a match can't leave them; the rest of a file costs one lookup a word.

The base labels are phrases, found wherever their words stand consecutively. score is the best coverage of a template whose NEEDS and UNLESS hold, at least PHRASE_SCORE with a base label.

Defined results: a null or empty text has no words and no label; repeated rows are scanned alike, one row each; of chains that cover as much, the one that begins first
counts, and of those the one that ends last; an empty table gives an empty result; other columns aren't returned, so that their names can't clash; very long texts are
scanned whole. One row is one file, held whole by its task; nothing else is held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, rows_of, utf8

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MIN_MATCH, PHRASE_SCORE = 6, 0.25
#: (words of a template from which, coverage): short wordings must be complete, whole texts may lack their appendix.
COVERAGES = [(100, 0.75), (20, 0.9), (0, 1.0)]
LONG = 20
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short wordings are these words and a name.
LEADS = [
    "licensed under", "licensed under the", "licensed under the terms of the", "released under", "released under the", "released under the terms of the", "distributed under", "distributed under the",
    "distributed under the terms of the", "available under", "available under the", "available under the terms of the", "published under the", "provided under the", "SPDX License Identifier",
]
#: label: names, and what the licence is called in package metadata. A name goes with every lead.
NAMES = {
    "mit": ["MIT License", "MIT Licence"],
    "apache-2.0": ["Apache License Version 2 0", "Apache License 2 0", "Apache 2 0 License", "Apache 2 0"],
    "gpl-2.0": ["GNU General Public License version 2", "GNU General Public License v2 0", "GNU GPL v2", "GPL v2", "GPL 2 0 only"],
    "gpl-3.0": ["GNU General Public License version 3", "GNU General Public License v3 0", "GNU GPL v3", "GPL v3", "GPL 3 0 only"],
    "lgpl-2.1": ["GNU Lesser General Public License version 2 1", "GNU Lesser General Public License v2 1", "LGPL v2 1", "LGPL 2 1 only"],
    "lgpl-3.0": ["GNU Lesser General Public License version 3", "GNU Lesser General Public License v3 0", "LGPL v3", "LGPL 3 0 only"],
    "agpl-3.0": ["GNU Affero General Public License version 3", "GNU Affero General Public License v3 0", "AGPL v3", "AGPL 3 0 only"],
    "mpl-2.0": ["Mozilla Public License version 2 0", "Mozilla Public License 2 0", "MPL 2 0"],
    "bsd-2-clause": ["BSD 2 Clause License", "BSD 2 Clause", "Simplified BSD License"],
    "bsd-3-clause": ["BSD 3 Clause License", "BSD 3 Clause", "New BSD License"],
    "epl-1.0": ["Eclipse Public License version 1 0", "Eclipse Public License 1 0", "EPL 1 0"],
    "epl-2.0": ["Eclipse Public License version 2 0", "Eclipse Public License 2 0", "EPL 2 0"],
    "isc": ["ISC License"],
    "zlib": ["zlib License"],
    "bsl-1.0": ["Boost Software License Version 1 0", "Boost Software License 1 0", "BSL 1 0"],
    "cc0-1.0": ["CC0 1 0", "Creative Commons Zero 1 0"],
    "cc-by-4.0": ["CC BY 4 0", "Creative Commons Attribution 4 0"],
    "cc-by-sa-4.0": ["CC BY SA 4 0", "Creative Commons Attribution ShareAlike 4 0"],
    "cc-by-nd-4.0": ["CC BY ND 4 0", "Creative Commons Attribution NoDerivatives 4 0"],
    "cc-by-nc-4.0": ["CC BY NC 4 0", "Creative Commons Attribution NonCommercial 4 0"],
    "cc-by-nc-sa-4.0": ["CC BY NC SA 4 0", "Creative Commons Attribution NonCommercial ShareAlike 4 0"],
    "cc-by-nc-nd-4.0": ["CC BY NC ND 4 0", "Creative Commons Attribution NonCommercial NoDerivatives 4 0"],
}
#: (label, words): notices, and the operative parts of permissive licences.
TEMPLATES = [
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4 0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4 0 International License"),
    ("gpl-2.0-or-later", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 2 of the License or at your option any later version"),
    ("gpl-3.0-or-later", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 3 of the License or at your option any later version"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0"),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("lgpl-2.1-or-later", "you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation either version 2 1 of the License or at your option any later version"),
    ("lgpl-3.0-or-later", "you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation either version 3 of the License or at your option any later version"),
    ("agpl-3.0-or-later", "you can redistribute it and or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation either version 3 of the License or at your option any later version"),
    ("agpl-3.0", "if you modify the Program your modified version must prominently offer all users interacting with it remotely through a computer network if your version supports such interaction an opportunity to receive the Corresponding Source of your version"),
]
#: label: words without which a template is another licence's, so that shared wording is not enough
NEEDS: dict[str, list[str]] = {
    "gpl-2.0-or-later": ["gnu general public license", "version 2 of the license"],
    "gpl-3.0-or-later": ["gnu general public license", "version 3 of the license"],
    "lgpl-2.1-or-later": ["gnu lesser general public license", "version 2 1 of the license"],
    "lgpl-3.0-or-later": ["gnu lesser general public license", "version 3 of the license"],
    "agpl-3.0-or-later": ["gnu affero general public license", "version 3 of the license"],
    "mit": ["mit license", "to deal in the software without restriction"],
    "bsd-3-clause": ["neither the name of"],
    "gpl-1.0": ["general public license", "version 1"],
    "gpl-2.0": ["gnu general public license"],
    "gpl-3.0": ["gnu general public license"],
    "lgpl-2.0": ["library general public license"],
    "lgpl-2.1": ["lesser general public license"],
    "gfdl-1.2": ["version 1 2 november 2002"],
    "gfdl-1.3": ["version 1 3 3 november 2008"],
}
#: of a label with two templates, one of the words is needed
ANY_OF = {"mit"}
#: label: words of another licence that has all of the template's own
UNLESS: dict[str, list[str]] = {
    "bsd-2-clause": ["neither the name", "may not be used to endorse or promote", "all advertising materials mentioning features"],
    "bsd-3-clause": ["all advertising materials mentioning features"],
    "gpl-3.0": ["remote network interaction"],
}


def short_wordings() -> list[tuple[str, str]]:
    return [(label, f"{lead} {name}") for label, names in NAMES.items() for name in names for lead in LEADS]


def whole_texts() -> list[tuple[str, str]]:
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def stands(words: list[bytes], phrase: list[bytes], first: int, end: int) -> bool:
    n = len(phrase)
    return any(words[i] == phrase[0] and words[i : i + n] == phrase for i in range(first, end - n + 1))


class Automaton:
    """A generalised suffix automaton of token sequences, with one end position per state and template."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for which, tokens in enumerate(sequences):
            last = 0
            for place, token in enumerate(tokens):
                last = self._extend(last, token)
                state = last
                while state > 0 and which not in self.ends[state]:
                    self.ends[state][which] = place + 1  # the first end of a template's substrings in this state
                    state = self.link[state]

    def _new(self, length: int, next_: dict[int, int], link: int, ends: dict[int, int]) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(ends)
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q], dict(self.ends[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        current = self._new(self.length[last] + 1, {}, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = current
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[current] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return current

    def each(self, length: int, state: int, least: int) -> dict[int, tuple[int, int]]:
        """(length, end) of the longest match of each template that ends here, so that one template's longer match doesn't hide another's."""
        out: dict[int, tuple[int, int]] = {}
        while length >= least:
            for which, end in self.ends[state].items():
                out.setdefault(which, (length, end))
            state = self.link[state]
            length = self.length[state]
        return out

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest match that ends at each token."""
        state = length = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                length += 1
            yield length, state


class Scanner:
    def __init__(self, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] = PHRASES) -> None:
        templates = [*short_wordings(), *TEMPLATES, *whole_texts()] if templates is None else templates
        self.labels = [label for label, _ in templates]
        sequences = [words_of(utf8(text)) for _, text in templates]
        self.ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for s in sequences for w in s))}
        self.lengths = [len(s) for s in sequences]
        self.automaton = Automaton([[self.ids[w] for w in s] for s in sequences])
        self.shares = [next(share for n, share in COVERAGES if len(s) >= n) for s in sequences]
        packed = lambda rules: {label: [words_of(utf8(p)) for p in ps] for label, ps in rules.items()}
        self.needs, self.unless = packed(NEEDS), packed(UNLESS)
        self.least = min([MIN_MATCH, *self.lengths])
        self.phrases = [([*words_of(utf8(p))], label) for p, label in phrases.items()]
        self.rare = [(max(p, key=len), p, label) for p, label in self.phrases]

    def seeds(self, tokens: list[int], start: int) -> Iterator[tuple[int, int, int, int]]:
        """(template, place in template, place in file, length) of matches that can't be extended to the right."""
        now: dict[int, tuple[int, int]] = {}
        for i, (length, state) in enumerate([*self.automaton.statistics(tokens), (0, 0)]):
            before, now = now, self.automaton.each(length, state, self.least)
            for which, (n, end) in before.items():
                if n >= now.get(which, (0, 0))[0] and n >= min(MIN_MATCH, self.lengths[which]):
                    yield which, end - n, start + i - n, n

    def fits(self, label: str, words: list[bytes], first: int, end: int) -> bool:
        """Whether the words of NEEDS are in the match, and none of UNLESS in the file."""
        needs, unless = self.needs.get(label, []), self.unless.get(label, [])
        held = (any if label in ANY_OF else all)(stands(words, p, first, end) for p in needs)
        return (held or not needs) and not any(stands(words, p, 0, len(words)) for p in unless)

    def coverage(self, seeds: list[tuple[int, int, int]], total: int) -> tuple[float, int, int]:
        """The best chain of one template's seeds: share of the template, first and one past the last word in the file."""
        best: list[tuple[int, int]] = []  # covered, first word
        top = (0, 0, 0)
        ordered = sorted({*seeds}, key=lambda s: (s[1], s[0]))
        for i, (at, place, length) in enumerate(ordered):
            covered, first = length, place
            for j in range(i - 1, -1, -1):
                a, p, n = ordered[j]
                if place - p > 2 * total:  # no earlier seed is near enough
                    break
                if a + n <= at and p + n <= place and place - (p + n) <= total and best[j][0] + length > covered:
                    covered, first = best[j][0] + length, best[j][1]
            best.append((covered, first))
            top = max(top, (covered, -first, place + length))
        return top[0] / total, -top[1], top[2]

    def scan(self, text: bytes) -> tuple:
        low = text.lower()
        words = WORD.findall(low)
        starts: list[int] = []
        base: set[str] = set()
        for rare, phrase, label in self.rare:
            if rare in low:
                first = phrase[0]
                at, n = -1, len(phrase)
                while True:
                    try:
                        at = words.index(first, at + 1)
                    except ValueError:
                        break
                    if words[at : at + n] == phrase:
                        starts.append(at)
                        base.add(label)
        spans: dict[int, list[tuple[int, int, int]]] = {}
        if len(words) >= self.least:
            ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int32, len(words))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
            begins, ends = edges[::2], edges[1::2]
            for k in np.flatnonzero(ends - begins >= self.least):
                b, e = int(begins[k]), int(ends[k])
                for which, at, place, length in self.seeds(ids[b:e].tolist(), b):
                    spans.setdefault(which, []).append((at, place, length))
        score, labels, found = 0.0, set(base), []
        for which, seeds in spans.items():
            share, first, end = self.coverage(seeds, self.lengths[which])
            if self.lengths[which] >= LONG and not self.fits(self.labels[which], words, first, end):
                continue
            score = max(score, share)
            if share >= self.shares[which]:
                found.append((self.lengths[which], {"label": self.labels[which], "start": first, "end": end, "coverage": share}))
        whole = [(f["start"], f["end"]) for n, f in found if n >= COVERAGES[0][0]]
        found = [f for n, f in found if n >= COVERAGES[0][0] or not any(a <= f["start"] and f["end"] <= b for a, b in whole)]
        labels |= {f["label"] for f in found}
        if base:
            score = max(score, PHRASE_SCORE)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(1.0, score), found


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, coverage: double>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), _SPAN]
_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


@lru_cache(maxsize=1)
def scanner_of_worker() -> Scanner:
    return Scanner()


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner, out = scanner_of_worker(), []
    for doc_id, text in rows_of(batches, "doc_id", "text"):
        out.append((doc_id, *scanner.scan(utf8(text))))
        if len(out) == 1024:
            yield _emit(out)
            out = []
    if out:
        yield _emit(out)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def scan(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(scan_batches, _SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("spans")

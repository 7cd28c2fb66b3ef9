"""Licence scan: matching statistics of a suffix automaton over licence templates, chained into covered spans.

Every word of a text gets the length of the longest template passage that ends there. Passages of ``min_match`` words
or more become anchors; per template, anchors that go forward in both text and template are chained, and the share of
the template that the best chain covers is its score. Base phrases are items of the same automaton, found at every
place where they stand. Null or empty texts have no words, no matches and score 0.
"""
from __future__ import annotations

from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame

from quotelab.llm.suffix_automaton import SuffixAutomaton
from quotelab.llm.texts import batch, keyed_text, terms

# Phrases with their labels, and the public notices and permission texts of common licences.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit-statement": "Released under the MIT License.",
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
               "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                  "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                  "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                  "permissions and limitations under the License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
                "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
                "conditions: The above copyright notice and this permission notice shall be included in all copies or "
                "substantial portions of the Software.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
                "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the "
                "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
                "other materials provided with the distribution.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                  "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                  "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
                  "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
                  "See the GNU General Public License for more details.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                 "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                 "binary, for any purpose, commercial or non-commercial, and by any means.",
}


class LicenseIndex:
    """The automaton of phrases and templates, with the places where each state's sequences end."""

    def __init__(self, base: dict[str, str], templates: dict[str, str], min_match: int):
        self.base = {tuple(terms(p.encode())): label for p, label in base.items()}
        self.templates = {name: len(terms(text.encode())) for name, text in templates.items()}
        items = [(None, list(p)) for p in self.base] + [(name, terms(text.encode())) for name, text in templates.items()]
        self.sam = sam = SuffixAutomaton(items)
        self.min_match = min_match
        self.ends: list[list[tuple[str, int]]] = [[] for _ in sam.link]
        for name, words in sam.items:
            for at, s in enumerate(sam.states_of(words) if name is not None else ()):
                while s > 0:
                    self.ends[s].append((name, at + 1))
                    s = sam.link[s]
        #: Nearest state, itself or up the suffix links, at which a phrase ends.
        self.phrase_at = {sam.states_of(list(p))[-1]: p for p in self.base}
        self.phrase = [0] * len(sam.link)
        for s in sam.by_length():
            self.phrase[s] = s if s in self.phrase_at else self.phrase[sam.link[s]]
        #: The same for whole templates, with the names of those that end at a state.
        self.whole_at: dict[int, list[str]] = {}
        for name, words in sam.items:
            if name is not None and words:
                self.whole_at.setdefault(sam.states_of(words)[-1], []).append(name)
        self.whole = [0] * len(sam.link)
        for s in sam.by_length():
            self.whole[s] = s if s in self.whole_at else self.whole[sam.link[s]]

    def scan(self, text: bytes | None, min_coverage: float = 0.8) -> tuple[int, list[tuple[int, str]], list[dict]]:
        """(words, places of base phrases with their labels, the best chain of each template that has one and further ones)."""
        words = terms(text)
        sam, low = self.sam, self.min_match
        places: list[tuple[int, str]] = []
        anchors: dict[str, list[tuple[int, int, int]]] = {}
        last: tuple[int, int, int] | None = None

        def keep(i: int, s: int, n: int) -> None:
            for name, end in self.ends[s]:
                if n >= min(low, self.templates[name]):
                    anchors.setdefault(name, []).append((i + 1 - n, end - n, n))

        for i, s, n in sam.read(words):
            at = self.phrase[s]
            while at:
                p = self.phrase_at[at]
                if len(p) <= n:
                    places.append((i + 1 - len(p), self.base[p]))
                at = self.phrase[sam.link[at]]
            at = self.whole[s]
            while at:  # a template that stands in full, even where a longer one goes on
                for name in self.whole_at[at]:
                    if (size := self.templates[name]) <= n:
                        anchors.setdefault(name, []).append((i + 1 - size, 0, size))
                at = self.whole[sam.link[at]]
            if last and not (i == last[0] + 1 and n == last[2] + 1):
                keep(*last)  # the match did not grow: it was as long as it can be
            last = (i, s, n)
        if last:
            keep(*last)
        return len(words), places, [c for name in sorted(anchors) for c in self._chains(name, anchors[name], min_coverage)]

    def _chains(self, name: str, anchors: list[tuple[int, int, int]], min_coverage: float) -> list[dict]:
        """The chain that covers most of the template, then the best of what does not overlap, while it reaches the coverage."""
        size, out, left = self.templates[name], [], sorted(set(anchors))
        while left:
            taken: list[tuple[int, int]] = []
            for covered, first, end, last in sorted(self._chained(size, left), key=lambda c: (-c[0], c[1])):
                if out and covered / size < min_coverage:
                    break
                at = bisect(taken, (first, end))
                if (at and taken[at - 1][1] > first) or (at < len(taken) and taken[at][0] < end):
                    at = bisect(taken, (last, end))
                    if (at and taken[at - 1][1] > last) or (at < len(taken) and taken[at][0] < end):
                        continue  # its last anchor is covered
                    break  # without what is taken, its chain is another one
                taken.insert(at, (first, end))
                out.append({"template": name, "coverage": covered / size, "start": first, "end": end})
            if not taken:
                break
            free = []
            for a in left:
                at = bisect(taken, (a[0], a[0] + a[2]))
                if not (at and taken[at - 1][1] > a[0]) and not (at < len(taken) and taken[at][0] < a[0] + a[2]):
                    free.append(a)
            left = free
        return out

    @staticmethod
    def _chained(size: int, anchors: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(covered, first word, end, first word of the last anchor) of the best chain that ends at each of the sorted
        anchors; gaps in the text stay below the template's length."""
        best: list[tuple[int, int, int]] = []  # covered, first word, end in text
        open_: list[int] = []
        for k, (at, in_template, n) in enumerate(anchors):
            got = (n, at, at + n, in_template + n)
            open_ = [j for j in open_ if at - best[j][2] <= size]
            for j in open_:
                covered, first, end, end_t = best[j]
                skip = max(0, end - at, end_t - in_template)
                if skip < n and covered + n - skip > got[0]:
                    got = (covered + n - skip, first, at + n, in_template + n)
            best.append(got)
            open_.append(k)
        return [(c[0], c[1], c[2], a[0]) for c, a in zip(best, anchors, strict=True)]


_held: dict[tuple, LicenseIndex] = {}


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None,
                  min_match: int = 5, min_coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, base (places and labels of phrases), spans (template, coverage, start, end of chains that
    reach ``min_coverage``) and score, the best coverage of any template, 1 where a base phrase stands."""
    base, templates = base or BASE, templates or TEMPLATES
    key = (tuple(base.items()), tuple(templates.items()), min_match)
    place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        if key not in _held:
            _held.clear()
            _held[key] = LicenseIndex(base, templates, min_match)
        index = _held[key]
        for b in batches:
            n_words, places, spans, scores = [], [], [], []
            for text in b.column("text").to_pylist():
                n, at, chains = index.scan(text, min_coverage)
                n_words.append(n)
                places.append([{"start": i, "label": label} for i, label in at])
                spans.append([c for c in chains if c["coverage"] >= min_coverage])
                scores.append(1.0 if at else max([0.0, *(c["coverage"] for c in chains)]))
            out = batch({"n_words": (n_words, pa.int64()), "base": (places, place), "spans": (spans, span), "score": (scores, pa.float64())})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *out.columns], names=["doc_id", *out.schema.names])

    rows = keyed_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, (
        f"doc_id {kind}, n_words long, base array<struct<start:long,label:string>>, "
        "spans array<struct<template:string,coverage:double,start:long,end:long>>, score double"
    ))

"""Licence scans with a generalised suffix automaton.

The words of all licence templates are put into one automaton. Reading a text through it gives the matching statistics:
at each word the longest run of words up to it that stands in some template. Runs of MIN_RUN words or more are anchors;
anchors that stand in the same order in text and template are chained, and a chain that covers enough of a template is
a span of that licence. Words that are in no template trigram cannot end a run of three, so whole batches are sifted by
array operations first and the automaton reads the remaining stretches only; its results are the same.

Fixed phrases are found beside that at every place. Null and empty texts have no words and no labels; repeated rows
are scanned each by itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codonlake.llm import arrays
from codonlake.llm.common import register, table
from codonlake.session import ship_package

# --- fixed values: phrases of the contract with their labels
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# --- fixed values: wordings of public licences and notices
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
]

#: Shortest run of words that becomes an anchor.
MIN_RUN = 3
#: Part of a template that a chain must cover.
COVERED = 0.8
#: Words by which text and template may run apart between two anchors of a chain.
GAP = 8

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[0x30:0x3A] = _SEPARATOR[0x41:0x5B] = _SEPARATOR[0x61:0x7B] = False
_SEPARATOR[0x80:] = False


def words_of(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of a few texts."""
    return [np.split(s.hashes(), s.first[1:-1])[0] for t in texts for s in arrays.slices(pa.array([t]), _SEPARATOR)]


class Automaton:
    """Suffix automaton of several word sequences. A state knows where in which templates its words end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[dict[int, int]] = [{}]

        def state(length: int, link: int, edges: dict[int, int]) -> int:
            self.next.append(edges)
            self.link.append(link)
            self.length.append(length)
            ends.append({})
            return len(self.next) - 1

        def split(p: int, word: int) -> int:
            """The state for p + word with exactly one word more than p."""
            q = self.next[p][word]
            if self.length[q] == self.length[p] + 1:
                return q
            copy = state(self.length[p] + 1, self.link[q], dict(self.next[q]))
            self.link[q] = copy
            while p >= 0 and self.next[p].get(word) == q:
                self.next[p][word] = copy
                p = self.link[p]
            return copy

        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                if word in self.next[last]:
                    last = split(last, word)
                else:
                    p, new = last, state(self.length[last] + 1, 0, {})
                    while p >= 0 and word not in self.next[p]:
                        self.next[p][word] = new
                        p = self.link[p]
                    if p >= 0:
                        self.link[new] = split(p, word)
                    last = new
                ends[last].setdefault(number, place + 1)
        for s in sorted(range(1, len(ends)), key=lambda i: -self.length[i]):  # a suffix ends where the longer word run ends
            for number, place in ends[s].items():
                ends[self.link[s]].setdefault(number, place)
        self.ends = ends

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(state, length of the longest match that ends here) for each word."""
        at, n, out = 0, 0, []
        for w in words:
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if w in self.next[at]:
                at = self.next[at][w]
                n += 1
            out.append((at, n))
        return out


@lru_cache(maxsize=1)
def _templates() -> tuple[Automaton, np.ndarray, np.ndarray, list[int]]:
    hashed = words_of([t for _, t in TEMPLATES])
    known = np.unique(np.concatenate(hashed))
    sequences = [np.searchsorted(known, h) for h in hashed]
    grams = [_trigrams(s.astype(np.int64), known.size) for s in sequences]
    return Automaton([s.tolist() for s in sequences]), known, np.unique(np.concatenate(grams)), [len(s) for s in sequences]


def _trigrams(ids: np.ndarray, base: int) -> np.ndarray:
    return (ids[:-2] * base + ids[1:-1]) * base + ids[2:]


def _chains(anchors: dict[int, list[tuple[int, int, int]]], lengths: list[int]) -> list[tuple[str, int, int, float]]:
    """Spans (label, first word, last word, covered part) from anchors (text end, template end, run) per template."""
    spans = []
    for number, runs in anchors.items():
        best: list[tuple[int, int, int, int]] = []  # covered, text first, text end, template end
        for end, place, run in sorted(runs):
            covered, first = run, end - run
            for c, f, e, p in reversed(best):  # chains apart by more than GAP words cannot be joined
                if end - e > 4 * GAP + run:
                    break
                new = min(run, end - e, place - p)  # words beyond what the chain has
                if new > 0 and abs((end - e) - (place - p)) <= GAP and c + new > covered:
                    covered, first = c + new, f
            best.append((covered, first, end, place))
        taken_to: list[tuple[int, int]] = []
        for c, f, e, _ in sorted((b for b in best if b[0] >= COVERED * lengths[number]), key=lambda b: (-b[0], b[1])):
            if all(e <= x or f >= y for x, y in taken_to):
                taken_to.append((f, e))
                spans.append((TEMPLATES[number][0], f, e - 1, min(1.0, c / lengths[number])))
    return spans


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, phrases, spans) of documents (doc_id, text).

    ``phrases``: (label, start) of every place of a fixed phrase, ``spans``: (label, first, last, covered) of templates.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        automaton, known, grams, lengths = _templates()
        phrases = list(zip((label for _, label in PHRASES), words_of([p for p, _ in PHRASES])))
        for batch in batches:
            for s in arrays.slices(batch.column("text"), _SEPARATOR):
                h, first = s.hashes(), s.first
                lo, hi = s.rows
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                places: dict[int, list[dict]] = defaultdict(list)
                for label, phrase in phrases:
                    m = phrase.size
                    if h.size < m:
                        continue
                    ok = np.ones(h.size - m + 1, dtype=bool)
                    for j in range(m):
                        ok &= h[j:h.size - m + 1 + j] == phrase[j]
                    ok &= row[:h.size - m + 1] == row[m - 1:]
                    for i in np.flatnonzero(ok).tolist():
                        places[int(row[i])].append({"label": label, "start": int(i - first[row[i]])})
                found: dict[int, list[dict]] = {}
                if h.size >= 3:
                    ids = np.minimum(np.searchsorted(known, h), known.size - 1)
                    good = known[ids] == h
                    three = good[:-2] & good[1:-1] & good[2:] & (row[:-2] == row[2:])
                    at = np.flatnonzero(three)
                    at = at[np.isin(_trigrams(ids.astype(np.int64), known.size)[at], grams)]
                    if at.size:
                        # stretches of overlapping trigrams, read by the automaton from their first word
                        cut = np.flatnonzero(np.diff(at) > 1) + 1
                        anchors: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
                        for stretch in np.split(at, cut):
                            a, b, d = int(stretch[0]), int(stretch[-1]) + 3, int(row[stretch[0]])
                            stats = automaton.statistics(ids[a:b].tolist())
                            for k, (state, n) in enumerate(stats):
                                if n >= MIN_RUN and (k + 1 == len(stats) or stats[k + 1][1] <= n):  # longest of its run
                                    for number, place in automaton.ends[state].items():
                                        anchors[d][number].append((a + k + 1 - int(first[d]), place, n))
                        found = {d: [dict(zip(("label", "first", "last", "covered"), x)) for x in _chains(x, lengths)] for d, x in anchors.items()}
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)),
                    pa.array([places.get(i, []) for i in range(hi - lo)], pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
                    pa.array([found.get(i, []) for i in range(hi - lo)], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))),
                ], ["doc_id", "n_words", "phrases", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, phrases array<struct<label:string,start:long>>, spans array<struct<label:string,first:long,last:long,covered:double>>")


@register("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and licence spans of all documents."""
    def labels(*names):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(n, lambda x: x["label"]) for n in names]))), ",")

    starts = F.transform("phrases", lambda x: x["start"])
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("phrases").alias("base_labels"), labels("phrases", "spans").alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["covered"])), F.lit(0.0))).alias("score"))

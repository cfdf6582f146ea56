"""License texts in documents: MinHash over overlapping windows, then exact containment.

Templates and documents are seen as shingles of five words (lower case, signs around
a word taken off).  Templates of like length share one window length, long enough
that every place a template may stand lies wholly in some window.  A window and a
template that it contains to the asked share have at least a known Jaccard
similarity; so many bands are used that such a pair meets in one of them with a
probability of at least ``1 - MISS``.  Windows that meet a template are verified with
their shingles themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfade.llm.words import Words, mixed, rolling, word_hashes, word_slices

SHINGLE = 5
CONTAINED = 0.8
MISS = 1e-6

# Notices as their licenses word them.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "CC BY-NC 4.0 notice": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:"
    ),
    "CC BY 4.0 notice": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ),
}

_STRIP = re.compile(r"^[\W_]+|[\W_]+$")


def _normal(words: list[str]) -> np.ndarray:
    """Hash of each word without the signs around it; 0 where nothing is left."""
    bare = [_STRIP.sub("", w) for w in words]
    return np.where([bool(b) for b in bare], word_hashes(bare) | np.uint64(1), np.uint64(0))


class Shingles:
    """Shingles of the texts of ``words``: ``hash``, ``doc`` and ``word`` (place in the text).

    A text of fewer than five words is one shingle; one without words has none.
    """

    def __init__(self, words: Words, size: int = SHINGLE):
        hashes = _normal(words.vocabulary)[words.codes]
        first = np.cumsum(words.counts) - words.counts
        place = np.arange(len(hashes)) - np.repeat(first, words.counts)
        some = hashes != 0
        hashes, doc, place = hashes[some], words.doc[some], place[some]
        whole = rolling(hashes, size)
        inside = doc[size - 1 :] == doc[: len(doc) - size + 1] if len(whole) else np.zeros(0, bool)
        start = np.flatnonzero(inside)
        counts = np.bincount(doc, minlength=len(words.counts))
        begin = np.cumsum(counts) - counts
        short = np.flatnonzero((counts > 0) & (counts < size))
        extra = [rolling(hashes[begin[d] : begin[d] + counts[d]], int(counts[d]))[0] for d in short]
        self.hash = np.concatenate([whole[inside], np.array(extra, np.uint64)])
        self.doc = np.concatenate([doc[start], short])
        self.word = np.concatenate([place[start], place[begin[short]]])
        order = np.lexsort((self.word, self.doc))
        self.hash, self.doc, self.word = self.hash[order], self.doc[order], self.word[order]


class TemplateIndex:
    """Templates by window length, with the smallest hash of each band."""

    def __init__(self, templates: dict[str, str], contained: float = CONTAINED, miss: float = MISS):
        self.names = list(templates)
        found = Shingles(Words([templates[n].lower() for n in self.names]))
        self.sets = [np.unique(found.hash[found.doc == k]) for k in range(len(self.names))]
        self.contained = contained
        self.classes = []
        by_length: dict[int, list[int]] = {}
        for k, own in enumerate(self.sets):
            if len(own):
                by_length.setdefault(int(math.log2(len(own))), []).append(k)
        for members in by_length.values():
            lengths = [len(self.sets[k]) for k in members]
            longest, stride = max(lengths), max(1, max(lengths) // 4)
            reach = -(-(longest + stride - 1) // stride)  # strides in a window
            window = reach * stride
            jaccard = min(contained * n / (window + (1 - contained) * n) for n in lengths)
            bands = math.ceil(math.log(miss) / math.log(1 - jaccard))
            lowest = np.array(
                [[_band(self.sets[k], b).min() for b in range(bands)] for k in members], np.uint64
            )
            self.classes.append((members, stride, reach, bands, lowest))

    def matches(self, words: Words) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, last word, containment) of the windows that hold one."""
        found = Shingles(words)
        out = []
        for members, stride, reach, bands, lowest in self.classes:
            begins, ends, docs = _windows(found.doc, stride, reach)
            if not len(begins):
                continue
            blocks, last_block = _blocks(found.doc, stride)
            for k_band in range(bands):
                least = np.minimum.reduceat(_band(found.hash, k_band), blocks)
                window_least = least.copy()
                for step in range(1, reach):
                    near = np.arange(len(least)) + step
                    inside = near <= last_block
                    window_least[inside] = np.minimum(window_least[inside], least[near[inside]])
                for row, template in enumerate(members):
                    for w in np.flatnonzero(window_least == lowest[row, k_band]):
                        out.append((int(docs[w]), template, int(begins[w]), int(ends[w])))
        verified = []
        for doc, template, low, high in sorted(set(out)):
            own = self.sets[template]
            inside = np.isin(found.hash[low:high], own)
            share = len(np.unique(found.hash[low:high][inside])) / len(own)
            if share >= self.contained:
                spots = found.word[low:high][inside]
                verified.append((doc, template, int(spots.min()), int(spots.max()) + SHINGLE - 1, share))
        return verified


def _band(hashes: np.ndarray, band: int) -> np.ndarray:
    return mixed(hashes * np.uint64(2 * band + 1) + np.uint64(band))


def _blocks(doc: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shingle of each stride of each text, number of its text's last stride)."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.append(0, np.flatnonzero(np.diff(doc)) + 1)
    size = np.diff(np.append(edge, len(doc)))
    inside = np.arange(len(doc)) - np.repeat(edge, size)
    blocks = np.flatnonzero(inside % stride == 0)
    per_text = -(-size // stride)
    return blocks, np.repeat(np.cumsum(per_text) - 1, per_text)


def _windows(doc: np.ndarray, stride: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first shingle, end, text) of the window that begins at each stride."""
    blocks, last = _blocks(doc, stride)
    ends = np.append(blocks[1:], len(doc))
    stop = np.minimum(np.arange(len(blocks)) + reach - 1, last)
    return blocks, ends[stop] if len(blocks) else ends[:0], doc[blocks]


def merged(found: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Windows of one text and template that overlap, as one match."""
    out: list[list] = []
    for doc, template, low, high, share in sorted(found):
        last = out[-1] if out else None
        if last and last[:2] == [doc, template] and low <= last[3]:
            last[3], last[4] = max(last[3], high), max(last[4], share)
        else:
            out.append([doc, template, low, high, share])
    return [tuple(m) for m in out]


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED
) -> DataFrame:
    """One row per match: doc_id, license, first_word, last_word, containment.

    Places count the words of the text (between white space) from 0.  NULL, empty and
    blank texts match nothing, so they give no row; a very long text is scanned whole.
    Rows without doc_id and repeated rows are scanned like any other.  A text with two
    licenses gives rows for both; empty tables give none.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates, contained)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, words in word_slices(batch.column("text").to_pylist(), lower=True):
                found = merged(index.matches(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[first + m[0]] for m in found], pa.int64()),
                        pa.array([index.names[m[1]] for m in found], pa.string()),
                        pa.array([m[2] for m in found], pa.int64()),
                        pa.array([m[3] for m in found], pa.int64()),
                        pa.array([m[4] for m in found], pa.float64()),
                    ],
                    ["doc_id", "license", "first_word", "last_word", "containment"],
                )

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return texts.mapInArrow(
        search, "doc_id long, license string, first_word long, last_word long, containment double"
    )

"""License scan: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment measures them.

Texts are reduced to words of lower-case letters and digits, joined over a whole text however long it is. Fingerprints are
the smallest hashes of `window` consecutive runs of `gram` words, so a stretch of gram + window - 1 words that a template
and a text share has one in common. Around each shared fingerprint the template's words are aligned with the text's words
in a band, with gaps, and reported with their coverage and span.

A match holds `need` = ceil(coverage * n) of a template's n words. `breaks` places at which words are missing, replaced or
added leave a stretch of at least ceil(need / (breaks + 1)) words whole. Gram and window are set for each template so that
this is gram + window - 1 with n - need missing words, the most there can be, and one added word in ten besides. So no
match with that many breaks is passed over; one with more is found if any stretch of that length is whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import by_tasks
from tracewright.llm.words import BASE, U, letter_words, mix, places, span_hashes

LEAST_CHARS = 12
PIECE = 1 << 19
# Letters a word up to which a run of words counts as one of short words.
SHORT_CHARS = 3
TEMPLATE_CHARS = 16_000_000

# Notices and opening paragraphs of well-known licences (fixed values).
TEMPLATES = (
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit-notice", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0-notice", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
)


def cut(texts: Iterable[str], size: int) -> Iterator[tuple[list[int], list[int], list[str], bool]]:
    """Groups of (text numbers, offsets, texts, done) of about `size` characters. A longer text comes alone, cut between words; its last piece is done."""
    numbers, group, held = [], [], 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield numbers, [0] * len(numbers), group, True
            numbers, group, held = [], [], 0
        if len(text) <= size:
            numbers.append(i)
            group.append(text)
            held += len(text)
            continue
        start = 0
        while start < len(text):
            end = min(len(text), start + size)
            while end < len(text) and (text[end].isalnum() or "\u0300" <= text[end] < "\u0370"):
                end += 1
            yield [i], [start], [text[start:end]], end == len(text)
            start = end
    if group:
        yield numbers, [0] * len(numbers), group, True


def text_words(texts: Iterable[str], size: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """Word hashes, their text number, and the words' bounds in their text, for groups of whole texts."""
    held = []
    for numbers, offsets, group, done in cut(texts, size):
        _, prefix, starts, ends, owner = letter_words(group, digits=True)
        origin = (np.cumsum([0] + [len(t) + 1 for t in group])[:-1] - np.array(offsets))[owner]
        held.append((span_hashes(prefix, starts, ends), np.array(numbers)[owner], starts - origin, ends - origin))
        if done:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held = []


def setting(n: int, need: int) -> tuple[int, int]:
    """Gram and window for a template of n words of which a match holds `need`."""
    breaks = n - need + ceil(n / 10)
    run = ceil(need / (breaks + 1))
    gram = run // 2 + 1
    return gram, run - gram + 1


def fingerprints(words: np.ndarray, lengths: np.ndarray, owner: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes of runs of words and the place of their first word: the rightmost smallest of each window.

    Runs of short words, which many texts share, count as the largest, so they are kept only where a window has no other.
    No run goes over the end of a text; a text of fewer runs than a window keeps its smallest.
    """
    n = len(words) - gram + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    hashes, chars = np.zeros(n, U), np.zeros(n, np.int64)
    for j in range(gram):
        hashes = hashes * U(BASE) + words[j : j + n]
        chars += lengths[j : j + n]
    whole = owner[:n] == owner[gram - 1 :]
    hashes = mix(hashes) >> U(2) | np.where(chars <= SHORT_CHARS * gram, U(1 << 62), U(0))
    hashes[~whole] = ~U(0)
    # Windows may begin before a text and end behind it: what lies outside counts as largest.
    edge = np.full(window - 1, ~U(0))
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate((edge, hashes, edge)), window)
    keep = np.unique(np.arange(len(views)) - views[:, ::-1].argmin(axis=1))
    keep = keep[(keep >= 0) & (keep < n)]
    keep = keep[whole[keep]]
    return hashes[keep], keep


def align(template: np.ndarray, words: np.ndarray, band: int) -> tuple[int, int, int]:
    """(matched template words, first and last matched word) of the best alignment with template word i near word i + band.

    Word gaps on either side are free of charge but stay within the band on both sides of the diagonal.
    """
    width = 2 * band + 1
    best = np.zeros(width, np.int64)
    first = np.full(width, -1)
    last = np.full(width, -1)
    for i in range(len(template)):
        at = i + np.arange(width)
        hit = (at < len(words)) & (words[np.minimum(at, len(words) - 1)] == template[i]) if len(words) else np.zeros(width, bool)
        # Row i - 1 at the same word lies one column to the right; a match comes from the word before it.
        taken = best + hit
        taken_first = np.where(hit & (first < 0), at, first)
        taken_last = np.where(hit, at, last)
        skip = np.append(best[1:], 0)
        use = hit & (taken > skip)
        row = np.where(use, taken, skip)
        row_first = np.where(use, taken_first, np.append(first[1:], -1))
        row_last = np.where(use, taken_last, np.append(last[1:], -1))
        for j in range(1, width):
            if row[j - 1] > row[j]:
                row[j], row_first[j], row_last[j] = row[j - 1], row_first[j - 1], row_last[j - 1]
        best, first, last = row, row_first, row_last
    j = int(best.argmax())
    return int(best[j]), int(first[j]), int(last[j])


def settled(found: list[tuple]) -> list[tuple]:
    """Of matches that overlap in one document, the one with most matched words, then the fullest, then the first by name, then the shortest."""
    kept: dict[int, list[tuple]] = {}
    for row in sorted(set(found), key=lambda r: (r[0], -r[3], -r[2], r[1], r[5] - r[4], r[4])):
        mine = kept.setdefault(row[0], [])
        if all(row[5] <= k[4] or row[4] >= k[5] for k in mine):
            mine.append(row)
    return [r for mine in kept.values() for r in sorted(mine, key=lambda r: r[4])]


def inverted(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    """Index from fingerprints to (template, place): its keys, their first entry and count, the entries, and a bit map that rules most hashes out."""
    rows = sorted(rows)
    hashes, owners, at = (np.array(c, kind) for c, kind in zip(zip(*rows) if rows else ((), (), ()), (U, np.int64, np.int64)))
    kinds, first, count = np.unique(hashes, return_index=True, return_counts=True)
    maybe = np.zeros(1 << 20, bool)
    maybe[(kinds >> U(40)).astype(np.int64) & 0xFFFFF] = True
    return kinds, first, count, owners, at, maybe


def scanner(templates: list[tuple[str, str]], coverage: float):
    """Task function: (key, template, coverage, matched words, start, end) of each match."""
    names = [n for n, _ in templates]
    hashes_, owner, starts, ends = next(text_words([t for _, t in templates], TEMPLATE_CHARS), [np.zeros(0, U)] * 4)
    words = [hashes_[owner == t] for t in range(len(names))]
    # Less a rounding error, as 0.8 * 5 words are four.
    needs = [max(1, ceil(coverage * len(body) - 1e-9)) for body in words]
    settings: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for t, body in enumerate(words):
        mine = setting(len(body), needs[t])
        hashes, at = fingerprints(body, (ends - starts)[owner == t], np.zeros(len(body)), *mine)
        settings.setdefault(mine, []).extend(zip(hashes.tolist(), [t] * len(at), at.tolist()))
    indexes = {size: inverted(rows) for size, rows in settings.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for mine, number, start, end in text_words(t.as_py() or "" for t in batch.column(1)):
                tried = set()
                for size, (kinds, first, count, owners, at, maybe) in indexes.items():
                    marks, spot = fingerprints(mine, end - start, number, *size)
                    some = np.flatnonzero(maybe[(marks >> U(40)).astype(np.int64) & 0xFFFFF])
                    kind = places(kinds, marks[some])
                    some, kind = spot[some[kind >= 0]], kind[kind >= 0]
                    tried.update((int(owners[s]), w - int(at[s]), int(number[w])) for w, k in zip(some.tolist(), kind.tolist()) for s in range(first[k], first[k] + count[k]))
                for t, diagonal, doc in sorted(tried):
                    body = words[t]
                    band = 4 + len(body) // 8
                    lo = max(diagonal - band, int(np.searchsorted(number, doc)))
                    hi = min(diagonal + len(body) + band, int(np.searchsorted(number, doc, "right")))
                    if np.isin(body, mine[lo:hi]).sum() < needs[t]:
                        continue
                    matched, a, b = align(body, np.concatenate((np.zeros(max(0, lo - (diagonal - band)), U), mine[lo:hi])), band)
                    if matched >= needs[t]:
                        shift = diagonal - band
                        out.append((doc, names[t], matched / len(body), matched, int(start[shift + a]), int(end[shift + b])))
            out = settled(out)
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), *[pa.array(c, pa.int64()) for c in cols[3:]]], names=["key", "template", "coverage", "matched_words", "start", "end"])

    return work


def scan(docs: DataFrame, templates: list[tuple[str, str]] | tuple = TEMPLATES, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, template, coverage, matched_words, start, end): stretches that hold `coverage` of a template's words in order.

    Spans are code points of the whole text; of overlapping matches the largest counts. Null and empty texts match nothing; repeated rows match each for
    themselves. Templates go to every task and may hold 16 million characters together; templates of fewer than 12
    letters and digits are refused, as they are met by chance. Other columns are not read.
    """
    if sum(len(t) for _, t in templates) > TEMPLATE_CHARS:
        raise ValueError("templates exceed the size that goes to every task: scan them in groups")
    short = [n for n, t in templates if sum(c.isalnum() for c in t) < LEAST_CHARS]
    if short:
        raise ValueError(f"templates too short to tell: {short}")
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    found = by_tasks(slim, scanner(list(templates), coverage), f"key {kind}, template string, coverage double, matched_words long, start long, end long")
    return found.withColumnRenamed("key", id_col)

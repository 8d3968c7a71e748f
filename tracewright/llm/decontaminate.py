"""Benchmark decontamination by greedy string tiling.

Every document is rolled through Karp-Rabin hashes of `least` tokens and joined to the items' hashes on them. Along a
diagonal, consecutive shared hashes are one match; the longest match of free tokens is marked as a tile again and again.
Tiles may lie in any order, so reordered passages keep their coverage. Items too short for a run count as one. Items come in blocks of bounded size; each block
is one pass over all documents, and nothing of the documents is moved.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewright.llm.common import by_tasks, pieces
from tracewright.llm.words import U, letter_words, mix, places, span_hashes

BLOCK_CHARS = 8_000_000


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-case letter and digit runs of all texts, and the number of the text of each."""
    hashes, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for numbers, _, group in pieces(texts):
        _, prefix, starts, ends, owner = letter_words(group, digits=True)
        hashes.append(span_hashes(prefix, starts, ends))
        owners.append(np.array(numbers)[owner] if len(owner) else owner)
    return np.concatenate(hashes), np.concatenate(owners)


def rolled(words: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `least` tokens within one text, and its first token's place."""
    n = len(words) - least + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(n, U)
    for i in range(least):
        total = total * U(0x9E3779B97F4A7C15) + words[i : n + i]
    inside = np.flatnonzero(owner[:n] == owner[least - 1 :])
    return mix(total[inside]), inside


def tile(seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, length) from shared runs of `least` tokens, longest first.

    Equal lengths are taken in order of the document, then of the item.
    """
    heap: list[tuple[int, int, int]] = []
    seeds = sorted(seeds, key=lambda s: (s[0] - s[1], s[0]))
    i = 0
    while i < len(seeds):
        j = i
        while j + 1 < len(seeds) and seeds[j + 1][0] - seeds[j + 1][1] == seeds[i][0] - seeds[i][1] and seeds[j + 1][0] == seeds[j][0] + 1:
            j += 1
        heap.append((-(j - i + least), *seeds[i]))
        i = j + 1
    heapq.heapify(heap)
    doc_marked: set[int] = set()
    item_marked: set[int] = set()
    tiles = []
    while heap:
        length, p, q = heapq.heappop(heap)
        free = [p + k not in doc_marked and q + k not in item_marked for k in range(-length)]
        if all(free):
            tiles.append((p, q, -length))
            doc_marked.update(range(p, p - length))
            item_marked.update(range(q, q - length))
            continue
        k = 0
        while k < len(free):
            run = k
            while run < len(free) and free[run]:
                run += 1
            if run - k >= least:
                heapq.heappush(heap, (-(run - k), p + k, q + k))
            k = run + 1
    return tiles


class Runs:
    """Hashes of the items' runs of `least` tokens: the distinct ones, and the item and place of every occurrence."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, least: int):
        hashes, at = rolled(words, owner, least)
        order = np.argsort(hashes, kind="stable")
        at = at[order]
        self.kinds, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.item, self.place = owner[at], at - np.searchsorted(owner, owner[at])
        # A table of 2^20 bits lets most runs of a document through without a search.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.kinds >> U(44)).astype(np.int64)] = True

    def shared(self, runs: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kind and place of those runs of documents that occur in an item."""
        some = np.flatnonzero(self.maybe[(runs >> U(44)).astype(np.int64)])
        kind = places(self.kinds, runs[some])
        return kind[kind >= 0], where[some[kind >= 0]]

    def occurrences(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into `kinds` and into the items' occurrences, for all occurrences of these kinds."""
        reps = self.count[kinds]
        which = np.repeat(np.arange(len(kinds)), reps)
        return which, np.arange(len(which)) + np.repeat(self.first[kinds] - np.cumsum(reps) + reps, reps)


def tiler(items: list[tuple[object, str]], least: int, threshold: float, item_type: pa.DataType = pa.int64()):
    """Task function for one block of items: (key, item, coverage, tiles) of each document and item above the threshold.

    Per document each shared run is first met with its places in the items alone, which bounds what tiles can cover of an
    item; only for items that may reach the threshold are places of both sides paired, one item after another. An item of
    fewer than `least` tokens is one run of its own length.
    """
    words, owner = tokens([t for _, t in items])
    sizes = np.bincount(owner, minlength=len(items))
    names = [k for k, _ in items]
    long = Runs(words, owner, least)
    short = {n: Runs(words[sizes[owner] == n], owner[sizes[owner] == n], n) for n in range(1, least) if n in sizes}
    parts = pa.struct([("doc_token", pa.int64()), ("item_token", pa.int64()), ("length", pa.int64())])

    def whole(kind: np.ndarray, where: np.ndarray, n: int) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        kinds, at = np.unique(kind, return_index=True)
        which, seed = short[n].occurrences(kinds)
        for w, i in zip(which.tolist(), short[n].item[seed].tolist()):
            yield i, 1.0, [(int(where[at[w]]), 0, n)]

    def tiled(kind: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, float, list[tuple[int, int, int]]]]:
        turn = np.argsort(kind, kind="stable")
        kind, where = kind[turn], where[turn]
        kinds, begin = np.unique(kind, return_index=True)
        end = np.append(begin[1:], len(kind))
        which, seed = long.occurrences(kinds)
        item, q = long.item[seed], long.place[seed]
        turn = np.lexsort((q, item))
        which, item, q = which[turn], item[turn], q[turn]
        edge = np.concatenate(([0], np.flatnonzero(np.diff(item)) + 1, [len(item)]))
        # Tiles cover at most the item tokens under any shared run.
        step = np.append(np.minimum(np.diff(q), least), least)
        step[edge[1:] - 1] = least
        under = np.add.reduceat(step, edge[:-1])
        mine = item[edge[:-1]]
        for g in np.flatnonzero(under >= threshold * sizes[mine]).tolist():
            i, size = int(mine[g]), int(sizes[mine[g]])
            seeds = [(p, b) for w, b in zip(which[edge[g] : edge[g + 1]].tolist(), q[edge[g] : edge[g + 1]].tolist()) for p in where[begin[w] : end[w]].tolist()]
            tiles = tile(seeds, least)
            share = sum(t[2] for t in tiles) / size
            if share >= threshold:
                yield i, share, sorted(tiles)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for lo in range(0, batch.num_rows, 256):
                texts = [t.as_py() or "" for t in batch.column(1).slice(lo, 256)]
                mine, of = tokens(texts)
                begin = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts)))))
                for n, table in [*short.items(), (least, long)]:
                    kind, where = table.shared(*rolled(mine, of, n))
                    doc = of[where]
                    edge = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)])) if len(doc) else [0]
                    for x, y in zip(edge[:-1], edge[1:]):
                        d = int(doc[x])
                        found = tiled(kind[x:y], where[x:y] - begin[d]) if table is long else whole(kind[x:y], where[x:y] - begin[d], n)
                        out += [(lo + d, names[i], share, [dict(zip(("doc_token", "item_token", "length"), t)) for t in tiles]) for i, share, tiles in found]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(parts))], names=["key", "item", "coverage", "tiles"])

    return work


def blocks(items: DataFrame, item_col: str, text_col: str, size: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of about `size` characters, read one after another."""
    group, held = [], 0
    for row in items.select(item_col, text_col).filter(F.col(text_col).isNotNull()).toLocalIterator():
        group.append((row[0], row[1]))
        held += len(row[1])
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def contaminated(docs: DataFrame, items: DataFrame, least: int = 3, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, coverage, tiles, n_tiles, longest) where tiles of a document cover `threshold` of an item's tokens.

    An item of fewer than `least` tokens is found where all its tokens follow one another, once a document, at the first such
    place. Items without tokens and null texts match nothing. Repeated documents and repeated items give a row each. Ids of
    both sides may have any type. Empty tables give no rows. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = items.schema[item_col].dataType
    schema = f"key {docs.schema[id_col].dataType.simpleString()}, item {kind.simpleString()}, coverage double, tiles array<struct<doc_token:long,item_token:long,length:long>>"
    found = None
    for block in blocks(items, item_col, item_text_col):
        part = by_tasks(slim, tiler(block, least, threshold, to_arrow_type(kind)), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.select(F.col("key").alias(id_col), F.col("item").alias(item_col), "coverage", "tiles", F.size("tiles").alias("n_tiles"), F.array_max("tiles.length").alias("longest"))

"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find grouping by star contraction.

1. Every document becomes its set of word shingles (64-bit hashes) and a SuperMinHash signature. In SuperMinHash the
   k-th draws of an element form a random permutation of the places, so early draws fill all places evenly; a document
   stops drawing as soon as no later draw can lower a value.
2. Documents with equal sets are one node from here on.
3. Nodes that share a band hash are candidates. No bucket lists all its pairs: first each member is compared with the
   bucket's smallest node, then, where members of one bucket are still in different components, each with its most
   alike member elsewhere, and last with all members of other components whose
   signatures leave a link possible. Buckets are cut into blocks of bounded size for this.
4. Candidates are confirmed on the full sets. Components come from alternating star contraction over tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import by_tasks
from tracewright.llm.words import BYTE_CODE, U, mix, prefix_sums, runs, span_hashes
from tracewright.session import cut_lineage

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PLACES, ROWS = 128, 4
GROUP_BYTES = 1 << 19
FLOOR_MISS = 1e-9


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, one without words none."""
    parts, at = [], 0
    while at < len(text):  # in blocks that end between words, so that memory follows the words, not eight-fold the bytes
        end = min(len(text), at + (1 << 20))
        while end < len(text) and text[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            end += 1
        block = np.frombuffer(text[at:end].translate(LOWER), np.uint8)
        starts, ends = runs(~SPACE[block])
        parts.append(span_hashes(prefix_sums(BYTE_CODE[block]), starts, ends))
        at = end
    return shingles(np.concatenate(parts) if parts else np.zeros(0, U), size)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    rolled = np.full(n - width + 1, width, U)
    for i in range(width):
        rolled = rolled * U(0x9E3779B97F4A7C15) + words[i : n - width + 1 + i]
    return np.unique(mix(rolled))


def super_minhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures (one row per non-empty set). A value is draw number * 2^24 + 24 random bits."""
    sizes = np.array([len(s) for s in sets])
    out = np.full(len(sets) * places, 0xFFFFFFFF, np.uint32)
    owner, seeds = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    perm = None
    for j in range(places):
        drawn = mix(seeds + U((j + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        value = np.uint32(j << 24) | (drawn >> U(40)).astype(np.uint32)
        at = j + ((drawn & U(0xFFFFFFFF)) * U(places - j) >> U(32)).astype(np.int64)
        if perm is None:
            place = at
        else:
            line = np.arange(len(seeds))
            place = perm[line, at].astype(np.int64)
            perm[line, at] = perm[:, j]
        np.minimum.at(out, owner * places + place, value)
        open_sets = out.reshape(-1, places).max(axis=1) >= np.uint32(j + 1 << 24) if j + 1 < places else np.zeros(len(sets), bool)
        if not open_sets.any():
            break
        keep = open_sets[owner]
        if perm is None:
            owner, seeds, first = owner[keep], seeds[keep], at[keep]
            perm = np.broadcast_to(np.arange(places, dtype=np.uint8), (len(seeds), places)).copy()
            perm[np.arange(len(seeds)), first] = 0
        elif not keep.all():
            owner, seeds, perm = owner[keep], seeds[keep], perm[keep]
    return out.reshape(-1, places)


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    shaped = signatures.reshape(len(signatures), -1, rows).astype(U)
    mixed = np.broadcast_to(np.arange(1, shaped.shape[1] + 1, dtype=U), shaped.shape[:2]).copy()
    for r in range(rows):
        mixed = mix(mixed * U(0x9E3779B97F4A7C15) + shaped[:, :, r])
    return mixed.view(np.int64)


def sketch(size: int, places: int, rows: int):
    """Task function: key, text hash, set size, digest of the set, one byte per signature place, band hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            marks = batch.column(2)
            at = 0
            while at < len(texts):
                sets, first, held = [], at, 0
                while at < len(texts) and held < GROUP_BYTES:
                    raw = (texts[at].as_py() or "").encode("utf-8", "surrogatepass")
                    sets.append(shingle_hashes(raw, size))
                    held += len(raw)
                    at += 1
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs = super_minhash([sets[i] for i in full], places) if full else np.zeros((0, places), np.uint32)
                bands = iter(band_hashes(sigs, rows))
                low = iter((sigs & np.uint32(0xFF)).astype(np.uint8))
                digests, lows, hashes = [], [], []
                for s in sets:
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    lows.append(next(low).tobytes() if len(s) else None)
                    hashes.append(next(bands) if len(s) else None)
                keys = batch.column(0).slice(first, at - first)
                yield pa.RecordBatch.from_arrays([keys, marks.slice(first, at - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(lows, pa.binary()), pa.array([None if h is None else h.tobytes() for h in hashes], pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], names=["key", "th", "n", "digest", "low", "bands", "each"])

    return work


MET = "hash long, lo int, hi int, id long, comp long, n long, low binary, bands binary"


def alike(mode: str, floor: float, percent: int, size: int | None = None):
    """Task function over rows `MET` sorted by block pair: what is still to be compared across components.

    `best`: each node with its most alike node of another component. `all`: every such pair whose estimated similarity
    reaches `floor`. Pairs inside one component are settled and skipped, as are sizes too far apart to link; a pair is
    looked at only in the first band that it shares. Without `size` the rows that take part in a pair are returned;
    with it the rows end in their text, and the links (a, b) confirmed on the full sets are. Blocks have bounded size.
    """

    def pairs(block: list[np.ndarray], bucket: int) -> tuple[np.ndarray, np.ndarray]:
        ids, comp, n, low, bands = block[:5]
        left, right, value = [], [], []
        step = max(1, (1 << 22) // low.size)
        for i in range(0, len(ids), step):
            near = (low[i : i + step, None, :] == low[None, :, :]).mean(axis=2)
            mine = n[i : i + step, None]
            near[(comp[i : i + step, None] == comp[None, :]) | (100 * np.minimum(mine, n) < percent * np.maximum(mine, n))] = -1.0
            if mode == "best":
                y = near.argmax(axis=1)
                x = np.arange(len(near))
                x, y = x[near[x, y] >= floor], y[near[x, y] >= floor]
            else:
                x, y = np.nonzero(near >= floor)
                x, y = x[x + i < y], y[x + i < y]
            left.append(x + i)
            right.append(y)
            value.append(near[x, y])
        x, y, value = np.concatenate(left), np.concatenate(right), np.concatenate(value)
        first = [np.flatnonzero(bands[i] == bands[j])[0] for i, j in zip(x, y)]
        here = np.array([bands[i][k] == bucket for i, k in zip(x, first)], bool)
        order = np.argsort(-value[here], kind="stable")
        return x[here][order], y[here][order]

    def linked(block: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        ids, comp, texts = block[0], block[1].tolist(), block[5]
        up = {c: c for c in comp}
        sets: dict[int, np.ndarray] = {}
        found = []

        def top(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        for i, j in zip(x.tolist(), y.tolist()):
            if top(comp[i]) == top(comp[j]):
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingle_hashes((texts[k] or "").encode("utf-8", "surrogatepass"), size)
            if similar(sets[i], sets[j], percent):
                up[top(comp[i])] = top(comp[j])
                found.append((int(ids[i]), int(ids[j])))
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            block = [np.concatenate(c) for c in zip(*held)]
            if (block[1] == block[1][0]).all():
                return
            x, y = pairs(block, key[0])
            if size is not None:
                links = linked(block, x, y)
                if links:
                    a, b = zip(*links)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            elif len(x):
                some = np.unique(np.concatenate((x, y)))
                cols = [pa.array(np.full(len(some), k), t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()))]
                cols += [pa.array(c[some]) for c in block[:3]] + [pa.array([r.tobytes() for r in c[some]], pa.binary()) for c in block[3:5]]
                yield pa.RecordBatch.from_arrays(cols, names=["hash", "lo", "hi", "id", "comp", "n", "low", "bands"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cols = [batch.column(i).to_numpy() for i in (3, 4, 5)]
            cols += [np.frombuffer(b"".join(batch.column(i).to_pylist()), t).reshape(len(keys), -1) for i, t in ((6, np.uint8), (7, np.int64))]
            if size is not None:
                cols.append(np.array(batch.column(8).to_pylist(), object))
            edges = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for x, y in zip(edges[:-1], edges[1:]):
                if key is not None and tuple(keys[x].tolist()) != key:
                    yield from settle()
                    held = []
                key = tuple(keys[x].tolist())
                held.append([c[x:y] for c in cols])
        if held:
            yield from settle()

    return work


def lowest_estimate(percent: int, places: int, miss: float = FLOOR_MISS) -> float:
    """The share of equal places that a pair at the threshold undercuts with probability `miss` at most.

    Counted for independent places; those of SuperMinHash vary less.
    """
    p, below, count = percent / 100, 0.0, 0
    while count < places and (below := below + comb(places, count) * p**count * (1 - p) ** (places - count)) <= miss:
        count += 1
    return count / places


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def confirm(size: int, percent: int):
    """Task function over rows (a, b, text_a, text_b): the pairs that are linked on their full sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def set_of(key: int, text) -> np.ndarray:
            if key not in held:
                if len(held) >= 64:
                    held.clear()
                held[key] = shingle_hashes((text.as_py() or "").encode("utf-8", "surrogatepass"), size)
            return held[key]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for i in range(batch.num_rows):
                x, y = set_of(a[i], batch.column(2)[i]), set_of(b[i], batch.column(3)[i])
                linked.append(similar(x, y, percent))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return work


def components(links: DataFrame, per_task: int = 200_000) -> DataFrame:
    """(id, comp) for every end of the links (a, b): comp is the smallest id of its connected component.

    Alternating large and small stars over tables: edges move towards the smallest neighbour until each id has one
    centre and no centre has one itself. Tables of few edges are handled by few tasks.
    """
    stars = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    stars = cut_lineage(stars)
    edges = stars.count()
    while True:
        tasks = edges // per_task + 1
        stars = stars.coalesce(tasks)
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").coalesce(tasks)
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")).coalesce(tasks))
        stars = cut_lineage(small.filter("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        edges = stars.count()
        inner = stars.join(stars.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        if stars.select("u").distinct().count() == edges and inner.isEmpty():
            break
    members = stars.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return members.union(stars.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def grouped_sets(docs: DataFrame, size: int, percent: int, places: int, rows: int, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows (key, th, n, digest, ...), and every distinct set: (digest, first_key, first_row, comp).

    `first_row` is the (nameless, key, th) of the set's row with the smallest id, rows without id last, then the smallest text hash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    hashed = slim.select("key", "text", F.xxhash64("text").alias("th"))
    sketches = by_tasks(hashed, sketch(size, places, rows), f"key {kind}, th long, n long, digest binary, low binary, bands binary, each array<long>")
    sketches = cut_lineage(sketches.withColumn("row", F.monotonically_increasing_id()))
    # A node is a distinct set, named by its first row.
    sets = sketches.filter("n > 0").groupBy("digest").agg(F.min("row").alias("id"), F.min("key").alias("first_key"), F.min(F.struct(F.col("key").isNull().alias("nameless"), "key", "th")).alias("first_row"))
    nodes = sketches.join(sets.select(F.col("id").alias("row")), "row").select(F.col("row").alias("id"), "key", "th", "n", "low", "bands", "each")
    banded = nodes.select("id", F.explode("each").alias("hash"))
    shared = banded.groupBy("hash").agg(F.count("*").alias("members"), F.min("id").alias("head")).filter("members > 1")
    buckets = cut_lineage(banded.join(shared, "hash"))
    # Signature and text of the nodes that meet another one, written once for all rounds.
    wanted = nodes.select("id", "key", "th", F.col("n").alias("size"), "low", "bands").join(buckets.select("id").distinct(), "id").withColumnRenamed("key", "k").withColumnRenamed("th", "t")
    facts = hashed.join(wanted, F.col("key").eqNullSafe(F.col("k")) & (F.col("th") == F.col("t"))).dropDuplicates(["key", "th", "id"])
    facts = cut_lineage(facts.select("id", F.col("size").alias("n"), "low", "bands", "text"))

    def verified(pairs: DataFrame) -> DataFrame:
        first = facts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        second = facts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        sided = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
        return by_tasks(sided, confirm(size, percent), "a long, b long")

    links = cut_lineage(verified(buckets.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()))
    floor = lowest_estimate(percent, places)
    for mode in ("best", "all"):
        labelled = buckets.select("hash", "members", "id").join(components(links), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        # In a bucket of two the only pair was compared with the head.
        mixed = labelled.filter("members > 2").groupBy("hash").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("hash")
        open_rows = labelled.join(mixed, "hash").join(facts.select("id", "n", "low", "bands"), "id")
        # A bucket of k blocks is compared block against block, so that no group exceeds two blocks.
        k = F.expr(f"cast((members + {block - 1}) div {block} as int)")
        spread = open_rows.withColumn("mine", F.pmod(F.xxhash64("id"), k).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
        spread = spread.select("hash", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "id", "comp", "n", "low", "bands")
        met = spread.repartition("hash", "lo", "hi").sortWithinPartitions("hash", "lo", "hi")
        involved = by_tasks(met, alike(mode, floor, percent), MET).join(facts.select("id", "text"), "id").select("hash", "lo", "hi", "id", "comp", "n", "low", "bands", "text")
        again = involved.repartition("hash", "lo", "hi").sortWithinPartitions("hash", "lo", "hi")
        more = cut_lineage(by_tasks(again, alike(mode, floor, percent, size), "a long, b long"))
        links = links.union(more)
    return sketches, sets.join(components(links), "id", "left").select("digest", "first_key", "first_row", F.coalesce("comp", "id").alias("comp"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, places: int = PLACES, rows: int = ROWS, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: linked where 100 * shared shingles >= percent * all shingles.

    Texts that are null or hold no word have no shingles and stay alone. Every row is a document of its own, also where
    rows repeat an id. Rows without id take part; a component without any id has a null component_id and is kept whole.
    A pair at the threshold is missed by the bands with probability (1 - 0.8^4)^32 < 4.8e-8. Pairs away from their bucket's
    smallest node are confirmed from a floor of the signature on (0.57), which misses 1e-9 at most: below 5e-8 together. An empty
    table gives no rows.
    """
    sketches, grouped = grouped_sets(docs, size, percent, places, rows, block, id_col, text_col)
    heads = grouped.groupBy("comp").agg(F.min("first_key").alias("component"))
    named = grouped.join(heads, "comp").select("digest", "component")
    out = sketches.select("key", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(component.isNull(), True).otherwise(F.coalesce(F.col("key") == component, F.lit(False))).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, places: int = PLACES, rows: int = ROWS, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, th): id and xxhash64 of the text of the rows to keep, one of each component and every text without shingles.

    A component keeps its text of the smallest id, also where that id has other texts; texts without id come last, and of
    one id's texts in the component the smallest hash counts. Rows of equal id and text are one here.
    """
    sketches, grouped = grouped_sets(docs, size, percent, places, rows, block, id_col, text_col)
    heads = grouped.groupBy("comp").agg(F.min("first_row").alias("row")).select("row.key", "row.th")
    return heads.union(sketches.filter("n = 0").select("key", "th")).distinct()

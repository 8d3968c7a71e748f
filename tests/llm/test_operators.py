"""Each operator against brute force or a round trip, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import gzip
import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import decontaminate, langid, licenses, merkle, neardup, packing, quality, registry, sharding, tokens, toxicity, warc, words

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, n long"
RNG = random.Random(5)
PROSE = " ".join(RNG.choice("the of and river stone light window garden paper quiet morning letter").capitalize() if i % 9 == 0 else RNG.choice("river stone light window garden paper quiet morning letter salt".split()) + ("." if i % 9 == 8 else "") for i in range(120))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty text, one without letters, a long one, repeated rows, one id with two texts, a row without id."""
    texts = [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, "12 ?!"), (6, "word " * 40_000), (7, PROSE + " end"), (8, "Öl\n\nund\tÉlan."), (8, "other text of id eight"), (None, PROSE + " x"), (9, "a"), (10, "x" * 30_000)]
    return spark.createDataFrame([(i, t, None if t is None else "en", None, None, "k", "s", 1) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.tokenizer_path("word_bpe_49k.json")


def test_shards(odd, nothing):
    rows = sharding.shard_by_bytes(odd, shards=4).collect()
    assert len(rows) == odd.count() and sharding.shard_by_bytes(nothing).collect() == []
    total = sum(r["size"] for r in rows)
    ordered = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
    before, seen = 0, {}
    for r in ordered:
        assert r["shard"] == min(3, (2 * before + r["size"]) * 4 // (2 * total))
        before += r["size"]
        seen.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in seen.values())
    sizes = {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows}
    assert {(3, 8, 0), (4, 8, 0), (9, 9, zlib.crc32(b"a")), (8, 8 + len("Öl\n\nund\tÉlan.".encode()), zlib.crc32("Öl\n\nund\tÉlan.".encode()))} <= sizes


def test_fingerprints(odd, nothing):
    assert merkle.edited_fingerprints(nothing).collect() == []
    rows = merkle.edited_fingerprints(odd).collect()
    assert len(rows) == odd.count()
    source = {(r["doc_id"], r["text"] or "") for r in odd.collect()}
    by_fingerprint = {}
    for r in rows:
        fits = [t for i, t in source if i == r["doc_id"] and len(t) == r["n_chars"]]
        by_fingerprint.setdefault(r["fingerprint"], set()).update(fits)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_fingerprint.values())
    nine = next(r for r in rows if r["doc_id"] == 9)
    assert nine["edited_sha256"] == hashlib.sha256(b"a").hexdigest() and nine["fingerprint"] == nine["edited_fingerprint"] and nine["near_edited"] == 1
    seven = next(r for r in rows if r["doc_id"] == 7)
    text = PROSE + " end"
    assert seven["edited_sha256"] == hashlib.sha256((text[: len(text) - len(text) // 3] + ("word " * 40_000)[: len(text) // 3]).encode()).hexdigest()
    assert seven["near_edited"] > seven["near_next"]


def test_differing_branches(spark):
    a = "\n".join(f"paragraph {i} of the text" for i in range(40))
    b = a.replace("paragraph 17 of", "paragraph 17 in")
    left, right = (merkle.trees(spark.createDataFrame([(1, t)], "doc_id long, text string")) for t in (a, b))
    row = merkle.differing(left, right).first()
    assert not row["equal"] and row["a_paragraphs"] == row["b_paragraphs"] == [17] and len(row["a_sections"]) <= 2
    assert merkle.differing(left, left).first()["equal"]


def test_token_ids_equal_the_tokenizer(tokenizer):
    cache = tokens.ChunkIds(tokenizer, limit=50)
    samples = [PROSE, "", "don't  STOP—now\x1cx", "Öl ẞ İ ŉ é é", "a1b2,c!! <|endoftext|> ##", "ÑÑ!! ß, x y z\x85w", "it's 'tis we'll 12.5%", "日本語 text", "😀😀 ok"] + ["".join(RNG.choice("aB'é,.!<| \n0ßÇ") for _ in range(60)) for _ in range(200)]
    for text in samples:
        assert cache.of(text) == cache._whole(text), text


def test_packing(odd, nothing, tokenizer):
    assert packing.pack(nothing, tokenizer).collect() == []
    rows = packing.pack(odd, tokenizer).collect()
    cache = tokens.chunk_ids(tokenizer)
    wanted = sorted(((r["doc_id"], cache.of(r["text"] or "") + b"\2\0\0\0") for r in odd.collect()), key=repr)
    assert sum(r["length"] for r in rows) == sum(len(i) // 4 for _, i in wanted)
    ids = {}
    for k, i in wanted:
        ids.setdefault(k, []).append(i)
    for r in rows:
        assert any(len(i) // 4 == r["doc_tokens"] and zlib.crc32(i[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for i in ids[r["doc_id"]])
    for group in {r["sequence_id"]: [x for x in rows if x["sequence_id"] == r["sequence_id"]] for r in rows}.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


@pytest.mark.parametrize("length", [1, 2, 15, 16, 17, 560, 1366, 2049, 4095, 4096, 4097, 50_000])
def test_cuts_cover_a_document(length):
    parts = packing.cuts(length, 4096, 256)
    assert [p[0] for p in parts] == list(np.cumsum([0] + [p[1] for p in parts])[:-1]) and sum(p[1] for p in parts) == length
    assert all(p[1] <= 4096 // p[2] for p in parts)


def grouped(texts, size, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = up[i], up[j]
            up = [min(a, b) if u in (a, b) else u for u in up]
    return [len(s) for s in sets], up


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_against_brute_force(spark, size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \t", "one two", "One TWO", "one two three"]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))] + rng.choice([[], shared])
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in neardup.near_duplicates(docs, size=size, block=16).collect()}
    counts, component = grouped(texts, size, 80)
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == counts
    assert [rows[i]["component_id"] for i in range(len(texts))] == component
    assert all(rows[i]["kept"] == (component[i] == i) for i in rows)


def test_near_duplicates_of_odd_rows(odd, nothing):
    assert neardup.near_duplicates(nothing).collect() == []
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows} >= {(1, 1, True), (2, 1, False), (None, 1, False), (3, 3, True), (4, 4, True), (7, 1, False)}


def test_a_pair_whose_signature_estimates_far_too_little_is_linked(spark):
    rng = random.Random(308)
    vocabulary = [str(rng.randrange(10**9)) for _ in range(1000)]
    pair = [vocabulary[:900], vocabulary[:800] + vocabulary[900:]]
    low = neardup.super_minhash([neardup.shingle_hashes(" ".join(w).encode(), 1) for w in pair]) & 0xFF
    assert (low[0] == low[1]).mean() < 0.68
    # Texts before them, like neither, so that the two meet only in buckets with another smallest node.
    others = [vocabulary[:800] + [f"o{i}x{k}" for k in range(400)] for i in range(40)]
    texts = [" ".join(w) for w in others + pair]
    rows = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), size=1).collect()}
    assert [rows[i]["component_id"] for i in range(42)] == [*range(41), 40] == grouped(texts, 1, 80)[1]
    assert neardup.lowest_estimate(80, 128) == 73 / 128


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    b = np.unique(np.concatenate((a[:270], rng.integers(0, 1 << 62, 30).astype(np.uint64))))
    one = neardup.super_minhash([a[:1], a, b, a])
    assert (one[1] == one[3]).all() and len(set((one[0] >> 24).tolist())) == 128
    assert abs((one[1] == one[2]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    found = {r["id"]: r["comp"] for r in neardup.components(links, per_task=10).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


def test_decontamination(spark, odd, nothing):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu."
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"start {item} end"), (2, "eta theta iota kappa lambda mu, and then ALPHA beta gamma delta epsilon zeta"), (3, "alpha beta only"), (4, None), (5, ""), (6, "alpha beta gamma x delta epsilon zeta")], "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (round(r["coverage"], 3), r["n_tiles"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(d, i): v for d, v in ((1, (1.0, 1)), (2, (1.0, 2)), (6, (0.5, 2))) for i in (1, 4)}
    assert decontaminate.contaminated(odd, items).collect() == decontaminate.contaminated(nothing, items).collect() == []
    assert decontaminate.contaminated(docs, items.limit(0)).collect() == []


def test_decontamination_against_brute_force(spark):
    rng = random.Random(17)
    words = ["red", "blue", "green", "teal", "Grey"]
    made = lambda least, most: " ".join(rng.choice(words) for _ in range(rng.randint(least, most)))
    texts = {f"d{i}": made(0, 25) for i in range(40)} | {"none": None, "long": "red " * 300}
    items = {f"i{i}": made(0, 9) for i in range(40)} | {"none": None, "one": "Grey", "two": "teal, blue", "stop": "...", "script": "\u6625\u7720"}
    texts["script"] = "a \u6625\u7720 b"
    split = lambda t: (t or "").lower().replace(",", " ").replace(".", " ").split()
    want = {}
    for d, i in ((d, i) for d in texts for i in items):
        a, b = split(texts[d]), split(items[i])
        if 0 < len(b) < 3:
            at = [p for p in range(len(a) - len(b) + 1) if a[p : p + len(b)] == b]
            tiles = [(at[0], 0, len(b))] if at else []
        else:
            tiles = decontaminate.tile([(p, q) for p in range(len(a) - 2) for q in range(len(b) - 2) if a[p : p + 3] == b[q : q + 3]], 3)
        if tiles and sum(t[2] for t in tiles) >= 0.5 * len(b):
            want[d, i] = sorted(tiles)
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(5)
    rows = decontaminate.contaminated(docs, spark.createDataFrame(list(items.items()), "item_id string, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): [tuple(t) for t in r["tiles"]] for r in rows} == want and len(rows) == len(want) > 100
    assert {("script", "script"), ("long", "i0")} & set(want) and any(i == "two" for _, i in want)


def test_tiles_are_greedy():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        seeds = [(i, j) for i in range(len(a) - 1) for j in range(len(b) - 1) if a[i : i + 2] == b[j : j + 2]]
        mark_a, mark_b, want = set(), set(), []
        while True:
            best = None
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in mark_a and j + n not in mark_b:
                        n += 1
                    if n >= 2 and (best is None or n > best[2]):
                        best = (i, j, n)
            if best is None:
                break
            want.append(best)
            mark_a |= set(range(best[0], best[0] + best[2]))
            mark_b |= set(range(best[1], best[1] + best[2]))
        assert decontaminate.tile(seeds, 2) == want


def test_licenses(spark, odd, nothing):
    mit = dict(licenses.TEMPLATES)["mit-grant"]
    docs = spark.createDataFrame([(1, f"x y z.\n{mit}\nmore"), (2, "A. Licensed under CC BY-NC 4.0. B. Released under the MIT Licence. C"), (3, mit.replace("without restriction", "with no restriction at all").upper()), (4, "permission is granted")], "doc_id long, text string")
    rows = {(r["doc_id"], r["template"]): r for r in licenses.scan(docs).collect()}
    assert set(rows) == {(1, "mit-grant"), (2, "cc-by-nc-4.0-notice"), (2, "mit-notice"), (3, "mit-grant")}
    one = rows[1, "mit-grant"]
    assert one["coverage"] == 1 and f"x y z.\n{mit}\nmore"[one["start"] : one["end"]] == mit and 0.9 < rows[3, "mit-grant"]["coverage"] < 1
    assert licenses.scan(odd).collect() == licenses.scan(nothing).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(docs, [("short", "MIT")])


def test_licenses_across_cuts_and_with_altered_words(spark):
    mit, notice = dict(licenses.TEMPLATES)["mit-grant"], "Released under an MIT License"
    long = [("salt river " * 100_000)[: (1 << 19) - k] + f". {mit} " + "stone " * 90_000 for k in (20, 150, 300)]
    solid = "." * ((1 << 19) - 5) + mit.replace(" ", "_") + "." * (1 << 19)
    docs = [(i, t) for i, t in enumerate([*long, solid, notice, "Licensed now under CC or BY - 4 and 0", "Licensed under CC", "Licensed. " * 3 + "Licensed under CC BY 4.0."])]
    rows = {(r["doc_id"], r["template"]): r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(rows) == {(i, "mit-grant") for i in range(4)} | {(4, "mit-notice"), (5, "cc-by-4.0-notice"), (7, "cc-by-4.0-notice")}
    assert all(rows[i, "mit-grant"]["coverage"] == 1 for i in range(4))
    assert all(docs[i][1][rows[i, "mit-grant"]["start"] : rows[i, "mit-grant"]["end"]] == mit for i in range(3))
    assert rows[4, "mit-notice"]["coverage"] == 0.8 and docs[7][1][rows[7, "cc-by-4.0-notice"]["start"] :] == "Licensed under CC BY 4.0."


def every_alignment(text, template, coverage=0.8):
    """Brute force: does any place of the text hold `coverage` of the template within the band?"""
    body, mine = (next(licenses.text_words([t]))[0] for t in (template, text))
    need, band = int(np.ceil(coverage * len(body) - 1e-9)), 4 + len(body) // 8
    padded = np.concatenate((np.zeros(len(body) + band, licenses.U), mine))
    return any(licenses.align(body, padded[i : i + len(body) + 2 * band], band)[0] >= need for i in range(len(padded)))


def test_winnowed_fingerprints_pick_every_altered_notice(spark):
    rng, texts, truth = random.Random(11), [], set()
    for name, template in licenses.TEMPLATES:
        plain = template.replace("-", " ").replace(".", " ").split()
        n = len(next(licenses.text_words([template]))[0])
        for _ in range(25):
            notice = list(plain)
            need = int(np.ceil(0.8 * n - 1e-9))
            for at in sorted(rng.sample(range(len(notice)), rng.randint(0, n - need)), reverse=True):
                notice[at : at + 1] = rng.choice(([], ["altered"]))
            for _ in range(rng.randint(0, -(-n // 10))):
                notice.insert(rng.randint(1, len(notice)), "added")
            texts.append(" ".join(["salt of the"] * 3 + notice + ["stone"] * 9))
            truth |= {(len(texts) - 1, name)} if every_alignment(texts[-1], template) else set()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = {(r["doc_id"], licenses.TEMPLATES[r["doc_id"] // 25][0]) for r in licenses.scan(docs).collect()}
    assert len(truth) > 200 and truth <= found
    alone = {t: {r["doc_id"] for r in licenses.scan(docs, [(t, b)]).collect()} for t, b in licenses.TEMPLATES[3:5]}
    assert all({d for d, name in truth if name == t} <= rows for t, rows in alone.items())


def test_windows_share_a_fingerprint_with_any_stretch_of_their_length():
    rng = np.random.default_rng(3)
    assert [licenses.setting(n, need) for n, need in ((5, 4), (40, 32), (100, 80), (100, 95), (10, 5))] == [(2, 1), (2, 2), (2, 2), (4, 3), (1, 1)]
    for gram, window in ((1, 1), (2, 1), (2, 2), (3, 2), (4, 3)):
        body, other = (rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (30, 40))
        run = gram + window - 1
        for start in range(30 - run + 1):
            text = np.concatenate((other[:7], body[start : start + run], other[7:]))
            owner = np.repeat([0, 1, 2], [6, run + 9, 25])
            marks = [set(licenses.fingerprints(w, (w % np.uint64(7)).astype(np.int64), o, gram, window)[0].tolist()) for w, o in ((body, np.zeros(30)), (text, owner))]
            assert marks[0] & marks[1]


def auc(rows, label):
    good, bad = ([r["score"] for r in rows if r[label] == v] for v in (1, 0))
    return np.mean([g > b for g in good for b in bad])


def test_toxicity(spark, odd, nothing):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        body = [" ".join(rng.choice(words_) for _ in range(8)) + "." for words_ in [PROSE.lower().replace(".", "").split()] * rng.randint(2, 6)]
        toxic = i % 4 == 0
        if toxic:
            body[rng.randrange(len(body))] = "you " + rng.choice(("vilename", "foulname")) + " person here."
        docs.append((i, " ".join(body)))
        labels.append((i, 1 if i else None, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.scored_fold(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert auc(rows, "toxic") > 0.99 and all(r["predicted"] == r["toxic"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all("name" in texts[r["doc_id"]][s["start"] : s["end"]] for r in rows for s in r["spans"])
    model = toxicity.fit(docs, labels)
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == odd.count() and {r["score"] for r in scores if r["doc_id"] in (3, 4, 5)} == {0.0}
    assert toxicity.score(nothing, model).collect() == []
    assert {r["predicted"] for r in toxicity.scored_fold(odd, labels.limit(0)).collect()} == {0}


def test_quality(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.scored_fold(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert auc(rows, "quality") > 0.95
    model = quality.fit(docs, labels)
    assert 0.7 < model.prior < 0.97
    scores = quality.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.score(nothing, model).collect() == [] and quality.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(odd, None).collect()} == {0.0}


def test_language(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predicted_fold(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95
    model = langid.fit(docs)
    found = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert len(langid.predict(odd, model).collect()) == odd.count()
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (3, 4, 5))
    assert langid.predict(nothing, model).collect() == []
    assert {r["lang_pred"] for r in langid.predicted_fold(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_unseen_words_back_off_to_shorter_grams():
    model = langid.Model(["a", "b"], (np.zeros(0, np.uint64), np.zeros((0, 2))), {})
    for size in range(1, 5):
        _, prefix, starts, ends, _ = langid.framed(["qu" if size < 3 else "zzzzz"])
        hashes, _ = langid.gram_hashes(prefix, starts, ends, size)
        keys = np.unique(hashes)
        model.grams[size] = (keys, np.tile([[-1.0 * size, -2.0 * size]], (len(keys), 1)))
    _, prefix, starts, ends, _ = langid.framed(["quqqq zzzzzz u"])
    assert langid.word_scores(model, prefix, starts, ends).tolist() == [[-2, -4], [-4, -8], [-2, -4]]


def test_archives(spark):
    big = "é" * 60
    pages = spark.createDataFrame([(3, "u3", big, 1), (1, "u 1\r\nx", big, 1), (2, None, "short", 1), (4, "u4", "short", 1), (5, "u5", None, 1), (6, "u6", "", 1), (None, "u7", big, 1), (8, "u8", "WARC/1.1\r\nx\r\n\r\n" * 20, 1), (9, "u9", "x" * 3_000_000, 1)], "page_id long, url string, html string, key int")
    rows = warc.round_trip(pages).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows), key=repr)
    assert got == sorted([(3, 120, "revisit", 1), (1, 120, "response", None), (2, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (6, 0, "response", None), (None, 120, "revisit", 1), (8, 300, "response", None), (9, 3_000_000, "response", None)], key=repr)
    assert {r["payload_digest"] for r in rows if r["page_id"] in (1, 3)} == {hashlib.sha256(big.encode()).hexdigest()}
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_archives_are_rolled(spark, tmp_path):
    noise, size = random.Random(8), 1 << 16
    bodies = {i: noise.randbytes(n).hex() for i, n in enumerate([60, 3000, 200_000, 500, 0] + [700] * 900)}
    pages = spark.createDataFrame(list(bodies.items()), "page_id long, html string").withColumn("url", F.lit("u")).repartition(1)
    warc.write_archives(pages, str(tmp_path / "rolled"), file_bytes=size)
    sizes = [f.stat().st_size for f in (tmp_path / "rolled").glob("part-*")]
    largest = max(len(b) for b in bodies.values())
    assert len(sizes) > sum(sizes) / (3 * size) and sum(s > 2 * size for s in sizes) <= 1 and max(sizes) < largest + 2 * size
    rows = warc.read_archives(spark, str(tmp_path / "rolled")).collect()
    assert {r["kind"] for r in rows} == {"response"} and len(rows) == len(bodies)
    assert {int(r["record_id"][len("<urn:x-page:") : -1]): r["payload"].decode() for r in rows} == bodies


def test_salvage_of_damaged_archives():
    def plain(key, body):
        return warc.record("response", key, "u", body, hashlib.sha256(body).hexdigest(), len(body), None, "2024-01-01T00:00:00Z")

    records = [plain(i, b"body %d " % i * 50) for i in range(6)]
    for pack in (lambda r: gzip.compress(r, mtime=0), lambda r: r):
        members = [pack(r) for r in records]
        whole = b"".join(members)
        rows = list(warc.salvage(whole))
        assert [r["record_id"] for r in rows] == [warc.page_name(i) for i in range(6)] and sum(r["length"] for r in rows) == len(whole)
        hurt = bytearray(members[2])
        hurt[len(hurt) // 2] ^= 0xFF
        for damaged in (members[:2] + [bytes(hurt)] + members[3:], members[:2] + [members[2][:-9]] + members[3:], [b"junk\n", *members[:2], *members[3:]], members[:5] + [members[5][:40]]):
            data = b"".join(damaged)
            rows = list(warc.salvage(data))
            kept = [r["record_id"] for r in rows if r["kind"] != "gap"]
            gaps = [r for r in rows if r["kind"] == "gap"]
            assert len(kept) == 5 and len(gaps) == 1 and gaps[0]["reason"] and sum(r["length"] for r in rows) == len(data)
    assert list(warc.salvage(b"")) == [] and [r["kind"] for r in warc.salvage(b"no archive")] == ["gap"]


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_inside_a_member_of_many_records(level):
    noise = random.Random(4)

    def plain(key, url="u"):
        body = noise.randbytes(3000).hex().encode()
        return warc.record("response", key, url, body, hashlib.sha256(body).hexdigest(), len(body), None, "2024-01-01T00:00:00Z")

    records = [plain(i) for i in range(6)]
    member = gzip.compress(b"".join(records), level, mtime=0)
    after = gzip.compress(plain(6), level, mtime=0)
    hurt = bytearray(b"".join(records))
    hurt[len(records[0]) + len(records[1]) + 2000] ^= 1
    bad_record = gzip.compress(bytes(hurt), level, mtime=0)
    bad_sum = member[:-8] + bytes([member[-8] ^ 1]) + member[-7:]
    bad_byte = bytearray(member)
    bad_byte[len(member) // 2] ^= 0xFF
    for first, least in ((member, 6), (bad_record, 5), (bad_sum, 6), (member[: len(member) * 2 // 3], 3), (bytes(bad_byte), 2)):
        data = first + after
        rows = list(warc.salvage(data))
        kept = [r["record_id"] for r in rows if r["kind"] != "gap"]
        assert len(kept) == len(set(kept)) >= least + 1 and kept[-1] == warc.page_name(6)
        assert set(kept) <= {warc.page_name(i) for i in range(7)}
        assert [r["kind"] for r in rows].count("gap") >= (first != member) and all(r["offset"] == 0 and r["length"] == len(first) for r in rows[:-1])
    assert warc.page_name(2) not in [r.get("record_id") for r in warc.salvage(bad_record)]
    long = plain(7, "http://x/" + "y" * (3 << 20))
    assert [r["kind"] for r in warc.salvage(gzip.compress(long, 1) + long)] == ["response", "response"]


def test_span_hashes_do_not_depend_on_the_place():
    codes = words.BYTE_CODE[np.frombuffer(b"abc xyz abc", np.uint8)]
    a, b, c = words.span_hashes(words.prefix_sums(codes), np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert a == c != b


def test_pipeline(spark, odd, nothing):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert 0 < len({r["doc_id"] for r in rows}) <= docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        left = stage(spark, odd, SMALL)
        assert left.columns == odd.columns and left.count() <= odd.count()
        assert stage(spark, nothing, SMALL).collect() == []
    copies = corpus_pipeline.one_of_each_group(spark, odd.dropna(subset=["doc_id"]), SMALL).collect()
    assert sorted(r["doc_id"] for r in copies) == [1, 3, 4, 5, 6, 8, 8, 9, 10]
    some = docs.unionByName(odd.select(docs.columns).filter("doc_id in (3, 4, 5)").withColumn("doc_id", F.col("doc_id") + 10_000))
    assert sorted(r["doc_id"] for r in some.join(corpus_pipeline.in_a_language(spark, some, SMALL), "doc_id", "left_anti").collect()) == [10_003, 10_004, 10_005]
    toxic = spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 0").join(docs, "doc_id")
    assert corpus_pipeline.without_toxic(spark, docs, SMALL).join(toxic, "doc_id", "left_semi").count() >= 0.97 * toxic.count()
    leaks = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    clean = {r["doc_id"] for r in corpus_pipeline.without_benchmarks(spark, docs, SMALL).collect()}
    assert leaks and clean == {r["doc_id"] for r in docs.collect()} - leaks
    assert sorted(registry.QUERIES) == sorted(f"op{n}" + k for n, k in ((1, "_sharding"), (2, "_license_scans"), (3, "_quality_classifier"), (4, "_document_fingerprints"), (5, "_packing"), (6, "_minhash_near_dedup"), (7, "_benchmark_decontamination"), (8, "_toxicity"), (9, "_language_id"), (10, "_warc"), (11, "_merkle_dataset_manifest"), (12, "_pii"), (13, "_filter_interaction_audit")))


def left_of_groups(rows):
    """(id, text) of the rows that one_of_each_group keeps, by brute force, with the kept text of an id's equals left open: a set of choices a group."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    counts, component = grouped([t for _, t in distinct], 5, 80)
    groups = {}
    for row, n, c in zip(distinct, counts, component):
        groups.setdefault(("alone", row) if n == 0 else c, []).append(row)
    return [{r for r in g if r[0] == min(g, key=lambda r: (r[0] is None, r[0] or 0))[0]} for g in groups.values()]


def test_pipeline_keeps_one_row_of_each_group(spark, tmp_path):
    rng = random.Random(11)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    some = [r.asDict() for r in docs.filter("length(text) > 300").orderBy("doc_id").limit(12).collect()]
    a, b, c, d = (r["text"] for r in some[:4])
    odd_rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c + " end"), (3, c), (None, d), (None, d + " end"), (None, d), (None, b + " more"), (4, None), (None, None), (None, ""), (5, "")]
    odd_rows += [(rng.choice([None, None, 20, 21, 22]), r["text"] + rng.choice(["", " x", " y z"])) for r in some[4:] for _ in range(4)]
    rng.shuffle(odd_rows)
    made = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in odd_rows], docs.select("doc_id", "text", "lang", "source", "n_chars").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))

    def fits(left, before):
        wanted = left_of_groups(before)
        return len(left) == len(wanted) and all(sum(r in g for r in left) == 1 for g in wanted)

    def pairs(df):
        return [(r["doc_id"], r["text"]) for r in df.collect()]

    assert fits(pairs(corpus_pipeline.one_of_each_group(spark, made, SMALL)), odd_rows)
    both = docs.select(made.columns).union(made).repartition(3)
    both.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    both = spark.read.parquet(f"{tmp_path}/documents.parquet")
    early = corpus_pipeline.in_a_language(spark, corpus_pipeline.without_toxic(spark, both, str(tmp_path)), str(tmp_path))
    unique = corpus_pipeline.one_of_each_group(spark, early, str(tmp_path)).cache()
    assert fits(pairs(unique), pairs(early))
    ids = tokens.chunk_ids(tokens.tokenizer_path("word_bpe_49k.json"))
    clean = pairs(corpus_pipeline.without_benchmarks(spark, unique, str(tmp_path)))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((repr(r["doc_id"]), r["doc_tokens"]) for r in packed if r["start"] == 0) == sorted((repr(i), len(ids.of(t or "")) // 4 + 1) for i, t in clean)

"""Merkle manifest against a plain tree over all rows; nulls, lone leaves, repeated rows, short last runs, empty tables."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracewright.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, root string"


def sha(joined):
    return hashlib.sha256(joined.encode()).hexdigest()


def leaf_of(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path_of(tree, i):
    out = []
    for level in tree[:-1]:
        run, at = level[i // 8 * 8 : i // 8 * 8 + 8], i % 8
        out.append(("".join(run[:at]), "".join(run[at + 1 :])))
        i //= 8
    return out


def expected(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), r))
    names = sorted(by_lang, key=lambda name: (name is not None, (name or "").encode()))
    for name in names:
        by_lang[name].sort(key=lambda x: x[:3])
    trees = {name: tree_of([x[2] for x in by_lang[name]]) for name in names}
    top = tree_of([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(by_lang[name]):
            path = path_of(trees[name], i) + path_of(top, k)
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if tampered and r.text is not None else r.text
            node = leaf_of(r, text)
            for before, behind in path:
                node = sha(before + node + behind)
            out.append((r.doc_id, leaf, trees[name][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 3])
def test_against_a_plain_tree(spark, levels):
    rng = random.Random(4)
    langs = [None, "", "en", "en", "en", "en", "z", "Ö", "1", *[f"l{i}" for i in range(9)]]
    rows = [(i if rng.random() < 0.9 else None, rng.choice([None, "", "Some Text", "ÄB cD", "x" * 5000]), rng.choice(langs), rng.choice([None, "s", "it's: 5"]), rng.choice([None, 3]), "n", "r") for i in range(700)]
    rows += [(5, "one", "alone", None, 1, None, None)] + [(9, "Same Row", "en", "s", 1, None, None)] * 20 + [(9, "other", "en", "s", 1, None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in manifest.tamper_audit(docs, levels).collect()]
    assert sorted(got, key=repr) == expected(docs.collect())
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_shapes_of_one_tree(spark, n):
    docs = spark.createDataFrame([(i, f"Text {i}", "en", "s", i, None, None) for i in range(n)], SCHEMA)
    assert sorted((tuple(r) for r in manifest.tamper_audit(docs, 1).collect()), key=repr) == expected(docs.collect())


def test_no_rows(spark):
    assert manifest.tamper_audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_witness_rejects_another_leaf_and_place(spark):
    leaves = spark.createDataFrame([("a", i, sha(str(i))) for i in range(70)], "part string, i long, node string")
    rows = manifest.manifest(leaves, "part", "i").withColumns({
        "own": manifest.folded(F.col("node"), F.col("witness")) == F.col("root"),
        "other": manifest.folded(F.lit(sha("x")), F.col("witness")) == F.col("root"),
    })
    assert {(r["own"], r["other"]) for r in rows.collect()} == {(True, False)}
    assert [r["pos"] for r in rows.orderBy("i").collect()] == list(range(70))


def test_appended_witnesses_extend_as_siblings_complete():
    appender = manifest.Appender(3)
    for i in range(9):
        appender.append(sha(str(i)))
    assert [len(w) for w in appender.witnesses] == [1] * 8 + [0]
    root = appender.close()
    assert {len(w) for w in appender.witnesses} == {3}
    for i, witness in enumerate(appender.witnesses):
        node = sha(str(i))
        for before, behind in witness:
            node = sha(before + node + behind)
        assert node == root

"""Filter interactions against a plain replay of every order; nulls, copies over parts, rows without id, empty tables."""

import random
import re
from itertools import permutations

import numpy as np

from tracewright.llm import filteraudit

SCHEMA = "doc_id long, text string, lang string, n long, good boolean, first string"


def fails(text):
    said = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(said) < 100, 100 * len(set(said)) < 80 * len(said), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text))]


def replayed(docs, labels):
    marks = {}
    for r in labels:
        good, toxic = marks.get(r.doc_id, (False, False))
        marks[r.doc_id] = (good or r.quality == 1, toxic or r.toxic == 1)
    least = {}
    for r in docs:
        if r.doc_id is not None:
            least[r.text or ""] = min(r.doc_id, least.get(r.text or "", r.doc_id))
    parts = {}
    for r in docs:
        text = r.text or ""
        flags = fails(text) + [r.doc_id is not None and r.doc_id > least[text]]
        parts.setdefault(r.lang or "", []).append((flags, *(marks.get(r.doc_id, (False, False)) if r.doc_id is not None else (False, False))))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                i = "ABCDE".index(letter)
                gone = [r for r in left if r[0][i]]
                left = [r for r in left if not r[0][i]]
                shapley[letter] += len(gone)
                failing = [r for r in rows if r[0][i]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(r[0]) == 1 for r in failing), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_against_replay(spark):
    rng = random.Random(3)
    pool = [f"word{i}" for i in range(150)]
    texts = [None, "", "short", " ".join(pool), " ".join(pool).upper(), " ".join(pool) + " #", "same " * 200, "same " * 200 + "$ A", " ".join(pool[:120]), "\x0b\x85   x", "é" * 20_000]
    docs = [(i if rng.random() < 0.9 else None, rng.choice(texts) if rng.random() < 0.7 else " ".join(rng.sample(pool, 110)), rng.choice([None, "", "en", "de"]), 1, True, "f") for i in range(300)]
    docs += [(7, " ".join(pool), "en", 1, True, "f")] * 4
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(200)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    d, m = spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filteraudit.audit(d, m).collect()}
    assert got == replayed(d.collect(), m.collect()) and len(got) == 3 * 600


def test_no_rows_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(spark.createDataFrame([], SCHEMA), labels).collect() == []
    one = spark.createDataFrame([(1, None, None, 1, True, "f")], SCHEMA)
    rows = filteraudit.audit(one, labels).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""} and all(r["removed"] == (r["filter_order"][r["step"] - 1] == "A") for r in rows)


def test_contractions_of_fewer_filters():
    tensor = np.zeros((2, 2, 3), np.int64)
    tensor[0, 0], tensor[1, 0], tensor[0, 1], tensor[1, 1] = (5, 1, 0), (3, 1, 1), (2, 0, 1), (4, 2, 0)
    rows = {(r[0], r[1]): r[2:] for r in filteraudit.contractions(tensor, "XY")}
    assert rows["XY", 1] == (7, 7, 0, 3, 3, 1, 10) and rows["XY", 2] == (5, 2, 4, 2, 0, 1, 8) and rows["YX", 2] == (5, 3, 4, 3, 1, 1, 10)

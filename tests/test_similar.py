"""Similar descriptions: candidates of the token-set join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import joins


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def as_rows(spark, sets):
    """sets: (key, sig, tokens, side)"""
    return spark.createDataFrame([(k, s, sorted(t), side) for k, s, t, side in sets], "k string, __sig string, __tokens array<string>, side string")


def brute(sets, least):
    a = [x for x in sets if x[3] in "AX"]
    b = [x for x in sets if x[3] in "BX"]
    return {(x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and alike(x[2], y[2]) >= least}


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_no_similar_pair_is_lost(spark, least):
    rng = random.Random(int(least * 10))
    vocabulary = [f"w{i}" for i in range(30)]
    made = {}
    for i in range(260):
        tokens = frozenset(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(30)], k=rng.randint(0, 14)))
        made.setdefault((rng.choice("pq"), tokens), rng.choice("ABX"))
    sets = [(k, f"s{i}", t, side) for i, ((k, t), side) in enumerate(made.items())]
    rows = as_rows(spark, sets)
    got = joins.similar_claims(rows, ["k"], F.col("side").isin("A", "X"), F.col("side").isin("B", "X"), least).collect()
    assert {tuple(r) for r in got} == brute(sets, least) and len(got) == len(brute(sets, least)) > 20


@pytest.mark.parametrize("hot", [7, 4096])
def test_sizes_at_the_threshold(spark, hot):
    """Sets whose overlap is just the threshold, for all sizes at which a product with 0.3 is rounded."""
    sets = []
    for i, (n, shared) in enumerate((n, s) for n in range(1, 60) for s in range(1, n + 1) if 10 * s == 3 * (2 * n - s)):
        common = {f"c{i}-{j}" for j in range(shared)} if i % 2 else {f"all{j}" for j in range(shared)}
        sets += [("p", f"a{i}", common | {f"x{i}-{j}" for j in range(n - shared)}, "A"), ("p", f"b{i}", common | {f"y{i}-{j}" for j in range(n - shared)}, "B")]
    rows = as_rows(spark, sets).withColumns({"__a": F.col("side") == "A", "__b": F.col("side") == "B"})
    got = {tuple(r) for r in joins.candidate_claims(rows, ["k"], 0.3, hot).collect()}
    assert len(sets) > 4 and brute(sets, 0.3) <= got and len(got) <= 10 * len(brute(sets, 0.3))


def test_templates_give_few_candidates(spark):
    """Most findings on one artifact, written from two templates: one whose texts differ enough, one whose texts don't."""
    rng = random.Random(9)
    word = lambda: f"u{rng.randrange(10**9)}"
    base = [f"t{j}" for j in range(5)]
    sets = [("hot", f"s{i}", set(base) | {word() for _ in range(8)}, "AB"[i % 2]) for i in range(600)]
    sets += [("hot", f"r{i}", {"rare", "words", "of", "one", "family", word(), word()}, "AB"[i % 2]) for i in range(20)]
    sets += [(f"cold{i % 9}", f"c{i}", set(base) | {word() for _ in range(8)}, "AB"[i % 2]) for i in range(200)]
    rows = as_rows(spark, sets).withColumns({"__a": F.col("side") == "A", "__b": F.col("side") == "B"})
    want = brute(sets, 0.3)
    got = {tuple(r) for r in joins.candidate_claims(rows, ["k"], 0.3, hot=50).collect()}
    assert want <= got and len(want) == 100 and len(got) <= 10 * len(want)


def test_empty_and_null_sets(spark):
    rows = spark.createDataFrame([("p", "e", [], "A"), ("p", "e", [], "B"), ("q", "e", [], "A"), ("p", "n", None, "A"), (None, "z", ["a"], "A"), (None, "y", ["a"], "B")], "k string, __sig string, __tokens array<string>, side string")
    got = joins.similar_claims(rows, ["k"], F.col("side") == "A", F.col("side") == "B").collect()
    assert [tuple(r) for r in got] == [("p", "e", "e")]
    assert joins.similar_claims(rows.limit(0), ["k"], F.col("side") == "A", F.col("side") == "B").collect() == []

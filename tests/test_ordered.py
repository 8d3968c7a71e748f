import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import ordered, windows


def skewed(n, seed=1):
    """One key holds most rows; times repeat and gap widely."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}", rng.choice([rng.randrange(200), rng.randrange(5000)]), i) for i in range(n)]


@pytest.mark.parametrize("width", [1, 37, 400, 10**6])
@pytest.mark.parametrize("parts", [1, 7])
def test_previous_values_and_positions_equal_a_plain_scan(spark, width, parts):
    data = skewed(120)
    df = spark.createDataFrame(data, "k string, us long, id long").repartition(parts)
    got = {r["id"]: r["prev_id"] for r in ordered.previous_values(df, ["k"], ["us", "id"], ["id"], ordered.slot("us", width)).collect()}
    pos = {r["id"]: r["p"] for r in ordered.dense_index(df, ["k"], ["us", "id"], ordered.slot("us", width), "p").collect()}
    for key in {d[0] for d in data}:
        mine = sorted([d for d in data if d[0] == key], key=lambda d: (d[1], d[2]))
        for i, d in enumerate(mine):
            assert got[d[2]] == (mine[i - 1][2] if i else None)
            assert pos[d[2]] == i


@pytest.mark.parametrize("width", [1, 50, 10**6])
def test_asof_before_is_strict(spark, width):
    left, right = skewed(60, 2), skewed(60, 3)
    a = spark.createDataFrame(left, "k string, us long, id long")
    b = spark.createDataFrame(right, "k string, us long, rid long").groupBy("k", "us").agg(F.max("rid").alias("rid"))
    best = {}
    for r in b.collect():
        best[(r["k"], r["us"])] = r["rid"]
    for r in ordered.asof_before(a, b, ["k"], "us", ["rid", "us"], width, prefix="r_").collect():
        earlier = [t for (k, t) in best if k == r["k"] and t < r["us"]]
        assert r["r_us"] == (max(earlier) if earlier else None)
        assert r["r_rid"] == (best[(r["k"], max(earlier))] if earlier else None)


@pytest.mark.parametrize("gap", [1, 40, 5000])
def test_first_within_and_trailing_count(spark, gap):
    left, right = skewed(60, 4), skewed(60, 5)
    a, b = spark.createDataFrame(left, "k string, us long, id long"), spark.createDataFrame(right, "k string, us long, rid long")
    out = ordered.first_within(a, b, ["k"], "us", ["rid"], gap).collect()
    assert len(out) == 60
    for r in out:
        later = [t for k, t, _ in right if k == r["k"] and r["us"] < t <= r["us"] + gap]
        assert r["r_us"] == (min(later) if later else None)
    counted = ordered.trailing_count(a, ["k"], "us", F.col("id") % 2 == 0, gap, "n").collect()
    assert len(counted) == 60
    for r in counted:
        assert r["n"] == sum(1 for k, t, i in left if k == r["k"] and r["us"] - gap <= t <= r["us"] and i % 2 == 0)


@pytest.mark.parametrize("gap,spanned", [(60, 3000), (60, 200000), (1, 90), (1000, 10**6)])
def test_clusters_equal_a_plain_scan(spark, gap, spanned):
    rng = random.Random(gap + spanned)
    data = [(rng.randrange(spanned), f"h{rng.randrange(3)}") for _ in range(150)]
    df = spark.createDataFrame(data, "us long, host string").repartition(5)
    got = sorted(tuple(r) for r in windows.temporal_clusters(df, gap_us=gap).collect())
    want, cur = [], []
    for d in sorted(data) + [(10**12, "end")]:
        if cur and d[0] - cur[-1][0] > gap:
            if len({h for _, h in cur}) >= 2:
                want.append((cur[0][0], cur[-1][0], cur[-1][0] - cur[0][0], len({h for _, h in cur}), len(cur)))
            cur = []
        cur.append(d)
    assert got == sorted(want)


def test_events_exactly_one_gap_apart_chain(spark):
    df = spark.createDataFrame([(0, "a"), (60_000_000, "b"), (120_000_001, "c")], "us long, host string")
    assert [tuple(r) for r in windows.temporal_clusters(df).collect()] == [(0, 60_000_000, 60_000_000, 2, 2)]

"""Operators whose work must not grow faster than their input, or must not lie in a few tasks."""

import random
import re

from pyspark.sql import functions as F

from tracewright.functions import text, values
from tracewright.operators import aggregates, custody, joins, ordered
from tracewright.plans import stream_plans
from tracewright.sources import readers


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_give_the_rows_of_a_plain_join(spark):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None])
    left = spark.createDataFrame([(key(), i % 90) for i in range(120)], "k string, l long")
    right = spark.createDataFrame([(key(), i % 90) for i in range(150)], "k string, r long")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    got = joins.blocked_join(left, right, ["k"], rows=10)
    assert sorted(map(tuple, got.collect())) == want
    held = [r["count"] for r in got.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == 4 and max(held) < 2 * min(held) + 200


FINDING = "case_id string, finding_id string, pool_origin string, tool_call_id string, artifact_path string, confidence string, mitre_technique string, description string"


def test_partners_are_judged_where_they_meet(spark):
    rows = [("c", f"f{i}", "AB"[i % 2], "t" if i < 4 else "", "/p", "CONFIRMED" if i % 3 else "HYPOTHESIS", "T1", f"word{i} other{i}") for i in range(10)]
    df = spark.createDataFrame(rows, FINDING)
    out = joins.contradiction_partners(df, df)
    # No pair is moved: what is grouped are the chosen ids, under the joins.
    assert not re.search(r"^[ :+-]*Aggregate .*partner_id", plan_of(out), re.M)
    got = sorted(map(tuple, out.collect()))
    assert len(got) == 25 and ("c", "f0", "f1", "opposite_tier") in got
    # Rows that come twice give a pair once; of several findings of one id the last rule counts.
    again = spark.createDataFrame([*rows, *rows, ("c", "f0", "A", "", "/p", "CONFIRMED", "T1", "word1 other1")], FINDING)
    assert sorted(map(tuple, joins.contradiction_partners(again, again).collect())) == got


def test_texts_of_partners_are_tokenised_once_and_met_by_their_bits(spark):
    rows = [("c", f"f{i}", "AB"[i % 2], "t", "/p", "HYPOTHESIS", "T1", f"word{i} other{i}") for i in range(6)]
    df = spark.createDataFrame(rows, FINDING)
    plan = plan_of(joins.contradiction_partners(df, df))
    assert plan.count("regexp_extract_all") == 2
    # Token lists are compared once at most, after the bits.
    assert plan.count("array_intersect") == 2 and plan.index("bit_count") < plan.index("array_intersect")


def test_bits_never_tell_too_much(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    some = lambda: rng.choice([None, [], rng.sample(words[:12], rng.randrange(13)), rng.sample(words, rng.choice([3, 30, 60, 390])), rng.sample(words, 40)])
    # A share of exactly the limit is not below it.
    even = [([f"w{i}" for i in range(u - r)], [f"w{i}" for i in range(u - r - s, u - s)][:s] + [f"x{i}" for i in range(r)]) for u, s, r in ((10 * k, 3 * k, 7 * k) for k in range(1, 20))]
    pairs = [*even, *((some(), some()) for _ in range(3000))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a array<string>, b array<string>")

    def told(c, few):
        bits = text.token_bits(F.col(c), few)
        spare = F.size(c) - sum(map(F.bit_count, bits[1:]), F.bit_count(bits[0]))
        return {"bits": bits, "size": F.size(c), "spare": F.coalesce(spare, F.lit(0))}

    sure = lambda few: text.bits_below(told("a", few), told("b", few), 0.3)
    got = {r["i"]: r for r in df.select("i", sure(8).alias("wide"), sure(1).alias("narrow"), text.jaccard_below(F.col("a"), F.col("b"), 0.3).alias("exact")).collect()}
    settled = 0
    for i, (a, b) in enumerate(pairs):
        below = None if a is None or b is None else bool(set(a) | set(b)) and len(set(a) & set(b)) * 10 < len(set(a) | set(b)) * 3
        assert got[i]["exact"] == below, (a, b)
        assert not (got[i]["wide"] or got[i]["narrow"]) or below, (a, b)
        settled += bool(below and got[i]["wide"])
    assert settled > 0.8 * sum(bool(r["exact"]) for r in got.values())


def test_a_header_per_line(spark, tmp_path):
    lines = []
    for i in range(3000):
        lines += ["#Fields: c-ip cs-method", f"10.0.{i // 250}.{i % 250} GET"] if i % 2 else ["#Fields: cs-method c-ip", f"POST 10.0.{i // 250}.{i % 250}"]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    out = readers.read_w3c_log(spark, str(tmp_path / "a.log"))
    assert not re.search("Join .*>=", plan_of(out))
    want = {(f"10.0.{i // 250}.{i % 250}", "GET" if i % 2 else "POST") for i in range(3000)}
    assert {(r["client_ip"], r["method"]) for r in out.collect()} == want


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    rows = spark.range(20).withColumnRenamed("id", "event_id")
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert stream_plans.drain(stream_plans.stream_table(spark, str(tmp_path), "events")).count() == 20
    one = tmp_path / "single"
    one.mkdir()
    next((tmp_path / "events.parquet").glob("part-*.parquet")).rename(one / "events.parquet")
    assert stream_plans.drain(stream_plans.stream_table(spark, str(one), "events")).count() == spark.read.parquet(str(one / "events.parquet")).count()


def test_counts_of_dense_windows(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", None]), rng.choice([None, *range(-30, 30)]), i) for i in range(400)]
    df = spark.createDataFrame(data, "k string, us long, id long")
    out = ordered.trailing_count(df, ["k"], "us", F.col("id") % 3 > 0, 7, "n")
    # A frame that slides is gone through anew for every row.
    assert not re.search(r"RangeFrame, -\d", plan_of(out))
    got = {r["id"]: r["n"] for r in out.collect()}
    assert got == {i: sum(1 for k, t, j in data if k == key and t is not None and us - 7 <= t <= us and j % 3) for key, us, i in data if us is not None}


def test_samples_of_one_split_are_dealt_out(spark):
    rows = spark.range(40).select(F.lit("h").alias("host"), F.col("id").alias("pid"), F.lit(0).alias("vad_start"), F.hex(F.concat(F.lit("see http://a.example/"), F.col("id").cast("string")).cast("binary")).alias("sample_hex")).coalesce(1)
    out = aggregates.region_iocs(rows)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r["value"] for r in out.where("kind = 'urls'").collect()} == {f"http://a.example/{i}" for i in range(40)}


def test_paths_are_read_once_for_many_documents(spark):
    values.path_trie.cache_clear()
    for i in range(50):
        assert values.trie_leaves({"a": {"b": i}}, ["a.b", "a", "]"])[0] == [{"kind": "int", "text": str(i)}]
    assert values.path_trie.cache_info().misses == 1
    df = spark.createDataFrame([('{"a": [1, null, {"x": "y"}]}', ["a[*]", "a[0]", "z"]), ("{", ["a"]), (None, None)], "doc string, paths array<string>")
    got = [[[tuple(leaf) for leaf in found] for found in r["v"]] for r in df.select(values.json_leaves("doc", "paths").alias("v")).collect()]
    assert got == [[[("int", "1"), ("null", ""), ("object", '{"x": "y"}')], [("int", "1")], []], [[]], []]


def test_a_block_is_hashed_once_for_all_its_leaves(spark):
    leaves = spark.range(300).select(F.lit("c").alias("case_id"), F.col("id").alias("leaf_idx"), F.sha2(F.col("id").cast("string"), 256).alias("digest_hex"))
    one = leaves.where("leaf_idx = 0").withColumn("case_id", F.lit("d"))
    all_leaves = leaves.unionByName(one)
    proofs = custody.inclusion_proofs(all_leaves, all_leaves.select("case_id", "leaf_idx"), bits=3)
    # The paths only carry what they pick: no hash is made after the leaves have met the levels.
    plan = plan_of(proofs)
    assert "sha2" not in plan[: plan.index("Join")] and "steps" in plan
    rows = custody.check_proofs(proofs).collect()
    assert len(rows) == 301 and all(r["proof_ok"] for r in rows)
    roots = {r["case_id"]: r["merkle_root"] for r in custody.merkle_root(all_leaves).collect()}
    assert {(r["case_id"], r["root"]) for r in rows} == set(roots.items())
    assert {len(r["siblings"]) for r in rows} == {0, 9}

"""JSON of any layout, read in parts: records, bad objects, and layouts over split borders."""

import gzip
import json
import random

import pytest

from tracewright.sources import json_values, readers


def texts(content, keys=json_values.CONTAINER_KEYS, step=1):
    parts = iter([content[i : i + step] for i in range(0, len(content), step)])
    return [r for _, _, r in json_values.records(json_values.Text(parts), keys)]


def random_record(rng, depth=0):
    kinds = [lambda: rng.randint(-9, 9), lambda: rng.random(), lambda: None, lambda: rng.choice(['a"}{', "\\", "é]\n", "x,y", "😀", ""]), lambda: True]
    if depth < 3:
        kinds += [lambda: [random_record(rng, depth + 1) for _ in range(rng.randint(0, 3))], lambda: {rng.choice(["k", "}", "value"]) + str(i): random_record(rng, depth + 1) for i in range(rng.randint(0, 3))}]
    return rng.choice(kinds)()


@pytest.mark.parametrize("seed", range(25))
def test_every_layout_gives_the_records(seed, monkeypatch):
    monkeypatch.setattr(json_values, "CHUNK", 5)
    rng = random.Random(seed)
    want = [{"n": i, "v": random_record(rng)} for i in range(rng.randint(1, 12))]
    indent, ascii_only = rng.choice([None, 1]), rng.random() < 0.5
    dump = lambda x: json.dumps(x, indent=indent, ensure_ascii=ascii_only)
    for content in (dump(want), dump({"x": [1], "Records": want, "y": {"Records": [7]}}), "\n".join(map(dump, want)), "".join(map(dump, want)), "﻿" + ", ".join(map(dump, want)) + "\r\n"):
        for step in (1, 7, 10_000):
            assert [json.loads(r) for r in texts(content, step=step)] == want


def test_bad_values(monkeypatch):
    monkeypatch.setattr(json_values, "CHUNK", 4)
    for step in (1, 1000):
        assert texts('{"a":1}\n{bad\n{"b":2}\n{"c":\n"d', step=step) == ['{"a":1}', None, '{"b":2}', None]
        assert texts('[{"a":1},\n{"a":nope},\n{"a":3}]', step=step) == ['{"a":1}', None, '{"a":3}']
        assert texts('{"value":[{"a":1},{"a":', step=step)[0] == '{"a":1}' and None in texts('{"value":[{"a":1},{"a":', step=step)
        assert texts('{"a":NaN}\n{"a":1e400, "b":1.10}', step=step) == [None, '{"a":1e400, "b":1.10}']
        assert texts('{"a":no}\n[{"b":2}]\n{"c":3}', step=step) == [None, '{"b":2}', '{"c":3}']
        assert texts("", step=step) == texts(" \n", step=step) == texts("[]", step=step) == texts('{"items":[]}', step=step) == []


@pytest.mark.parametrize("tail", ["", "\n", " \n\n"])
def test_files_in_small_splits(spark, tmp_path, tail):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        rows = [{"n": i, "t": "}" * (i % 5) + "é", "o": {"in": [i]}} for i in range(90)]
        (tmp_path / "array.json").write_text(json.dumps(rows, ensure_ascii=False) + tail, encoding="utf-8")
        (tmp_path / "both.json").write_text(json.dumps({"events": [{"n": -1}], "value": rows, "items": 3}, indent=1) + tail)
        (tmp_path / "a b%20c.json").write_bytes(b"\xef\xbb\xbf" + "\n".join(map(json.dumps, rows)).encode() + tail.encode())
        (tmp_path / "cut.json").write_text('{"n": 1}{"n": {"m": 2}' + tail)
        (tmp_path / "empty.json").write_text(tail)
        with gzip.open(tmp_path / "packed.json.gz", "wt") as f:
            f.write(json.dumps(rows) + tail)
        got = {}
        for r in json_values.read_values(spark, str(tmp_path)).collect():
            got.setdefault(r["file"].rsplit("/", 1)[1][:4], []).append(json.loads(r["raw"])["n"] if r["parsed"] else None)
        assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(range(90), key=str) for k in ("arra", "both", "a%20", "pack")} | {"cut.": [1, None]}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_readers_tell_the_layout(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Records":[{"eventTime":"t","userIdentity":{"arn":"a"}}]}')
    (tmp_path / "b.json").write_text('{"eventTime":"t","userIdentity":{"arn":"b"}}\n{"eventTime":"t","userIdentity":{"arn":"c"}}\n{')
    assert sorted(r["actor"] for r in readers.read_cloud(spark, str(tmp_path), "cloudtrail", lines=False).collect()) == ["a", "b", "c"]
    assert readers.read_json_documents(spark, str(tmp_path)).where("NOT parsed").count() == 1

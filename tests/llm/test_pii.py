"""Strict spans against plain patterns, labelers and reliabilities, added spans, odd rows."""

import hashlib
import random
import re
import time

import numpy as np

from tracewright.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, key string, candidates string, spans string"


def holds(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(n - 9 * (n > 9) for n in twice) % 10 == 0
    return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in span.split("."))) or (kind == "phone" and 9 <= len(digits) <= 15)


def plain(text):
    return [(k, *m.span()) for k, form in FORMS.items() for m in re.finditer(form, text) if holds(k, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_strict_spans_equal_plain_patterns():
    rng = random.Random(8)
    seen = 0
    for _ in range(20_000):
        signs = rng.choice(["0123456789 .-()+@a%", "12.", "1 -", "+1 (.-)9", "a@.-1%", "ab@.c@", "1234567890- ", "+12 .()-x", "é1.2@a+"])
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        want = plain(text)
        assert [(pii.KINDS[k], a, b) for k, spans in enumerate(pii.strict(text).spans) for a, b in spans] == want, text
        seen += len(want)
        pii.candidates(text)
    assert seen > 1000


def test_time_is_linear_in_the_text():
    for part in ("x", "1", "1 ", "1.", "+1", "a@", ":", "1234 ", "a@b.c "):
        took = []
        for n in (20_000, 160_000):
            started = time.process_time()
            pii.candidates(part * (n // len(part)))
            took.append(time.process_time() - started)
        assert took[1] < 0.5 + 24 * took[0], part


def test_reliabilities_follow_the_votes():
    rng = np.random.default_rng(1)
    right = [0.9, 0.99, 0.7, 0.85, 0.6, 0.55]
    counts, truth = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.4
        votes = [0 if rng.random() < 0.3 else (1 if (rng.random() < r) == y else -1) for r in right]
        p = pii.pattern_of(votes)
        assert pii.votes_of(p) == votes
        counts[p] = counts.get(p, 0) + 1
        truth[p] = truth.get(p, 0) + y
    share, chance, posterior = pii.reliabilities(counts)
    assert abs(share - 0.4) < 0.02
    for j in (0, 2, 3, 4):
        assert abs(chance[1, j, 2] / (chance[1, j, 2] + chance[1, j, 0]) - right[j]) < 0.04
    said = sum(n * ((posterior[p] >= 0.5) * truth[p] / n + (posterior[p] < 0.5) * (1 - truth[p] / n)) for p, n in counts.items())
    assert said / 20_000 > 0.95


def test_documents(spark):
    rng = random.Random(2)
    fill = lambda: " ".join(rng.choice("river stone light window garden paper quiet".split()) for _ in range(12))
    rows = [(i, f"{fill()} anna.{i}@mail.example.com {fill()} 10.20.{i % 250}.9 {fill()} +1 (555) 010-{1000 + i} {fill()} 4539578763621486 {fill()}") for i in range(60)]
    rows += [(100 + i, f"{fill()} {rng.randrange(10**15, 10**16)} and {2000 + i}-01-17 or version 1.{i}.0 {fill()}") for i in range(60)]
    planted = {
        900: ("x 4539578763621486 4539578763621486 y", {"card:2:18", "card:19:35"}),
        901: ("call +1 (555) 010-9999 4539578763621486 now", {"phone:5:22", "card:23:39"}),
        902: ("token a1b2c3 5551234567x 2024-01-17 and 12.5", set()),
        903: ("write to anna (at) example (dot) com please", {"email:9:36"}),
    }
    rows += [(i, t) for i, (t, _) in planted.items()] + [(950, None), (951, ""), (None, "a@b.org"), (952, "é 1.2.3.4 " * 30_000), (953, "a@b.org"), (953, "a@b.org")]
    docs = spark.createDataFrame([(*r, "k", "c", "s") for r in rows], SCHEMA).repartition(4)
    got = pii.span_report(docs).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    for r in got:
        base = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        every = [s.split(":") for s in r["spans"].split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",")) and every == sorted(every, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))
        if r["doc_id"] in planted:
            assert set(r["spans"].split(",")) - {""} == planted[r["doc_id"]][1], (r["doc_id"], r["spans"])
        elif r["doc_id"] is not None and 100 <= r["doc_id"] < 160:
            assert len(every) == len(base)


def test_no_rows(spark):
    assert pii.span_report(spark.createDataFrame([], SCHEMA)).collect() == []

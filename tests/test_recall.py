"""Recall by word places, stems and kind."""

from pyspark.sql import functions as F

from tracewright.functions.stems import stem
from tracewright.operators import recall

DAY = 86_400_000_000


def test_stems_of_the_published_algorithm():
    pairs = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
    falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radically radic differently differ
    vilely vile analogously analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit
    sensibility sensibl triplicate triplic formative form formalize formal electricity electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
    gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ homologous homolog
    effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll oscillators oscil generalizations gener is is été et""".split()
    assert {w: stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))


def plain(memory, phrase, change=lambda w: w):
    """Brute force: occurrences of the phrase in each memory, at every place."""
    import re

    words = lambda text: [change(w) for w in re.findall(r"[^\W_]+", text.lower())]
    want, out = words(phrase), {}
    for key, kind, text in memory:
        have = words(f"{kind} x {text}")
        n = sum(have[i : i + len(want)] == want for i in range(len(have) - len(want) + 1)) if want else 0
        if n:
            out[key] = n
    return out


def test_phrases_are_met_at_their_places(spark, monkeypatch):
    import random

    rng = random.Random(4)
    memory = [(i, rng.choice("ab"), " ".join(rng.choice(("deleting", "deleted", "file", "files", "the", "the")) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    phrases = ["the", "the the", "deleted files", "the deleted file the", "files the the the", "absent", "the absent", "", "?!", "a x"]
    rows = spark.createDataFrame([(i, "c", kind, "x", text, 0) for i, kind, text in memory], "memory_id long, case_id string, kind string, key string, value string, us long").repartition(4)
    asked = spark.createDataFrame(list(enumerate(phrases)), "query_id long, phrase string")
    for stems, change in ((False, lambda w: w), (True, stem)):
        words = (lambda c: recall.stemmed(recall._words(c))) if stems else recall._words
        doc = rows.select("memory_id", words(F.concat_ws(" ", "kind", "key", "value")).alias("__w"))
        ask = asked.select("query_id", words(F.col("phrase")).alias("__q")).where(F.size("__q") > 0)
        got = {(r["query_id"], r["memory_id"]): r["f"] for r in recall._phrase_starts(doc, ask).collect()}
        assert got == {(q, m): n for q, phrase in enumerate(phrases) for m, n in plain(memory, phrase, change).items()}
    of_kind = spark.createDataFrame([(1, "deletes file", "a"), (2, "deletes file", None), (3, "deletes file", "z")], "query_id long, phrase string, kind string")
    found = recall.recall(rows, of_kind, F.lit(DAY), k=1000, stems=True).collect()
    everything = plain(memory, "deletes file", stem)
    assert {r["memory_id"] for r in found if r["query_id"] == 1} == {m for m in everything if memory[m][1] == "a"} and {r["memory_id"] for r in found if r["query_id"] == 2} == set(everything)
    scores = {q: {r["memory_id"]: r["score"] for r in found if r["query_id"] == q} for q in (1, 2, 3)}
    assert not scores[3] and scores[1].items() <= scores[2].items()
    assert recall.recall(rows, asked.where("query_id > 4 AND query_id < 9"), F.lit(DAY)).collect() == recall.recall(rows.limit(0), asked, F.lit(DAY)).collect() == []

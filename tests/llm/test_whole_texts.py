"""Results don't change where a long text is cut for memory's sake: sentences, words and lines over the cut."""

import re

import numpy as np
import pyarrow as pa

from tracewright.llm import common, decontaminate, quality, toxicity, words

CUT = 1 << 19


def scored(model, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])
    out = pa.Table.from_batches(list(toxicity.scorer(model)(iter([batch]))))
    return out["score"].to_pylist(), out["spans"].to_pylist()


def test_spans_cut_behind_stops_only():
    text = "ab cd\nefghij k"
    for size in range(1, 20):
        cuts = list(common.spans(text, size))
        assert "".join(text[a:b] for a, b in cuts) == text and all(b == len(text) or text[b - 1].isspace() for _, b in cuts)
    assert list(common.spans("abcdef", 2)) == [(0, 6)] and list(common.spans("", 2)) == []


def test_a_sentence_over_the_cut():
    _, prefix, starts, ends, _ = words.letter_words(["bad word"])
    hashes = words.span_hashes(prefix, starts, ends)
    order = np.argsort(hashes)
    model = toxicity.Model(hashes[order], np.array([3.0, 3.0])[order], -4.0)
    sentence = "this is bad and then word."
    fill = "x" * 9 + ". "
    texts = []
    for place in (CUT - 200, CUT - 12, CUT - 5, CUT, CUT + 300):
        start = fill * (place // len(fill)) + "y" * (place % len(fill) - 2) + ". " if place % len(fill) >= 2 else fill * (place // len(fill))
        texts.append((len(start), start + sentence + " " + fill * 300))
    scores, spans = scored(model, [t for _, t in texts])
    for score, found, (start, text) in zip(scores, spans, texts):
        tails = len(re.findall(r"[a-z][^.]*\.", text)) - 1
        assert abs(score - (1 - (1 - 1 / (1 + np.exp(-2.0))) * (1 - 1 / (1 + np.exp(4.0))) ** tails)) < 1e-9
        assert [(s["start"], s["end"]) for s in found] == [(start, start + len(sentence) - 1)]


def plain_features(text):
    """Word, pair and line figures of a text, counted plainly."""
    said = [w.lower() for w in re.findall(r"[a-z0-9]+", text)]
    pairs = list(zip(said, said[1:]))
    lines = [x for x in text.split("\n") if x]
    top = lambda x: max((x.count(v) for v in set(x)), default=0)
    n = max(len(said), 1)
    return [np.log1p(len(said)), sum(map(len, said)) / n, len(set(said)) / n, top(said) / n, sum(a == b for a, b in pairs) / n, len(set(pairs)) / max(len(pairs), 1), top(pairs) / max(len(pairs), 1), None, len(set(lines)) / max(len(lines), 1)]


def test_quality_figures_of_a_long_text():
    line = "the river runs to the sea and the stone stays 12\n"
    for text in ("", "one two\ntwo one\none two", line * 40 + "one more", "same " * 30, (line + "other words\n") * 30):
        want = plain_features(text)
        for size in (7, 64, 1 << 19):
            got = quality.features([text, "a b", text], size)
            assert np.array_equal(got[0], got[2])
            extra = got[0][quality.KINDS :]
            assert all(abs(a - b) < 1e-12 for a, b in zip(extra, want) if b is not None), (size, extra, want)
    grown = quality.features([line * 10_400, line * 12_600])
    assert [round(x[quality.KINDS + 2] * 11 * n, 9) for x, n in zip(grown, (10_400, 12_600))] == [9, 9]


def test_a_word_over_the_cut():
    text = "a" * (CUT - 100) + "b" * 20_000 + " end of it"
    groups = list(common.pieces([text]))
    assert "".join(p for _, _, group in groups for p in group) == text and groups[0][2][0].endswith("b ")
    assert len(decontaminate.tokens([text])[0]) == 4

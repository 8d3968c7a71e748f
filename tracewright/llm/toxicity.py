"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels alone.

A document is toxic if any sentence is: p(doc) = 1 - prod(1 - p(sentence)), p(sentence) = sigmoid(bias + word weights).
Training sees only the document label; the sentence scores that result point out the offending sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import by_tasks, fold_of, labelled_sample, pieces
from tracewright.llm.words import letter_words, places, span_hashes
from tracewright.session import cut_lineage

FOLD = (5, 0)
SENTENCE_ENDS = ".!?\n\r;…。！？"
ENDS = np.zeros(0x110000, bool)
ENDS[[ord(c) for c in SENTENCE_ENDS]] = True
# Long texts are cut between sentences, so a sentence's words add up wherever it lies.
BREAKS = re.compile(f"[{SENTENCE_ENDS}]")


@dataclass
class Model:
    """Sorted word hashes, their weights and the bias of a sentence."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def sentences(group: list[str]) -> tuple[np.ndarray, ...]:
    """Word hashes, sentence number of each word, and per sentence: text number, first and last word place in its text."""
    low, prefix, starts, ends, owner = letter_words(group)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none
    mark = np.cumsum(ENDS[low])[starts]
    first = np.concatenate(([True], (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])))
    number = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    tails = np.concatenate((heads[1:] - 1, [len(starts) - 1]))
    origin = np.cumsum([0] + [len(t) + 1 for t in group])[owner[heads]]
    return span_hashes(prefix, starts, ends), number, owner[heads], starts[heads] - origin, ends[tails] - origin


def word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word hash, y, documents) of each batch: documents of a label that hold a word."""
    for batch in batches:
        labels = np.array(batch.column(2).to_pylist(), np.int64)
        seen = []
        for numbers, _, group in pieces((t.as_py() or "" for t in batch.column(1)), stops=BREAKS):
            hashes, _, owner, _, _ = words_of(group)
            seen.append(np.stack([hashes, np.array(numbers, np.uint64)[owner]], axis=1))
        if not seen:
            continue
        pairs = np.unique(np.concatenate(seen), axis=0)
        keyed, n = np.unique(np.stack([pairs[:, 0], labels[pairs[:, 1].astype(np.int64)].astype(np.uint64)], axis=1), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keyed[:, 0].copy().view(np.int64)), pa.array(keyed[:, 1].astype(np.int32)), pa.array(n)], names=["word", "y", "n"])


def words_of(group: list[str]) -> tuple[np.ndarray, ...]:
    low, prefix, starts, ends, owner = letter_words(group)
    return span_hashes(prefix, starts, ends), starts, owner, ends, low


def bags(vocabulary: np.ndarray):
    """Task function: per document its label, sentence count, and (sentence, word place) pairs of vocabulary words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            total, sent, word = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
            for numbers, _, group in pieces((t.as_py() or "" for t in batch.column(1)), stops=BREAKS):
                hashes, number, owner, _, _ = sentences(group)
                at = places(vocabulary, hashes)
                hit = np.flatnonzero(at >= 0)
                of = np.array(numbers)[owner]
                count = np.bincount(of, minlength=n) if len(of) else np.zeros(n, np.int64)
                local = np.arange(len(of)) - np.concatenate(([0], np.cumsum(count)))[of] if len(of) else of
                pair = np.unique(np.stack([number[hit], at[hit]], axis=1), axis=0) if len(hit) else np.zeros((0, 2), np.int64)
                doc = of[pair[:, 0]]
                for d in np.unique(doc):
                    mine = pair[doc == d]
                    sent[d].append(local[mine[:, 0]] + total[d])
                    word[d].append(mine[:, 1])
                total += count
            flat = [[np.concatenate(x) if x else np.zeros(0, np.int64) for x in side] for side in (sent, word)]
            yield pa.RecordBatch.from_arrays([batch.column(2).cast(pa.int32()), pa.array(total), pa.array(flat[0], pa.list_(pa.int64())), pa.array(flat[1], pa.list_(pa.int64()))], names=["y", "sentences", "sent", "word"])

    return work


def noisy_or(rows: list[tuple], vocabulary: int, weight: dict[int, float], rounds: int = 300, rate: float = 0.1, l1: float = 0.3) -> tuple[np.ndarray, float]:
    """Word weights and bias that minimise the noisy-or likelihood loss with an L1 term of l1 / rows (Adam, full batch)."""
    y = np.array([r[0] for r in rows], float)
    case = np.array([weight[int(v)] for v in y])
    case /= case.sum()
    base = np.concatenate(([0], np.cumsum([r[1] for r in rows])))
    sent = np.concatenate([np.asarray(r[2]) + base[i] for i, r in enumerate(rows)]).astype(np.int64)
    word = np.concatenate([np.asarray(r[3]) for r in rows]).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), np.diff(base))
    theta = np.zeros(vocabulary + 1)
    theta[-1] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = np.bincount(sent, theta[word], minlength=base[-1]) + theta[-1]
        total = np.bincount(doc, np.logaddexp(0, z), minlength=len(rows))
        slope = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-9), 1.0) * case
        back = slope[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, back[sent], minlength=vocabulary), back.sum())
        grad[:-1] += l1 / len(rows) * np.sign(theta[:-1])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, vocabulary: int = 2048, min_documents: int = 5, fold: tuple[int, int] = FOLD, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Model of labelled rows outside the held-out fold: at most `per_class` rows of each label, a documented bound.

    The vocabulary is the words whose share of documents differs most surely between the labels. Without rows of both
    labels the model gives every sentence the one label there is, and without rows none is toxic.
    """
    sample, taken = labelled_sample(docs, labels, "toxic", fold, per_class, id_col, text_col)
    if len(taken) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 5.0 if taken.get(1) else -50.0)
    sample = cut_lineage(sample)
    there = {y: n[1] for y, n in taken.items()}
    counts = by_tasks(sample, word_sets, "word long, y int, n long")
    counts = counts.groupBy("word").agg(*[F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (0, 1)])
    p0, p1 = (F.col("n0") + 0.5) / (there[0] + 1), (F.col("n1") + 0.5) / (there[1] + 1)
    sure = F.abs(p1 - p0) / F.sqrt(p0 * (1 - p0) / there[0] + p1 * (1 - p1) / there[1])
    best = counts.filter(F.col("n0") + F.col("n1") >= min_documents).orderBy(sure.desc(), "word").limit(vocabulary)
    words = np.sort(np.array([r["word"] for r in best.select("word").collect()], np.int64).view(np.uint64))
    rows = [tuple(r) for r in by_tasks(sample, bags(words), "y int, sentences long, sent array<long>, word array<long>").collect()]
    if not rows:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0)
    weights, bias = noisy_or(rows, len(words), {y: n / k for y, (n, k) in taken.items()})
    return Model(words, weights, bias)


def scorer(model: Model, report: float = 0.5):
    """Task function over (key, text): (key, score, spans)."""
    words, weights, bias = model.words, model.weights, model.bias
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for numbers, offsets, group in pieces((t.as_py() or "" for t in batch.column(1)), stops=BREAKS):
                hashes, number, owner, start, end = sentences(group)
                if not len(owner):
                    continue
                at = places(words, hashes)
                hit = np.flatnonzero(at >= 0)
                # A word counts once in a sentence.
                pair = np.unique(number[hit] * max(1, len(words)) + at[hit])
                z = np.bincount(pair // max(1, len(words)), weights[pair % max(1, len(words))] if len(words) else None, minlength=len(owner)) + bias
                np.add.at(total, np.array(numbers)[owner], np.logaddexp(0, z))
                chance = 1 / (1 + np.exp(-z))
                for i in np.flatnonzero(chance >= report):
                    o = owner[i]
                    spans[numbers[o]].append({"start": int(start[i] + offsets[o]), "end": int(end[i] + offsets[o]), "score": float(chance[i])})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(-np.expm1(-total)), pa.array(spans, pa.list_(span))], names=["key", "score", "spans"])

    return work


def score(docs: DataFrame, model: Model, report: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, spans) of every row: the document's probability and the sentences of at least `report`.

    Spans are (start, end, score) in code points. Texts that are null or hold no word score 0 and have no spans.
    Repeated rows are scored each for itself; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    out = by_tasks(slim, scorer(model, report), f"key {kind}, score double, spans array<struct<start:long,end:long,score:double>>")
    return out.withColumnRenamed("key", id_col)


def scored_fold(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = FOLD) -> DataFrame:
    """Every document's score, whether its fold was held out, and the decision at 0.5."""
    out = score(docs, fit(docs, labels, fold=fold))
    return out.select("doc_id", (fold_of(F.col("doc_id"), fold[0]) == fold[1]).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")

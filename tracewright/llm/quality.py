"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Only trusted positives and unlabelled texts train it. The risk of the negatives is the unlabelled risk less the
prior-weighted positive one; where that estimate turns negative, the step goes against it instead of below zero. The
class prior comes from the best bin: the smallest ratio of unlabelled to positive rows above any score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import by_tasks, fold_of, labelled_sample, spans
from tracewright.llm.toxicity import ENDS
from tracewright.llm.words import U, characters, code_points, mix, prefix_sums, runs, span_hashes

FOLD = (3, 1)
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KINDS = 6 + len(SIGNS)


def kind_of_characters() -> np.ndarray:
    """0 lower-case or caseless letter, 1 capital, 2 digit, 3 blank, 4 line end, 5 other, then one kind for each sign."""
    letter, lower = characters()
    kind = np.full(0x110000, 5, np.uint8)
    kind[letter] = 0
    kind[letter & (lower != np.arange(0x110000))] = 1
    for chars, k in (("0123456789", 2), (" \t\x0b\x0c ", 3), ("\n\r", 4)):
        kind[[ord(c) for c in chars]] = k
    kind[[ord(c) for c in SIGNS]] = np.arange(6, KINDS)
    return kind


_KIND: list[np.ndarray] = []


def repeated(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: items, distinct items, count of the most frequent one."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    pairs = np.stack([owner.astype(U), hashes], axis=1)
    order = np.lexsort((hashes, owner))
    pairs = pairs[order]
    first = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1))))
    count = np.diff(np.concatenate((first, [len(pairs)])))
    of = pairs[first, 0].astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, of, count)
    return np.bincount(owner, minlength=n).astype(float), np.bincount(of, minlength=n).astype(float), top


LINE_ENDS = re.compile(r"[\n\r]")


def groups(texts: list[str], size: int = 1 << 19) -> Iterator[tuple[list[int], list[list[str]]]]:
    """(text numbers, one list of pieces per round) of whole texts of about `size` characters together.

    A longer text is alone in its group and comes in rounds, cut behind line ends: what its pieces hold is put together
    before anything distinct is counted.
    """
    numbers, group, held = [], [], 0
    for i, text in enumerate(texts):
        if len(text) > size:
            yield [i], [[text[a:b]] for a, b in spans(text, size, LINE_ENDS)]
            continue
        numbers.append(i)
        group.append(text)
        held += len(text)
        if held >= size:
            yield numbers, [group]
            numbers, group, held = [], [], 0
    if group:
        yield numbers, [group]


def items(group: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Character kinds and sentence ends per text, and (hash, text) of its words (with lengths), sentences and lines in order."""
    low = code_points("\n".join(group) + "\n")
    kind, m = _KIND[0][low], len(group)
    bounds = np.cumsum([len(t) + 1 for t in group])
    owner = np.repeat(np.arange(m), np.diff(np.concatenate(([0], bounds))))
    counts = np.bincount(owner * KINDS + kind, minlength=m * KINDS).reshape(m, KINDS).astype(float)
    counts[:, 4] -= 1
    prefix = prefix_sums(characters()[1][low].astype(U) + U(1))
    found = []
    for mask in ((kind <= 2) | (kind == 5), ~ENDS[low], kind != 4):
        starts, ends = runs(mask)
        found.append((span_hashes(prefix, starts, ends) if len(starts) else np.zeros(0, U), owner[starts], ends - starts))
    return counts, np.bincount(owner, ENDS[low], minlength=m) - 1, found


def features(texts: list[str], size: int = 1 << 19) -> np.ndarray:
    """One row of shares and repetition figures per whole text; `size` bounds the memory of a step and changes no figure."""
    if not _KIND:
        _KIND.append(kind_of_characters())
    n = len(texts)
    kinds, tallies = np.zeros((n, KINDS)), np.zeros((n, 13))
    for numbers, rounds in groups(texts, size):
        m = len(numbers)
        parts = [items(group) for group in rounds]
        kinds[numbers] = sum(p[0] for p in parts)
        tallies[numbers, 12] = sum(p[1] for p in parts)
        (word, whose, length), *others = ([np.concatenate(x) for x in zip(*of)] for of in zip(*(p[2] for p in parts)))
        local = np.zeros((m, 12))
        if len(word):
            local[:, 0:3] = np.stack(repeated(word, whose, m), axis=1)
            same = whose[1:] == whose[:-1]
            local[:, 3] = np.bincount(whose[1:], same & (word[1:] == word[:-1]), minlength=m)
            local[:, 4] = np.bincount(whose, length, minlength=m)
            local[:, 5:8] = np.stack(repeated(mix(word[1:] * U(3) + word[:-1])[same], whose[1:][same], m), axis=1)
        for col, (hashes, of, _) in zip((8, 10), others):
            local[:, col], local[:, col + 1], _ = repeated(hashes, of, m)
        tallies[numbers, :12] = local
    chars = np.maximum(kinds.sum(axis=1), 1)
    words = np.maximum(tallies[:, 0], 1)
    extra = np.stack([
        np.log1p(tallies[:, 0]), tallies[:, 4] / words, tallies[:, 1] / words, tallies[:, 2] / words, tallies[:, 3] / words,
        tallies[:, 6] / np.maximum(tallies[:, 5], 1), tallies[:, 7] / np.maximum(tallies[:, 5], 1),
        tallies[:, 9] / np.maximum(tallies[:, 8], 1), tallies[:, 11] / np.maximum(tallies[:, 10], 1), np.minimum(tallies[:, 12] / words, 2),
    ], axis=1)
    return np.concatenate([np.sqrt(kinds / chars[:, None]), extra], axis=1)


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, features) of each text."""
    for batch in batches:
        x = features([t.as_py() or "" for t in batch.column(1)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["key", "x"])


@dataclass
class Model:
    """Standardisation, one hidden layer, and the estimated class prior."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2[0]


def train(p: np.ndarray, u: np.ndarray, prior: float | None, hidden: int = 32, rounds: int = 600, rate: float = 0.01, decay: float = 1e-4) -> list[np.ndarray]:
    """Layers by Adam: the non-negative positive-unlabelled risk, or without a prior the plain positive-against-unlabelled one."""
    rng = np.random.default_rng(7)
    layers = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers]
    x = np.concatenate([p, u])
    np_, nu = len(p), len(u)
    for step in range(1, rounds + 1):
        w1, b1, w2, b2 = layers
        h = np.tanh(x @ w1 + b1)
        z = h @ w2 + b2[0]
        sig = 1 / (1 + np.exp(-z))
        # Logistic loss: slope of the positive loss is sig - 1, of the negative loss sig.
        back = np.zeros(len(x))
        if prior is None:
            back[:np_], back[np_:] = (sig[:np_] - 1) / (2 * np_), sig[np_:] / (2 * nu)
        else:
            loss = np.logaddexp(0, z)
            negative = loss[np_:].mean() - prior * loss[:np_].mean()
            sign = 1.0 if negative >= 0 else -1.0
            back[np_:] = sign * sig[np_:] / nu
            back[:np_] = -sign * prior * sig[:np_] / np_ + (prior * (sig[:np_] - 1) / np_ if sign > 0 else 0)
        inner = np.outer(back, w2) * (1 - h**2)
        grads = [x.T @ inner + decay * w1, inner.sum(axis=0), h.T @ back + decay * w2, np.array([back.sum()])]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            layers[i] = layers[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def best_bin(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Class prior: the smallest upper bound on the ratio of unlabelled to positive mass above a score."""
    cut = np.sort(p)[: max(1, int(len(p) * 0.8))]
    above_p = 1 - np.searchsorted(np.sort(p), cut) / len(p)
    above_u = 1 - np.searchsorted(np.sort(u), cut) / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(u)) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    at = np.argmin(above_u / above_p + slack / above_p)
    return float(np.clip(above_u[at] / above_p[at], 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, fold: tuple[int, int] = FOLD, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Model of at most `per_class` positive rows and `per_class` unlabelled ones outside the held-out fold.

    The bound is documented and the choice follows a hash of the id. Rows labelled 0 are not used. None without positives.
    """
    positives = labels.filter(F.col("quality") == 1)
    sample, taken = labelled_sample(docs, positives, "quality", fold, per_class, id_col, text_col)
    if 1 not in taken:
        return None
    folds, held_out = fold
    drawn = docs.select(F.col(id_col).alias("key")).filter(F.col("key").isNotNull() & (fold_of(F.col("key"), folds) != held_out))
    drawn = drawn.distinct().orderBy(F.xxhash64("key", F.lit(1)), "key").limit(per_class)
    web = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "key")
    p, u = (np.array([r["x"] for r in by_tasks(d.select("key", "text"), featured, f"key {docs.schema[id_col].dataType.simpleString()}, x array<double>").orderBy(F.xxhash64("key"), "x").collect()]) for d in (sample, web))
    if not len(p) or not len(u):
        return None
    mean, scale = u.mean(axis=0), np.maximum(u.std(axis=0), 1e-3)
    sp, su = (np.clip((a - mean) / scale, -8, 8) for a in (p, u))
    # The prior is read from rows that its classifier has not seen; else chance differences would pass for negatives.
    first = Model(np.zeros(1), np.ones(1), train(sp[::2], su[::2], None, hidden=8, rounds=300, decay=1e-2), 0.5)
    prior = best_bin(first.logits(sp[1::2]), first.logits(su[1::2]))
    return Model(mean, scale, train(sp, su, prior), prior)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, 0 to 1. A null text counts as empty; without a model every score is 0.

    Repeated rows are scored each for itself; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for at in range(0, batch.num_rows, 500):
                texts = [t.as_py() or "" for t in batch.column(1).slice(at, 500)]
                parts.append(1 / (1 + np.exp(-model.logits(features(texts)))) if model else np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], names=["key", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return by_tasks(slim, work, f"key {kind}, score double").withColumnRenamed("key", id_col)


def scored_fold(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = FOLD) -> DataFrame:
    out = score(docs, fit(docs, labels, fold=fold))
    return out.select("doc_id", (fold_of(F.col("doc_id"), fold[0]) == fold[1]).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

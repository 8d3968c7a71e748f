"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back to its character 4-grams, then
3-, 2- and 1-grams: the first length of which any gram is known decides. Word and gram counts cover all training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import by_tasks, fold_of, pieces
from tracewright.llm.words import U, letter_words, places, prefix_sums, span_hashes
from tracewright.session import cut_lineage

FOLD = (4, 2)
LONGEST = 4
UNDETERMINED = "und"


@dataclass
class Model:
    """Languages in order; sorted hashes and log frequencies (rows by language) of words and of grams by length."""

    languages: list[str]
    words: tuple[np.ndarray, np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray]]


def framed(group: list[str]) -> tuple[np.ndarray, ...]:
    """Words of a group, over code points in which all else than letters is one boundary sign."""
    low, _, starts, ends, owner = letter_words(["", *group, ""])
    plain = np.zeros(len(low), np.uint32)
    size = ends - starts
    inside = np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(size) else size
    plain[inside] = low[inside]
    return low, prefix_sums(plain.astype(U) + U(1)), starts, ends, owner - 1


def gram_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words with one boundary sign at each side (none for n = 1), and each gram's word."""
    edge = 0 if n == 1 else 1
    count = np.maximum(ends - starts + 2 * edge - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), count)
    at = (starts - edge)[word] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return span_hashes(prefix, at, at + n), word


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) summed over each batch."""
    for batch in batches:
        tongues, codes = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
        for numbers, _, group in pieces(t.as_py() or "" for t in batch.column(0)):
            low, prefix, starts, ends, owner = framed(group)
            if not len(starts):
                continue
            code = codes[np.array(numbers)[owner]]
            key = span_hashes(prefix, starts, ends) * U(len(tongues)) + code.astype(U)
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            text = low.tobytes()
            words = [text[4 * s : 4 * e].decode("utf-32-le", "surrogatepass").encode("utf-8", "replace").decode() for s, e in zip(starts[first].tolist(), ends[first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(tongues[code[first]].tolist()), pa.array(words), pa.array(n)], names=["lang", "word", "n"])


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, gram hash, n) of counted words, summed over each task's rows in blocks."""

    def block(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(rows)
        tongues, codes = np.unique(np.array(whole["lang"].to_pylist(), object).astype(str), return_inverse=True)
        weight = whole["n"].to_numpy()
        _, prefix, starts, ends, owner = framed(whole["word"].to_pylist())
        for size in range(1, LONGEST + 1):
            hashes, word = gram_hashes(prefix, starts, ends, size)
            of = owner[word]
            kinds, back = np.unique(hashes, return_inverse=True)
            sums = np.bincount(back * len(tongues) + codes[of], weight[of], minlength=len(kinds) * len(tongues))
            hit = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(tongues[hit % len(tongues)].tolist()), pa.array(np.full(len(hit), size, np.int32)), pa.array(kinds[hit // len(tongues)].view(np.int64)), pa.array(sums[hit].astype(np.int64))], names=["lang", "size", "gram", "n"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= 100_000:
            yield from block(held)
            held, rows = [], 0
    if held:
        yield from block(held)


def fit(docs: DataFrame, fold: tuple[int, int] = FOLD, cells: int = 20_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of the rows with a language outside the held-out fold.

    Kept are words and grams whose share of a language is at least max(2e-5, languages^2 / cells): so a language keeps
    at most the inverse of that, and the tables hold at most about `cells` numbers however large the corpus is.
    """
    folds, held_out = fold
    train = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold_of(F.col(id_col), folds) != held_out))
    counted = by_tasks(train.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")), count_words, "lang string, word string, n long")
    counted = cut_lineage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    share = max(2e-5, len(languages) ** 2 / cells)
    if not languages:
        return Model([], (np.zeros(0, U), np.zeros((0, 0))), {})

    def above(sums: dict) -> Column:
        least = F.lit(None)
        for k, n in sums.items():
            least = F.when(F.col("lang") == k, max(2.0, share * n)).otherwise(least)
        return F.col("n") >= least

    def logs(keys: np.ndarray, tongue: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds, back = np.unique(keys, return_inverse=True)
        table = np.full((len(kinds), len(languages)), 0.5)
        np.add.at(table, (back, tongue), n)
        return kinds, np.log(table / table.sum(axis=0)).astype(np.float32)

    number = {k: i for i, k in enumerate(languages)}
    known = counted.join(counted.filter(above(totals)).select("word").distinct(), "word").select("lang", "word", "n").toPandas()
    _, prefix, starts, ends, owner = framed(known["word"].tolist())
    hashes = np.zeros(len(known), U)
    hashes[owner] = span_hashes(prefix, starts, ends)
    words = logs(hashes, known["lang"].map(number).to_numpy(), known["n"].to_numpy())
    grams = cut_lineage(by_tasks(counted, count_grams, "lang string, size int, gram long, n long").groupBy("size", "lang", "gram").agg(F.sum("n").alias("n")))
    kept = {}
    sums = {(r["size"], r["lang"]): r["n"] for r in grams.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    for size in range(1, LONGEST + 1):
        mine = grams.filter(F.col("size") == size)
        often = mine.filter(above({k: n for (s, k), n in sums.items() if s == size})).select("gram").distinct()
        rows = mine.join(often, "gram").select("lang", "gram", "n").toPandas()
        kept[size] = logs(rows["gram"].to_numpy(np.int64).view(U), rows["lang"].map(number).to_numpy(), rows["n"].to_numpy())
    return Model(languages, words, kept)


def word_scores(model: Model, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log frequency of each word in each language, by the word itself or its longest known grams."""
    out = np.zeros((len(starts), len(model.languages)), np.float32)
    at = places(model.words[0], span_hashes(prefix, starts, ends))
    seen = at >= 0
    out[seen] = model.words[1][at[seen]]
    left = np.flatnonzero(~seen)
    for size in range(LONGEST, 0, -1):
        if not len(left):
            break
        hashes, word = gram_hashes(prefix, starts[left], ends[left], size)
        at = places(model.grams[size][0], hashes)
        hit = np.flatnonzero(at >= 0)
        if not len(hit):
            continue
        n = np.bincount(word[hit], minlength=len(left))
        have = n > 0
        for k in range(len(model.languages)):
            sums = np.bincount(word[hit], model.grams[size][1][at[hit], k], minlength=len(left))
            out[left[have], k] = sums[have] / n[have]
        left = left[~have]
    return out


def predictor(model: Model):
    """Task function over (key, text): (key, lang_pred, score)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros((batch.num_rows, max(1, len(model.languages))))
            seen = np.zeros(batch.num_rows, np.int64)
            for numbers, _, group in pieces(t.as_py() or "" for t in batch.column(1)):
                _, prefix, starts, ends, owner = framed(group)
                of = np.array(numbers)[owner] if len(owner) else owner
                seen += np.bincount(of, minlength=len(seen)) if len(of) else 0
                if model.languages and len(of):
                    scores = word_scores(model, prefix, starts, ends)
                    for k in range(len(model.languages)):
                        total[:, k] += np.bincount(of, scores[:, k], minlength=len(seen))
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            named = (seen > 0) & bool(model.languages)
            tongue = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, named)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tongue, pa.string()), pa.array(np.where(named, share, 0.0))], names=["key", "lang_pred", "score"])

    return work


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row: the likeliest learned language and its share of the likelihood.

    `und` with score 0 for texts that are null, hold no letter, or when nothing was learned. Ties go to the language
    that comes first by name. Repeated rows are predicted each for itself; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return by_tasks(slim, predictor(model), f"key {kind}, lang_pred string, score double").withColumnRenamed("key", id_col)


def predicted_fold(docs: DataFrame, fold: tuple[int, int] = FOLD) -> DataFrame:
    out = predict(docs, fit(docs, fold))
    return out.select("doc_id", (fold_of(F.col("doc_id"), fold[0]) == fold[1]).alias("held_out"), "lang_pred", "score")

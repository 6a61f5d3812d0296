"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its words, a document's score is the
noisy-or of its sentences, ``1 - prod(1 - p)``, and only document labels are known. The weights minimise the loss of
the document scores, so that the blame within a toxic document falls on the sentences that set it apart, and these
can be located afterwards.

The classifier is fitted on a bounded sample of the labelled rows (``MAX_ROWS``; the rows with the smallest hashes of
their identifier, the same in every run). Counts that choose its words are Spark aggregations over that sample: all words
that tell the labels apart with significance are in the model. The fit itself is a few hundred steps of numpy on the
driver, on at most ``MAX_ROWS`` sparse rows of those words. Scoring reads every text whole.

Defined results: null and empty texts, and texts without words, have no sentences and score 0; repeated rows are scored
each; of labels that repeat for an identifier the greatest counts; labels with nulls don't; without labels of both
kinds, or without any word that sets them apart, a document's score is the share of positive labels; further columns
are not read; texts of any length are scored whole. Words are runs of letters, A-Z as a-z; sentences end at ``.``, ``!``, ``?`` or a line's end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumensift.llm.common import small_batches, stored
from lumensift.llm.textbuf import buffer_of, distinct, releasing, runs

MAX_ROWS = 20_000
#: Words count from so many documents on, and from this chi-square of a two by two table on: chance gives it to one word
#: in ten thousand. Of four such levels the one with the least log loss in cross-validation over the training folds.
LEAST_ROWS, LEAST_CHI2 = 3, 15.137
#: Penalty on squared weights, relative to the mean loss.
PENALTY = 1e-4


class Model(NamedTuple):
    """Sorted word hashes, their weights, the bias; rate: what to score without words, or None."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    rate: float | None = None


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, number of its sentence, text of each sentence, sentence's first and one past its last byte, n x 2)."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    h, doc, start = runs(data, offsets, ~letter)
    stop = (data == 46) | (data == 33) | (data == 63) | (data == 10)
    ends = np.concatenate([np.flatnonzero(stop) + 1, offsets[1:]])
    ends = np.unique(ends)
    at = np.searchsorted(ends, start, "right")
    own, sentence = np.unique(at, return_inverse=True)  # sentences with words only
    first = np.zeros(len(own), np.int64)
    if len(own):
        text = np.zeros(len(own), np.int64)
        text[sentence] = doc
        before = np.where(own > 0, ends[np.maximum(own - 1, 0)], 0)
        first = np.maximum(before, offsets[text])
    else:
        text = np.zeros(0, np.int64)
    return h, sentence, text, np.stack([first, ends[own] if len(own) else first], 1)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(bag: np.ndarray, sentence: np.ndarray, word: np.ndarray, sizes: np.ndarray, labels: np.ndarray, words: int, steps: int = 400) -> tuple[np.ndarray, float]:
    """(weights, bias) of the noisy-or model, by Adam on all bags at once.

    bag[s]: of which bag sentence s is; (sentence[i], word[i]): that sentence holds that word; sizes: all sentences of
    each bag, those without any listed word included.
    """
    named = len(bag)
    blank = sizes - np.bincount(bag, minlength=len(sizes))
    theta = np.zeros(words + 1)
    theta[-1] = np.log(max(labels.mean(), 1e-3) / max(sizes.mean(), 1))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        z = b + np.bincount(sentence, w[word], minlength=named)
        total = np.bincount(bag, _softplus(z), minlength=len(sizes)) + blank * _softplus(np.array(b))
        total = np.maximum(total, 1e-9)
        slope = np.where(labels > 0, -np.exp(-total) / -np.expm1(-total), 1.0) / len(labels)
        dz = slope[bag] * _sigmoid(z)
        grad = np.concatenate([np.bincount(word, dz[sentence], minlength=words) + 2 * PENALTY / words * w, [dz.sum() + (slope * blank).sum() * _sigmoid(np.array(b))]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        rate = 0.2 * min(1.0, 4 * (1 - step / steps) + 0.02)
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


@releasing
def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, rows with it, those of label 1), combined within a batch."""
    for batch in batches:
        data, offsets = buffer_of(batch.column(0))
        h, sentence, text, _ = sentences(data, offsets)
        h, own = distinct(h, text[sentence])
        label = batch.column(1).to_numpy()[own] if len(own) else np.zeros(0)
        words, at = np.unique(h, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.bincount(at, minlength=len(words)).astype(np.int64)), pa.array(np.bincount(at, label, minlength=len(words)).astype(np.int64))], names=["word", "n", "n1"])


@releasing
def _bags(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(label, sentences, [sentence, word, ...]) of each row: places of its listed words."""
    for batch in batches:
        data, offsets = buffer_of(batch.column(0))
        h, sentence, text, _ = sentences(data, offsets)
        size = np.bincount(text, minlength=batch.num_rows)
        first = np.cumsum(size) - size
        at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
        hit = np.flatnonzero(chosen[at] == h)
        pairs = np.unique(np.stack([sentence[hit], at[hit]], 1), axis=0)
        row = text[pairs[:, 0]]
        count = np.bincount(row, minlength=batch.num_rows)
        flat = np.stack([pairs[:, 0] - first[row], pairs[:, 1]], 1).ravel().astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * count)]).astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(size.astype(np.int64)), lists], names=["label", "size", "places"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on docs (doc_id, text) with labels (doc_id, label): max_rows labels at most, those of the smallest hashes.

    The sample of labels is taken before any text is read; only its documents are.
    """
    small_batches(docs.sparkSession)
    sample = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = sample.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(max_rows)
    # max_rows identifiers and labels at most
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    held = stored(held.select("text", F.col("label").cast("long").alias("label")), "toxicity-sample")
    n, n1 = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, n1 / n if n else 0.0)
    if not n1 or n1 == n:
        return empty
    count = held.mapInArrow(_word_rows, "word long, n long, n1 long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    miss = F.col("n1") * (n - n1) - (F.col("n") - F.col("n1")) * n1
    chi2 = n * (miss.cast("double") ** 2) / (F.lit(float(n1)) * (n - n1) * F.col("n") * (n - F.col("n") + 0.5))
    best = count.where(F.col("n") >= LEAST_ROWS).where(miss > 0).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    chosen = np.sort(np.array([r["word"] for r in best.select("word").collect()], np.int64).view(np.uint64))
    if not len(chosen):
        return empty
    got = held.mapInArrow(partial(_bags, chosen=chosen), "label long, size long, places array<int>").toArrow().combine_chunks()
    label, size = (got.column(c).to_numpy() for c in ("label", "size"))
    lists = got.column("places").combine_chunks()
    edge = lists.offsets.to_numpy() // 2
    pairs = lists.values.to_numpy().reshape(-1, 2)
    # rows come in any order; sums are to agree in every run
    order = sorted(range(len(label)), key=lambda i: (label[i], size[i], pairs[edge[i] : edge[i + 1]].tobytes()))
    bag = np.repeat(np.arange(len(order)), np.diff(edge)[order])
    pairs = np.concatenate([pairs[edge[i] : edge[i + 1]] for i in order]).astype(np.int64)
    # sentences with any of the words, numbered through all bags
    most = int(size.max()) + 1
    named, sentence = np.unique(bag * most + pairs[:, 0], return_inverse=True)
    weights, bias = fit(named // most, sentence, pairs[:, 1], size[order], label[order].astype(float), len(chosen))
    return Model(chosen, weights, bias)


def _scored(batches: Iterator[pa.RecordBatch], model: Model, offending: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer_of(batch.column(1))
        h, sentence, text, span = sentences(data, offsets)
        rows = batch.num_rows
        if model.rate is None:
            at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
            hit = np.flatnonzero(model.words[at] == h)
            pairs = np.unique(np.stack([sentence[hit], at[hit]], 1), axis=0)
            z = model.bias + np.bincount(pairs[:, 0], model.weights[pairs[:, 1]], minlength=len(text))
            score = -np.expm1(-np.bincount(text, _softplus(z), minlength=rows))
            p = _sigmoid(z)
        else:
            score = np.where(np.bincount(text, minlength=rows) > 0, model.rate, 0.0)
            p = np.zeros(len(text))
        bad = np.flatnonzero(p >= offending)
        count = np.bincount(text[bad], minlength=rows)
        local = span[bad] - offsets[text[bad]][:, None]
        struct = pa.StructArray.from_arrays([pa.array(local[:, 0].astype(np.int32)), pa.array(local[:, 1].astype(np.int32)), pa.array(p[bad])], names=["start", "stop", "score"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), struct)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), lists], names=["doc_id", "score", "offending"])


_score = releasing(_scored)


def score(docs: DataFrame, model: Model, offending: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, offending) per row; offending: (start, stop, score) of sentences, in bytes of the UTF-8 text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_score, model=model, offending=offending), "doc_id long, score double, offending array<struct<start:int,stop:int,score:double>>")


@releasing
def _score_rows(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The rows as they came, each with its score."""
    for batch in batches:
        doc = batch.column(0)
        text = doc.field("text") if not doc.null_count else doc.flatten()[doc.type.get_field_index("text")]
        numbers = pa.array(np.arange(batch.num_rows))
        scored = next(_scored(iter([pa.RecordBatch.from_arrays([numbers, text], names=["doc_id", "text"])]), model, 1.0))
        yield pa.RecordBatch.from_arrays([doc, scored.column(1)], names=["doc", "score"])


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """(doc, score): every row of docs as a struct, with the score of its column ``text``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("doc"))
    schema = T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(partial(_score_rows, model=model), schema)


def fold(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def toxic_labels(labels: DataFrame, held_out: int | None = 2) -> DataFrame:
    """(doc_id, label) of a table of labels, without the held-out fold."""
    known = labels.select("doc_id", F.col("toxic").alias("label"))
    return known if held_out is None else known.where(fold(F.col("doc_id")) != held_out)

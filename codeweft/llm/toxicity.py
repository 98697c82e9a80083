"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct words, their stems (first bytes), word pairs and pairs with one word between, hashed to
2^20 places. Training goes
through a bounded sample of labelled rows one by one; each coordinate has its own rate and the L1 term leaves few weights,
which are small enough to send to every executor whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.common import ARROW_ROWS, bounded_batches, cut, map_texts, mix, text_of, whole_row, word_hashes

BITS, STEM = 20, 4
#: Labelled rows to learn from at most: those with the smallest hashes of doc_id.
TRAINING_ROWS = 12_000
#: Bytes of their texts at most, for one worker reads them all.
TRAINING_BYTES = 64 << 20
EPOCHS, ALPHA, BETA, L1, L2 = 6, 2.0, 1.0, 10.0, 1.0
#: From this score on a text is called toxic.
THRESHOLD = 0.7


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows no model learns from: crc32 of doc_id as text leaves 1 when divided by 3 (null: as empty text)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int = TRAINING_BYTES) -> DataFrame:
    """Rows (order, label, text): labelled documents that may be learnt from, those with the smallest hashes of doc_id.

    At most `rows` of them, and no more than together have `size` bytes of text (the first counts whatever its size). Labels
    that are null or of no document are left out; of several labels of one doc_id the largest counts, of several documents the
    smallest text. Only ids are shuffled; the sample is bounded, so it is sent to the documents and no other text moves.
    """
    known = labels.where(~held_out()).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    met = known.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    sample = cut(met.withColumn("__order", F.xxhash64("doc_id")).orderBy("__order", "doc_id").limit(rows))
    texts = docs.select("doc_id", text_of("text").alias("__text")).join(F.broadcast(sample), "doc_id")
    each = cut(texts.groupBy("doc_id", "__label", "__order").agg(F.min("__text").alias("__text")))
    # One window over at most `rows` rows, of their sizes alone.
    before = Window.orderBy("__order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    told = each.select("doc_id", "__order", F.octet_length("__text").cast("long").alias("__size")).withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    kept = told.where((F.col("__before") == 0) | (F.col("__before") + F.col("__size") <= size)).select("doc_id")
    return each.join(F.broadcast(cut(kept)), "doc_id", "left_semi").select(F.col("__order").alias("order"), F.col("__label").alias("label"), F.col("__text").alias("text"))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams and skip-grams of the texts, and the number of the text each is from."""
    words, counts = word_hashes(texts)
    text = np.repeat(np.arange(len(texts)), counts)
    shift = np.uint64(64 - BITS)
    stems = mix(word_hashes(texts, STEM)[0] + np.uint64(STEM))
    places, owners = [words >> shift, stems >> shift], [text, text]
    for gap, salt in ((1, 0x51ED270B), (2, 0xA3B19535)):
        same = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, dtype=bool)
        pair = words[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + words[gap:][same] + np.uint64(salt) if same.size else np.zeros(0, np.uint64)
        places.append(mix(pair) >> shift)
        owners.append(text[:-gap][same] if same.size else np.zeros(0, np.int64))
    return np.concatenate(places).astype(np.int64), np.concatenate(owners)


def learn(rows: list[tuple[int, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights other than zero after FTRL-proximal passes over (label, places). Place 2^BITS is the intercept."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > L1, w, 0.0)

    for _ in range(epochs):
        for label, at in rows:
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            old = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - old) / ALPHA * w
    w = weights(np.arange(len(z)))
    kept = np.flatnonzero(w)
    return kept, w[kept]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Learn weights in one task from the bounded sample. Without labelled rows there are no weights and all scores are 1/2."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[int, np.ndarray]] = []
        for batch in (whole.slice(k, ARROW_ROWS) for whole in batches for k in range(0, whole.num_rows, ARROW_ROWS)):
            texts = batch.column(1).to_pylist()
            places, owners = features(texts)
            order = np.argsort(owners, kind="stable")
            parts = np.split(places[order], np.cumsum(np.bincount(owners, minlength=len(texts)))[:-1]) if texts else []
            seen += [(y, np.append(np.unique(p), 1 << BITS).astype(np.int32)) for y, p in zip(batch.column(0).to_pylist(), parts, strict=True)]
        if seen:
            place, weight = learn(seen)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(weight)], names=["place", "weight"])

    bounded_batches(docs.sparkSession)
    sample = labelled(docs, labels, label, rows).repartition(1).sortWithinPartitions("order", "text").select("label", "text")
    found = sample.mapInArrow(train, "place long, weight double").collect()  # at most 2^BITS + 1 rows
    return np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found])


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], out: str = "score", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the probability of the label for each whole text; null and empty texts get that of a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    dense: list[np.ndarray] = []

    def work(texts: list[str]) -> list[list]:
        if not dense:
            dense.append(np.zeros((1 << BITS) + 1))
            dense[0][shared.value[0]] = shared.value[1]
        w = dense[0]
        places, owners = features(texts)
        hit = w[places] != 0
        pairs = np.unique(owners[hit] * (1 << BITS) + places[hit])
        total = np.bincount(pairs >> BITS, w[pairs & ((1 << BITS) - 1)], minlength=len(texts)) + w[-1]
        return [1 / (1 + np.exp(-np.clip(total, -35, 35)))]

    return map_texts(docs, text, [(out, T.DoubleType())], work, keep)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score and predicted.

    Null texts score as empty ones, empty ones as texts without words, repeated rows each. Without labels all scores are 1/2;
    an empty table stays empty; other columns of the documents are not read.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    scored = score(rows, fit(docs, labels), keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that are not called toxic."""
    rows = docs.select(whole_row(docs), "text")
    return score(rows, fit(docs, labels), keep=["row"]).where(F.col("score") < THRESHOLD).select("row.*")

"""Resampling documents towards a target distribution by importance weights over hashed word n-grams.

A byte automaton runs over the Arrow buffer of a batch of texts: a table classifies its bytes, differences of neighbours tell
where words begin and end, and the CRC registers of all words advance together, one byte of each at a step, by the table of the
checksum. No text becomes a Python string. The buckets of the corpus and of the target are counted in one pass; a second one adds
up each document's gains. Weights with Gumbel noise are drawn from without replacement by taking the highest.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.common import bounded_batches, bucketed_rank, cut, text_of, whole_row, without

BUCKETS = 10_000
#: Bytes of text the automaton works on at a time (a longer text is one piece), and bytes of a word after which its checksum is
#: carried on alone: few words are longer, and steps for a handful of registers cost as much as for thousands.
PIECE, LONG_WORD = 1 << 20, 48
MIN_WORDS, PERCENT, SEED = 20, 25, 7
#: Quantiles of the scores that make buckets of close ranks about even.
CUTS = 256

#: Bytes as they are hashed (A-Z as a-z), and which of them are of words: digits, letters and all beyond ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _crc_table() -> np.ndarray:
    """The effect of each byte on a reflected 32-bit checksum."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word of the texts that lie between the offsets, one after the other."""
    word = _WORD[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data), dtype=bool)  # where a text begins, so does a word
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Registers after the bytes of each span, all of them advanced at once: those of longer spans stay in front."""
    order = np.argsort(starts - ends, kind="stable")
    register, at, length = state[order], starts[order], (ends - starts)[order]
    most = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(1, min(most, LONG_WORD) + 1), side="right")  # spans of at least so many bytes
    for k, n in enumerate(alive.tolist()):
        register[:n] = _CRC[(register[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (register[:n] >> np.uint32(8))
    for i in range(int(np.searchsorted(-length, -LONG_WORD, side="left"))):  # strictly longer
        rest = data[at[i] + LONG_WORD : at[i] + length[i]]
        register[i] = zlib.crc32(rest, int(register[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(register)
    out[order] = register
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, n: int = 2, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of the texts (all runs of up to n words, joined by one space), each one's text, and words of a text."""
    data = _LOWER[data]
    starts, ends = word_bounds(data, offsets)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    register, found, whose = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32), [], []
    for k in range(n):
        runs = len(starts) - k
        if runs <= 0:
            break
        if k:
            register = register[:runs]
            register = _CRC[(register ^ np.uint32(32)) & np.uint32(255)] ^ (register >> np.uint32(8))
        register = advance(register, data, starts[k:], ends[k:])
        whole = owner[:runs] == owner[k:]
        found.append(((register[whole] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64))
        whose.append(owner[:runs][whole])
    return (np.concatenate(found), np.concatenate(whose), counts) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), counts)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, to, their bytes and offsets among these, out of the buffers of an Arrow column of texts; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, n: int = 2) -> DataFrame:
    """Rows (bucket, n): how often features fall into each bucket. A task gives one row a bucket at most."""
    bounded_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in _pieces(batch.column(0)):
                total += np.bincount(feature_buckets(data, offsets, n, buckets)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["bucket", "n"])

    return texts.select(text_of(text).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain: 1000 times the logarithm of how much likelier the target makes it, both with one more in every bucket."""

    def dense(counted: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in counted.collect():  # one row a bucket at most
            out[r["bucket"]] = r["n"]
        return out

    s, t = dense(source), dense(target)
    of_s, of_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * of_s / ((a + 1) * of_t))) for a, b in zip(s, t, strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", n: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Add n_words, n_features and weight, the floored mean of the gains of a document's features (0 if it has none), to the
    columns `keep` (None: all)."""
    bounded_batches(docs.sparkSession)
    made = ["n_words", "n_features", "weight"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], text_of(F.col(f"`{text}`")).alias("__text"))
    schema = T.StructType(source.schema.fields[:-1])
    for name in made:
        schema = schema.add(name, "long")
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in _pieces(batch.column(len(keep))):
                found, whose, words = feature_buckets(data, offsets, n, len(shared.value))
                features = np.bincount(whose, minlength=end - at)
                total = np.bincount(whose, weights=shared.value[found], minlength=end - at).astype(np.int64)  # whole numbers below 2^53: exact
                weight = total // np.maximum(features, 1)
                arrays = [batch.column(i).slice(at, end - at) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(x.astype(np.int64)) for x in (words, features, weight)]], names=schema.names)

    return source.mapInArrow(run, schema)


def noise(doc_id: str | Column = "doc_id", seed: int = SEED) -> Column:
    """A Gumbel variable in thousandths, from the hash of seed and doc_id (null: of the seed alone)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    head = F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8))
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = MIN_WORDS) -> DataFrame:
    """Add rank (1, 2, 3 ...) to the highest scores among documents of enough words, ties to the smaller doc_id, until `percent` of
    these are drawn; others get null. Ranks are found in buckets of close scores, about even by quantiles, so no task sees all rows."""
    fit = F.col("n_words") >= least_words
    fit_score = F.when(fit, F.col("score"))
    told = scored.agg(F.count(F.lit(1)).alias("rows"), F.count(fit_score).alias("n"), F.min(fit_score).alias("lo"), F.max(fit_score).alias("hi"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).first()
    lo, hi, first, last = (told[k] or 0 for k in ("lo", "hi", "first", "last"))
    marks = [int(x) for x in scored.where(fit).approxQuantile("score", [k / CUTS for k in range(1, CUTS)], 0.25 / CUTS)]
    edges = F.lit([lo, *marks, hi])
    k = F.size(F.filter(F.lit(marks or [hi]), lambda x: F.col("score") > x))
    inside = F.coalesce((F.col("doc_id") - first) / F.lit(float(last - first + 1)), F.lit(1.0))
    depth = (F.get(edges, k + 1) - F.col("score") + inside) / (F.get(edges, k + 1) - F.get(edges, k) + 2)
    ordered = (F.lit(len(marks)) - k + depth) / F.lit(len(marks) + 1.0)
    place = F.when(fit, ordered).otherwise(F.shiftrightunsigned(F.xxhash64("score", "doc_id"), 11) / F.lit(2.0**53))  # others get no rank
    ranked = bucketed_rank(scored.withColumn("__fit", fit), ["__fit"], [F.desc("score"), F.col("doc_id").asc_nulls_last()], "__rank", told["rows"], position=place)
    drawn = F.col("__fit") & (F.col("__rank") < percent * told["n"] // 100)
    return ranked.withColumn("rank", F.when(drawn, F.col("__rank") + 1)).drop("__fit", "__rank")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one for each row of docs.

    Null and empty texts have no features and weight 0, and are never drawn; neither do texts of the target without words count.
    Repeated rows are documents of their own with the same score and follow each other in rank; a null doc_id gets the noise of an
    empty one and comes last among equal scores. An empty table gives no rows, an empty target the gains of no observations. Other
    columns are not read. doc_id is a whole number.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = cut(weigh(docs, gain, keep=["doc_id"]).withColumn("score", F.col("weight") + noise()))
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = MIN_WORDS) -> DataFrame:
    """The drawn documents with all their columns, and rank, which replaces a column of that name."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = docs.select(whole_row(without(docs, ["rank"])), "doc_id", "text")
    scored = cut(weigh(rows, gain, keep=["row", "doc_id"]).withColumn("score", F.col("weight") + noise()))
    return draw(scored, percent, least_words).where("rank is not null").select("row.*", "rank")

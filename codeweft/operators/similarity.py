"""Similarity of symbols and vectors: token statistics, sketches, signals and top-k."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.functions import patterns as P
from codeweft.functions.text import OPERATOR_MARKS, TOKEN, cosine, jaccard, path_proximity, quantize, tokens
from codeweft.operators import graph
from codeweft.schema import SIGNAL_WEIGHTS

DIMENSION, SLOTS = 768, 64
_BASIS, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(words: list[str], seed: int = 0) -> np.ndarray:
    """64-bit FNV-1a of each word, the seed folded into the basis; all words a byte at a time."""
    data = [w.encode() for w in words]
    size = max(map(len, data), default=0)
    grid = np.zeros((len(data), size), dtype=np.uint64)
    for row, w in zip(grid, data, strict=True):
        row[: len(w)] = np.frombuffer(w, dtype=np.uint8)
    length, h = np.array([len(w) for w in data]), np.full(len(data), _BASIS ^ seed, dtype=np.uint64)
    for k in range(size):
        h = np.where(k < length, (h ^ grid[:, k]) * np.uint64(_PRIME), h)
    return h


@F.pandas_udf(T.LongType())
def fnv_hash(words: pd.Series) -> pd.Series:
    """FNV-1a as a signed 64-bit integer."""
    return pd.Series(fnv1a(words.fillna("").tolist()).astype(np.int64))


def _slots(words: list[str]) -> np.ndarray:
    """Two places and a sign of each word in a random-index vector."""
    a, b, s = (fnv1a(words, k) for k in range(3))
    sign = np.where(s % np.uint64(2) == 0, 1, -1)
    return np.stack([(a % np.uint64(DIMENSION)).astype(int), (b % np.uint64(DIMENSION)).astype(int), sign], axis=1).astype(np.int32)


def _sketch_hashes(shingles: list[str]) -> np.ndarray:
    """The seeded hashes of each shingle, sign bit flipped so that signed order is unsigned order. The longest come first, so that each
    place of the texts is a step over those that have it, all seeds at a time."""
    data = [w.encode() for w in shingles]
    size = np.array([len(w) for w in data], dtype=np.int64)
    order = np.argsort(-size, kind="stable")
    flat, start = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint64), np.cumsum(size) - size
    out = np.empty((len(data), SLOTS), dtype=np.uint64)
    for k in range(0, len(data), 2048):
        own = order[k : k + 2048]
        h = np.tile(np.uint64(_BASIS) ^ np.arange(SLOTS, dtype=np.uint64), (len(own), 1))
        for place in range(int(size[own[0]])):
            n = int(np.searchsorted(-size[own], -place))  # those longer than the place
            h[:n] ^= flat[start[own[:n]] + place][:, None]
            h[:n] *= np.uint64(_PRIME)
        out[own] = h
    return (out ^ np.uint64(1 << 63)).astype(np.int64)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def index_slots(words: pd.Series) -> pd.Series:
    """Two places and a sign of each word in a random-index vector."""
    return pd.Series(list(_slots(words.fillna("").tolist())))


@F.pandas_udf(T.ArrayType(T.LongType()))
def slot_hashes(shingles: pd.Series) -> pd.Series:
    """The seeded hashes of a shingle; see _sketch_hashes."""
    return pd.Series(list(_sketch_hashes(shingles.fillna("").tolist())))


_TOKEN = re.compile(TOKEN)
#: Rows of a batch that leaves a Python task; shingles that are hashed at a time.
_ROWS, _HASHED = 100_000, 20_000
#: Rows of tokens that are added up at a time, or those of one key.
_SUMMED = 30_000


def _words_of(text: str | None) -> list[str]:
    """As tokens(), in Python."""
    return _TOKEN.findall(text.encode().lower().decode()) if text else []  # bytes lower A to Z alone


def _shingles_of(words: list[str], k: int = 3) -> list[str]:
    """As shingles(), in Python."""
    return ["_".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def _counted(texts: DataFrame, key: str, text: str, item: str, items: Callable[[list[str]], list[str]], total: bool = False) -> DataFrame:
    """Rows (key, item, n) and with total the number of the text's words: what is in each text, counted where the text stands, so that
    nothing is shuffled. Only the rows of keys that more than one text has are added up afterwards."""
    kind = texts.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField(item, T.StringType()), T.StructField("n", T.LongType()), *([T.StructField("total", T.IntegerType())] if total else [])])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            columns = [keys.take(pa.array(np.repeat(rows, sizes))), pa.array(found, pa.string()), pa.array(times, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *([pa.array(np.repeat(totals, sizes), pa.int32())] if total else [])], names=schema.names)

        for batch in batches:
            keys = batch.column(0)
            rows, sizes, totals, found, times = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                words = _words_of(value.as_py())
                bag = Counter(items(words))
                rows.append(row)
                sizes.append(len(bag))
                totals.append(len(words))
                found += bag.keys()
                times += bag.values()
                if len(found) >= _ROWS:
                    yield told()
                    rows, sizes, totals, found, times = [], [], [], [], []
            if found:
                yield told()

    narrow = texts.select(F.col(key), F.col(text).alias("__text"))
    several = narrow.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col(key).alias("__key"))
    if several.isEmpty():
        return narrow.mapInArrow(count, schema)
    same = narrow[key].eqNullSafe(several["__key"])
    merged = narrow.join(several, same, "left_semi").mapInArrow(count, schema)
    merged = merged.groupBy(key, item, *(["total"] if total else [])).agg(F.sum("n").alias("n")).select(*schema.names)
    return narrow.join(several, same, "left_anti").mapInArrow(count, schema).unionByName(merged)


def token_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, token, n): how often each token is in each text."""
    return _counted(texts, key, text, "token", lambda words: words)


def token_bags(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, token, n, total): as token_rows, with the number of tokens of the whole text beside each."""
    return _counted(texts, key, text, "token", lambda words: words, total=True)


def shingle_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, shingle, n): how often each shingle is in each text."""
    return _counted(texts, key, text, "shingle", _shingles_of)


def idf(counted: DataFrame, documents: int | Column) -> DataFrame:
    """Rows (token, df, idf): ln((N + 1) / (df + 1)) + 1 from rows (key, token, n)."""
    n = F.lit(documents) if isinstance(documents, int) else documents
    return counted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)


def tfidf(counted: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Rows (key, token, w): share of the text's tokens times idf. counted: key, token, n and, if it is there, total."""
    if "total" not in counted.columns:
        counted = counted.join(counted.groupBy(key).agg(F.sum("n").alias("total")), key)
    return by_token(counted, known, "idf").select(key, "token", (F.col("n") / F.col("total") * F.col("idf")).alias("w"))


#: A word that has more than one in this many of all rows is frequent; by that there are fewer of them.
OFTEN = 500_000


def by_token(counted: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
    """Join the columns of each token. Where known says in how many texts each is (df), frequent ones, fewer than OFTEN, are sent to the
    rows, which are most of them; only rows of rare tokens are shuffled, and none meet in one task for their token."""
    if "df" not in known.columns:
        return counted.join(known.select("token", *columns), "token")
    least = (known.agg(F.sum("df")).first()[0] or 0) // OFTEN
    often = F.broadcast(known.where(F.col("df") > least).select("token", *columns))
    near = counted.join(often, "token")
    if not least:
        return near
    rare = counted.join(F.broadcast(known.where(F.col("df") > least).select("token")), "token", "left_anti").join(known.where(F.col("df") <= least).select("token", *columns), "token")
    return near.unionByName(rare)


def ri_lists(counted: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Rows (key, slots, vs) of random-index vectors, scaled to length 1: a row for each key with the places that its tokens have and what
    is there. Hashing runs over the distinct words only; a token is one row when keys meet, and runs of a key are added up as arrays."""
    placed = known.select("token", "idf", *(["df"] if "df" in known.columns else [])).withColumn("s", index_slots("token"))
    parts = by_token(counted, placed, "idf", "s").select(key, F.col("s")[0].alias("p"), F.col("s")[1].alias("q"), (F.col("n") * F.col("idf") * F.col("s")[2]).alias("x"))
    schema = T.StructType([T.StructField(key, counted.schema[key].dataType), T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("vs", T.ArrayType(T.DoubleType()))])

    def added(rows: pa.Table, run: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(run, prepend=-1))
        p, q, x = (rows.column(k).to_numpy() for k in (1, 2, 3))
        places = np.concatenate([run * DIMENSION + p, run * DIMENSION + q])
        there = np.flatnonzero(np.bincount(places, minlength=len(first) * DIMENSION))
        v = np.bincount(places, np.concatenate([x, x * 0.5]), len(first) * DIMENSION)[there]
        of = there // DIMENSION
        norm = np.sqrt(np.bincount(of, v**2, len(first)))[of]
        v = np.where(norm > 1e-8, v / np.where(norm > 1e-8, norm, 1), v)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(first)))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(a)) for a in ((there % DIMENSION).astype(np.int32), v)]
        return pa.RecordBatch.from_arrays([rows.column(0).combine_chunks().take(pa.array(first)), *lists], names=schema.names)

    def runs(keys: pa.ChunkedArray) -> np.ndarray:
        """The number of each row's run of equal keys; a missing key is one, too."""
        codes = keys.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        return np.cumsum(np.diff(codes, prepend=codes[:1]) != 0)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < _SUMMED:
                continue
            rows = pa.Table.from_batches(held)
            run = runs(rows.column(0))
            whole = int(np.searchsorted(run, run[-1]))  # the last key may go on
            if whole:
                yield added(rows.slice(0, whole), run[:whole])
            held, size = rows.slice(whole).combine_chunks().to_batches(), len(rows) - whole if whole else 0
        if held:
            rows = pa.Table.from_batches(held)
            if len(rows):
                yield added(rows, runs(rows.column(0)))

    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(add, schema)


def ri_sparse(counted: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Rows (key, slot, v): ri_lists() with a row for each place."""
    return ri_lists(counted, key, known).select(key, F.inline(F.arrays_zip(F.col("slots").alias("slot"), F.col("vs").alias("v"))))


def shingles(words: Column, k: int = 3) -> Column:
    """k words in a row joined by _; fewer words make one shingle, none makes none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), "_"))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(many)


def minhash(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, sketch): 64 unsigned minima over 3-token shingles; a text without tokens has none. Shingles never leave the task
    that reads their text; texts of one key share their minima."""
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("own", T.ArrayType(T.LongType()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ends, made, low = [], [0], [], []
            for row, value in enumerate(batch.column(1)):
                new = _shingles_of(_words_of(value.as_py()))
                while new:
                    part, new = new[:_HASHED], new[_HASHED:]
                    rows.append(row)
                    made += part
                    ends.append(len(made))
                    if len(made) >= _HASHED:
                        low.append(np.minimum.reduceat(_sketch_hashes(made), ends[:-1], axis=0))
                        ends, made = [0], []
            if made:
                low.append(np.minimum.reduceat(_sketch_hashes(made), ends[:-1], axis=0))
            if rows:
                values = pa.array(np.concatenate(low).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SLOTS), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists], names=schema.names)

    own = texts.select(F.col(key), F.col(text).alias("__text")).mapInArrow(sketch, schema)
    low = own.groupBy(key).agg(*[F.min(F.col("own")[k]).alias(f"m{k}") for k in range(SLOTS)])
    return low.select(key, F.array(*[F.col(f"m{k}") for k in range(SLOTS)]).alias("sketch"))


def sketch_similarity(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.lit(float(SLOTS))


def api_tokens(signature: Column) -> Column:
    return F.filter(tokens(signature), lambda t: ~t.isin(*P.API_STOP))


def _count(words: Column, word: Column) -> Column:
    return F.size(F.filter(words, lambda t: t == word))


def api_similarity(a: Column, b: Column) -> Column:
    """Token frequencies of a against the set of b, over the larger of their lengths, within 0 and 1; not symmetric."""
    xs, ys = F.array_distinct(a), F.array_distinct(b)
    share = F.transform(xs, lambda t: _count(a, t) / F.size(a))
    norm = F.sqrt(F.aggregate(share, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.filter(xs, lambda t: F.array_contains(ys, t)), F.lit(0.0), lambda s, t: s + _count(a, t) / F.size(a))
    value = dot / F.greatest(norm, F.sqrt(F.size(ys).cast("double")))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def volume(signature: Column) -> Column:
    """Operator marks and tokens of a signature."""
    marks = F.length(signature) - F.length(F.translate(signature, OPERATOR_MARKS, ""))
    return (marks + F.size(tokens(signature))).cast("double")


def volume_similarity(a: Column, b: Column) -> Column:
    return volumes_alike(volume(a), volume(b))


def volumes_alike(x: Column, y: Column) -> Column:
    return F.when((x == 0) & (y == 0), 0.0).otherwise(1 - F.abs(x - y) / F.greatest(x, y))


def type_tokens(signature: Column) -> Column:
    """Words that begin with a capital, without common ones, in lower case."""
    found = F.regexp_extract_all(signature, F.lit(r"(?<![\p{L}\p{N}_])(\p{Lu}[\p{L}\p{N}_]+)"), F.lit(1))
    return F.transform(F.filter(found, lambda t: ~t.isin(*P.TYPE_STOP)), F.lower)


def identifier_tokens(signature: Column, name: Column) -> Column:
    return F.filter(F.concat(tokens(signature), tokens(name)), lambda t: F.length(t) >= 3)


def decorator_tokens(signature: Column) -> Column:
    marked = F.filter(F.transform(F.split(signature, "\n", -1), F.trim), lambda x: x.startswith("#") | x.startswith("@"))
    return F.flatten(F.transform(marked, tokens))


def histogram(signature: Column, name: Column) -> Column:
    """How many tokens are keywords, identifiers, others and numbers."""
    words = F.concat(tokens(signature), tokens(name))
    is_key, is_number = (lambda t: t.isin(*P.KEYWORDS)), (lambda t: t.rlike("^[0-9]+$"))
    number = F.size(F.filter(words, lambda t: ~is_key(t) & is_number(t)))
    key = F.size(F.filter(words, is_key))
    return F.array(key.cast("double"), (F.size(words) - key - number).cast("double"), F.lit(0.0), number.cast("double"))


def combined(signals: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    weights = weights or SIGNAL_WEIGHTS
    out = F.lit(0.0)
    for name, column in signals.items():
        out = out + column * weights.get(name, 0.0)
    return out


def prepared(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols with what their signals are computed from; neighbours are those by CALLS within the population."""
    s = symbols.select("qualified_name", "name", "label", "file_path", F.coalesce("signature", F.lit("")).alias("signature"))
    s = s.withColumn("document", F.concat_ws(" ", "name", "qualified_name", "label", "signature"))
    names = s.select("qualified_name")
    calls = edges.where("edge_type = 'CALLS' and src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = calls.unionByName(calls.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(names.withColumnRenamed("qualified_name", "a"), "a", "left_semi").join(names.withColumnRenamed("qualified_name", "b"), "b", "left_semi")
    near = both.groupBy(F.col("a").alias("qualified_name")).agg(F.collect_set("b").alias("near"))
    counted = token_rows(s, "qualified_name", "document")
    size = s.agg(F.count(F.lit(1)).alias("documents"))
    known = counted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(size)).withColumn("idf", F.log((F.col("documents") + 1) / (F.col("df") + 1)) + 1)
    weights = tfidf(counted, "qualified_name", known).groupBy("qualified_name").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("tfidf"))
    ri = ri_lists(counted, "qualified_name", known).select("qualified_name", F.map_from_arrays("slots", "vs").alias("ri"))
    out = s.join(near, "qualified_name", "left").join(weights, "qualified_name", "left").join(ri, "qualified_name", "left").join(minhash(s, "qualified_name", "document"), "qualified_name", "left")
    return out.select("*", api_tokens(F.col("signature")).alias("api"), type_tokens(F.col("signature")).alias("types"), F.array_distinct(identifier_tokens(F.col("signature"), F.col("name"))).alias("words"), histogram(F.col("signature"), F.col("name")).alias("kinds"), F.array_distinct(decorator_tokens(F.col("signature"))).alias("marks"))


def _map_cosine(a: Column, b: Column) -> Column:
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x)
    product = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))
    norm = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.coalesce(F.when(norm > 0, product / norm), F.lit(0.0))


#: The signals of a pair that are made from vectors or sets, by the column that each reads.
_SETS = {"type": "types", "flow": "words", "decorator": "marks", "diffusion": "near"}
#: Symbols of a block, and blocks of a partition at most. A block is one packed row; partitions of blocks meet without being shuffled for
#: it, and a task reads a block at a time of either side, so neither what is written nor what a task holds grows with the square of the input.
BLOCK, GROUP, TASKS = 1024, 32, 12


def pair_signals(ready: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows (a, b, one column for each signal) of given pairs, as expressions. ready: see prepared()."""
    x = ready.select(*[F.col(c).alias(f"{c}_a") for c in ready.columns])
    y = ready.select(*[F.col(c).alias(f"{c}_b") for c in ready.columns])
    p = candidates.join(x, F.col("a") == F.col("qualified_name_a")).join(y, F.col("b") == F.col("qualified_name_b"))
    c = lambda n: (F.col(f"{n}_a"), F.col(f"{n}_b"))
    empty = F.array().cast("array<string>")
    signals = {
        "tfidf": _map_cosine(*c("tfidf")),
        "ri": _map_cosine(*c("ri")),
        "minhash": F.coalesce(sketch_similarity(*c("sketch")), F.lit(0.0)),
        "api": api_similarity(*c("api")),
        "module": path_proximity(*c("file_path")),
        "ast": cosine(*c("kinds")),
        "halstead": volume_similarity(*c("signature")),
    } | {name: jaccard(*[F.coalesce(k, empty) for k in c(column)]) for name, column in _SETS.items()}
    return p.select("a", "b", *[v.alias(n) for n, v in signals.items()])


#: Items that meet in at most one of this many pairs of a block are multiplied pair by pair, the others as dense strips.
_SPARSE, _STRIP, _PAIRS = 200, 1024, 1 << 20


def _entries(x: pd.Series, y: pd.Series) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """(row, number of the item) of everything in the lists of both sides, and how many numbers there are; null lists are empty."""
    lists = [[() if v is None else v for v in side] for side in (x, y)]
    rows = [np.repeat(np.arange(len(side)), np.fromiter(map(len, side), int, len(side))) for side in lists]
    codes, known = pd.factorize(np.array([w for side in lists for v in side for w in v], dtype=object))
    return [(rows[0], codes[: len(rows[0])]), (rows[1], codes[len(rows[0]) :])], len(known)


def _once(rows: np.ndarray, codes: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (row, item) and how often each stands there."""
    places, n = np.unique(rows * max(known, 1) + codes, return_counts=True)
    return places // max(known, 1), places % max(known, 1), n.astype(float)


def _products(a: tuple, b: tuple, known: int, shape: tuple[int, int]) -> np.ndarray:
    """Inner products of sparse rows, each side as (row, item, value). Memory is bounded whatever the number of items: those of
    few rows are joined a million pairs at a time, the others multiplied in strips."""
    out = np.zeros(shape)
    met = np.bincount(a[1], minlength=known) * np.bincount(b[1], minlength=known)
    few = met * _SPARSE <= shape[0] * shape[1]
    often = np.flatnonzero(~few)
    place = np.full(known, -1)
    place[often] = np.arange(len(often))
    for k in range(0, len(often), _STRIP):
        width, grids = min(_STRIP, len(often) - k), []
        for (rows, codes, values), n in ((a, shape[0]), (b, shape[1])):
            at = place[codes] - k
            own = (at >= 0) & (at < width)
            grids.append(np.bincount(rows[own] * width + at[own], values[own], n * width).reshape(n, width))
        out += grids[0] @ grids[1].T
    rows, codes, values = (v[few[a[1]] & (met[a[1]] > 0)] for v in a)
    order = np.argsort(b[1], kind="stable")
    other = tuple(v[order] for v in b)
    start = np.searchsorted(other[1], np.arange(known + 1))
    meets = start[codes + 1] - start[codes]
    parts = np.cumsum(meets) // _PAIRS
    for k in np.unique(parts):
        at = np.flatnonzero(parts == k)
        left = np.repeat(at, meets[at])
        right = np.arange(len(left)) - np.repeat(np.cumsum(meets[at]) - meets[at], meets[at]) + start[codes[left]]
        out += np.bincount(rows[left] * shape[1] + other[0][right], values[left] * other[2][right], out.size).reshape(shape)
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)


def _weighted(x: pd.DataFrame, y: pd.DataFrame, items: str, values: str) -> np.ndarray:
    """Cosines of weighted items."""
    sides, known = _entries(x[items], y[items])
    full = [(*e, np.array([v for vs in side[values] if vs is not None for v in vs], dtype=float)) for e, side in zip(sides, (x, y), strict=True)]
    norms = [np.sqrt(np.bincount(e[0], e[2] ** 2, len(side))) for e, side in zip(full, (x, y), strict=True)]
    return _ratio(_products(*full, known, (len(x), len(y))), norms[0][:, None] * norms[1][None, :])


def _api(x: pd.DataFrame, y: pd.DataFrame, first: np.ndarray) -> np.ndarray:
    """The API signal, which looks from the row that is first to the other."""
    sides, known = _entries(x["api"], y["api"])
    bags = [_once(*e, known) for e in sides]
    total = [np.bincount(e[0], minlength=len(side)).astype(float) for e, side in zip(sides, (x, y), strict=True)]
    share = [(r, c, n / t[r]) for (r, c, n), t in zip(bags, total, strict=True)]
    member = [(r, c, np.ones(len(r))) for r, c, _ in bags]
    norm = [np.sqrt(np.bincount(r, v**2, len(t))) for (r, _, v), t in zip(share, total, strict=True)]
    size = [np.sqrt(np.bincount(r, minlength=len(t))) for (r, _, _), t in zip(bags, total, strict=True)]
    shape = (len(x), len(y))
    there = _ratio(_products(share[0], member[1], known, shape), np.maximum(norm[0][:, None], size[1][None, :]))
    back = _ratio(_products(member[0], share[1], known, shape), np.maximum(size[0][:, None], norm[1][None, :]))
    return np.clip(np.where(first, there, back), 0, 1)


def _sets(x: pd.Series, y: pd.Series) -> np.ndarray:
    """Jaccard similarity of sets; two empty ones have none."""
    sides, known = _entries(x, y)
    bags = [(r, c, np.ones(len(r))) for r, c, _ in (_once(*e, known) for e in sides)]
    both = _products(*bags, known, (len(x), len(y)))
    size = [np.bincount(r, minlength=len(side)) for (r, _, _), side in zip(bags, (x, y), strict=True)]
    return _ratio(both, size[0][:, None] + size[1][None, :] - both)


def _module(x: pd.Series, y: pd.Series) -> np.ndarray:
    """Shared leading folders over the longer path."""
    paths = [[p.split("/") for p in side] for side in (x, y)]
    depth = max(len(p) for side in paths for p in side)
    part = {w: i for i, w in enumerate({w for side in paths for p in side for w in p})}
    grid = [np.array([[part[w] for w in p] + [-1 - s] * (depth - len(p)) for p in side]) for s, side in enumerate(paths)]
    shared, going = np.zeros((len(x), len(y))), np.ones((len(x), len(y)), dtype=bool)
    for k in range(depth):
        going &= grid[0][:, None, k] == grid[1][None, :, k]
        shared += going
    long = [np.array([len(p) for p in side]) for side in paths]
    blank = [(side == "").to_numpy() for side in (x, y)]
    return np.where(blank[0][:, None] | blank[1][None, :], 0.0, shared / np.maximum(long[0][:, None], long[1][None, :]))


def _kinds(x: pd.Series, y: pd.Series) -> np.ndarray:
    kinds = [np.stack(side.to_list()).astype(float) for side in (x, y)]
    return _ratio(kinds[0] @ kinds[1].T, np.sqrt((kinds[0] ** 2).sum(1))[:, None] * np.sqrt((kinds[1] ** 2).sum(1))[None, :])


def _halstead(x: pd.Series, y: pd.Series) -> np.ndarray:
    a, b = x.to_numpy()[:, None], y.to_numpy()[None, :]
    most = np.maximum(a, b)
    return np.where(most == 0, 0.0, 1 - np.abs(a - b) / np.where(most == 0, 1, most))


def _sketches(x: pd.Series, y: pd.Series, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Share of equal sketch values for the pairs of rows (i, j); no sketch, none equal."""
    there = [np.array([s is not None and len(s) > 0 for s in side], dtype=bool) for side in (x, y)]
    grid = [np.array([s if t else [0] * SLOTS for s, t in zip(side, known, strict=True)], dtype=np.int64).reshape(-1, SLOTS) for side, known in zip((x, y), there, strict=True)]
    out = np.zeros(len(i))
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        out[k : k + len(p)] = (grid[0][p] == grid[1][q]).mean(1) * (there[0][p] & there[1][q])
    return out


def _places(x: pd.Series, y: pd.Series) -> list[np.ndarray]:
    """Numbers of the texts of both sides that are in the order of the texts."""
    codes = pd.factorize(pd.concat([x, y], ignore_index=True).to_numpy(dtype=object), sort=True, use_na_sentinel=True)[0]
    return [codes[: len(x)], codes[len(x) :]]


def score_blocks(x: pd.DataFrame, y: pd.DataFrame, least: float, weights: dict[str, float], within: bool) -> tuple[pd.DataFrame, dict[str, int]]:
    """Pairs of a row of x and one of y that score `least` or more, and for how many pairs each signal had still to be known.

    Signals are added in turn, those that tell pairs apart at little cost first. A signal is at most 1, so a pair is given up once
    its sum and the weights that are left can't reach `least`; when none is left, the rest of the signals isn't computed.
    """
    i, j, score, first, asked = _scored_places(x, y, least, weights, within)
    a, b = _ends(x, y, i, j, first)
    return pd.DataFrame({"a": a, "b": b, "score": score}).astype({"a": str, "b": str, "score": float}), asked


def _ends(x: pd.DataFrame, y: pd.DataFrame, i: np.ndarray, j: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of pairs, the lesser one before the other."""
    a, b, ahead = x["qualified_name"].to_numpy(dtype=object)[i], y["qualified_name"].to_numpy(dtype=object)[j], first[i, j]
    return np.where(ahead, a, b), np.where(ahead, b, a)


def _scored_places(x: pd.DataFrame, y: pd.DataFrame, least: float, weights: dict[str, float], within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """The pairs of score_blocks() as rows of x, rows of y and scores; whether a row of x is before one of y; pairs asked of each signal."""
    places = _places(x["qualified_name"], y["qualified_name"])
    first = places[0][:, None] < places[1][None, :]
    (ours, theirs), (here, there) = _places(x["name"], y["name"]), _places(x["file_path"], y["file_path"])
    alike = (ours[:, None] == theirs[None, :]) & (here[:, None] == there[None, :])
    open_, total = (first if within else places[0][:, None] != places[1][None, :]) & ~alike, np.zeros((len(x), len(y)))
    signals = {
        "ri": lambda: _weighted(x, y, "slots", "values"),
        "halstead": lambda: _halstead(x["volume"], y["volume"]),
        "ast": lambda: _kinds(x["kinds"], y["kinds"]),
        "module": lambda: _module(x["file_path"], y["file_path"]),
        **{n: (lambda c=c: _sets(x[c], y[c])) for n, c in _SETS.items()},
        "api": lambda: _api(x, y, first),
        "tfidf": lambda: _weighted(x, y, "tokens", "weights"),
    }
    left, asked = sum(max(0.0, weights.get(n, 0.0)) for n in (*signals, "minhash")), {}
    for name, signal in signals.items():
        asked[name] = int(open_.sum())
        if not asked[name]:
            break
        value = signal()
        if name == "ri":
            open_ &= value >= 0.05
        total += weights.get(name, 0.0) * value
        left -= max(0.0, weights.get(name, 0.0))
        open_ &= total + left >= least - 1e-9
    i, j = np.nonzero(open_)
    asked["minhash"] = len(i)
    score = total[i, j] + weights.get("minhash", 0.0) * _sketches(x["sketch"], y["sketch"], i, j)
    i, j, score = (v[score >= least] for v in (i, j, score))
    return i, j, score, first, asked


def score_rows(ready: DataFrame) -> DataFrame:
    """What score_blocks() reads of prepared symbols."""
    return ready.select("qualified_name", "name", "file_path", F.map_keys("tfidf").alias("tokens"), F.map_values("tfidf").alias("weights"), F.map_keys("ri").alias("slots"), F.map_values("ri").alias("values"), "sketch", "api", "types", "words", "kinds", "marks", "near", volume(F.col("signature")).alias("volume"))


def packed(rows: DataFrame, blocks: int, block: int) -> DataFrame:
    """Rows (id, rows): blocks of about `block` rows by the hash of their name, each written as one value; no two have the same id."""

    def pack(part: pa.Table) -> pa.Table:
        values = []
        for k in range(0, len(part), 2 * block):
            own, out = part.slice(k, 2 * block).combine_chunks(), pa.BufferOutputStream()
            with pa.ipc.new_stream(out, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(own)
            values.append(out.getvalue().to_pybytes())
        first = part.column("block")[0].as_py()
        return pa.table({"id": pa.array([first + blocks * k for k in range(len(values))], pa.int64()), "rows": pa.array(values, pa.binary())})

    return rows.withColumn("block", F.pmod(F.xxhash64("qualified_name"), F.lit(blocks))).groupBy("block").applyInArrow(pack, "id long, rows binary")


def met_blocks(rows: DataFrame, n: int, work: Callable[[Iterator[tuple[pd.DataFrame, pd.DataFrame, bool]]], Iterator[pa.RecordBatch]], schema: str, block: int = BLOCK) -> DataFrame:
    """What `work` makes of the pairs of blocks (x, y, whether they are one block) of n rows, each pair once in one of the tasks."""
    blocks = max(1, -(-n // block))
    parts = met_parts(n, block)
    own = packed(rows, blocks, block).repartitionById(parts, F.pmod("id", F.lit(parts)).cast("int"))
    other = own.select(F.col("id").alias("other"), F.col("rows").alias("others"))
    # Of two blocks the lower one is on the left if their sum is even and on the right if it is odd, so that tasks have equal work.
    once = (F.col("id") == F.col("other")) | ((F.col("id") < F.col("other")) == ((F.col("id") + F.col("other")) % 2 == 0))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = lambda value: pa.ipc.open_stream(value.as_buffer()).read_pandas()

        def met() -> Iterator[tuple[pd.DataFrame, pd.DataFrame, bool]]:
            known, x = None, None
            for batch in batches:
                for i, value, j, beside in zip(*batch.columns, strict=True):
                    if i.as_py() != known:
                        known, x = i.as_py(), unpacked(value)
                    yield x, x if i == j else unpacked(beside), i == j

        return work(met())

    return own.crossJoin(other.hint("shuffle_replicate_nl")).where(once).mapInArrow(meet, schema)


def met_parts(n: int, block: int = BLOCK) -> int:
    """How many partitions the blocks of n rows are dealt to; the square of that is the number of tasks in which they meet."""
    blocks = max(1, -(-n // block))
    return max(min(blocks, TASKS), -(-blocks // GROUP))


def pair_scores(ready: DataFrame, candidates: DataFrame | None = None, least: float = 0.35, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """Rows (a, b, score) of pairs a < b, not of one name in one file, whose combined score is `least` or more.

    Without candidates all pairs are scored, which is quadratic in the symbols by its meaning, as is the number of pairs found: blocks of
    symbols meet in tasks (see met_blocks), and only pairs that reach `least` come out of them. Pairs whose random-index vectors are
    less alike than 0.05 are not scored, as in the definition; others end once what is left of their signals can't bring them
    to `least` (see score_blocks). No pair is passed over for what its tokens are.
    """
    weights = weights or SIGNAL_WEIGHTS
    if candidates is not None:
        names = ready.select("qualified_name", "name", "file_path")
        own = candidates.join(names.select(*[F.col(c).alias(f"{c}_a") for c in names.columns]), F.col("a") == F.col("qualified_name_a")).join(names.select(*[F.col(c).alias(f"{c}_b") for c in names.columns]), F.col("b") == F.col("qualified_name_b"))
        fit = own.where("a < b and not (file_path_a = file_path_b and name_a = name_b)").select("a", "b")
        told = pair_signals(ready, fit).where("ri >= 0.05")
        return told.select("a", "b", combined({n: F.col(n) for n in weights}, weights).alias("score")).where(F.col("score") >= least)

    def score(met: Iterator[tuple[pd.DataFrame, pd.DataFrame, bool]]) -> Iterator[pa.RecordBatch]:
        for x, y, within in met:
            yield pa.RecordBatch.from_pandas(score_blocks(x, y, least, weights, within)[0], preserve_index=False)

    return met_blocks(score_rows(ready), ready.count(), score, "a string, b string, score double", block)


def _rounded(score: np.ndarray, digits: int) -> np.ndarray:
    """Spark's round(): half away from zero of the decimal that a number is written as."""
    far = score * 10.0**digits
    out = np.rint(far) / 10.0**digits
    for k in np.flatnonzero(np.abs(far - np.floor(far) - 0.5) < 1e-4):
        out[k] = float(Decimal(repr(float(score[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


class _Best:
    """The first `most` of the pairs seen, by (score desc, a, b). `cut`: some were left out, all of them after the last that is held."""

    def __init__(self, most: int) -> None:
        self.most, self.cut, self.least, self.size, self.parts = most, False, -math.inf, 0, []

    def add(self, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((a, b, score))
        self.size += len(score)
        if self.size > 2 * self.most:
            self.shorten()

    def shorten(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is held; where some were left out, the last comes last."""
        a, b, score = (np.concatenate(v) for v in zip(*self.parts, strict=True)) if self.parts else (np.array([], object), np.array([], object), np.array([]))
        if self.cut or len(score) > self.most:
            self.cut, self.least = True, float(-np.partition(-score, self.most - 1)[self.most - 1])
            above, level = np.flatnonzero(score > self.least), np.flatnonzero(score == self.least)
            level = np.array(sorted(level, key=lambda k: (a[k], b[k])), dtype=np.int64)[: self.most - len(above)]
            own = np.concatenate([above, level])
            a, b, score = a[own], b[own], score[own]
        self.parts, self.size = [(a, b, score)], len(score)
        return a, b, score


#: Pairs that lie on disk at a time are about this many of a type, or this many for each symbol.
PAIRS, PAIRS_EACH = 16_000_000, 32


def greedy_scores(ready: DataFrame, similar: float = 0.55, similar_cap: int = 10, related_cap: int = 15, least: float = 0.35, weights: dict[str, float] | None = None, digits: int | None = None, block: int = BLOCK, pairs: int = PAIRS, each: int = PAIRS_EACH) -> DataFrame:
    """graph.greedy_pairs() of pair_scores(), whose pairs, quadratic in the symbols, are never all written. digits: scores are rounded.

    Each task in which blocks meet returns its best pairs of either type up to a number. All pairs up to the first that a task left out
    are known then and gone through in order; symbols without room leave, and the others are scored anew for the pairs that come after.
    The result is that of going through all of them, whatever the number; fewer rounds are needed the more pairs lie on disk at a time.
    """
    spark, weights = ready.sparkSession, weights or SIGNAL_WEIGHTS
    rows, n = score_rows(ready), ready.count()
    caps = {"SIMILAR_TO": similar_cap, "SEMANTICALLY_RELATED": related_cap}
    after: dict[str, tuple[float, str, str] | None] = dict.fromkeys(caps)  # the types that are not at their end, and the pair up to which they are
    most, taken = max(pairs, each * n), []
    used = spark.createDataFrame([], "edge_type string, n string, used long")
    while after:
        own = rows.withColumns({f"room_{k}": F.lit(True) for k in after})
        if taken:
            room = used.groupBy("n").agg(*[F.max(F.when(F.col("edge_type") == k, F.col("used"))).alias(k) for k in after])
            own = rows.join(room, rows["qualified_name"] == room["n"], "left").select(*rows.columns, *[(F.coalesce(k, F.lit(0)) < caps[k]).alias(f"room_{k}") for k in after])
            own = own.where(" or ".join(f"room_{k}" for k in after))
            n = own.count()
        told = graph.kept(met_blocks(own, n, _best_pairs(similar, least if "SEMANTICALLY_RELATED" in after else max(least, similar - 1e-5), weights, digits, after, max(1, most // met_parts(n, block) ** 2)), f"{graph.CHOSEN}, cut boolean", block))
        ends = told[0].where("cut").groupBy("edge_type").agg(F.min(F.struct((-F.col("score")).alias("down"), "a", "b")).alias("end")).collect()
        after = {r["edge_type"]: (-r["end"]["down"], r["end"]["a"], r["end"]["b"]) for r in ends}
        known = F.lit(True)
        for k, (score, a, b) in after.items():
            known &= (F.col("edge_type") != k) | (F.col("score") > score) | ((F.col("score") == score) & ((F.col("a") < a) | ((F.col("a") == a) & (F.col("b") <= b))))
        taken += graph.greedy_folders(told[0].where(known).drop("cut"), told[1], used, similar_cap, related_cap)
        if after:
            used, _ = graph.kept(graph.chosen_edges(spark, taken).select("edge_type", F.explode(F.array("a", "b")).alias("n")).groupBy("edge_type", "n").agg(F.count(F.lit(1)).alias("used")))
    return graph.chosen_edges(spark, taken)


def _best_pairs(similar: float, least: float, weights: dict[str, float], digits: int | None, after: dict[str, tuple[float, str, str] | None], most: int) -> Callable[[Iterator[tuple[pd.DataFrame, pd.DataFrame, bool]]], Iterator[pa.RecordBatch]]:
    """The work of a task of greedy_scores()."""

    def best(met: Iterator[tuple[pd.DataFrame, pd.DataFrame, bool]]) -> Iterator[pa.RecordBatch]:
        held = {kind: _Best(most) for kind in after}
        for x, y, within in met:
            i, j, score, first, _ = _scored_places(x, y, least, weights, within)
            if digits is not None:
                score = _rounded(score, digits)
            for kind, end in after.items():
                own = (score >= similar) == (kind == "SIMILAR_TO")
                own &= x[f"room_{kind}"].to_numpy(dtype=bool)[i] & y[f"room_{kind}"].to_numpy(dtype=bool)[j] & (score >= held[kind].least)
                if end is not None:
                    own &= score <= end[0]
                own = np.flatnonzero(own)
                a, b = _ends(x, y, i[own], j[own], first)
                if end is not None:
                    later = np.ones(len(own), dtype=bool)
                    for k in np.flatnonzero(score[own] == end[0]):
                        later[k] = (a[k], b[k]) > end[1:]
                    own, a, b = own[later], a[later], b[later]
                held[kind].add(a, b, score[own])
        for kind, some in held.items():
            a, b, score = some.shorten()
            if len(score):
                cut = np.arange(len(score)) == (len(score) - 1 if some.cut else -1)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(score), pa.array([kind] * len(score)), pa.array(cut)], names=["a", "b", "score", "edge_type", "cut"])

    return best


@F.arrow_udf(T.ArrayType(T.ByteType()))
def dense_codes(slots: pa.Array, values: pa.Array) -> pa.Array:
    """quantize() of the vectors that have these values in these places and 0 elsewhere; a batch is one grid."""
    grid = np.zeros((len(slots), DIMENSION), dtype=np.int8)
    v = values.flatten().to_numpy(zero_copy_only=False)
    far = np.minimum(1.0, np.abs(v)) * 127
    low = np.floor(far)
    grid[np.repeat(np.arange(len(slots)), pc.list_value_length(slots).to_numpy()), slots.flatten().to_numpy()] = np.sign(v) * (low + (far - low >= 0.5))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(slots) + 1, dtype=np.int32) * DIMENSION), pa.array(grid.ravel()))


def code_cosine(a: Column, b: list[int] | None) -> Column:
    """cosine() of vectors of whole numbers with a known one, as products of a batch; null with none."""
    one = np.nan_to_num(np.array([] if b is None else b, dtype=float))  # missing components are 0

    @F.arrow_udf(T.DoubleType())
    def met(a: pa.Array) -> pa.Array:
        size = pc.list_value_length(a).fill_null(0).to_numpy()
        rows, at = np.repeat(np.arange(len(a)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        v = np.asarray(a.flatten().fill_null(0), dtype=float)
        norm = np.sqrt(np.bincount(rows, v**2, len(a))) * np.sqrt((one**2).sum())
        return pa.array(_ratio(np.bincount(rows, v * np.append(one, 0.0)[np.minimum(at, len(one))], len(a)), norm), mask=np.asarray(a.is_null()))

    return F.lit(None).cast("double") if b is None else met(a)


def symbol_vectors(symbols: DataFrame) -> DataFrame:
    """Rows (qualified_name, dim, data): the random-index vector of each symbol's document, as whole numbers from -127 to 127."""
    s = symbols.select("qualified_name", F.concat_ws(" ", "name", "qualified_name", "label", F.coalesce("signature", F.lit(""))).alias("document"))
    counted = token_rows(s, "qualified_name", "document")
    known = idf(counted, s.count())
    return ri_lists(counted, "qualified_name", known).select("qualified_name", F.lit(DIMENSION).alias("dim"), dense_codes("slots", "vs").alias("data"))


def text_vector(query: DataFrame) -> DataFrame:
    """One row (q): the vector of a query text (text) as whole numbers. The text is its own corpus, so all its words weigh alike."""
    asked = token_rows(query.limit(1).select(F.lit(1).alias("id"), "text"), "id", "text")
    return ri_lists(asked, "id", asked.select("token", F.lit(1.0).alias("idf"))).select(dense_codes("slots", "vs").alias("q"))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("tfidf", "ri", "minhash")]))
def asked_signals(words: pd.Series, asked: pd.Series) -> pd.DataFrame:
    """Signals of a query's words (the same in all rows) with the words of each text, where the two are the whole corpus: a word of
    one of them alone weighs ln(3/2) + 1, one of both 1. The query's own vector knows no other text, so its words weigh 1."""
    texts = [list(asked.iloc[0]) if len(asked) else [], *map(list, words)]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    code, known = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    row, code, n = _once(row, code, len(known))
    weight = np.full(len(known), math.log(1.5) + 1)
    weight[code[row == 0]] = 1.0
    value = n * weight[code]
    share = value / np.maximum(1, np.array([len(t) for t in texts]))[row]
    norm = np.sqrt(np.bincount(row, share**2, len(texts)))
    own = np.zeros(len(known))
    own[code[row == 0]] = share[row == 0]
    tfidf = _ratio(np.bincount(row, share * own[code], len(texts)), norm * norm[0])[1:]
    slots = np.array(_slots(list(known))).reshape(-1, 3)[code]
    grid = np.zeros((len(texts), DIMENSION))
    np.add.at(grid, (row, slots[:, 0]), value * slots[:, 2])
    np.add.at(grid, (row, slots[:, 1]), value * slots[:, 2] * 0.5)
    norm = np.sqrt((grid**2).sum(1))
    ri = _ratio(grid @ grid[0], norm * norm[0])[1:]
    made = [["_".join(t[k : k + 3]) for k in range(max(1, len(t) - 2))] if t else [] for t in texts]
    code, known = pd.factorize(np.array([w for m in made for w in m], dtype=object))
    hashes, ends = _sketch_hashes(list(known)), np.cumsum([len(m) for m in made])
    sketch = [hashes[code[e - len(m) : e]].min(0) if m else None for e, m in zip(ends, made, strict=True)]
    same = [0.0 if s is None or sketch[0] is None else float((s == sketch[0]).mean()) for s in sketch[1:]]
    return pd.DataFrame({"tfidf": tfidf, "ri": ri, "minhash": same})


def search_signals(vectors: DataFrame, symbols: DataFrame, query: DataFrame, least: float = 0.05) -> DataFrame:
    """Rows of symbols with a column for each signal between a query text and them, for those whose stored vectors are as near
    to the query's as `least`. The query has no path and no neighbours, so `module` and `diffusion` are 0."""
    text, name = F.col("text"), F.lit("query")
    of_query = {"_asked": tokens(text), "_api": api_tokens(text), "_kinds": histogram(text, name), "_volume": volume(text), "_types": type_tokens(text), "_words": identifier_tokens(text, name), "_marks": decorator_tokens(text)}
    asked = query.limit(1).select("text", *[v.alias(n) for n, v in of_query.items()]).where(F.size("_asked") > 0)
    one = text_vector(asked).first()  # the one vector that all are held against
    near = vectors.where(code_cosine(F.col("data"), one and one["q"]) >= least).select("qualified_name").join(F.broadcast(asked.drop("text")))
    told = symbols.join(near, "qualified_name")
    signature = F.coalesce("signature", F.lit(""))
    told = told.withColumn("made", asked_signals(tokens(F.concat_ws(" ", "name", "qualified_name", "label", signature)), F.col("_asked")))
    signals = {
        **{n: F.col(f"made.{n}") for n in ("tfidf", "ri", "minhash")},
        "api": api_similarity(F.col("_api"), api_tokens(signature)),
        "module": F.lit(0.0),
        "ast": cosine(F.col("_kinds"), histogram(signature, F.col("name"))),
        "halstead": volumes_alike(F.col("_volume"), volume(signature)),
        "type": jaccard(F.col("_types"), type_tokens(signature)),
        "flow": jaccard(F.col("_words"), identifier_tokens(signature, F.col("name"))),
        "decorator": jaccard(F.col("_marks"), decorator_tokens(signature)),
        "diffusion": F.lit(0.0),
    }
    return told.select(*symbols.columns, F.struct(*[F.coalesce(v, F.lit(0.0)).alias(n) for n, v in signals.items()]).alias("signals"))


def vector_search(vectors: DataFrame, symbols: DataFrame, query: DataFrame, limit: int | None = 20, least: float = 0.05, weights: dict[str, float] | None = None) -> DataFrame:
    """The symbols that a query text (one row, text) finds, best first: rows of symbols with score and signals.

    The stored vectors choose who is looked at (`least`), all eleven signals give the score, and scores over 0.1 count. Without
    `limit` all that are found. A query without words, one that is null and an empty table find nothing; ties go by name.
    """
    found = search_signals(vectors, symbols, query, least)
    ranked = found.withColumn("score", combined({n: F.col(f"signals.{n}") for n in SIGNAL_WEIGHTS}, weights)).orderBy(F.desc("score"), "qualified_name")
    # The test stands after the limit, which it doesn't change: before it, all signals would be made twice.
    return (ranked if limit is None else ranked.limit(limit)).where("score > 0.1")


def vector_topk(vectors: DataFrame, query: DataFrame, limit: int = 20, least: float = 0.05) -> DataFrame:
    """Rows (id, score) of the vectors nearest by cosine to the one query vector (q): a cheap test on whole numbers first."""
    with_q = vectors.join(F.broadcast(query.limit(1)))
    stored = vectors.schema["v"].dataType.elementType.typeName() == "byte"
    codes = F.col("v") if stored else quantize(F.col("v"))
    near = with_q.where(cosine(codes, quantize(F.col("q"))) >= least)
    return near.select("id", cosine(F.col("v"), F.col("q")).alias("score")).orderBy(F.desc("score"), "id").limit(limit)

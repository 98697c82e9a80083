"""N-gram Jaccard join: texts whose sets of five-word shingles have a similarity of 0.8 or more.

Equal texts fall together first, by digest. Texts that share a MinHash band are candidates: their MinHash values are compared
a few at a time, and a pair is dropped as soon as the posterior probability that it reaches the threshold is below the
tolerance. Of the pairs that stay a task returns a spanning forest only, and their components are worked on in blocks, in
which pairs are compared in the same way and those that stay verified on their exact sets. Tasks return each text's number of
links and a spanning forest, not the pairs, so results grow with the texts whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.common import cut, map_texts, mix, text_of, whole_row, word_hashes

SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5  # a link: similarity of 4/5 at least
#: Two texts at the threshold share no band with a probability of (1 - 0.8^6)^36, under 2 in 100,000.
BANDS, ROWS = 36, 6
#: MinHash values of the incremental comparison, how many at a time, and the posterior probability below which a pair goes.
VALUES, STEP, TOLERANCE = 128, 16, 1e-6
#: A block holds about so many texts and so many bytes of text; a bucket of a band is compared in parts of about so many texts.
BLOCK_TEXTS, BLOCK_BYTES, BUCKET_TEXTS = 128, 1 << 20, 1024
#: Pairs of a bucket up to this size are compared in one go with those of other buckets.
SMALL_BUCKET = 16
#: Joins to one row of each key are dealt by key and by so many parts of its rows; thus both sides are shuffled for the join
#: itself, and Spark splits what is skewed.
PARTS = 4
#: Rows of ids (about 50 bytes each) up to which they are sent to every executor; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
_RANDOM = np.random.default_rng(20240607)
_XOR = _RANDOM.integers(0, 1 << 32, max(BANDS * ROWS, VALUES), dtype=np.uint64).astype(np.uint32)
_ODD = (_RANDOM.integers(0, 1 << 32, len(_XOR), dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def _id() -> Column:
    return F.unhex(F.md5(text_of("text"))).alias("id")


def _windows(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each shingle its text's number and its five words; texts of fewer words are filled up with word 0."""
    missing = np.where((counts > 0) & (counts < SHINGLE), SHINGLE - counts, 0)
    if missing.any():
        words = np.insert(words, np.repeat(np.cumsum(counts), missing), words.dtype.type(0))
        counts = counts + missing
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(owner) < SHINGLE:
        return owner[:0], [words[:0]] * SHINGLE
    at = np.flatnonzero(owner[: 1 - SHINGLE] == owner[SHINGLE - 1 :])
    return owner[at], [words[at + k] for k in range(SHINGLE)]


def _minima(hashes: np.ndarray, owner: np.ndarray, texts: int, values: int) -> np.ndarray:
    """MinHash values (texts x values); a text without shingles has the largest value everywhere."""
    out = np.full((texts, values), 0xFFFFFFFF, dtype=np.uint32)
    if not len(hashes):
        return out
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    which = owner[first]
    for j in range(values):
        out[which, j] = np.minimum.reduceat((hashes ^ _XOR[j]) * _ODD[j], first)
    return out


def signatures(texts: list[str]) -> list[bytes | None]:
    """16 bits of each MinHash value, the low byte first; None for a text without words."""
    words, counts = word_hashes(texts)
    owner, parts = _windows(words, counts)
    hashes = parts[0]
    for p in parts[1:]:
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + p
    low = (_minima((mix(hashes) >> np.uint64(32)).astype(np.uint32), owner, len(texts), BANDS * ROWS) * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    return [row.tobytes() if n else None for row, n in zip(low.astype("<u2"), counts, strict=True)]


def _least_matches(values: int = VALUES) -> dict[int, int]:
    """Fewest matches among n values at which the posterior, from an even prior, of reaching the threshold is tolerable.

    The posterior after m matches is Beta(m + 1, n - m + 1), so that probability is that of at most m in n + 1 trials.
    """
    t, out = NUMERATOR / DENOMINATOR, {}
    for n in range(STEP, values + 1, STEP):
        total, m = 0.0, -1
        while total < TOLERANCE:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def _dense(*parts: np.ndarray) -> np.ndarray:
    """Exact small integers for tuples of integers."""
    ids = np.unique(parts[0], return_inverse=True)[1]
    for p in parts[1:]:
        top, more = np.unique(p, return_inverse=True)
        ids = np.unique(ids * np.int64(len(top)) + more, return_inverse=True)[1]
    return ids


def links(texts: list[str], side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text i, the later texts j that it is linked to, and their similarity. side: only pairs of different sides."""
    table: dict[bytes, int] = {}
    flat = [[table.setdefault(w, len(table) + 1) for w in _words(t)] for t in texts]
    counts = np.array([len(x) for x in flat], dtype=np.int64)
    owner, parts = _windows(np.fromiter((w for x in flat for w in x), np.int64, int(counts.sum())), counts)
    shingle = _dense(*parts)
    size = np.int64(shingle.max() + 1) if len(shingle) else np.int64(1)
    pairs = np.unique(owner * size + shingle)
    owner, shingle = pairs // size, pairs % size
    start = np.searchsorted(owner, np.arange(len(texts) + 1))
    n = np.diff(start)
    values = _minima((mix(shingle.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32), owner, len(texts), VALUES)
    least, mark = _least_matches(), np.zeros(int(size), dtype=bool)
    for i in range(len(texts) - 1):
        j = np.arange(i + 1, len(texts))
        a, b = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        j = j[(a * DENOMINATOR >= b * NUMERATOR) & (a > 0) & (True if side is None else side[j] != side[i])]
        same = np.zeros(len(j), dtype=np.int64)
        for k in range(0, VALUES, STEP):
            same += (values[i, k : k + STEP] == values[j, k : k + STEP]).sum(1)
            stay = same >= least[k + STEP]
            j, same = j[stay], same[stay]
        if not len(j):
            continue
        mark[shingle[start[i] : start[i + 1]]] = True
        if len(j) * 3 > len(texts) - i:  # most texts that follow: count in one go
            full = np.flatnonzero(n[i + 1 :]) + i + 1
            shared = np.zeros(len(texts), dtype=np.int64)
            shared[full] = np.add.reduceat(mark[shingle[start[i + 1] :]].astype(np.int64), start[full] - start[i + 1])
            shared = shared[j]
        else:
            shared = np.array([np.count_nonzero(mark[shingle[start[x] : start[x + 1]]]) for x in j])
        mark[shingle[start[i] : start[i + 1]]] = False
        union = n[i] + n[j] - shared
        good = shared * DENOMINATOR >= union * NUMERATOR
        if good.any():
            yield i, j[good], shared[good] / union[good]


def _words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_TO_SPACE).split()


_TO_SPACE = bytes(i if i > 127 or chr(i) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for i in range(256))


def to_one(rows: DataFrame, one: DataFrame, key: str, spread: str) -> DataFrame:
    """Join rows to the one row of their key, which an aggregate made. A hot key's rows are dealt by `spread` too."""
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(PARTS)))
    return dealt.join(one.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))), [key, "__part"]).drop("__part")


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, root) for the nodes of edges (a, b): root is the smallest id of the component.

    Alternate large and small stars; every step is a grouped minimum and a join, so no neighbourhood is gathered.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = to_one(both, least, "a", "b")
        hung = joined.where("b > a") if large else joined.where("b <> m")
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out if large else out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    edges, told = cut(edges.where("a <> b").distinct()), None
    while True:
        new = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == told or not new[0]:
            break
        told = new
        edges = cut(star(cut(star(edges, True)), False))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class _Sets:
    """Sets of ids that grow together."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.root: list[int] = []

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: bytes, b: bytes) -> bool:
        """Whether the two were apart."""
        x, y = (self.find(self.number[k] if k in self.number else self._new(k)) for k in (a, b))
        self.root[x] = y
        return x != y

    def _new(self, k: bytes) -> int:
        self.number[k] = len(self.root)
        self.root.append(self.number[k])
        return self.number[k]


def _stay(values: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs (i, j) stay candidates when their values are compared step by step."""
    alive = np.arange(len(i))
    same = np.zeros(len(i), dtype=np.int64)
    for n, m in least.items():
        same += (values[i[alive], n - STEP : n] == values[j[alive], n - STEP : n]).sum(1)
        stay = same >= m
        alive, same = alive[stay], same[stay]
        if not len(alive):
            break
    return alive


def bucket_ties(values: np.ndarray, bucket: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that connect what the candidate pairs of each bucket connect.

    values: MinHash values by row; bucket: sorted numbers; side: for buckets cut into two parts, the part (others: -1), only
    pairs of different parts being compared. Small buckets give all pairs that stay; in large ones a text already connected is
    not compared again.
    """
    least = _least_matches(values.shape[1] // STEP * STEP)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(bucket)))
    small = np.repeat(size <= SMALL_BUCKET, size)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gap in range(1, min(SMALL_BUCKET, int(size.max(initial=1)))):
        i = np.flatnonzero(small[:-gap] & (bucket[:-gap] == bucket[gap:]))
        i = i if side is None else i[(side[i] < 0) | (side[i] != side[i + gap])]
        for k in range(0, len(i), 100_000):
            part = i[k : k + 100_000]
            part = part[_stay(values, part, part + gap, least)]
            left.append(part)
            right.append(part + gap)
    for start, n in zip(first[size > SMALL_BUCKET], size[size > SMALL_BUCKET], strict=True):
        apart = np.arange(start, start + n)
        while len(apart):
            ahead, apart = [apart[0]], apart[1:]
            while ahead and len(apart):
                x = ahead.pop()
                near = apart if side is None or side[x] < 0 else apart[side[apart] != side[x]]
                near = near[_stay(values, np.full(len(near), x), near, least)]
                left.append(np.full(len(near), x))
                right.append(near)
                ahead += near.tolist()
                apart = np.setdiff1d(apart, near, assume_unique=True)
    return np.concatenate(left), np.concatenate(right)


def candidate_ties(texts: DataFrame) -> DataFrame:
    """Rows (a, b) that connect all candidate pairs: texts that share a band and stay when their MinHash values are compared.

    A bucket meets in one task, one that is large in pairs of its parts; only 8 bits of each value travel, and only of texts
    that share a band with another. A task gives a spanning forest of its pairs.
    """
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    known = texts.where("signature is not null")
    bands = known.select("id", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = to_one(bands, shared, "key", "id").withColumn("parts", F.ceil(F.col("n") / BUCKET_TEXTS).cast("int"))
    members = members.select("id", "key", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    # members are as many rows of a text as it shares bands, at most BANDS.
    whole = members.join(known.select("id", "signature"), "id")
    other = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = other.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "signature")
    dealt = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, rest = _Sets(), None

        def ties(table: pa.Table) -> pa.RecordBatch:
            key, low, high, part = (table[c].to_numpy() for c in ("key", "low", "high", "part"))
            bucket = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            values = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint8).reshape(-1, 2 * BANDS * ROWS)[:, ::2]
            i, j = bucket_ties(values, bucket, np.where(low != high, part, -1))
            ids = table["id"].to_pylist()
            new = [(ids[x], ids[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if sets.join(ids[x], ids[y])]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.binary()), pa.array([y for _, y in new], pa.binary())], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            key, low, high = (table[c].to_numpy() for c in ("key", "low", "high"))
            last = (key == key[-1]) & (low == low[-1]) & (high == high[-1]) if len(key) else np.zeros(0, bool)
            done = int(len(last) - last.sum())  # the last bucket may go on in the next batch
            if done:
                yield ties(table.slice(0, done))
            rest = table.slice(done)
        if rest is not None and rest.num_rows:
            yield ties(rest)

    return dealt.mapInArrow(forest, "a binary, b binary")


def _blocks(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (component, low, high, id, block, text): each pair of blocks of a component, with the texts of both."""
    near = cut(components(candidate_ties(texts)).join(texts.select("id", "bytes"), "id"))
    sizes = near.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = to_one(near, sizes, "root", "id").select("id", "root", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    placed = cut(placed)
    whole = docs.select(_id(), text_of("text").alias("text")).join(_sent(placed, placed.count()), "id")
    once = whole.groupBy("id", "root", "blocks", "block").agg(F.any_value("text").alias("text"))
    other = once.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "block", "text")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Rows (id, rep, copies, bytes, signature) for distinct texts: id is a digest, rep the smallest doc_id, null last."""
    rows = map_texts(docs.select("doc_id", _id(), F.octet_length(text_of("text")).cast("long").alias("bytes"), "text"), "text", [("signature", T.BinaryType())], lambda t: [signatures(t)], ["doc_id", "id", "bytes"])
    return cut(rows.groupBy("id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("bytes").alias("bytes"), F.any_value("signature").alias("signature")))


def similar_pairs(docs: DataFrame) -> DataFrame:
    """All links as rows (a, b, similarity) between the smallest doc_ids of two different texts.

    They are as many as there are links: a group of n texts alike gives n (n - 1) / 2 rows. Use near_duplicates for classes.
    """
    texts = distinct_texts(docs)

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].to_numpy()
        side = None if group["low"].iloc[0] == group["high"].iloc[0] else group["block"].to_numpy()
        rows = [(min(ids[i], ids[x]), max(ids[i], ids[x]), s) for i, j, sim in links(group["text"].tolist(), side) for x, s in zip(j, sim, strict=True)]
        return pd.DataFrame(rows, columns=["x", "y", "similarity"])

    found = _blocks(docs, texts).groupBy("root", "low", "high").applyInPandas(pairs, "x binary, y binary, similarity double")
    names = texts.select("id", "rep")
    return found.join(names.select(F.col("id").alias("x"), F.col("rep").alias("a")), "x").join(names.select(F.col("id").alias("y"), F.col("rep").alias("b")), "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (id, rep, copies) and, for those with links, (id, root, n_links); root names the class."""
    texts = distinct_texts(docs)

    def forest(group: pa.Table) -> pa.Table:
        ids, sets = group["id"].to_pylist(), _Sets()
        block = group["block"].to_numpy()
        side = None if group["low"][0].as_py() == group["high"][0].as_py() else block
        n, to = np.zeros(len(ids), dtype=np.int64), [[] for _ in ids]
        for i, j, _ in links(group["text"].to_pylist(), side):
            n[i] += len(j)
            n[j] += 1
            for x in j.tolist():
                if sets.join(ids[i], ids[x]):
                    to[i].append(ids[x])
        kept = np.flatnonzero(n)
        rows = [(ids[x], k, int(n[x]) if first else 0) for x in kept.tolist() for first, k in [(True, ids[x]), *((False, y) for y in to[x])]]
        return pa.table({"id": pa.array([r[0] for r in rows], pa.binary()), "to": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.int64())})

    found = cut(_blocks(docs, texts).groupBy("root", "low", "high").applyInArrow(forest, "id binary, to binary, n long"))
    joined = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    counted = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    return texts, cut(joined.join(counted, "id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links, n_copies.

    class_id is the smallest doc_id among all texts that equal texts and links connect; n_links the number of other distinct
    texts with a similarity of 0.8 or more; n_copies the number of rows with this very text. Texts of one to four words are
    one shingle; texts without words, null and empty ones among them, link to nothing but their equals.
    """
    docs = docs.select("doc_id", "text")
    texts, linked = classes(docs)
    each = texts.select("id", "rep", "copies").join(linked, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = each.groupBy("root").agg(F.min("rep").alias("class_id"))
    named = to_one(each, least, "root", "id").select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("copies").alias("n_copies"))
    return docs.select("doc_id", _id()).join(named, "id", "left").select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, one of each class: that with the smallest doc_id (of rows alike, any one)."""
    texts, linked = classes(docs.select("doc_id", "text"))
    best = linked.join(texts.select("id", "rep"), "id").groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "id"))["id"].alias("id"))
    gone = cut(linked.select("id").join(best, "id", "left_anti"))
    copied = cut(texts.where("copies > 1").select("id", "rep"))
    rows = docs.select(whole_row(docs), _id().alias("__id"), "doc_id")
    stay = rows.join(_sent(gone.withColumnRenamed("id", "__id"), gone.count()), "__id", "left_anti")
    n = copied.count()
    copied = copied.withColumnRenamed("id", "__id")
    single = stay.join(_sent(copied.select("__id"), n), "__id", "left_anti").select("row.*")
    first = stay.join(_sent(copied, n), "__id").where(F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["__id"]).select("row.*")
    return single.unionByName(first)

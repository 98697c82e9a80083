"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one word of each codebook, all over the full dimension. Codebooks begin as k-means of residuals and are
refitted by least squares on a bounded sample; a beam search finds every vector's words. A query scores the codes of all
vectors by looking up its products with the words and the stored norm of the sum. The best are ranked exactly, and so is every
vector that its stored quantisation error lets come within the distance they reach: what is left out is farther for certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.common import cut

#: Vectors, and bytes of vectors, that the codebooks are fitted to at most: those with the smallest hashes of vec_id. Every vector is indexed.
SAMPLE, SAMPLE_BYTES = 8_000, 64 << 20
BOOKS, WORDS, BEAM, ROUNDS = 16, 128, 4, 1
#: Vectors of one task, at most and (where queries are few enough to be sent to each) about; queries of one task; candidates of
#: a query in a block that are ranked first, to know how near the others have to come.
MOST, BLOCK, QUERY_BLOCK, CANDIDATES = 100_000, 8_192, 16_384, 1_000
#: Share of the squares involved that rounding can take from an approximate squared distance, with room.
ROUNDING = 1e-9


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v) that take part: not null, not zero, all components finite. Repeated rows are one; of different vectors
    of one vec_id the smallest counts; rows without vec_id are left out. Vectors of different lengths have no distance: those of
    the commonest length (of equally common ones the smallest) take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    rows = rows.where(whole)
    length = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    return rows.where(F.size("v") == (length["size"] if length else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def beam_search(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Words (n x books) whose sums are near the vectors, and the squared norms of the sums.

    Book by book, the `beam` best of all (kept sum, word) pairs are kept, by what would be left of the vector.
    """
    n, k = len(x), books.shape[1]
    rows, rest = np.arange(n)[:, None], x[:, None, :]
    cost, chosen = (x * x).sum(1)[:, None], np.zeros((n, 1, 0), dtype=np.int64)
    for words in books:
        total = (cost[:, :, None] - 2 * (rest @ words.T) + (words * words).sum(1)).reshape(n, -1)
        width = min(beam, total.shape[1])
        best = np.argpartition(total, width - 1, axis=1)[:, :width] if width < total.shape[1] else np.tile(np.arange(width), (n, 1))
        at, word = best // k, best % k
        cost, rest = total[rows, best], rest[rows, at] - words[word]
        chosen = np.concatenate([chosen[rows, at], word[:, :, None]], axis=2)
    first = cost.argmin(1)
    return chosen[np.arange(n), first], ((x - rest[np.arange(n), first]) ** 2).sum(1)


def _sums(x: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    order = np.argsort(group, kind="stable")
    there, first = np.unique(group[order], return_index=True)
    out = np.zeros((groups, x.shape[1]))
    out[there] = np.add.reduceat(x[order], first)
    return out


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (books x words x dimension)."""
    rng, words = np.random.default_rng(20240607), max(1, min(words, len(x)))
    out, rest = np.zeros((books, words, x.shape[1])), x.copy()
    near_of = lambda rest, centre: ((centre**2).sum(1) - 2 * rest @ centre.T).argmin(1)
    for b in range(books):
        centre = rest[rng.choice(len(rest), words, replace=False)]
        for _ in range(6):
            near = near_of(rest, centre)
            count = np.bincount(near, minlength=words)[:, None]
            centre = np.where(count > 0, _sums(rest, near, words) / np.maximum(count, 1), centre)
        out[b] = centre
        rest = rest - centre[near_of(rest, centre)]
    for _ in range(rounds):  # all words at once, given which of them each vector uses
        codes = np.concatenate([beam_search(p, out)[0] for p in np.array_split(x, max(1, len(x) // 1000))]) + np.arange(books) * words
        size = books * words
        uses = np.bincount((codes[:, :, None] * size + codes[:, None, :]).ravel(), minlength=size * size).reshape(size, size).astype(float)
        sums = sum(_sums(x, codes[:, a], size) for a in range(books))
        out = np.linalg.solve(uses + 0.05 * np.eye(size), sums + 0.05 * out.reshape(size, -1)).reshape(out.shape)
    return out


def index(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Rows (vec_id, v, code, norm, error): one byte for each codebook, the squared norm of the words' sum and its distance from v."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                codes = beam_search(x, shared.value)[0]
                made = sum(words[codes[:, b]] for b, words in enumerate(shared.value))  # as it is looked up
                norms, errors = (made**2).sum(1), np.sqrt(((x - made) ** 2).sum(1))
                code = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), code, pa.array(norms), pa.array(errors)], names=["vec_id", "v", "code", "norm", "error"])

    return vectors.select("vec_id", "v").mapInArrow(encode, "vec_id long, v array<double>, code binary, norm double, error double")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(len(column), -1)


def block_nearest(codes: DataFrame, queries: DataFrame, books: np.ndarray, rows: int, n_queries: int, neighbours: int, best: int) -> DataFrame:
    """Rows (query_id, vec_id, score): the nearest in each block for each query, exactly, ties to the smaller vec_id.

    Every query meets every code; both are dealt in blocks, and a pair of blocks is one task. It looks up approximate distances,
    ranks the `best` exactly, and then every other vector whose distance can be within the last of them: the approximate distance
    less the quantisation error is a lower bound. So neither copies nor near copies are cut, however many they are.
    """
    blocks = max(1, -(-rows // MOST), min(-(-rows // BLOCK), rows // max(1, n_queries)))
    groups = max(1, -(-n_queries // QUERY_BLOCK))
    shared = codes.sparkSession.sparkContext.broadcast(books)
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = codes.select("vec_id", "v", "code", "norm", "error", dealt(blocks).alias("block"), each(groups).alias("group"))
    right = queries.select("vec_id", "v", dealt(groups).alias("group"), each(blocks).alias("block"))

    def scan(codes: pa.Table, queries: pa.Table) -> pa.Table:
        found = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        if not codes.num_rows or not queries.num_rows:
            return found[0]
        m, k, _ = shared.value.shape
        ids, norm, error = (codes[c].to_numpy() for c in ("vec_id", "norm", "error"))
        code = np.frombuffer(b"".join(codes["code"].to_pylist()), dtype=np.uint8).reshape(-1, m).astype(np.int64)
        across = np.ascontiguousarray(matrix(codes["v"]).T)
        slack = ROUNDING * (norm + m * (shared.value**2).sum(2).max(1).sum())

        def exact(at: np.ndarray, x: np.ndarray) -> np.ndarray:
            apart = across[:, at] - x[:, None]
            return np.sqrt(np.add.reduce(apart * apart, axis=0))  # one component after the other: equal vectors, equal scores

        for q, x in zip(queries["vec_id"].to_numpy(), matrix(queries["v"]), strict=True):
            table, square = shared.value @ x, x @ x  # books x words
            near = norm - 2 * sum(table[b][code[:, b]] for b in range(m)) + square
            other = ids != q
            near[~other] = np.inf
            at = np.argpartition(near, best)[:best] if len(near) > best else np.arange(len(near))
            at = at[other[at]]
            score = exact(at, x)
            if len(near) > best:
                last = np.partition(score, neighbours - 1)[neighbours - 1] if len(score) >= neighbours else np.inf
                least = np.sqrt(np.maximum(near - slack - ROUNDING * square, 0)) - error * (1 + ROUNDING)
                more = other & (least <= last * (1 + ROUNDING))
                more[at] = False
                more = np.flatnonzero(more)
                at, score = np.concatenate([at, more]), np.concatenate([score, exact(more, x)])
            top = np.lexsort((ids[at], score))[:neighbours]
            found.append(pa.table({"query_id": np.full(len(top), q), "vec_id": ids[at[top]], "score": score[top]}))
        return pa.concat_tables(found)

    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(scan, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, neighbours: int = 10, best: int = CANDIDATES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of each query's nearest by Euclidean distance, ties to the smaller vec_id."""
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.count()
    width = vectors.select(F.size("v").alias("n")).first()
    fitted = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, width["n"] if width else 1))))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fitted).select("v").collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], schema)
    books = fit(np.array([r[0] for r in sample], dtype=np.float64))
    n = queries.count()
    found = block_nearest(cut(index(vectors, books)), queries, books, rows, n, neighbours, max(best, neighbours + 1))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the nearest of every vector whose vec_id `every` divides.

    usable() tells which rows take part; an empty table, or one without such rows, gives no rows; other columns are not read.
    """
    vectors = cut(usable(embeddings.select("vec_id", "embedding")))
    return nearest(vectors, vectors.where(F.col("vec_id") % every == 0))

"""Near duplicates among embeddings by tiled comparison in the order of principal components.

Equal vectors are counted once. A tree of medians over principal components, fitted to a bounded sample, deals the rest to leaves; a
leaf's ball tells with which others it can have links at all. Leaves are cut into blocks, and a pair of blocks is a task. It compares
tile by tile: the leading components of all pairs first, with the product of the norms of what is left as an upper bound (the
Cauchy-Schwarz inequality); pairs that cannot reach the threshold go, the next components are added for the others, and the cosine of
those that remain is taken from the original vectors. Degrees and one row a vector leave a task, never its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import cut
from codeweft.llm.near_duplicates import components, to_one
from codeweft.llm.neighbours import matrix, usable

THRESHOLD = 0.9
#: Vectors, and bytes of vectors, that the components and the tree are fitted to at most (those with the smallest hashes of vec_id).
SAMPLE, SAMPLE_BYTES = 8_000, 32 << 20
#: Bytes of a block at most; blocks that small tables are cut into, of so many rows at least; depth of the tree; rows of a tile.
BLOCK_BYTES, FEWEST, SMALLEST, DEPTH, TILE = 8 << 20, 8, 512, 9, 1_024
#: Room for rounding: of products of single precision, and of products taken at once against one by one.
SINGLE, DOUBLE = 1e-4, 1e-12


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors over their norms, whatever their sizes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])  # a power of two: exact
    return x / np.sqrt((x * x).sum(1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the row of y beside it."""
    return np.einsum("ij,ij->i", unit(x), unit(y))


@dataclass
class Layout:
    """Principal axes (columns, the widest first), components after which pairs are looked at again, and the tree's cuts:
    node k halves at value[k] of component axis[k] and has the children 2k + 1 and 2k + 2."""

    axes: np.ndarray
    stops: list[int]
    axis: np.ndarray
    value: np.ndarray
    centres: np.ndarray

    def leaf(self, y: np.ndarray) -> np.ndarray:
        node = np.zeros(len(y), dtype=np.int64)
        for _ in range(int(np.log2(len(self.axis) + 1))):
            node = 2 * node + 1 + (y[np.arange(len(y)), self.axis[node]] > self.value[node])
        return node - len(self.axis)


def fit(sample: np.ndarray, depth: int, threshold: float = THRESHOLD) -> Layout:
    """Layout from a sample of unit vectors. It decides what is skipped early, never what is found."""
    values, axes = np.linalg.eigh(sample.T @ sample)
    share = np.cumsum(values[::-1]) / max(values.sum(), 1e-300)
    axes, width = np.ascontiguousarray(axes[:, ::-1]), sample.shape[1]
    stop = max(1, int(np.searchsorted(share, 1.2 - threshold)) + 1)  # what is left is then well under the threshold for most pairs
    stops = []
    while stop < width:
        stops.append(stop)
        stop = stop + max(8, stop // 2)
    y = sample @ axes
    axis, value, rows = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1), {0: np.arange(len(y))}
    for k in range(len(axis)):
        own = y[rows[k]]
        axis[k] = own.var(0).argmax() if len(own) else 0
        value[k] = np.median(own[:, axis[k]]) if len(own) else 0.0
        right = own[:, axis[k]] > value[k]
        rows[2 * k + 1], rows[2 * k + 2] = rows[k][~right], rows.pop(k)[right]
    leaves = [y[rows[k]] for k in range(len(axis), 2 * len(axis) + 1)]
    return Layout(axes, [*stops, width], axis, value, np.array([x.mean(0) if len(x) else np.zeros(width) for x in leaves]))


class Links:
    """Links between the rows of one task: weighted degrees, and a representative of what they connect."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight, self.degree, self.root = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.degree, i, self.weight[j])
        np.add.at(self.degree, j, self.weight[i])
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]


def compare(x: np.ndarray, weight: np.ndarray, side: np.ndarray | None, layout: Layout, threshold: float = THRESHOLD, told: list[int] | None = None) -> Links:
    """Links of all pairs of rows of x (side: of rows of different sides only). told, if given, gets how many pairs reached each stop."""
    links, units = Links(weight), unit(x)
    y = units @ layout.axes
    order = np.lexsort((y[:, 0], np.zeros(len(x)) if side is None else side))
    ends = np.searchsorted(side[order], [0, 1, 2]).tolist() if side is not None else [0, len(x), len(x)]
    y = y[order]
    single = y.astype(np.float32)
    left = np.sqrt(np.maximum(np.cumsum((y**2)[:, ::-1], axis=1)[:, ::-1], 0))  # norms of what is left from each component on
    rest = np.stack([left[:, s] if s < y.shape[1] else np.zeros(len(y)) for s in layout.stops], axis=1).astype(np.float32)
    low, reach, first = np.float32(threshold - SINGLE), 2 - 2 * threshold + SINGLE, layout.stops[0]
    heads = np.concatenate([single[:, :first], rest[:, :1]], axis=1)  # their product is the bound at the first stop
    tiles = lambda a, b: [(k, min(k + TILE, b)) for k in range(a, b, TILE)]
    box = lambda t: (y[t[0] : t[1]].min(0), y[t[0] : t[1]].max(0))
    rows = [(t, *box(t)) for t in tiles(ends[0], ends[1])]
    columns = rows if side is None else [(t, *box(t)) for t in tiles(ends[1], ends[2])]
    counts = np.zeros(len(layout.stops) + 1, np.int64)
    for n, ((a, b), least, most) in enumerate(rows):
        for (c, d), least2, most2 in columns if side is not None else columns[n:]:
            apart = np.maximum(0, np.maximum(least - most2, least2 - most))
            if (apart**2).sum() > reach:
                continue
            counts[0] += (b - a) * (d - c)
            stay = heads[a:b] @ heads[c:d].T >= low
            if a == c:
                stay = np.triu(stay, 1)
            many = np.count_nonzero(stay)
            counts[1] += many
            if many > stay.size // 16:  # near copies: all components of all pairs at once
                dot = units[order[a:b]] @ units[order[c:d]].T
                stay &= dot >= threshold - DOUBLE
                i, j = (k + at for k, at in zip(np.nonzero(stay), (a, c), strict=True))
                close = np.flatnonzero(dot[i - a, j - c] < threshold + DOUBLE)
                gone = close[cosines(x[order[i[close]]], x[order[j[close]]]) < threshold]
                i, j = np.delete(i, gone), np.delete(j, gone)
                links.add(order[i], order[j])
                continue
            whole = [k + at for k, at in zip(np.nonzero(stay), (a, c), strict=True)]
            for at in range(0, many, 65_536):
                i, j = (k[at : at + 65_536] for k in whole)
                dot = np.einsum("ij,ij->i", single[i, :first], single[j, :first])
                for k, (begin, end) in enumerate(zip(layout.stops[:-1], layout.stops[1:], strict=True), 1):
                    dot = dot + np.einsum("ij,ij->i", single[i, begin:end], single[j, begin:end])
                    near = dot + rest[i, k] * rest[j, k] >= low
                    i, j, dot = i[near], j[near], dot[near]
                    counts[k + 1] += len(i)
                near = cosines(x[order[i]], x[order[j]]) >= threshold
                links.add(order[i[near]], order[j[near]])
    if told is not None:
        told.extend(counts.tolist())
    return links


def _leaves(vectors: DataFrame, layout: Layout) -> DataFrame:
    """Add leaf and the distance away of each unit vector from its leaf's centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(layout)

    def deal(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            if batch.num_rows:
                known = shared.value
                y = unit(batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)) @ known.axes
                leaf = known.leaf(y)
                away = np.sqrt(((y - known.centres[leaf]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32)), pa.array(away)], names=[*batch.schema.names, "leaf", "away"])

    return vectors.mapInArrow(deal, "rep long, weight long, v array<double>, leaf int, away double")


def block_links(distinct: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Rows (id, n, root) from each pair of blocks: the weight of what a vector is linked with there, and a vector that the links
    of that pair of blocks connect it with. distinct: rep, weight, v (of one length)."""
    spark, schema = distinct.sparkSession, "id long, n long, root long"
    told = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not told["n"]:
        return spark.createDataFrame([], schema)
    width = max(1, told["width"])
    fitted = distinct.orderBy(F.xxhash64("rep"), "rep").limit(max(1, min(sample, SAMPLE_BYTES // (8 * width)))).select("v").collect()
    most = max(SMALLEST, BLOCK_BYTES // (8 * width))
    block = min(most, max(SMALLEST, -(-told["n"] // FEWEST)))
    depth = min(DEPTH, max(0, (-(-told["n"] // block) - 1).bit_length()))
    layout = fit(unit(np.array([r[0] for r in fitted], dtype=np.float64)), depth, threshold)
    dealt = cut(_leaves(distinct, layout))
    sizes = dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()  # at most 2^DEPTH rows
    number = np.array([r["leaf"] for r in sizes])
    parts = np.array([-(-r["n"] // block) for r in sizes])
    before = np.concatenate([[0], np.cumsum(parts)])[:-1]
    centre, radius = layout.centres[number], np.array([r["away"] for r in sizes])
    gap = np.stack([np.sqrt(((centre - c) ** 2).sum(1)) for c in centre])
    near = gap - radius[:, None] - radius[None, :] <= np.sqrt(2 - 2 * threshold) + DOUBLE
    pairs = [(int(number[a]), int(parts[a]), int(before[a]), int(parts[b]), int(before[b])) for a, b in zip(*np.nonzero(near), strict=True)]
    table = spark.createDataFrame(pairs, "leaf int, parts int, before long, others int, before2 long")  # at most 4^DEPTH rows
    here = F.col("before") + F.pmod(F.xxhash64("rep"), F.col("parts"))
    there = F.explode(F.sequence(F.col("before2"), F.col("before2") + F.col("others") - 1))
    met = dealt.drop("away").join(F.broadcast(table), "leaf").select("rep", "weight", "v", here.alias("own"), there.alias("other"))
    met = met.select("rep", "weight", "v", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    shared = spark.sparkContext.broadcast(layout)

    def pair(key: tuple, rows: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        ids, side = rows["rep"].to_numpy(), rows["side"].to_numpy()
        links = compare(matrix(rows["v"]), rows["weight"].to_numpy(), None if same else side, shared.value, threshold)
        linked = np.flatnonzero(links.degree)
        return pa.table({"id": ids[linked], "n": links.degree[linked], "root": ids[links.root[linked]]})

    return met.groupBy("a", "b").applyInArrow(pair, schema)


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each vec_id: how many other vectors have a cosine of at least the threshold
    with it, the smallest vec_id reachable by links, and whether that is its own.

    Vectors that are null, zero or hold null or non-finite components link with nothing, nor do those of another than the commonest
    length (of equally common ones the smallest). Repeated rows are one; of different vectors of one vec_id the smallest counts; rows
    without vec_id are left out. Equal vectors are linked. An empty table gives no rows; other columns are not read.
    """
    vectors = cut(usable(embeddings.select("vec_id", "embedding")))
    distinct = cut(vectors.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")).select("rep", "weight", "v"))
    found = cut(block_links(distinct, threshold))
    degrees = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    reached = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("rep"), "root")
    told = distinct.join(degrees, "rep", "left").join(reached, "rep", "left")
    told = told.select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    known = to_one(vectors, told, "v", "vec_id").select("vec_id", "n_links", "component_id")
    every = embeddings.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id")).distinct().join(known, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def one_of_each(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose vec_id is the smallest of its component; rows without vec_id stay."""
    gone = near_duplicates(embeddings, threshold).where("not kept").select("vec_id")
    return embeddings.join(gone, "vec_id", "left_anti").select(embeddings.columns)

"""Hard negatives by branch and bound in ball trees.

Rows are dealt into parts by hash, and each part builds trees over its integer vectors: one for each residue of the label, halved
along the line between two far points until a leaf is small. A ball (centre, radius) bounds the inner product with an anchor from
both sides. All anchors of a task walk a tree together; an anchor leaves a node whose bounds miss its score window, or that lies
strictly beneath what its k-th best has by now, score and vec_id taken together. Parts' bests are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.llm.common import cut

#: Rows of a leaf; rows of a part at most, and about (where anchors are few enough to be sent to each); anchors of a task, and of
#: those the ones that walk together; trees of a part (by label).
LEAF, MOST, PART, QUERY_BLOCK, WALK, TREES = 64, 100_000, 2_048, 16_384, 4_096, 16
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
EXACT = float(1 << 53)
#: Relative room for rounding in bounds; scores lie within half of a long.
ROUNDING = 1e-9
NO_SCORE, NO_ID = -(1 << 62) - 1, np.iinfo(np.int64).max


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """Rows (vec_id, label, v): those that take part, as whole numbers.

    Left out are rows with a null vec_id, label or vector, or a null or non-finite component, and those whose integer vector has a
    squared norm beyond a long, as a product of theirs might not be one. Repeated rows are one; of different rows of one vec_id the
    smallest (label, vector) counts. Vectors of different lengths have no product: those of the commonest length (of equally common
    ones the smallest) take part. Where 7 divides vec_id, the label becomes (label + 1) % 10.
    """
    x = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").select("vec_id", F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.where(F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)))
    norm = F.aggregate("x", F.lit(0.0), lambda a, x: a + F.pow(F.floor(256 * x).cast("double"), F.lit(2.0)))
    rows = rows.where(F.forall("x", lambda x: F.abs(x) < 1e15) & (norm < float(1 << 62)))
    length = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    whole = F.transform("x", lambda x: F.floor(256 * x).cast("long")).alias("v")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    kept = rows.where(F.size("x") == (length["size"] if length else 0)).select("vec_id", label, whole)
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v")


@dataclass
class Tree:
    """Nodes in preorder: a node's rows are lo to hi of the part's order, its left child is the next node, its right one `right`."""

    centre: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    right: np.ndarray
    label: np.ndarray  # of all rows of the node, where they have one label; `mixed` tells
    mixed: np.ndarray
    least_id: np.ndarray


def build(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree, list[int]]:
    """An order of the rows, the nodes over it, and the roots."""
    order, nodes, roots = np.arange(len(x)), [], []
    order = order[np.argsort(labels % TREES, kind="stable")]
    cuts = np.flatnonzero(np.diff(labels[order] % TREES)) + 1
    bounds = [0, *cuts.tolist(), len(x)] if len(x) else [0]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        roots.append(len(nodes))
        stack = [(lo, hi, -1)]
        while stack:
            lo, hi, parent = stack.pop()
            at = order[lo:hi]
            points = x[at]
            centre = points.mean(0)
            away = ((points - centre) ** 2).sum(1)
            number = len(nodes)
            if parent >= 0:
                nodes[parent][4] = number
            own = labels[at]
            nodes.append([centre, np.sqrt(away.max()) * (1 + ROUNDING), lo, hi, -1, own[0], bool((own != own[0]).any()), ids[at].min()])
            if hi - lo > leaf and away.max() > 0:  # copies stay together: their ball is a point
                one = points[away.argmax()]
                other = points[((points - one) ** 2).sum(1).argmax()]
                middle = (hi - lo) // 2
                order[lo:hi] = at[np.argpartition(points @ (other - one), middle)]
                stack += [(lo + middle, hi, number), (lo, lo + middle, -1)]
            else:
                order[lo:hi] = at[np.argsort(ids[at])]
    parts = list(zip(*nodes, strict=True)) if nodes else [[]] * 8
    return order, Tree(np.array(parts[0]).reshape(len(nodes), -1), *[np.array(p) for p in parts[1:]]), roots


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as integers: in doubles where no sum can leave their whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.stack([(b * row).sum(1) for row in a])


class Best:
    """The first k (score, vec_id) of each anchor so far: higher scores first, ties to the smaller vec_id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((n, k), NO_SCORE), np.full((n, k), NO_ID)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """score: rows x candidates; only valid ones count."""
        score = np.where(valid, score, NO_SCORE)
        named = np.where(valid, ids, NO_ID)
        score, named = np.concatenate([self.score[rows], score], 1), np.concatenate([self.id[rows], named], 1)
        if score.shape[1] > 4 * self.k:  # candidates that can't be among the first k go before the sort
            kth = -np.partition(-score, self.k - 1, axis=1)[:, [self.k - 1]]
            width = int((score >= kth).sum(1).max())
            if width < score.shape[1]:
                keep = np.argsort(-score, axis=1, kind="stable")[:, :width] if width > self.k else np.argpartition(-score, self.k - 1, axis=1)[:, : self.k]
                score, named = np.take_along_axis(score, keep, 1), np.take_along_axis(named, keep, 1)
        first = np.lexsort((named, -score), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, first, 1), np.take_along_axis(named, first, 1)

    def beats(self, rows: np.ndarray, upper: np.ndarray, least_id: int) -> np.ndarray:
        """Whether a node of such an upper bound and smallest vec_id can still change the first k of each of the rows."""
        last, named = self.score[rows, -1], self.id[rows, -1]
        return (upper > last) | ((upper >= last) & (least_id < named))


def search(tree: Tree, roots: list[int], ids: np.ndarray, labels: np.ndarray, x: np.ndarray, q: np.ndarray, q_id: np.ndarray, q_label: np.ndarray, same: bool, lo: np.ndarray, hi: np.ndarray, k: int, met: list[int] | None = None) -> Best:
    """The first k of each query among rows of the same (or of a different) label whose score lies in [lo, hi].

    Rows are in the order of build(). met, if given, gets how many (query, row) products were taken.
    """
    best, long = Best(len(q), k), q.astype(np.float64)
    norm, size = np.sqrt((long**2).sum(1)), np.sqrt((tree.centre**2).sum(1))
    whole = lambda v: np.where(np.abs(v) < EXACT, np.floor(v + 1e-6 + ROUNDING * np.abs(v)), v * (1 + np.sign(v) * ROUNDING))  # noqa: E731  upper bound of an integer
    stack = [(r, np.arange(len(q))) for r in reversed(roots)]
    while stack:
        node, who = stack.pop()
        pure, label = not tree.mixed[node], tree.label[node]
        if pure:
            who = who[(q_label[who] == label) == same]
        middle, reach = long[who] @ tree.centre[node], norm[who] * tree.radius[node]
        room = ROUNDING * (reach + norm[who] * size[node])
        upper, lower = whole(middle + reach + room), -whole(reach + room - middle)
        stay = (upper >= lo[who]) & (lower <= hi[who]) & best.beats(who, upper, tree.least_id[node])
        who, upper = who[stay], upper[stay]
        if not len(who):
            continue
        if tree.right[node] < 0:
            for at in range(tree.lo[node], tree.hi[node], 1024):
                rows = slice(at, min(at + 1024, tree.hi[node]))
                stay = best.beats(who, upper, ids[at])  # a leaf of copies ends here for most: its vec_ids rise
                who, upper = who[stay], upper[stay]
                if not len(who):
                    break
                score = products(q[who], x[rows])
                if met is not None:
                    met.append(score.size)
                valid = ((q_label[who][:, None] == labels[rows]) == same) & (q_id[who][:, None] != ids[rows])
                valid &= (score >= lo[who][:, None]) & (score <= hi[who][:, None])
                useful = valid.any(1)
                if useful.any():
                    best.add(who[useful], score[useful], ids[rows], valid[useful])
        else:
            left, right = node + 1, int(tree.right[node])
            first = (long[who] @ (tree.centre[left] - tree.centre[right])).sum() >= 0  # the child that most of them prefer goes first
            stack += [(right, who), (left, who)] if first else [(left, who), (right, who)]
    return best


def _grid(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return flat.reshape(len(column), -1)


def _walks(rows: DataFrame, queries: DataFrame, parts: int, groups: int, same: bool, k: int) -> DataFrame:
    """Rows (anchor_id, lo, hi, vec_id, score): the first k of each part for each query (anchor_id, v, label, lo, hi).

    Every query meets every part; both are dealt in blocks, and a pair of blocks is one task.
    """
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", "label", dealt("vec_id", parts).alias("part"), each(groups).alias("group"))
    right = queries.select("anchor_id", F.col("v").alias("q"), F.col("label").alias("q_label"), "lo", "hi", dealt("anchor_id", groups).alias("group"), each(parts).alias("part"))
    long = lambda t, c: t[c].to_numpy()

    def walk(part: pa.Table, asked: pa.Table) -> pa.Table:
        out = {n: [np.zeros(0, np.int64)] for n in ("anchor_id", "lo", "hi", "vec_id", "score")}
        if part.num_rows and asked.num_rows:
            x, ids, labels = _grid(part["v"]), long(part, "vec_id"), long(part, "label")
            order, tree, roots = build(ids, labels, x.astype(np.float64))
            x, ids, labels = x[order], ids[order], labels[order]
            for at in range(0, asked.num_rows, WALK):
                t = asked.slice(at, WALK)
                q_id, lo, hi = long(t, "anchor_id"), long(t, "lo"), long(t, "hi")
                best = search(tree, roots, ids, labels, x, _grid(t["q"]), q_id, long(t, "q_label"), same, lo, hi, k)
                row, col = np.nonzero(best.id != NO_ID)
                for name, value in (("anchor_id", q_id[row]), ("lo", lo[row]), ("hi", hi[row]), ("vec_id", best.id[row, col]), ("score", best.score[row, col])):
                    out[name].append(value)
        return pa.table({n: np.concatenate(v) for n, v in out.items()})

    return left.groupBy("part", "group").cogroup(right.groupBy("part", "group")).applyInArrow(walk, "anchor_id long, lo long, hi long, vec_id long, score long")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id `every` divides. A negative's score lies within `low` and `high` hundredths of its
    positive's. integer_vectors() tells which rows take part and how ties, repeats and odd vectors count; an empty table, an
    anchor without another row of its label, and a positive without a row in its window give no rows. Other columns are not read.
    """
    rows = cut(integer_vectors(embeddings))
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "v", "label")
    n, asking = rows.count(), anchors.count()
    parts = max(1, -(-n // MOST), min(-(-n // PART), n // max(1, asking)))
    groups = max(1, -(-asking // QUERY_BLOCK))
    all_scores = anchors.withColumns({"lo": F.lit(NO_SCORE + 1), "hi": F.lit(-NO_SCORE - 1)})
    near = _first(_walks(rows, all_scores, parts, groups, True, positives), ["anchor_id"], positives)
    near = cut(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Positives of an anchor with one score ask for the same negatives, and so do scores with the same whole numbers between.
    share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * percent / 100
    bound = lambda x: F.greatest(F.least(x, F.lit(-NO_SCORE - 1)), F.lit(NO_SCORE + 1)).cast("long")
    windows = near.withColumns({"lo": bound(F.ceil(share(low))), "hi": bound(F.floor(share(high)))}).where("lo <= hi")
    asked = windows.select("anchor_id", "lo", "hi").distinct().join(anchors, "anchor_id")
    groups = max(1, -(-asking * positives // QUERY_BLOCK))
    found = _first(_walks(rows, asked, parts, groups, False, negatives), ["anchor_id", "lo", "hi"], negatives)
    told = windows.join(found, ["anchor_id", "lo", "hi"])
    return told.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

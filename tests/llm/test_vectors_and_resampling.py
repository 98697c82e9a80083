"""Resampling, hard negatives and near duplicates of vectors against plain Python, and their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeweft.llm import hard_negatives, resampling, vector_duplicates

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id long, embedding array<double>, label int"


def features(text):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    made = [*words, *[f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in made]


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcXéö😀7") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    made = [rng.choice([" ", ". ", "\x00", "~"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 300]))) for _ in range(n)]
    return [*made, None, "", "...", "z" * 3_000_000, "É é", made[3], made[3]]


@pytest.mark.parametrize("first, piece", [(0, 1 << 20), (2, 100)])
def test_the_automaton_finds_the_checksums_of_all_features(monkeypatch, first, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    t = texts(1, 80)
    seen = 0
    for at, end, data, offsets in resampling._pieces(pa.array(t).slice(first)):
        found, whose, counts = resampling.feature_buckets(data, offsets)
        for i in range(at, end):
            words, want = features(t[first + i])
            assert counts[i - at] == words and sorted(found[whose == i - at].tolist()) == sorted(want)
            seen += 1
    assert seen == len(t) - first


def resampled(docs, target):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, rows in ((s, [x for _, x in docs]), (t, target)):
        for x in rows:
            for b in features(x)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, x in docs:
        words, found = features(x)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return [(*r[:4], k if k <= 25 * len(fit) // 100 else None) for k, r in enumerate(fit, 1)] + [(*r[:4], None) for r in rows if not r[4]]


def test_resampling(spark):
    docs = [(i if i % 17 else None, x) for i, x in enumerate(texts(2, 120), 1)]
    docs += docs[:5]  # repeated rows
    target = texts(3, 20)
    df = spark.createDataFrame([(*r, 9, 9) for r in docs], "doc_id long, text string, weight long, rank int")
    items = spark.createDataFrame([(x,) for x in target], "text string")
    key = lambda r: tuple(map(str, r))
    got = resampling.resample(df, items)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(resampled(docs, target), key=key)
    drawn = resampling.drawn_documents(df, items)
    assert drawn.columns == ["doc_id", "text", "weight", "rank"] and sorted(r["rank"] for r in drawn.collect()) == list(range(1, 1 + sum(r[4] is not None for r in resampled(docs, target))))
    assert resampling.resample(df.limit(0), items).count() == 0
    key2 = sorted(map(tuple, resampling.resample(df, items.limit(0)).collect()), key=key)
    assert key2 == sorted(resampled(docs, []), key=key)
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(r["n_features"] == 0 and r["weight"] == 0 and r["rank"] is None for r in resampling.resample(none, none).collect())


def negatives(rows, every=100, positives=5, count=10):
    kept = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        new = (label, [math.floor(256 * x) for x in v])
        kept[i] = min(kept.get(i, new), new)
    out = []
    for a in (i for i in kept if i % every == 0):
        la, va = kept[a]
        score = {i: sum(x * y for x, y in zip(va, v, strict=True)) for i, (_, v) in kept.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if kept[i][0] == la][:positives]:
            fit = [i for i in order if kept[i][0] != la and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(fit[:count], 1)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives(spark, seed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PART", 90)
    monkeypatch.setattr(hard_negatives, "QUERY_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    x = centres[rng.integers(6, size=700)] + rng.normal(size=(700, 5)) * [0.0, 0.1, 1.0][seed]  # seed 0: copies only
    rows = [(i, v, int(rng.integers(3))) for i, v in enumerate(x.tolist())]
    rows[5], rows[6], rows[8] = (5, None, 1), (6, [1.0, None, 0.0, 0.0, 0.0], 1), (8, x[8].tolist(), None)
    rows[9], rows[10], rows[11] = (9, [math.nan] * 5, 1), (10, [0.0] * 5, 2), (11, [-math.inf] + [0.0] * 4, 2)
    rows += [(None, x[0].tolist(), 1), rows[100], rows[100], (200, x[3].tolist(), 0), (12, [1e300] * 5, 1), (13, [1.0], 1)]
    rows = [r for r in rows if r[0] not in (12, 13)] + [(12, [1e300] * 5, 1), (13, [1.0], 1)]
    df = spark.createDataFrame([(*r, 7) for r in rows], VECTORS + ", rank int")
    got = hard_negatives.mine(df)
    want = negatives([r for r in rows if r[0] not in (12, 13)])  # beyond a long; another length
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and (want or seed == 0)
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_trees_leave_out_what_is_far():
    """On vectors in clusters most products are never taken, and none that counts is lost."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(80, 32)) * 300
    x = np.floor(centres[rng.integers(80, size=8000)] + rng.normal(size=(8000, 32)) * 5).astype(np.int64)
    ids, labels = np.arange(8000), rng.integers(2, size=8000)
    order, tree, roots = hard_negatives.build(ids, labels, x.astype(float), leaf=16)
    q, lo = x[:80], np.full(80, hard_negatives.NO_SCORE + 1)
    met = []
    best = hard_negatives.search(tree, roots, ids[order], labels[order], x[order], q, ids[:80], labels[:80], False, lo, -lo, 10, met)
    assert sum(met) < 0.15 * 80 * 8000
    for i in range(80):
        score = x @ q[i]
        other = labels != labels[i]
        assert best.id[i].tolist() == ids[other][np.lexsort((ids[other], -score[other]))[:10]].tolist()


def test_products_beyond_doubles_are_exact():
    a = np.array([[(1 << 29) + 1, 3], [-5, 7]])
    b = np.array([[(1 << 29) + 3, -1], [2, 2]])
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b.tolist()] for p in a.tolist()]
    assert hard_negatives.products(a, b).tolist() == want


def linked(rows, threshold=0.9):
    vectors, ids = {}, set()
    for i, v in rows:
        if i is None:
            continue
        ids.add(i)
        if v is not None and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            vectors[i] = min(vectors.get(i, v), v)
    names = list(vectors)
    x = np.array([vectors[i] for i in names])
    x = x / np.abs(x).max(1, keepdims=True)
    cos = (x @ x.T) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((x * x).sum(1)))
    near = cos >= threshold
    np.fill_diagonal(near, False)
    component = {i: i for i in ids}
    for _ in names:
        for a, b in zip(*np.nonzero(near), strict=True):
            least = min(component[names[a]], component[names[b]])
            component[names[a]] = component[names[b]] = least
        if all(component[names[a]] == component[names[b]] for a, b in zip(*np.nonzero(near), strict=True)):
            break
    degree = dict(zip(names, near.sum(1).tolist(), strict=True))
    return sorted((i, degree.get(i, 0), component[i], i == component[i]) for i in ids)


@pytest.mark.parametrize("spread, copies", [(1.0, 1), (0.35, 1), (0.35, 40), (0.02, 1)])
def test_near_duplicate_vectors(spark, monkeypatch, spread, copies):
    for name, value in (("SMALLEST", 40), ("FEWEST", 5), ("TILE", 16), ("DEPTH", 2)):
        monkeypatch.setattr(vector_duplicates, name, value)
    rng = np.random.default_rng(copies)
    x = rng.normal(size=(9, 6))[rng.integers(9, size=300)] * 10.0 ** rng.integers(-3, 3, size=(300, 1)) + 0.0
    x = x + rng.normal(size=x.shape) * spread * np.abs(x).max(1, keepdims=True)
    rows = [(i, v) for i, v in enumerate(x.tolist(), 3)]
    rows += [(1000 + k, rows[7][1]) for k in range(copies)]
    rows += [(2000, None), (2001, [0.0] * 6), (2002, [math.nan] + [1.0] * 5), (2003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2004, [1.0]), (2005, [math.inf] * 6)]
    rows += [(None, rows[0][1]), rows[3], rows[3], (4, rows[20][1]), (2006, [1e300] * 6), (2007, [1e-300] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, kept int, n_links int")
    got = vector_duplicates.near_duplicates(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == linked(rows)
    kept = vector_duplicates.one_of_each(df)
    assert kept.columns == df.columns and {r["vec_id"] for r in kept.collect()} == {r[0] for r in linked(rows) if r[3]} | {None}
    assert vector_duplicates.near_duplicates(df.limit(0)).count() == 0


def test_float_vectors_without_links(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<float>").withColumn("x", F.lit(1))
    assert sorted(map(tuple, vector_duplicates.near_duplicates(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_bounds_end_most_pairs_after_the_first_components():
    x = np.random.default_rng(3).normal(size=(3000, 64))
    layout = vector_duplicates.fit(vector_duplicates.unit(x), 3)
    told = []
    vector_duplicates.compare(x, np.ones(len(x), np.int64), None, layout, told=told)
    assert told[0] == sum((min(k + 1024, 3000) - k) * (min(m + 1024, 3000) - m) for k in range(0, 3000, 1024) for m in range(k, 3000, 1024))
    assert told[1] < 0.05 * told[0] and told[-1] == 0 and told[2] < 0.1 * told[1]

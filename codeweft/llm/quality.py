"""Quality by hierarchical empirical Bayes: what a document looks like, weighed with what its host and path are like.

A logistic classifier of style gives each document's evidence. Grouped sums of its probabilities give the rates of hosts and
of paths in them; prior strengths estimated from how much the rates differ shrink sparse paths toward their host and sparse
hosts toward the whole. The path's posterior, without the document's own share, then stands in for the common prior.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.llm.common import cut, map_texts, whole_row, without
from codeweft.llm.toxicity import labelled

#: Labelled rows to learn from at most: those with the smallest hashes of doc_id.
TRAINING_ROWS = 20_000
#: Bytes of their texts at most.
TRAINING_BYTES = 128 << 20
#: Rows of paths (about 60 bytes each) up to which they are sent to every executor; beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
_UPPER, _LOWER, _DIGIT, _SPACE = (bytes(x, "ascii") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r\x0b\x0c"))
_HIGH = bytes(range(128, 256))


def style(texts: list[str]) -> np.ndarray:
    """Eleven measures of a whole text: length, letter case, symbols, repetition of words and lines, word and line length."""
    out = np.zeros((len(texts), 11))
    for row, text in zip(out, texts, strict=True):
        data = text.encode()
        n = max(1, len(data))
        upper, lower, digit, space, high = (len(data) - len(data.translate(None, x)) for x in (_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH))
        words, lines = data.split(), data.split(b"\n")
        w = max(1, len(words))
        row[:] = (
            np.log1p(len(words)), upper / max(1, upper + lower), (len(data) - upper - lower - digit - space - high) / n, len(set(words)) / w,
            min(60.0, (len(data) - space) / w), 1 - len(set(lines)) / len(lines), digit / n, text.count("|") / w, min(5.0, text.count("!") / w),
            len(lines) / w, sum(1 for x in words if len(x) > 20) / w,
        )
    return out


def _design(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / scale, -8, 8)
    return np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights from a bounded sample of labelled rows (ridge logistic regression by Newton's method).

    Without labelled rows all weights are 0 and every document's evidence is even.
    """
    sample = map_texts(labelled(docs, labels, label, rows, TRAINING_BYTES), "text", [("x", T.ArrayType(T.DoubleType()))], lambda t: [list(style(t))], ["label"])
    found = sample.collect()  # at most `rows` rows of 12 numbers
    if not found:
        return np.zeros(11), np.ones(11), np.zeros(23)
    x, y = np.array([r["x"] for r in found]), np.array([float(r["label"]) for r in found])
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z, w = _design(x, centre, scale), np.zeros(23)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.eye(23), z.T @ (y - p) - w)
    return centre, scale, w


def evidence(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """Add `evidence`: the classifier's log-odds that the whole text is good (null text: as empty), within 12 of even."""
    centre, scale, w = model
    return map_texts(docs, "text", [("evidence", T.DoubleType())], lambda t: [np.clip(_design(style(t), centre, scale) @ w, -12, 12)], keep)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _strength(spread: float, mean: float, groups: int, n: float) -> float:
    """Rows a prior is worth: mean (1 - mean) / variance between groups - 1, the variance beyond that of sampling."""
    between = spread - mean * (1 - mean) * groups / max(n, 1.0)
    return float(min(1e6, max(1.0, mean * (1 - mean) / max(between, 1e-9) - 1)))


def sites(evidenced: DataFrame, host: Column, path: Column) -> tuple[DataFrame, dict[str, float]]:
    """Sums of each (host, path) and of its host, and the sums of the whole and prior strengths.

    Sums are made before the shuffle, so a host with a third of all rows costs a row for each task.
    """
    p = _chance(F.col("evidence"))
    paths = cut(evidenced.groupBy(F.struct(host, path).alias("site")).agg(F.sum(p).alias("good"), F.count(F.lit(1)).cast("double").alias("n")))
    hosts = paths.groupBy(F.struct(F.col("site")[paths.schema["site"].dataType.names[0]]).alias("host")).agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    row = hosts.agg(F.sum("host_good"), F.sum("host_n"), F.count(F.lit(1)), F.sum(F.col("host_good") * F.col("host_good") / F.col("host_n"))).first()
    total, groups = row[1] or 0.0, row[2]
    mean = (row[0] / total) if total else 0.5
    host_strength = _strength(row[3] / total - mean * mean, mean, groups, total) if total else 1.0
    shrunk = hosts.withColumn("__at", (F.lit(host_strength * mean) + F.col("host_good")) / (F.lit(host_strength) + F.col("host_n")))
    both = paths.withColumn("host", F.struct(F.col("site")[paths.schema["site"].dataType.names[0]])).join(shrunk, "host")
    away = both.agg(F.sum((F.col("good") / F.col("n") - F.col("__at")) ** 2 * F.col("n")), F.count(F.lit(1))).first()
    path_strength = _strength(away[0] / total, mean, away[1], total) if total else 1.0
    told = {"good": row[0] or 0.0, "n": total, "host_strength": host_strength, "path_strength": path_strength, "paths": away[1]}
    return both.select("site", "good", "n", "host_good", "host_n"), told


def combine(evidenced: DataFrame, known: DataFrame, told: dict[str, float], host: Column, path: Column) -> DataFrame:
    """Add host_posterior, path_posterior, quality (probability) and accepted (quality is 1/2 at least)."""
    rows = without(evidenced, ["host_posterior", "path_posterior", "quality", "accepted"]).withColumn("site", F.struct(host, path))
    joined = rows.join(F.broadcast(known) if told["paths"] <= BROADCAST_ROWS else known, "site", "left")
    # A document's own share is taken out of its path, its host and the whole, so that it doesn't count twice.
    own = _chance(F.col("evidence"))
    others = told["n"] - 1
    mean = (F.lit(told["good"]) - own) / others if others > 0 else F.lit(0.5)
    k_host, k_path = F.lit(told["host_strength"]), F.lit(told["path_strength"])
    host_posterior = (k_host * mean + F.col("host_good") - own) / (k_host + F.col("host_n") - 1)
    posterior = (k_path * F.col("host_posterior") + F.col("good") - own) / (k_path + F.col("n") - 1)
    quality = _chance(F.col("evidence") + _logit(F.col("path_posterior")) - _logit(mean))
    out = joined.withColumn("host_posterior", host_posterior)
    out = out.withColumn("path_posterior", posterior).withColumn("quality", quality).withColumn("accepted", F.col("quality") >= 0.5)
    return out.drop("site", "good", "n", "host_good", "host_n")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document. Host: source; path: lang within it; null is a host or path of its own.

    Null texts count as empty; repeated rows are judged each, and each adds to its path; an empty table stays empty; other
    columns are not read. Without labels the evidence is even and the sites' rates are all one half.
    """
    seen = cut(evidence(docs.select("doc_id", "source", "lang", "text"), fit(docs, labels), ["doc_id", "source", "lang"]))
    known, told = sites(seen, F.col("source"), F.col("lang"))
    out = combine(seen, known, told, F.col("source"), F.col("lang"))
    return out.select("doc_id", "source", "lang", "evidence", "host_posterior", "path_posterior", "quality", "accepted")


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that are accepted. The evidence is found twice, which costs less than moving the texts."""
    model = fit(docs, labels)
    seen = evidence(docs.select("source", "lang", "text"), model, ["source", "lang"])
    known, told = sites(seen, F.col("source"), F.col("lang"))
    packed = evidence(docs.select(whole_row(docs), "source", "lang", "text"), model, ["row", "source", "lang"])
    return combine(packed, known, told, F.col("source"), F.col("lang")).where("accepted").select("row.*")

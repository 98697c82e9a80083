"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that Python works on at a time, and that Spark hands over at a time in a session that does not say itself how many.
ARROW_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Words are runs of digits, ASCII letters and everything beyond ASCII.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir. Where it is unset a local session gets a folder; a cluster has to name one that all share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codeweft-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared folder: survives lost executors and ends the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def bounded_batches(spark: SparkSession) -> None:
    """Texts are long: where the session leaves the rows of a batch at Spark's default, fewer are handed over at a time. A value
    that the session has set is kept."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(ARROW_ROWS))


def text_of(column: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns that would clash with an operator's own output are replaced by that output."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def whole_row(df: DataFrame) -> Column:
    """Column row: all columns of a row, whatever their names, out of the way of an operator's own; row.* brings them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


def map_texts(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], work: Callable[[list[str]], list[list]], keep: list[str] | None = None, rows: int = ARROW_ROWS) -> DataFrame:
    """Add columns that Python computes from at most `rows` texts at a time (null: empty)."""
    bounded_batches(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n, _ in fields}]
    source = df.select(*[F.col(f"`{c}`") for c in keep], text_of(f"`{text}`").alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in keep], *[T.StructField(n, t) for n, t in fields]])
    kinds = [to_arrow_type(t) for _, t in fields]
    names = [*keep, *[n for n, _ in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = work(batch.column(len(keep)).to_pylist())
                arrays = [batch.column(i) for i in range(len(keep))]
                arrays += [v if isinstance(v, pa.Array) else pa.array(v, type=k) for v, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


def bucketed_rank(df: DataFrame, group: list[str], order: list[str], out: str, rows: int, per_bucket: int = 20_000, position: Column | None = None) -> DataFrame:
    """Exact 0-based rank of each row in its group, without gathering a group in one task.

    position: a double in [0, 1) that orders the rows first, spread about evenly (default: from a seeded hash of
    `order`). Rows fall into buckets by it; the sizes of buckets, at most groups x buckets rows, give each bucket its
    offset, and row_number runs inside a bucket only. Group and order columns may be null.
    """
    n = 1 << max(6, (rows // per_bucket).bit_length())
    spot = position if position is not None else F.shiftrightunsigned(F.xxhash64(F.lit(20240607), *[F.col(c) for c in order]), 11) / F.lit(float(1 << 53))
    keys = [f"__g{i}" for i in range(len(group))]
    df = df.withColumns({"__spot": spot} | {k: F.struct(F.col(c)) for k, c in zip(keys, group, strict=True)})
    df = df.withColumn("__bucket", F.least(F.lit(n - 1), F.floor(F.col("__spot") * n)).cast("int"))
    sizes = df.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__spot", *order)
    ranked = df.withColumn("__in", F.row_number().over(inside))
    joined = ranked.join(offsets, [*keys, "__bucket"], "left")
    return joined.withColumn(out, F.col("__before") + F.col("__in") - 1).drop("__spot", "__bucket", "__before", "__in", *keys)


_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[:128] = [chr(i) in "0123456789abcdefghijklmnopqrstuvwxyz" for i in range(128)]
_POWERS = np.ones((2, 1), dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
#: Bytes of text hashed at once.
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit integers (a fixed bijection)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number and of its inverse modulo 2^64."""
    global _POWERS
    if _POWERS.shape[1] < n:
        n = max(n, 2 * _CHUNK)
        _POWERS = np.ones((2, n), dtype=np.uint64)
        _POWERS[0, 1:], _POWERS[1, 1:] = _P, pow(_P, -1, 1 << 64)
        np.multiply.accumulate(_POWERS, axis=1, out=_POWERS)
    return _POWERS


def word_hashes(texts: list[str], stem: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the lower-cased texts, one text after the other, and each text's number of words.

    stem: hash only so many first bytes of a word (0: all).
    """
    hashes, counts, k = [], [], 0
    while k < len(texts):
        size, first = 0, k
        parts = []
        while k < len(texts) and (not parts or size < _CHUNK):
            parts.append(texts[k].lower().encode())
            size += len(parts[-1]) + 1
            k += 1
        data = np.frombuffer(b"\n".join([b"", *parts, b""]), dtype=np.uint8)
        word = _WORD_BYTE[data]
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, end = edge[::2] + 1, edge[1::2] + 1
        end = np.minimum(end, start + stem) if stem else end
        power = _powers(len(data))
        total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[0, : len(data)], dtype=np.uint64)
        hashes.append(mix((total[end - 1] - total[start - 1]) * power[1, start]))
        ends = np.cumsum([len(p) + 1 for p in parts])
        counts.append(np.diff(np.searchsorted(start, np.concatenate([[0], ends + 1]))))
        assert k > first
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def scratch(df: DataFrame) -> tuple[DataFrame, str]:
    """Write as Parquet in the shared folder and read again; the folder, to be given to discard() once nothing reads it."""
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/codeweft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that scratch() made, through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

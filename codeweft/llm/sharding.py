"""Proportional stratified interleaving: every shard gets the mixture of the sources.

Rows are ranked in a seeded shuffle within their source; the fractional rank (rank + u) / rows of the source, u being a seeded
hash of the source in [0, 1), spreads each source evenly over [0, 1), and small sources over it one beside the other. Sorted by
it, the sources interleave in proportion, and cutting the sorted rows into equal runs gives shards whose counts differ by one at
most. Both ranks are found in buckets, so no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import bucketed_rank, cut, text_of, without

#: Seed of the offset at which each source begins.
SEED = 20240607


def interleave(rows: DataFrame, shards: int, stratum: str, order: list[str]) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    order: columns whose seeded hash shuffles a stratum; rows equal in all of them and in the stratum are exchangeable. A null
    stratum is a stratum of its own; columns named shard or slot are replaced; an empty table stays empty.
    """
    rows = cut(without(rows, ["shard", "slot"]))
    n = rows.count()
    strata = rows.groupBy(F.struct(stratum).alias("__stratum")).agg(F.count(F.lit(1)).alias("__size"))
    ranked = bucketed_rank(rows, [stratum], order, "__rank", n)
    # The sizes of strata are as many as there are sources; Spark broadcasts them if they are few, else splits the hot ones.
    sized = ranked.withColumn("__stratum", F.struct(stratum)).join(strata, "__stratum", "left").drop("__stratum")
    # Null strata have an offset of their own; 53 bits of the hash are exact in a double.
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(stratum).isNull(), F.col(stratum)), 11) / F.lit(float(1 << 53))
    mixed = sized.withColumn("__at", (F.col("__rank") + offset) / F.col("__size"))
    placed = bucketed_rank(mixed, [], ["__at", stratum, *order], "__place", n, position=F.col("__at"))
    # Integer arithmetic: row p goes to shard floor(p * shards / n), whose first row is ceil(shard * n / shards).
    shard = F.expr(f"__place * {shards}L div {max(1, n)}L")
    first = F.expr(f"(({shards}L - 1L) + __shard * {n}L) div {shards}L")
    out = placed.withColumn("__shard", shard).withColumn("slot", F.col("__place") - first).withColumn("shard", F.col("__shard").cast("int"))
    return out.drop("__rank", "__size", "__at", "__place", "__shard")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row for each document: doc_id, source, size, text_crc32, law (`rows`), shard, slot and grown_shard (null under this law).

    Null texts have a size of 1 and the checksum of the empty text; repeated rows are placed each; other columns are not read.
    """
    text = text_of("text")
    sized = docs.select("doc_id", "source", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = interleave(sized, shards, "source", ["doc_id", "text_crc32", "size"])
    law = placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    return law


def write_shards(docs: DataFrame, folder: str, shards: int = 16, stratum: str = "source", order: list[str] | None = None) -> None:
    """Write whole rows as one Parquet folder for each shard, in slot order inside a file."""
    placed = interleave(docs, shards, stratum, order or docs.columns)
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)

"""Streams of traces and changes: what arrives is merged into tables, once, and the stream stops when it has caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeweft.operators.graph import cut, runtime_edges

TRACE_SCHEMA = "caller string, `from` string, src string, callee string, `to` string, dst string, ts timestamp"


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str = TRACE_SCHEMA) -> None:
    """Append the distinct RUNTIME_TRACE edges of JSON lines in a folder; what an earlier run has seen is not added again.

    Each batch is compared with the edges already there, so nothing is kept in state however long the stream runs; a batch that
    is repeated after a failure finds its own edges there and adds none.
    """

    def batch(items: DataFrame, number: int) -> None:
        new = runtime_edges(items.drop("ts"))
        if _exists(spark, out):
            new = new.join(spark.read.schema(new.schema).parquet(out).select("src", "dst"), ["src", "dst"], "left_anti").select(*new.columns)
        cut(new).write.mode("append").parquet(out)

    spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def recent_calls(items: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Extension: calls in tumbling windows of event time; later than `delay` is dropped."""
    pairs = items.select(F.coalesce("caller", "from", "src").alias("src"), F.coalesce("callee", "to", "dst").alias("dst"), "ts").where("src is not null and dst is not null")
    return pairs.withWatermark("ts", delay).groupBy(F.window("ts", width), "src", "dst").agg(F.count(F.lit(1)).alias("calls"))


def watch(spark: SparkSession, folder: str, checkpoint: str, apply, schema: T.StructType | str = "path string, content string, language string, deleted boolean") -> None:
    """Hand each batch of changed files to apply(changed, removed), the last change of a path winning within a batch."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            apply(rows.where("not coalesce(deleted, false)").drop("deleted"), rows.where("deleted").select("path"))

    spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def next_interval(now_ms: int, changed: bool, clean: bool, base: int = 5_000, most: int = 60_000) -> int:
    """Polling back-off: doubled while nothing changes, back to the base on a change or a clean tree."""
    return base if changed or clean else min(most, now_ms * 2)


#: What a job can become: it is queued, runs, and ends.
TRANSITIONS = {None: ("Queued",), "Queued": ("Running", "Failed"), "Running": ("Completed", "Failed"), "Completed": (), "Failed": ()}


def job_states(log: DataFrame, finished: int = 32) -> DataFrame:
    """Rows (project, job, state, at) from a log (project, job, state, at): each job's last state.

    Steps that the state before does not allow are left out, as are unknown states and rows without a job or time; steps of one
    time count in order of name. Of finished jobs a project keeps the newest ones.
    """
    job, t = Window.partitionBy("project", "job"), F.col("t")
    step = lambda *states: F.col("state").isin(*states)
    known = log.where(F.col("state").isin(*(k for k in TRANSITIONS if k)) & F.col("job").isNotNull() & F.col("at").isNotNull()).select("project", "job", "state", F.struct("at", "state").alias("t"))
    # A job makes three steps at most; each is the first one after the one before that its state allows.
    known = known.withColumn("s1", F.min(F.when(step("Queued"), t)).over(job))
    known = known.withColumn("s2", F.min(F.when(step(*TRANSITIONS["Queued"]) & (t > F.col("s1")), t)).over(job))
    known = known.withColumn("s3", F.min(F.when(step(*TRANSITIONS["Running"]) & (F.col("s2.state") == "Running") & (t > F.col("s2")), t)).over(job))
    last = known.groupBy("project", "job").agg(F.first(F.coalesce("s3", "s2", "s1")).alias("m")).where("m is not null").select("project", "job", F.col("m.state").alias("state"), F.col("m.at").alias("at"))
    newest = Window.partitionBy("project", F.col("state").isin("Completed", "Failed")).orderBy(F.desc("at"), "job")
    return last.withColumn("k", F.row_number().over(newest)).where(~F.col("state").isin("Completed", "Failed") | (F.col("k") <= finished)).drop("k")


def may_start(states: DataFrame, project: str) -> bool:
    """One job of a project at a time."""
    return states.where((F.col("project") == project) & F.col("state").isin("Queued", "Running")).isEmpty()

"""Traversal, components, communities and roll-ups of the graph."""

from __future__ import annotations

import random
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.schema import COMMUNITY_WEIGHTS

# A symbol whose name holds one of these words may be called from outside.
ENTRY_WORDS = (
    "main", "handler", "handle", "route", "test", "spec", "setup", "teardown",
    "before_each", "after_each", "middleware", "init", "run", "start", "serve", "listen",
)


def shared_folder(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir. Where it is unset a local session gets a folder; a cluster has to name one that all share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codeweft-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute once in the shared folder: survives lost executors and ends the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """Compute once, as Parquet in the shared folder, which takes a fraction of the room of a checkpoint; the folder, to be given to
    forget() once nothing reads it. It goes with the session at the latest."""
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/codeweft-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder that kept() made, through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Names that are sent to all edges or symbols, rather than those being dealt by name to meet them.
NEAR = 500_000


def _few(names: DataFrame) -> DataFrame:
    return F.broadcast(names) if names.count() <= NEAR else names


def _ways(edges: DataFrame, direction: str) -> DataFrame:
    """Rows (at, qualified_name, way): each edge out of its source, into its target, or both, for which the edges are read once."""
    out, into = (F.struct(F.col(a).alias("at"), F.col(b).alias("qualified_name"), F.lit(k).alias("way")) for k, (a, b) in enumerate((("src", "dst"), ("dst", "src"))))
    if direction in ("out", "outbound", "in", "inbound"):
        return edges.select((out if direction in ("out", "outbound") else into).alias("w")).select("w.*")
    return edges.select(F.inline(F.array(out, into)))


def _known(new: DataFrame, symbols: DataFrame) -> DataFrame:
    """Those of the new names (written) that are symbols."""
    return new.join(symbols.select("qualified_name").join(_few(new.select("qualified_name")), "qualified_name", "left_semi"), "qualified_name", "left_semi")


def trace(symbols: DataFrame, edges: DataFrame, start: str, direction: str = "both", depth: int = 3) -> DataFrame:
    """Breadth-first search: rows (qualified_name, level) of the symbols reached, each at its first level.

    Ends that are no symbols are neither returned nor searched from. The frontier of a level meets the edges in one join: while it is
    small it is sent to them, so that the edges, which are not written, are neither dealt nor sorted.
    """
    step = _ways(edges, direction)
    first = symbols.where(F.col("qualified_name") == start).select("qualified_name").distinct()
    seen = frontier = kept(first.withColumn("level", F.lit(0)))[0]
    for level in range(1, depth + 1):
        ahead = step.join(_few(frontier.select(F.col("qualified_name").alias("at"))), "at", "left_semi").select("qualified_name").distinct()
        new, path = kept(ahead.join(_few(seen.select("qualified_name")), "qualified_name", "left_anti"))
        frontier, _ = kept(_known(new, symbols).withColumn("level", F.lit(level)))
        forget(symbols.sparkSession, path)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def discovery(symbols: DataFrame, edges: DataFrame, start: str, direction: str = "both", depth: int = 3) -> DataFrame:
    """trace() with place, the number in order of discovery: by the place of the node that a symbol is first met from, edges out of
    it before edges into it, then by name."""
    step = _ways(edges, direction)
    first = symbols.where(F.col("qualified_name") == start).select("qualified_name").distinct()
    seen = frontier = kept(first.select("qualified_name", F.lit(0).alias("level"), F.lit(0).cast("long").alias("place")))[0]
    count = seen.count()
    for level in range(1, depth + 1):
        met = step.join(_few(frontier.select(F.col("qualified_name").alias("at"), F.col("place").alias("parent"))), "at")
        ahead = met.groupBy("qualified_name").agg(F.min(F.struct("parent", "way")).alias("from"))
        new, path = kept(ahead.join(_few(seen.select("qualified_name")), "qualified_name", "left_anti"))
        ordered = numbered(_known(new, symbols).select("qualified_name", F.struct("from.parent", "from.way", "qualified_name").alias("key")), "key", "k")
        frontier, _ = kept(ordered.select("qualified_name", F.lit(level).alias("level"), (F.col("k") + count).alias("place")))
        forget(symbols.sparkSession, path)
        more = frontier.count()
        if not more:
            break
        seen, count = seen.unionByName(frontier), count + more
    return seen


def trace_edges(edges: DataFrame, nodes: DataFrame, direction: str, depth: int) -> DataFrame:
    """Edges met when the nodes below `depth` are searched from; in both directions an inner edge is met twice."""
    inner = nodes.where(F.col("level") < depth).select("qualified_name")
    ends = {end: _few(inner.select(F.col("qualified_name").alias(end))) for end in ("src", "dst")}
    out, into = (edges.join(ends[end], end, "left_semi").select(*edges.columns) for end in ("src", "dst"))
    return out if direction in ("out", "outbound") else into if direction in ("in", "inbound") else out.unionByName(into)


#: Pairs, and links by number, that one task finishes at most; keys of more rows than HUB meet their row by broadcast, as do those
#: outside the largest component up to FEW.
FINISH, LINKS, HUB, FEW = 500_000, 2_000_000, 100_000, 1_000_000


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that each of n nodes is linked with, over links a - b."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    return root


def to_one(rows: DataFrame, one: DataFrame, key: str, hubs: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows to the one row of their key. hubs (key): the keys of very many rows, of which there are few by that; their rows stay
    where they are, so none is dealt to one task for its key."""
    if hubs.isEmpty():
        return rows.join(one, key, how)
    held = one.join(F.broadcast(hubs), key, "left_semi")
    near = rows.join(F.broadcast(hubs), key, "left_semi").join(F.broadcast(held), key, how)
    return near.unionByName(rows.join(F.broadcast(hubs), key, "left_anti").join(one, key, how))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def _contracted(links: DataFrame, finish: int) -> DataFrame:
    """Rows (a, b): for each number in links (a, b) one number of its component, the same for all of it.

    In each round every number goes to the least of itself and its neighbours, in an order drawn anew, and links between what is left are
    taken on; that is a fixed share fewer at least. The last `finish` links are worked off in one task.
    """
    spark, steps, written = links.sparkSession, [], []

    def work_off(part: pd.DataFrame) -> pd.DataFrame:
        ids, codes = np.unique(part[["a", "b"]].to_numpy().ravel(), return_inverse=True)
        codes = codes.reshape(-1, 2)
        return pd.DataFrame({"a": ids, "b": ids[_roots(codes[:, 0], codes[:, 1], len(ids))]})

    draw, last = random.Random(0), None
    while n := links.count():
        if n <= finish:
            last, path = kept(links.groupBy().applyInPandas(work_off, "a long, b long"))
            written.append(path)
            break
        order = F.lit(draw.getrandbits(63))
        least = _both_ways(links).groupBy("a").agg(F.min(F.col("b").bitwiseXOR(order)).alias("m"), F.count(F.lit(1)).alias("n"))
        step, path = kept(least.select("a", F.least("m", F.col("a").bitwiseXOR(order)).bitwiseXOR(order).alias("r"), "n"))
        hubs, to = step.where(F.col("n") > HUB).select("a"), step.select("a", "r")
        half = to_one(links, to, "a", hubs).select(F.col("r").alias("a"), "b")
        moved = to_one(half, to.select(F.col("a").alias("b"), "r"), "b", hubs.select(F.col("a").alias("b"))).select("a", F.col("r").alias("b"))
        links, made = kept(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        steps.append((to, hubs))
        written += [path, made]
    for to, hubs in reversed(steps):
        if last is None:
            last = to.select("a", F.col("r").alias("b"))
            continue
        # A number has no more followers than neighbours.
        led = to_one(to, last.select(F.col("a").alias("r"), "b"), "r", hubs.select(F.col("a").alias("r")), "left")
        last = led.select("a", F.coalesce("b", "r").alias("b"))
    out, _ = kept(last if last is not None else links)
    for path in written:
        forget(spark, path)
    return out


def connected_components(nodes: DataFrame, edges: DataFrame, finish: int = LINKS) -> DataFrame:
    """Rows (qualified_name, root): root is the smallest name of the component; edges with an end outside are left out.

    Names are numbered by a hash of 64 bits that is drawn again if two nodes share a number. The least and the greatest neighbour of
    each node join nearly all that hangs together; then the edges are gone through for those that still part two components. The edges
    are read twice or three times and never written; only numbers are shuffled.
    """
    spark = nodes.sparkSession
    for seed in range(9):
        number = lambda c: F.xxhash64(F.col(c), F.lit(seed))  # noqa: B023, E731
        least = nodes.select(number("qualified_name").alias("a"), "qualified_name").groupBy("a").agg(F.min("qualified_name").alias("qualified_name"), F.max("qualified_name").alias("other"))
        known, names = kept(least)
        if known.where("qualified_name <> other").isEmpty():
            break
        forget(spark, names)
    links = edges.where("src <> dst").select(number("src").alias("a"), number("dst").alias("b"))

    def ends(rows: DataFrame) -> tuple[DataFrame, str]:
        met = _both_ways(rows).withColumn("k", F.lit(None).cast("int")).unionByName(known.select("a", F.lit(None).cast("long").alias("b"), F.lit(1).alias("k")))
        return kept(met.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count("b").alias("n"), F.max("k").alias("k")))

    near, written = ends(links)
    outside = near.where("k is null").select("a")
    if strange := outside.count():
        few = F.broadcast if strange <= FEW else lambda df: df
        links = links.join(few(outside), "a", "left_anti").join(few(outside.select(F.col("a").alias("b"))), "b", "left_anti").select("a", "b")
        near, _ = ends(links)  # what is outside stays on disk, as the links read it
    first, _ = kept(near.where("n > 0").select("a", F.explode(F.array("low", "high")).alias("b")))
    label = _contracted(first, finish)
    sizes = label.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    if largest := sizes.orderBy(F.desc("n"), "b").first():
        rest = label.where(F.col("b") != largest["b"])
        if (apart := rest.count()) and apart <= FEW:
            x, y = (F.broadcast(rest.select(F.col("a").alias(end), F.col("b").alias(f"r{end}"))) for end in "ab")
            led = links.join(x, "a", "left").join(y, "b", "left").select(*[F.coalesce(f"r{end}", F.lit(largest["b"])).alias(end) for end in "ab"])
        elif apart:
            hubs = near.where(F.col("n") > HUB).select("a")
            half = to_one(links, label.withColumnRenamed("b", "r"), "a", hubs).select(F.col("r").alias("a"), "b")
            led = to_one(half, label.select(F.col("a").alias("b"), F.col("b").alias("r")), "b", hubs.select(F.col("a").alias("b"))).select("a", F.col("r").alias("b"))
        if apart:
            more, left = kept(led.where("a <> b").distinct())
            joined = _contracted(more, finish)
            forget(spark, left)
            few = sizes.where(F.col("n") > HUB).select("b")
            label = to_one(label, joined.select(F.col("a").alias("b"), F.col("b").alias("r")), "b", few, "left").select("a", F.coalesce("r", "b").alias("b"))
    named, _ = kept(known.join(label, "a", "left").select("qualified_name", "b"))
    least, _ = kept(named.where("b is not null").groupBy("b").agg(F.min("qualified_name").alias("root"), F.count(F.lit(1)).alias("n")))
    forget(spark, written)
    rooted = to_one(named.where("b is not null"), least.select("b", "root"), "b", least.where(F.col("n") > HUB).select("b")).select("qualified_name", "root")
    return rooted.unionByName(named.where("b is null").select("qualified_name", F.col("qualified_name").alias("root")))


def _moves(rows: list[tuple[str, str | None, float]], total: float, resolution: float, sweeps: int) -> tuple[list[str], list[str]]:
    """The names of a component and the first name of the community of each. rows: its nodes (name, None, 0) and pairs (a, b, weight)."""
    names = sorted(a for a, b, _ in rows if b is None)
    if len(names) == len(rows):  # no pairs
        return names, names
    place = {n: k for k, n in enumerate(names)}
    near: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in rows:
        if b is not None:
            near[place[a]][place[b]] = near[place[b]][place[a]] = w
    strength = [sum(x.values()) for x in near]
    home, mass = list(range(len(names))), list(strength)
    for _ in range(sweeps if total > 0 else 0):
        moved = False
        for k, mine in enumerate(near):
            if not mine:
                continue
            mass[home[k]] -= strength[k]
            gain: dict[int, float] = {home[k]: 0.0}
            for j, w in mine.items():
                gain[home[j]] = gain.get(home[j], 0.0) + w
            score = {c: w - resolution * strength[k] * mass[c] / (2 * total) for c, w in gain.items()}
            best = max(score.values())
            to = min(c for c, s in score.items() if s >= best - 1e-12)
            moved |= to != home[k]
            home[k] = to
            mass[to] += strength[k]
        if not moved:
            break
    first: dict[int, str] = {}
    for k, c in enumerate(home):
        first.setdefault(c, names[k])
    return names, [first[c] for c in home]


def moved(parts: Iterator[pd.DataFrame], total: float, resolution: float, sweeps: int) -> Iterator[pd.DataFrame]:
    """Rows (qualified_name, head) of all components of a task: rows (root, a, b, w) come in order of root, however they are cut into
    batches. A task has many components of few rows, so none costs a call of its own."""
    root, own = None, []
    for part in parts:
        names, heads = [], []
        for r, *row in zip(part["root"], part["a"], part["b"], part["w"], strict=True):
            if r != root:
                told = _moves(own, total, resolution, sweeps)
                names += told[0]
                heads += told[1]
                root, own = r, []
            own.append(row)
        yield pd.DataFrame({"qualified_name": names, "head": heads}, dtype=str)
    names, heads = _moves(own, total, resolution, sweeps)
    yield pd.DataFrame({"qualified_name": names, "head": heads}, dtype=str)


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, sweeps: int = 20, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows (qualified_name, community): one level of modularity moves, nodes visited in order of name.

    Each node goes to the neighbouring community of the largest gain, ties to the smaller number; communities are numbered
    in order of their first node. A component never trades nodes with another, so components are worked on apart; the total
    weight that gains are measured against is that of the whole graph.
    """
    weights = weights or COMMUNITY_WEIGHTS
    weight = F.coalesce(*[F.when(F.col("edge_type") == k, F.lit(v)) for k, v in weights.items()])
    root = connected_components(nodes, edges.where(F.col("edge_type").isin(*weights)))
    known = nodes.select("qualified_name")
    used = edges.where("src <> dst").withColumn("w", weight).where("w is not null").join(known, F.col("src") == F.col("qualified_name"), "left_semi").join(known, F.col("dst") == F.col("qualified_name"), "left_semi")
    pairs = used.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))
    total = float(pairs.agg(F.sum("w")).first()[0] or 0.0)
    rows = root.select("root", F.col("qualified_name").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w")).unionByName(
        pairs.join(root, pairs["a"] == root["qualified_name"]).select("root", "a", "b", "w")
    )

    found = rows.repartition("root").sortWithinPartitions("root").mapInPandas(lambda parts: moved(parts, total, resolution, sweeps), "qualified_name string, head string")
    found = cut(found)
    return found.join(numbered(found.select("head").distinct(), "head", "community"), "head").select("qualified_name", "community")


def communities(nodes: DataFrame, edges: DataFrame, algorithm: str = "louvain", resolution: float = 1.0) -> DataFrame:
    """Rows (qualified_name, community) by the named algorithm: louvain, or components (cc, connected)."""
    if algorithm in ("components", "cc", "connected"):
        return number_components(connected_components(nodes, edges.where(F.col("edge_type").isin(*COMMUNITY_WEIGHTS))))
    return louvain(nodes, edges, resolution)


def number_components(roots: DataFrame) -> DataFrame:
    """Dense numbers in order of a component's smallest name."""
    roots, _ = kept(roots)
    sizes, _ = kept(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    return to_one(roots, numbered(sizes.select("root"), "root", "community"), "root", sizes.where(F.col("n") > HUB).select("root")).select("qualified_name", "community")


def numbered(rows: DataFrame, key: str, out: str) -> DataFrame:
    """Add `out`: the place of each key in order, from 0. Keys are sorted in ranges; the sizes of the ranges, one row for each,
    give their first numbers, so no task sees all keys."""
    ranged, _ = kept(rows.repartitionByRange(F.col(key)).withColumn("__part", F.spark_partition_id()))
    # One row for each partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = ranged.withColumn("__k", F.row_number().over(Window.partitionBy("__part").orderBy(key)))
    return inside.join(F.broadcast(sizes), "__part").withColumn(out, (F.col("__before") + F.col("__k") - 1).cast("long")).drop("__part", "__before", "__k")


def community_summary(members: DataFrame, top: int = 10, samples: int = 5) -> DataFrame:
    """The largest communities with their size and first members by name; ties to the smaller number. The first members are found in
    parts of a community, then among those of its parts."""
    sized = members.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community").limit(top)
    first = members.join(F.broadcast(sized), "community").withColumn("part", F.pmod(F.xxhash64("qualified_name"), F.lit(1024)))
    for keys in (["community", "part"], ["community"]):
        first = first.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("qualified_name"))).where(F.col("k") <= samples)
    return first.groupBy("community", "size").agg(F.array_join(F.sort_array(F.collect_list("qualified_name")), ",").alias("members"))


def dead_code(symbols: DataFrame, edges: DataFrame, labels: tuple[str, ...] = ("Function", "Method"), first: int = 50, words: tuple[str, ...] = ENTRY_WORDS) -> DataFrame:
    """Symbols that nothing calls: the first by name, then without those whose name holds an entry-point word."""
    called = edges.where(F.col("edge_type") == "CALLS").select(F.col("dst").alias("qualified_name"))
    idle = symbols.where(F.col("label").isin(*labels)).join(called, "qualified_name", "left_anti").orderBy("qualified_name").limit(first)
    return idle.where(~F.lower("name").rlike("|".join(words)))


def degree_by_type(edges: DataFrame) -> DataFrame:
    """Edges out of and into each node by edge type."""
    ends = edges.select(F.col("src").alias("qualified_name"), "edge_type", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("qualified_name"), "edge_type", F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("qualified_name", "edge_type").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def structure(project: str, files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (qualified_name, name, label) and CONTAINS edges (src, dst) of a project's files, folders and symbols.

    Every leading part of a path is a folder of the project, the whole path among them; a file contains its symbols.
    """
    root = f"{project}::Project::{project}"
    paths = files.select("path").distinct()
    parts = F.split("path", "/", -1)
    folder = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("p")).distinct()
    as_file = paths.select(F.concat("path", F.lit("::File::"), "path").alias("qualified_name"), F.col("path").alias("name"), F.lit("File").alias("label"))
    as_folder = folder.select(F.concat("p", F.lit("::Folder::"), "p").alias("qualified_name"), F.col("p").alias("name"), F.lit("Folder").alias("label"))
    top = files.sparkSession.range(1).select(F.lit(root).alias("qualified_name"), F.lit(project).alias("name"), F.lit("Project").alias("label"))
    nodes = top.unionByName(as_file).unionByName(as_folder)
    holds = as_file.unionByName(as_folder).select(F.lit(root).alias("src"), F.col("qualified_name").alias("dst"))
    inside = symbols.join(paths, symbols["file_path"] == paths["path"]).select(F.concat("path", F.lit("::File::"), "path").alias("src"), F.col("qualified_name").alias("dst"))
    return nodes, holds.unionByName(inside)


def layout(symbols: DataFrame, edges: DataFrame, limit: int = 100, radius: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """The first symbols by name on a Fibonacci sphere, and the edges between them: of the first 4 x limit edges at most 2 x limit."""
    first = symbols.orderBy("qualified_name").limit(limit).withColumn("n", F.row_number().over(Window.orderBy("qualified_name")) - 1)
    count = F.greatest(F.count(F.lit(1)).over(Window.partitionBy()), F.lit(1))
    y = F.lit(1.0) - F.col("n") / F.greatest(count - 1, F.lit(1)) * 2
    ring, turn = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y)), F.col("n") * F.lit(2.399963229728653)
    nodes = first.select("qualified_name", "label", (F.cos(turn) * ring * radius).alias("x"), (y * radius).alias("y"), (F.sin(turn) * ring * radius).alias("z"))
    names = nodes.select("qualified_name")
    prefix = edges.orderBy("src", "dst", "edge_type").limit(4 * limit)
    inside = prefix.join(names, F.col("src") == F.col("qualified_name"), "left_semi").join(names, F.col("dst") == F.col("qualified_name"), "left_semi")
    return nodes, inside.orderBy("src", "dst", "edge_type").limit(2 * limit)


def runtime_edges(traces: DataFrame) -> DataFrame:
    """Distinct RUNTIME_TRACE edges of items with a caller and a callee, under any of their names; incomplete items are skipped."""

    def first(*names: str):
        return F.coalesce(*[F.col(n) for n in names if n in traces.columns])

    pairs = traces.select(first("caller", "from", "src").alias("src"), first("callee", "to", "dst").alias("dst"))
    return pairs.where("src is not null and dst is not null").distinct().withColumn("edge_type", F.lit("RUNTIME_TRACE"))


def _in_order(part: pd.DataFrame) -> pd.DataFrame:
    """Pairs kept when gone through one by one; room_a and room_b are what their ends have left."""
    part, room, kept = part.sort_values(["edge_type", "score", "a", "b"], ascending=[True, False, True, True], kind="stable"), {}, []
    for k, (kind, a, b, left_a, left_b) in enumerate(part[["edge_type", "a", "b", "room_a", "room_b"]].itertuples(index=False)):
        at, to = (kind, a), (kind, b)
        if room.setdefault(at, left_a) > 0 and room.setdefault(to, left_b) > 0:
            kept.append(k)
            room[at] -= 1
            room[to] -= 1
    return part.iloc[kept][["a", "b", "score", "edge_type"]]


def greedy_pairs(scored: DataFrame, similar: float = 0.55, similar_cap: int = 10, related_cap: int = 15, finish: int = FINISH, rounds: int = 4) -> DataFrame:
    """Edges kept in order of (score desc, a, b) while both ends have room; the similar and the related have their own room.

    A pair that finds no room is dropped. Pairs are sorted into stretches of about `finish`, which are gone through one after another, each
    in one task; of a stretch only the pairs whose ends have room left by then come there. After `rounds` stretches, then after twice
    as many and so on, all that wait are cleared of pairs without room and sorted into stretches anew, so that what is read grows no faster
    than the pairs but for a logarithm, whatever waits for each other.
    """
    spark = scored.sparkSession
    kind = F.when(F.col("score") >= similar, "SIMILAR_TO").otherwise("SEMANTICALLY_RELATED")
    left, path = kept(scored.select("a", "b", F.col("score").cast("double").alias("score")).withColumn("edge_type", kind))
    taken = greedy_folders(left, path, spark.createDataFrame([], "edge_type string, n string, used long"), similar_cap, related_cap, finish, rounds)
    return chosen_edges(spark, taken)


CHOSEN = "a string, b string, score double, edge_type string"


def chosen_edges(spark: SparkSession, taken: list[str]) -> DataFrame:
    return spark.read.schema(CHOSEN).parquet(*taken) if taken else spark.createDataFrame([], CHOSEN)


def greedy_folders(left: DataFrame, path: str, used: DataFrame, similar_cap: int = 10, related_cap: int = 15, finish: int = FINISH, rounds: int = 4) -> list[str]:
    """Folders of the edges kept of the pairs `left`, which lie in a folder that goes, where `used` are the edges that ends have before."""
    spark = left.sparkSession
    full = F.when(F.col("edge_type") == "SIMILAR_TO", similar_cap).otherwise(related_cap)
    taken: list[str] = []

    def with_room(pairs: DataFrame) -> DataFrame:
        """The pairs whose ends both have room, and how much."""
        room = _few(used)
        for end in ("a", "b"):
            pairs = pairs.join(room.select("edge_type", F.col("n").alias(end), (full - F.col("used")).alias(f"room_{end}")), ["edge_type", end], "left")
        return pairs.withColumns({f"room_{end}": F.coalesce(f"room_{end}", full.cast("long")) for end in ("a", "b")}).where("room_a > 0 and room_b > 0")

    while n := left.count():
        parts = -(-n // max(finish, 16))
        if parts > 1:
            ranged, sorted_ = kept(left.repartitionByRange(parts, F.desc("score"), "a", "b").withColumn("stretch", F.spark_partition_id()))
            forget(spark, path)
            left, path = ranged, sorted_
        for k in range(min(parts, rounds)):
            own = left.where(F.col("stretch") == k) if parts > 1 else left
            chosen, folder = kept(with_room(own.select("a", "b", "score", "edge_type")).groupBy().applyInPandas(_in_order, CHOSEN))
            taken.append(folder)
            if k < parts - 1:
                ends = chosen.select("edge_type", F.explode(F.array("a", "b")).alias("n"), F.lit(1).cast("long").alias("used"))
                used, _ = kept(used.unionByName(ends).groupBy("edge_type", "n").agg(F.sum("used").alias("used")))
        if parts <= rounds:
            break
        waiting, cleared = kept(with_room(left.where(F.col("stretch") >= rounds).select("a", "b", "score", "edge_type")).select("a", "b", "score", "edge_type"))
        forget(spark, path)
        left, path, rounds = waiting, cleared, 2 * rounds
    forget(spark, path)
    return taken


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key: first write wins with an ascending order, last write wins with a descending one."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")

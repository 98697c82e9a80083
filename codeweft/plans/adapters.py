"""The driver's tables seen as a property graph, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.text import lines


PAIRS_OF_A_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers, parts and orders as symbols."""
    t = lambda n: table(spark, sf_dir, n)
    place = t("nation").select(F.col("n_nationkey").alias("nk"), F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("at"))

    def rows(df: DataFrame, kind: str, key: str, name, path, signature) -> DataFrame:
        k = F.col(key).cast("long")
        return df.select(
            F.concat(F.lit(f"{kind.lower()}::{kind}::"), k).alias("qualified_name"), name.alias("name"), F.lit(kind).alias("label"), path.alias("file_path"),
            k.alias("line_start"), (k + 2).alias("line_end"), signature.cast("string").alias("signature"),
        )

    c, none = F.col, F.lit(None)
    located = lambda n, k: t(n).join(F.broadcast(place), c(k) == c("nk"))  # noqa: E731  25 rows
    parts = [
        rows(t("region"), "Region", "r_regionkey", c("r_name"), F.concat(F.lit("r"), "r_regionkey", F.lit("/region")), none),
        rows(t("nation"), "Nation", "n_nationkey", c("n_name"), F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/nation")), none),
        rows(located("customer", "c_nationkey"), "Customer", "c_custkey", c("c_name"), F.concat("at", F.lit("/customer")), c("c_mktsegment")),
        rows(located("supplier", "s_nationkey"), "Supplier", "s_suppkey", c("s_name"), F.concat("at", F.lit("/supplier")), none),
        rows(t("part"), "Part", "p_partkey", c("p_name"), F.concat("p_brand", F.lit("/"), "p_type"), c("p_type")),
        rows(t("orders"), "Order", "o_orderkey", F.concat(F.lit("order_"), "o_orderkey"), F.concat("o_orderpriority", F.lit("/"), "o_orderstatus"), c("o_orderstatus")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The tables that edges of a kind are made of, a row an edge (of lineitem: at most).
_ROWS = {"CONTAINS": ("nation", "customer", "supplier"), "CALLS": ("orders", "lineitem"), "IMPORTS": ("lineitem",)}


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("CONTAINS", "CALLS", "IMPORTS"), once: bool = True, by: str | None = None) -> DataFrame:
    """Foreign keys as edges: regions contain nations, nations contain customers and suppliers; customers call orders and orders
    parts; parts import suppliers. Of the kinds asked for only, so that unused tables are not read. once=False leaves repeated edges in,
    for those who ask only what hangs together. by: the end that a statement joins on. Where the session's partitions would get more
    rows than a task should sort, edges are dealt by it to more; Spark then deals the other side of the join alike, and shuffles no more."""
    t = lambda n: table(spark, sf_dir, n)

    def link(df: DataFrame, kind: str, a: str, ak: str, b: str, bk: str) -> DataFrame:
        name = lambda k, c: F.concat(F.lit(f"{k.lower()}::{k}::"), F.col(c))
        return df.select(name(a, ak).alias("src"), name(b, bk).alias("dst"), F.lit(kind).alias("edge_type"))

    def lines_of(*keys: str) -> DataFrame:
        pairs = t("lineitem").select(*keys)
        if not once:
            return pairs
        # Tasks of a bounded number of rows, whatever the size of the table and the session's number of partitions.
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS_OF_A_TASK))
        return pairs.repartition(parts, *keys).distinct()

    out = []
    if "CONTAINS" in kinds:
        out += [
            link(t("nation"), "CONTAINS", "Region", "n_regionkey", "Nation", "n_nationkey"),
            link(t("customer"), "CONTAINS", "Nation", "c_nationkey", "Customer", "c_custkey"),
            link(t("supplier"), "CONTAINS", "Nation", "s_nationkey", "Supplier", "s_suppkey"),
        ]
    if "CALLS" in kinds:
        out += [
            link(t("orders"), "CALLS", "Customer", "o_custkey", "Order", "o_orderkey"),
            link(lines_of("l_orderkey", "l_partkey"), "CALLS", "Order", "l_orderkey", "Part", "l_partkey"),
        ]
    if "IMPORTS" in kinds:
        out.append(link(lines_of("l_partkey", "l_suppkey"), "IMPORTS", "Part", "l_partkey", "Supplier", "l_suppkey"))
    whole = out[0]
    for e in out[1:]:
        whole = whole.unionByName(e)
    if by is not None:
        names = [n for k in kinds for n in _ROWS[k]]
        rows = {n: t(n).count() for n in set(names)}  # by the files' footers
        parts = -(-sum(rows[n] for n in names) // PAIRS_OF_A_TASK)
        if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
            return whole.repartition(parts, by)
    return whole


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"), F.col("lang").alias("language"), F.size(lines(F.col("text"))).cast("long").alias("line_count"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as calls from one event type to the next."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("caller"), F.lead("event_type").over(order).alias("callee"), "user_id", "event_id")


# The same in SQL, for the oracle.
SYMBOLS_SQL = """symbols AS (
  SELECT 'region::Region::' || r_regionkey AS qualified_name, r_name AS name, 'Region' AS label, 'r' || r_regionkey || '/region' AS file_path,
         r_regionkey::BIGINT AS line_start, r_regionkey::BIGINT + 2 AS line_end, NULL::VARCHAR AS signature FROM region
  UNION ALL SELECT 'nation::Nation::' || n_nationkey, n_name, 'Nation', 'r' || n_regionkey || '/n' || n_nationkey || '/nation', n_nationkey, n_nationkey + 2, NULL FROM nation
  UNION ALL SELECT 'customer::Customer::' || c_custkey, c_name, 'Customer', 'r' || n_regionkey || '/n' || n_nationkey || '/customer', c_custkey, c_custkey + 2, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier::Supplier::' || s_suppkey, s_name, 'Supplier', 'r' || n_regionkey || '/n' || n_nationkey || '/supplier', s_suppkey, s_suppkey + 2, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part::Part::' || p_partkey, p_name, 'Part', p_brand || '/' || p_type, p_partkey, p_partkey + 2, p_type FROM part
  UNION ALL SELECT 'order::Order::' || o_orderkey, 'order_' || o_orderkey, 'Order', o_orderpriority || '/' || o_orderstatus, o_orderkey, o_orderkey + 2, o_orderstatus FROM orders)"""
EDGES_SQL = """edges AS (
  SELECT 'region::Region::' || n_regionkey AS src, 'nation::Nation::' || n_nationkey AS dst, 'CONTAINS' AS edge_type FROM nation
  UNION ALL SELECT 'nation::Nation::' || c_nationkey, 'customer::Customer::' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 'nation::Nation::' || s_nationkey, 'supplier::Supplier::' || s_suppkey, 'CONTAINS' FROM supplier
  UNION ALL SELECT 'customer::Customer::' || o_custkey, 'order::Order::' || o_orderkey, 'CALLS' FROM orders
  UNION ALL SELECT DISTINCT 'order::Order::' || l_orderkey, 'part::Part::' || l_partkey, 'CALLS' FROM lineitem
  UNION ALL SELECT DISTINCT 'part::Part::' || l_partkey, 'supplier::Supplier::' || l_suppkey, 'IMPORTS' FROM lineitem)"""
FILES_SQL = """files AS (
  SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, lang AS language,
         CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END::BIGINT AS line_count FROM documents)"""
TRACES_SQL = """traces AS (
  SELECT event_type AS caller, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee, user_id, event_id FROM events)"""
TOKENS_SQL = """bags AS (
  SELECT doc_id, token, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]{2,}'), lambda x: lower(x))) AS token FROM documents) GROUP BY ALL)"""

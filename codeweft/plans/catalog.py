"""Queries over the driver's tables, one or more for each operator, and their SQL for the oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.functions import patterns as P
from codeweft.functions import text as X
from codeweft.operators import graph, resolve, search, similarity, text
from codeweft.plans import adapters as A
from codeweft.plans import code_corpus as C
from codeweft.plans import passes, sqlgate
from codeweft.schema import EngineConfig
from codeweft.sources import discover, extract
from codeweft.store import Store, projects
from codeweft.streaming.traces import job_states

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *needs: str, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query; needs: the common tables that its SQL reads."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            recursive = "RECURSIVE " if "recursive" in needs else ""
            common = [n for n in needs if n != "recursive"]
            ORACLES[key] = (f"WITH {recursive}" + ",\n".join(common) + ("\n" if sql.lstrip().upper().startswith(("SELECT", "(")) else ",\n") + sql) if common or recursive else sql
        return f

    return register


S, E, FILES, TRACES, BAGS = A.SYMBOLS_SQL, A.EDGES_SQL, A.FILES_SQL, A.TRACES_SQL, A.TOKENS_SQL
COLS = "qualified_name, name, label, file_path, line_start, line_end, signature"


# --- sources -----------------------------------------------------------------------------------------------------------


def _paths(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "pages").select(F.coalesce(X.url_path(F.col("url")), F.lit("")).alias("p"), F.length("html").cast("long").alias("size"), "page_id")


_EXTENSIONS = ("py", "rs", "md", "png", "xyz")


@query(
    """p AS (SELECT page_id, length(html)::BIGINT AS size, 'src/' || (page_id % 3) || CASE page_id % 4 WHEN 0 THEN '/tests/f' WHEN 1 THEN '/node_modules/f' ELSE '/f' END || page_id || '.' ||
      ['py','rs','md','png','xyz'][(page_id % 5 + 1)::INT] AS path FROM pages)
    SELECT path, size, CASE page_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' ELSE 'markdown' END AS language FROM p WHERE page_id % 5 < 3 AND page_id % 4 > 1""",
    "one AS (SELECT 1)",
)
def discovery_filter(s, d):
    p = A.table(s, d, "pages").select("page_id", F.length("html").cast("long").alias("size"))
    folder = F.when(F.col("page_id") % 4 == 0, "/tests/f").when(F.col("page_id") % 4 == 1, "/node_modules/f").otherwise("/f")
    end = F.get(F.array(*[F.lit(x) for x in _EXTENSIONS]), (F.col("page_id") % 5).cast("int"))
    files = p.select(F.concat(F.lit("src/"), F.col("page_id") % 3, folder, "page_id", F.lit("."), end).alias("path"), "size")
    return discover.wanted(files, "moderate").select("path", "size", "language")


@query("SELECT path, line_count FROM files", FILES)
def file_line_counts(s, d):
    return A.files(s, d).select("path", "line_count")


@query("SELECT lang AS project, count(*)::BIGINT AS files FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def list_projects(s, d):
    """A project for each language, kept in a store of its own, listed and read back."""
    files = A.table(s, d, "documents").where("lang is not null").select(F.col("lang").alias("project"), F.concat(F.col("doc_id"), F.lit(".txt")).alias("path"), F.lit("").alias("content"))
    graph.shared_folder(s)
    root = f"{s.sparkContext.getCheckpointDir()}/projects-{uuid.uuid4().hex}"
    for r in files.select("project").distinct().collect():  # the languages
        Store(s, root, r["project"]).replace(files=files.where(F.col("project") == r["project"]))
    listed = [Store(s, root, p).read("files").agg(F.count(F.lit(1)).alias("files")).select(F.lit(p).alias("project"), "files") for p in projects(s, root)]
    out = s.createDataFrame([], "project string, files long")
    for one in listed:
        out = out.unionByName(one)
    return out


@query(f"SELECT {COLS} FROM symbols WHERE qualified_name IN (SELECT DISTINCT 'part::Part::' || l_partkey FROM lineitem WHERE l_quantity = 50)", S)
def symbol_lookup(s, d):
    keys = A.table(s, d, "lineitem").where("l_quantity = 50").select(F.concat(F.lit("part::Part::"), "l_partkey").alias("qualified_name")).distinct()
    return search.lookup(A.symbols(s, d), keys)


@query("SELECT * FROM (VALUES ('M','src/a.py',false), ('R','new.py',false), ('D','gone.rs',true), ('??','x y.txt',false)) AS t(status, path, deleted)")
def porcelain_parse(s, d):
    return discover.parse_porcelain(s.createDataFrame([(" M src/a.py",), ("R  old.py -> new.py",), (" D gone.rs",), ('?? "x y.txt"',), ("",)], "line string"))


# --- structured search -------------------------------------------------------------------------------------------------

_SEARCHES = {
    "search_label": (search.SearchFilter(label="Supplier", limit=None), "label = 'Supplier'"),
    "search_glob": (search.SearchFilter(file_pattern="r[0-2]/n?/*er", limit=None), "file_path GLOB 'r[0-2]/n?/*er'"),
    "search_query": (search.SearchFilter(query="BUILDing", limit=None), "contains(lower(name), 'building') OR contains(lower(qualified_name), 'building') OR contains(lower(coalesce(signature, '')), 'building')"),
    "search_name_regex": (search.SearchFilter(name_pattern="_[0-9]*7$", label="Order", limit=None), "label = 'Order' AND regexp_matches(name, '_[0-9]*7$')"),
    "search_qn_regex": (search.SearchFilter(qn_pattern="^part::.*99$", limit=None), "regexp_matches(qualified_name, '^part::.*99$')"),
    "search_invalid_regex": (search.SearchFilter(name_pattern="(", limit=None), "false"),
    "search_relationship_out": (search.SearchFilter(label="Customer", relationship="CALLS", direction="outbound", limit=None), "label = 'Customer' AND qualified_name IN (SELECT src FROM edges WHERE edge_type = 'CALLS')"),
    "search_relationship_in": (search.SearchFilter(label="Part", relationship="CALLS", direction="in", limit=None), "label = 'Part' AND qualified_name IN (SELECT dst FROM edges WHERE edge_type = 'CALLS')"),
    "search_relationship_any": (search.SearchFilter(label="Nation", relationship="CONTAINS", limit=None), "label = 'Nation' AND qualified_name IN (SELECT src FROM edges WHERE edge_type = 'CONTAINS' UNION SELECT dst FROM edges WHERE edge_type = 'CONTAINS')"),
    "search_degree": (search.SearchFilter(label="Customer", relationship="CALLS", min_degree=12, max_degree=15, limit=None), "label = 'Customer' AND (SELECT count(*) FROM edges WHERE edge_type = 'CALLS' AND (src = qualified_name OR dst = qualified_name)) BETWEEN 12 AND 15"),
    "search_zero_degree": (search.SearchFilter(label="Part", relationship="CALLS", direction="in", max_degree=20, limit=None), "label = 'Part' AND coalesce((SELECT count(*) FROM edges WHERE edge_type = 'CALLS' AND dst = qualified_name), 0) <= 20"),
    "search_non_entry": (search.SearchFilter(label="Order", name_pattern="00$", exclude_entry_points=True, limit=None), "label = 'Order' AND regexp_matches(name, '00$') AND qualified_name IN (SELECT dst FROM edges WHERE edge_type = 'CALLS')"),
}
for _key, (_filter, _where) in _SEARCHES.items():
    query(f"SELECT {COLS} FROM symbols WHERE {_where}", S, E, name=_key)(lambda s, d, f=_filter: search.search(A.symbols(s, d), A.edges(s, d, ("CONTAINS",) if f.relationship == "CONTAINS" else ("CALLS",)), f))


@query(
    f"""hub AS (SELECT c.qualified_name FROM symbols c JOIN (SELECT src, count(*) AS n FROM edges WHERE edge_type = 'CALLS' GROUP BY src) e ON e.src = c.qualified_name WHERE label = 'Customer' AND n >= 20),
    near AS (SELECT qualified_name AS q FROM hub UNION SELECT dst FROM edges JOIN hub ON src = qualified_name WHERE edge_type = 'CALLS' UNION SELECT src FROM edges JOIN hub ON dst = qualified_name WHERE edge_type = 'CALLS')
    SELECT {COLS} FROM symbols WHERE qualified_name IN (SELECT q FROM near)""",
    S,
    E,
)
def search_connected(s, d):
    f = search.SearchFilter(label="Customer", relationship="CALLS", direction="any", min_degree=20, include_connected=True, limit=None)
    return search.search(A.symbols(s, d), A.edges(s, d, ("CALLS",)), f)


@query(
    f"""f AS (SELECT * FROM symbols WHERE label = 'Part')
    SELECT {COLS}, (SELECT count(*) FROM f)::BIGINT AS total, 25::BIGINT AS "limit", 50::BIGINT AS "offset", 75 < (SELECT count(*) FROM f) AS has_more FROM (SELECT * FROM f ORDER BY qualified_name LIMIT 25 OFFSET 50)""",
    S,
)
def search_page(s, d):
    return search.search_page(A.symbols(s, d), A.edges(s, d), search.SearchFilter(label="Part", limit=25, offset=50))


@query("SELECT src, dst, edge_type, CASE WHEN src = 'order::Order::7' THEN 'out' ELSE 'in' END AS direction FROM edges WHERE src = 'order::Order::7' OR dst = 'order::Order::7'", E)
def node_detail(s, d):
    return search.node_detail(A.edges(s, d), "order::Order::7")


@query(
    """w AS (SELECT page_id, list_filter(regexp_extract_all(url, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) >= 4) AS ws FROM pages)
    SELECT page_id, left(list_filter(ws, lambda x: length(x) = list_max(list_transform(ws, lambda y: length(y))))[1], 96) AS identifier FROM w""",
    "one AS (SELECT 1)",
)
def longest_identifier(s, d):
    return A.table(s, d, "pages").select("page_id", X.longest_identifier(F.col("url")).alias("identifier"))


# --- graph -------------------------------------------------------------------------------------------------------------

_TRACE = """known AS (SELECT qualified_name FROM symbols), step AS ({step}),
    l0 AS (SELECT 'customer::Customer::1' AS q),
    l1 AS (SELECT DISTINCT b AS q FROM step JOIN l0 ON a = q WHERE b IN (FROM known) AND b NOT IN (FROM l0)),
    l2 AS (SELECT DISTINCT b AS q FROM step JOIN l1 ON a = q WHERE b IN (FROM known) AND b NOT IN (FROM l0 UNION ALL FROM l1)),
    l3 AS (SELECT DISTINCT b AS q FROM step JOIN l2 ON a = q WHERE b IN (FROM known) AND b NOT IN (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2))
    SELECT q AS qualified_name, 0 AS level FROM l0 UNION ALL SELECT q, 1 FROM l1 UNION ALL SELECT q, 2 FROM l2 UNION ALL SELECT q, 3 FROM l3"""
for _way, _step in {"out": "SELECT src AS a, dst AS b FROM edges", "in": "SELECT dst AS a, src AS b FROM edges", "both": "SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges"}.items():
    query(_TRACE.format(step=_step), S, E, name=f"trace_{_way}")(lambda s, d, way=_way: graph.trace(A.symbols(s, d), A.edges(s, d, once=False), "customer::Customer::1", way, 3))


_FOUND = """SELECT b AS q, {k} AS level, row_number() OVER (ORDER BY f, b) + (SELECT max(place) FROM ({seen})) AS place FROM
      (SELECT b, min({{'p': place, 'w': way}}) AS f FROM step JOIN d{last} ON a = q WHERE b IN (SELECT qualified_name FROM symbols) AND b NOT IN (SELECT q FROM ({seen})) GROUP BY b)"""
_seen = [" UNION ALL ".join(f"SELECT q, place FROM d{j}" for j in range(k)) for k in range(4)]


@query(
    """step AS (SELECT src AS a, dst AS b, 0 AS way FROM edges UNION ALL SELECT dst, src, 1 FROM edges), d0 AS (SELECT 'customer::Customer::1' AS q, 0 AS level, 0::BIGINT AS place),
    """
    + ",\n".join(f"d{k} AS MATERIALIZED ({_FOUND.format(k=k, seen=_seen[k], last=k - 1)})" for k in (1, 2, 3))
    + " SELECT q AS qualified_name, level, place FROM d0 UNION ALL FROM d1 UNION ALL FROM d2 UNION ALL FROM d3",
    S,
    E,
)
def trace_discovery(s, d):
    return graph.discovery(A.symbols(s, d), A.edges(s, d, once=False), "customer::Customer::1", "both", 3)


_MET = _TRACE.format(step="SELECT src AS a, dst AS b FROM edges").rpartition("SELECT q AS qualified_name, 0")[0].rstrip()


@query(_MET + ", near AS MATERIALIZED (SELECT q FROM l0 UNION SELECT q FROM l1 UNION SELECT q FROM l2) SELECT src, dst, edge_type FROM edges SEMI JOIN near ON src = q", S, E)
def trace_edges(s, d):
    met = graph.trace(A.symbols(s, d), A.edges(s, d, once=False), "customer::Customer::1", "out", 3)
    return graph.trace_edges(A.edges(s, d), met, "out", 3)


@query("SELECT src, dst, edge_type FROM edges WHERE src = 'order::Order::7'", E)
def edges_from(s, d):
    return A.edges(s, d).where("src = 'order::Order::7'")


@query("SELECT dst, src, edge_type FROM edges WHERE dst = 'part::Part::1'", E)
def edges_to(s, d):
    return A.edges(s, d).where("dst = 'part::Part::1'")


@query("SELECT q AS qualified_name, edge_type, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS q, edge_type, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, edge_type, 0, 1 FROM edges) GROUP BY ALL", E)
def degree_by_type(s, d):
    return graph.degree_by_type(A.edges(s, d))


_WORDS = "|".join(graph.ENTRY_WORDS)


@query(
    f"""idle AS (SELECT {COLS} FROM symbols WHERE label IN ('Customer', 'Part') AND qualified_name NOT IN (SELECT dst FROM edges WHERE edge_type = 'CALLS') ORDER BY qualified_name LIMIT 50)
    SELECT * FROM idle WHERE NOT regexp_matches(lower(name), '{_WORDS}')""",
    S,
    E,
)
def dead_code(s, d):
    return graph.dead_code(A.symbols(s, d), A.edges(s, d, ("CALLS",)), ("Customer", "Part"))


# What hangs together with the smallest name, found by walking; the tables leave no other component but single symbols, and the
# result would differ if they did.
_WALKED = """two AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges), known AS (SELECT qualified_name AS q FROM symbols),
    reach AS (SELECT min(q) AS q FROM known UNION SELECT b FROM reach JOIN two ON a = q JOIN known k ON k.q = b),
    m AS (SELECT q AS qualified_name, CASE WHEN q IN (FROM reach) THEN (SELECT min(q) FROM known) ELSE q END AS root FROM known),
    n AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS community FROM (SELECT DISTINCT root FROM m))"""


@query(f"{_WALKED} SELECT qualified_name, community::BIGINT AS community FROM m JOIN n USING (root)", S, E, "recursive")
def connected_components(s, d):
    return graph.number_components(graph.connected_components(A.symbols(s, d), A.edges(s, d, once=False)))


@query()
def louvain(s, d):
    """Communities of the code made from the documents: calls, imports and inheritance between its symbols."""
    files = C.files(s, d)
    found, symbols = passes.read_files(files)
    none = symbols.limit(0).select(F.lit("").alias("src"), F.lit("").alias("dst"), F.lit("").alias("edge_type"), F.lit("").alias("properties"))
    edges = None
    for one in (passes.call_pass, passes.import_pass, passes.inheritance_pass):
        new = one("demo", files, found, symbols, none, EngineConfig())
        edges = new if edges is None else edges.unionByName(new)
    return graph.louvain(symbols, graph.cut(edges))


@query(
    f"""{_WALKED}, z AS (SELECT community, count(*)::BIGINT AS size FROM m JOIN n USING (root) GROUP BY ALL ORDER BY size DESC, community LIMIT 10),
    r AS (SELECT community, qualified_name, row_number() OVER (PARTITION BY community ORDER BY qualified_name) AS k FROM m JOIN n USING (root))
    SELECT community::BIGINT AS community, size, string_agg(qualified_name, ',' ORDER BY qualified_name) AS members FROM z JOIN r USING (community) WHERE k <= 5 GROUP BY ALL""",
    S,
    E,
    "recursive",
)
def community_summary(s, d):
    return graph.community_summary(connected_components(s, d))


_LAYOUT_NODES = f"first AS (SELECT *, row_number() OVER (ORDER BY qualified_name) - 1 AS n FROM (SELECT {COLS} FROM symbols WHERE label IN ('Region', 'Nation') ORDER BY qualified_name LIMIT 100))"


@query(
    f"""{_LAYOUT_NODES}, y AS (SELECT *, 1.0::DOUBLE - n::DOUBLE / greatest((SELECT count(*) FROM first) - 1, 1) * 2 AS y0, n * 2.399963229728653::DOUBLE AS t FROM first)
    SELECT qualified_name, label, round(cos(t) * sqrt(greatest(0, 1 - y0 * y0)) * 8, 4) AS x, round(y0 * 8, 4) AS y, round(sin(t) * sqrt(greatest(0, 1 - y0 * y0)) * 8, 4) AS z FROM y""",
    S,
)
def graph_layout(s, d):
    nodes, _ = graph.layout(A.symbols(s, d).where("label in ('Region', 'Nation')"), A.edges(s, d, ("CONTAINS",)))
    return nodes.select("qualified_name", "label", *[F.round(c, 4).alias(c) for c in "xyz"])


@query(
    f"""{_LAYOUT_NODES}, p AS (SELECT * FROM edges WHERE edge_type = 'CONTAINS' AND dst LIKE 'nation::%' ORDER BY src, dst, edge_type LIMIT 400)
    SELECT src, dst, edge_type FROM p WHERE src IN (SELECT qualified_name FROM first) AND dst IN (SELECT qualified_name FROM first) ORDER BY ALL LIMIT 200""",
    S,
    E,
)
def graph_layout_edges(s, d):
    return graph.layout(A.symbols(s, d).where("label in ('Region', 'Nation')"), A.edges(s, d, ("CONTAINS",)).where("dst like 'nation::%'"))[1]


_FOLDERS = "dirs AS (SELECT DISTINCT p FROM (SELECT unnest([string_split(path, '/')[1], array_to_string(string_split(path, '/')[1:2], '/'), path]) AS p FROM files))"


@query(
    f"""{_FOLDERS} SELECT 'demo::Project::demo' AS qualified_name, 'demo' AS name, 'Project' AS label
    UNION ALL SELECT path || '::File::' || path, path, 'File' FROM files UNION ALL SELECT p || '::Folder::' || p, p, 'Folder' FROM dirs""",
    FILES,
)
def structure_nodes(s, d):
    return graph.structure("demo", A.files(s, d), A.symbols(s, d))[0]


@query(
    f"""{_FOLDERS} SELECT 'demo::Project::demo' AS src, path || '::File::' || path AS dst FROM files UNION ALL SELECT 'demo::Project::demo', p || '::Folder::' || p FROM dirs
    UNION ALL SELECT path || '::File::' || path, 'doc::' || doc_id FROM (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents)""",
    FILES,
)
def structure_edges(s, d):
    docs = A.table(s, d, "documents").select(F.concat(F.lit("doc::"), "doc_id").alias("qualified_name"), F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("file_path"))
    return graph.structure("demo", A.files(s, d), docs)[1]


@query("SELECT DISTINCT caller AS src, callee AS dst, 'RUNTIME_TRACE' AS edge_type FROM traces WHERE callee IS NOT NULL", TRACES)
def runtime_trace_edges(s, d):
    return graph.runtime_edges(A.traces(s, d).select("caller", "callee"))


# --- references --------------------------------------------------------------------------------------------------------


_QN = "path || '::' || label || '::' || name || '@L' || line_start"


@query(f"SELECT {_QN} AS qualified_name, name, label, path AS file_path, line_start, line_end, signature FROM symbols", C.BASE_SQL, C.SYMBOLS_SQL)
def extract_symbols(s, d):
    return extract.extract(C.files(s, d), "symbols")


@query("SELECT DISTINCT path AS file_path, specifier, kind FROM imports", C.BASE_SQL, C.IMPORTS_SQL)
def import_specs(s, d):
    return extract.extract(C.files(s, d), "imports")


@query("SELECT path AS file_path, callee, line FROM calls", C.BASE_SQL, C.CALLS_SQL)
def call_sites(s, d):
    return extract.extract(C.files(s, d), "calls")


@query("SELECT path AS file_path, route, framework, line FROM routes", C.BASE_SQL, C.ROUTES_SQL)
def route_sites(s, d):
    return extract.extract(C.files(s, d), "routes")


@query("SELECT path AS file_path, url, client, line FROM clients", C.BASE_SQL, C.CLIENTS_SQL)
def client_sites(s, d):
    return extract.extract(C.files(s, d), "clients")


@query("SELECT path AS file_path, name, base, edge_type FROM bases", C.BASE_SQL, C.BASES_SQL)
def inherits(s, d):
    return extract.extract(C.files(s, d), "bases")


@query("SELECT path AS file_path, decorator, line FROM decorators", C.BASE_SQL, C.DECORATORS_SQL)
def decorator_sites(s, d):
    return extract.extract(C.files(s, d), "decorators")


@query(
    """SELECT i.path AS file_path, specifier, kind, coalesce(b.path || '::File::' || b.path, specifier || '::Module::' || specifier) AS dst, CASE WHEN b.path IS NULL THEN 'external' ELSE 'path' END AS method, b.path
    FROM imports i LEFT JOIN base b ON b.path = i.meant AND b.path <> i.path""",
    C.BASE_SQL,
    C.IMPORTS_SQL,
)
def resolve_imports(s, d):
    files = C.files(s, d)
    return passes.resolve_imports(extract.extract(files, "imports"), files, passes.path_aliases(files))


def _edges_of(s: SparkSession, d: str, run) -> DataFrame:
    files = C.files(s, d)
    found, symbols = passes.read_files(files)
    return run("demo", files, found, symbols, symbols.limit(0), EngineConfig()).select("src", "dst", "edge_type")


# Only do_* is defined where it is called, once in each file.
@query(
    """SELECT c.path || '::Function::' || c.name || '@L' || c.line AS src, s.path || '::Function::' || s.name || '@L' || s.line_start AS dst, 'CALLS' AS edge_type
    FROM caller c JOIN symbols s ON s.path = c.path AND s.name = 'do_' || c.w""",
    C.BASE_SQL,
    C.CALLER_SQL,
    C.SYMBOLS_SQL,
)
def call_edges(s, d):
    return _edges_of(s, d, passes.call_pass)


@query("SELECT r.path || '::Route::' || route || '@L' || r.line AS route, r.route AS path, h.path || '::Function::' || name || '@L' || h.line AS start FROM routes r JOIN handler h ON h.path = r.path", C.BASE_SQL, C.ROUTES_SQL, C.HANDLER_SQL)
def http_routes(s, d):
    found, symbols = passes.read_files(C.files(s, d))
    return passes.handlers(extract.of_kind(found, "routes"), symbols.where("label = 'Function'"))


@query("SELECT a.path || '::Function::' || name || '@L' || a.line AS span, regexp_replace(url, '^http://h', '') AS path FROM clients c JOIN asker a ON a.path = c.path", C.BASE_SQL, C.CLIENTS_SQL, C.ASKER_SQL)
def http_client_calls(s, d):
    found, symbols = passes.read_files(C.files(s, d))
    return passes.client_calls(extract.of_kind(found, "clients"), symbols.where("label = 'Function'"))


# A client's path fits the templates that begin with its kind and word; the last of them by name is meant.
@query(
    """t AS (SELECT split_part(route, '/', 2) AS kind, w, max(path || '::Route::' || route || '@L' || line) AS node FROM routes WHERE route LIKE '%{id}' GROUP BY ALL),
    h AS (SELECT h.path || '::Function::' || name || '@L' || h.line AS src, r.path || '::Route::' || route || '@L' || r.line AS dst FROM routes r JOIN handler h ON h.path = r.path),
    c AS (SELECT DISTINCT a.path || '::Function::' || name || '@L' || a.line AS src, node AS dst FROM clients c JOIN asker a ON a.path = c.path JOIN t ON t.w = c.w AND t.kind = split_part(regexp_replace(url, '^http://h', ''), '/', 2))
    SELECT src, dst, 'HTTP_ROUTE' AS edge_type FROM h UNION ALL SELECT src, dst, 'HTTP_CALLS' FROM c""",
    C.BASE_SQL,
    C.ROUTES_SQL,
    C.HANDLER_SQL,
    C.CLIENTS_SQL,
    C.ASKER_SQL,
)
def http_edges(s, d):
    return _edges_of(s, d, passes.route_pass)


@query("SELECT h.path || '::Function::' || name || '@L' || h.line AS src, d.path || '::Decorator::' || decorator || '@L' || d.line AS dst FROM decorators d JOIN handler h ON h.path = d.path", C.BASE_SQL, C.DECORATORS_SQL, C.HANDLER_SQL)
def decorates(s, d):
    found, symbols = passes.read_files(C.files(s, d))
    return passes.decorated(extract.of_kind(found, "decorators"), symbols)


# No base is defined anywhere, so a stand-in is made in the file; every definition of the class inherits.
@query(
    """SELECT s.path || '::Class::' || s.name || '@L' || line_start AS src, b.path || '::Class::' || base || '@L0' AS dst, edge_type FROM bases b JOIN symbols s ON s.path = b.path AND s.name = b.name AND label = 'Class'
    UNION ALL SELECT h.path || '::Function::' || h.name || '@L' || h.line, d.path || '::Decorator::' || decorator || '@L' || d.line, 'DECORATES' FROM decorators d JOIN handler h ON h.path = d.path""",
    C.BASE_SQL,
    C.BASES_SQL,
    C.SYMBOLS_SQL,
    C.DECORATORS_SQL,
    C.HANDLER_SQL,
)
def inheritance_edges(s, d):
    return _edges_of(s, d, passes.inheritance_pass)


@query("p AS (SELECT doc_id, text, strpos(text, ' the ') AS place FROM documents), l AS (SELECT *, length(left(text, place - 1)) - length(replace(left(text, place - 1), chr(10), '')) + 1 AS n FROM p WHERE place > 0) SELECT doc_id, place, n AS line, n + CASE WHEN place > 1 AND text[place - 1] <> chr(10) THEN 1 ELSE 0 END AS compat FROM l", "one AS (SELECT 1)")
def line_of_offset(s, d):
    found = A.table(s, d, "documents").select("doc_id", "text", F.instr("text", " the ").cast("long").alias("place")).where("place > 0")
    return found.select("doc_id", "place", X.line_of(F.col("text"), F.col("place")).alias("line"), X.line_of(F.col("text"), F.col("place"), True).alias("compat"))


# A path's parts, and those that `..` steps back over: a part goes if, counted from it, as many steps back follow.
@query(
    """u AS (SELECT page_id, coalesce(split_part(url, '/', 4), '') AS a, page_id % 5 AS k FROM pages),
    r AS (SELECT page_id, a, CASE k WHEN 0 THEN './' || a || '/../' || page_id WHEN 1 THEN a || chr(92) || 'x' WHEN 2 THEN '../../' || a WHEN 3 THEN '../../../' || a || '//y/.' ELSE a || '/x/../../z' END AS spec, k FROM u)
    SELECT page_id, spec, array_to_string(list_filter([CASE WHEN k IN (0, 1, 4) THEN 'a' WHEN k = 2 THEN '' ELSE '' END, CASE WHEN k IN (0, 1, 4) THEN 'b' ELSE '' END, CASE WHEN k IN (1, 2, 3) THEN a ELSE '' END, CASE k WHEN 0 THEN page_id::VARCHAR WHEN 1 THEN 'x' WHEN 3 THEN 'y' WHEN 4 THEN 'z' ELSE '' END], lambda x: x <> ''), '/') AS path FROM r""",
    "one AS (SELECT 1)",
)
def normalize_path(s, d):
    k, a = F.col("page_id") % 5, F.coalesce(F.split_part("url", F.lit("/"), F.lit(4)), F.lit(""))
    spec = (
        F.when(k == 0, F.concat(F.lit("./"), a, F.lit("/../"), F.col("page_id").cast("string"))).when(k == 1, F.concat(a, F.lit("\\x"))).when(k == 2, F.concat(F.lit("../../"), a))
        .when(k == 3, F.concat(F.lit("../../../"), a, F.lit("//y/."))).otherwise(F.concat(a, F.lit("/x/../../z")))
    )
    return A.table(s, d, "pages").select("page_id", spec.alias("spec")).withColumn("path", X.normal_path(F.concat(F.lit("a/./b//"), "spec")))


# A call site is an order naming its customer's segment; the registry has suppliers under the same names.
_SITES = """sites AS (SELECT o_orderkey AS site, 'n' || (o_orderkey % 25) || '/f' || (o_orderkey % 7) AS file_path, 's' || (o_custkey % 60) AS callee FROM orders),
    registry AS (SELECT 'supplier::' || s_suppkey AS qualified_name, 's' || (s_suppkey % 55) AS name, 'n' || s_nationkey || '/f' || (s_suppkey % 7) AS file_path FROM supplier),
    brought AS (SELECT DISTINCT 'n' || (c_custkey % 25) || '/f' || (c_custkey % 7) AS file_path, 'n' || c_nationkey || '/f' || (c_custkey % 5) AS imported FROM customer WHERE c_custkey % 3 = 0)"""


def _call_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    at = lambda a, b: F.concat(F.lit("n"), a, F.lit("/f"), b)
    k = F.col
    sites = A.table(s, d, "orders").select(k("o_orderkey").alias("site"), at(k("o_orderkey") % 25, k("o_orderkey") % 7).alias("file_path"), F.concat(F.lit("s"), k("o_custkey") % 60).alias("callee"))
    registry = A.table(s, d, "supplier").select(F.concat(F.lit("supplier::"), "s_suppkey").alias("qualified_name"), F.concat(F.lit("s"), k("s_suppkey") % 55).alias("name"), at(k("s_nationkey"), k("s_suppkey") % 7).alias("file_path"))
    brought = A.table(s, d, "customer").where("c_custkey % 3 = 0").select(at(k("c_custkey") % 25, k("c_custkey") % 7).alias("file_path"), at(k("c_nationkey"), k("c_custkey") % 5).alias("imported")).distinct()
    return sites, registry, brought


@query(
    f"""{_SITES}, c AS (SELECT site, r.qualified_name AS target, r.file_path = s.file_path AS t1, b.imported IS NOT NULL AS t2, split_part(r.file_path, '/', 1) = split_part(s.file_path, '/', 1) AS t3, r.file_path AS home
      FROM sites s JOIN registry r ON s.callee = r.name LEFT JOIN brought b ON b.file_path = s.file_path AND b.imported = r.file_path),
    n AS (SELECT site, CASE WHEN count(*) FILTER (t1) > 0 THEN 'same_file' WHEN count(*) FILTER (t2) = 1 OR (count(*) FILTER (t2) > 1 AND count(DISTINCT home) FILTER (t2) = 1) THEN 'import_map'
      WHEN count(*) FILTER (t3) = 1 THEN 'same_directory' WHEN count(*) = 1 THEN 'unique_name' END AS strategy FROM c GROUP BY site)
    SELECT site, target, strategy FROM c JOIN n USING (site) WHERE CASE strategy WHEN 'same_file' THEN t1 WHEN 'import_map' THEN t2 WHEN 'same_directory' THEN t3 WHEN 'unique_name' THEN true ELSE false END""",
    "one AS (SELECT 1)",
)
def resolve_calls(s, d):
    return resolve.resolve_calls(*_call_tables(s, d))


@query(
    f"""{_SITES}, reg AS (SELECT *, CASE WHEN substr(qualified_name, 11)::BIGINT % 2 = 0 THEN 'Class' ELSE 'Function' END AS label FROM registry),
    c AS (SELECT site, s.file_path, callee, r.qualified_name, label, r.file_path AS home, count(r.qualified_name) OVER (PARTITION BY site) AS n FROM sites s LEFT JOIN reg r ON s.callee = r.name),
    t AS (SELECT *, CASE WHEN home = file_path THEN CASE WHEN label = 'Class' THEN 1 ELSE 2 END WHEN n = 1 THEN 3 WHEN label = 'Class' THEN 4 ELSE 9 END AS tier FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY tier, qualified_name) AS k FROM t)
    SELECT site AS ref, CASE WHEN tier = 9 THEN file_path || '::Class::' || callee || '@L0' ELSE qualified_name END AS target, CASE WHEN tier <= 2 THEN 'local' WHEN tier = 3 THEN 'unique' WHEN tier = 4 THEN 'first_class' ELSE 'synthetic' END AS strategy FROM k WHERE k = 1""",
    "one AS (SELECT 1)",
)
def resolve_parents(s, d):
    sites, registry, _ = _call_tables(s, d)
    label = F.when(F.substring("qualified_name", 11, 20).cast("long") % 2 == 0, "Class").otherwise("Function")
    return resolve.resolve_parents(sites.select(F.col("site").alias("ref"), "file_path", F.col("callee").alias("base")), registry.withColumn("label", label))


# Points are events, a user standing for a file and the minute of the day for a line; spans are made of every tenth event.
_POINTS = """points AS (SELECT event_id AS point, user_id AS file_path, (hour(ts) * 60 + minute(ts))::BIGINT AS line FROM events WHERE event_type <> 'signup'),
    spans AS (SELECT event_id AS span, user_id AS file_path, (hour(ts) * 60 + minute(ts))::BIGINT AS low, (hour(ts) * 60 + minute(ts) + 30 + event_id % 300)::BIGINT AS high FROM events WHERE event_type = 'signup')"""


def _point_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = A.table(s, d, "events")
    line = (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    points = e.where("event_type <> 'signup'").select(F.col("event_id").alias("point"), F.col("user_id").alias("file_path"), line.alias("line"))
    return points, e.where("event_type = 'signup'").select(F.col("event_id").alias("span"), F.col("user_id").alias("file_path"), line.alias("low"), (line + 30 + F.col("event_id") % 300).alias("high"))


@query(f"{_POINTS} SELECT point, span FROM points JOIN spans USING (file_path) WHERE line BETWEEN low AND high", "one AS (SELECT 1)")
def enclosing_spans(s, d):
    return resolve.enclosing(*_point_tables(s, d))


@query(f"{_POINTS} SELECT point, arg_max(span, (low, span)) AS span FROM points JOIN spans USING (file_path) WHERE line BETWEEN low AND high GROUP BY point", "one AS (SELECT 1)")
def innermost_span(s, d):
    return resolve.innermost(*_point_tables(s, d))


@query(f"{_POINTS} SELECT point, arg_min(span, (low, span)) AS start FROM points JOIN spans USING (file_path) WHERE low > line AND low <= line + 5 GROUP BY point", "one AS (SELECT 1)")
def next_start_within(s, d):
    points, spans = _point_tables(s, d)
    return resolve.next_after(points, spans.select(F.col("span").alias("start"), "file_path", "low"), 5)


@query(f"{_POINTS} SELECT point, arg_min(span, (low, span)) AS start FROM points JOIN spans USING (file_path) WHERE low >= line + 1 GROUP BY point", "one AS (SELECT 1)")
def next_start(s, d):
    points, spans = _point_tables(s, d)
    return resolve.next_after(points, spans.select(F.col("span").alias("start"), "file_path", "low"))


_URL = "CASE WHEN contains(b, '/') THEN b WHEN contains(url, '://') THEN '/' END"
_KEY = "CASE WHEN length(l) > 1 AND l LIKE '%/' THEN left(l, length(l) - 1) ELSE l END"


@query(
    f"""u AS (SELECT page_id, url, split_part(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '?', 1) AS b FROM pages), p AS (SELECT page_id, {_URL} AS path FROM u),
    l AS (SELECT page_id, path, CASE WHEN path LIKE '/%' THEN path ELSE '/' || path END AS l FROM p) SELECT page_id, path, {_KEY} AS route_key FROM l""",
    "one AS (SELECT 1)",
)
def normalize_urls(s, d):
    path = X.url_path(F.col("url"))
    return A.table(s, d, "pages").select("page_id", path.alias("path"), X.route_key(path).alias("route_key"))


# Calls from the URLs of all pages, routes of five shapes from all parts: exact, with holes of each kind (some of them last), and
# some that only end alike, with last segments that do and don't count.
_LINK = """u AS (SELECT page_id AS call, '/' || split_part(url, '/', 4) || CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '/v1/' ELSE '/a/b.c/' END || (page_id % 40) || CASE page_id % 5 WHEN 0 THEN '.json' ELSE '' END AS p FROM pages),
    r AS (SELECT p_partkey AS route, p_partkey AS position, CASE p_partkey % 7 WHEN 0 THEN '/en/' || (p_partkey % 40) WHEN 1 THEN '/fr/{id}' WHEN 2 THEN '/:lang/' || (p_partkey % 40) WHEN 3 THEN '/x/y/' || (p_partkey % 40)
      WHEN 4 THEN '/<lang>/v1/{id}' WHEN 5 THEN '/b.c/' || (p_partkey % 40) || '.json' ELSE '/orders' || p_partkey || '/{id}' END AS t FROM part),
    us AS (SELECT call, p, string_split(p, '/')[2:] AS s FROM u),
    rs AS (SELECT *, string_split(t, '/')[2:] AS s FROM r)"""


@query(
    f"""{_LINK}, c AS (SELECT call, route, 1 AS tier, position AS pos FROM us JOIN rs ON p = t
      UNION ALL SELECT call, route, 2, -position FROM us JOIN rs ON len(us.s) = len(rs.s) AND list_bool_and(list_transform(range(1, len(rs.s) + 1), lambda k: rs.s[k] = us.s[k] OR rs.s[k][1] IN (':', '<') OR (rs.s[k][1] = '{{' AND rs.s[k][-1] = '}}')))
      UNION ALL SELECT call, route, 3, position FROM us JOIN rs ON suffix(t, p) OR suffix(p, t) OR (us.s[-1] = rs.s[-1] AND regexp_full_match(us.s[-1], '[A-Za-z0-9_-]+')))
    SELECT call, arg_min(route, (tier, pos, route)) AS route, ['exact', 'template', 'suffix'][min(tier)] AS confidence FROM c GROUP BY call""",
    "one AS (SELECT 1)",
)
def link_routes(s, d):
    k = F.col("page_id")
    path = F.concat(F.lit("/"), F.split_part("url", F.lit("/"), F.lit(4)), F.when(k % 3 == 0, "/").when(k % 3 == 1, "/v1/").otherwise("/a/b.c/"), k % 40, F.when(k % 5 == 0, ".json").otherwise(""))
    i = F.col("p_partkey")
    end = (i % 40).cast("string")
    shapes = [F.concat(F.lit("/en/"), end), F.lit("/fr/{id}"), F.concat(F.lit("/:lang/"), end), F.concat(F.lit("/x/y/"), end), F.lit("/<lang>/v1/{id}"), F.concat(F.lit("/b.c/"), end, F.lit(".json")), F.concat(F.lit("/orders"), i, F.lit("/{id}"))]
    routes = A.table(s, d, "part").select(i.alias("route"), F.get(F.array(*shapes), (i % 7).cast("int")).alias("template"), i.alias("position"))
    return resolve.link_routes(A.table(s, d, "pages").select(k.alias("call"), path.alias("path")), routes)


@query("SELECT path, line_count FROM files WHERE path NOT LIKE 'src1/%' AND path NOT LIKE 'src2/%' UNION ALL SELECT path, line_count + 1 FROM files WHERE path LIKE 'src1/%'", FILES)
def incremental_merge(s, d):
    f = A.files(s, d).select("path", "line_count")
    changed = f.where(F.col("path").like("src1/%")).withColumn("line_count", F.col("line_count") + 1)
    return resolve.merge_changes(f, changed, "path", f.where(F.col("path").like("src2/%")))


# --- text --------------------------------------------------------------------------------------------------------------

_FOLD = "' ' || trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
_HIT = """h AS (SELECT path, string_split(content, chr(10)) AS ls FROM found), k AS (SELECT path, ls, coalesce(nullif(coalesce(list_position(list_transform(ls, lambda x: contains(x, '{p}')), true), 0), 0),
      nullif(coalesce(list_position(list_transform(ls, lambda x: contains(lower(x), lower('{p}'))), true), 0), 0), 1) AS n FROM h) SELECT path, n::BIGINT AS line_number, left(ls[n], 200) AS preview FROM k"""
_PHRASE = f"found AS (SELECT * FROM files WHERE contains({_FOLD.format('content')}, ' of the ') OR contains({_FOLD.format('path')}, ' of the ')), " + _HIT.format(p="of the")


@query(_PHRASE, FILES)
def fts_phrase(s, d):
    return text.phrase_search(A.files(s, d), "of the", None)


@query(_PHRASE.partition(", h AS")[0] + " SELECT path FROM found", FILES)
def indexed_phrase(s, d):
    return text.indexed_phrase(graph.kept(text.postings(A.files(s, d)))[0], "of the")


# Best by bm25, from postings and bounds of blocks.
_BM25 = r"""w AS (SELECT path, list_filter(string_split(trim(regexp_replace(lower(path), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') || list_filter(string_split(trim(regexp_replace(lower(content), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM files),
    n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
    t AS (SELECT path, len(ws) AS length, q, len(list_filter(ws, lambda x: x = q)) AS tf FROM w, (SELECT unnest(['the', 'thand', 'wherees']) AS q)),
    i AS (SELECT q, greatest(1e-6, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5))) AS weight FROM t, n WHERE tf > 0 GROUP BY q)
    SELECT path, round(sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 8) AS score FROM t JOIN i USING (q), n WHERE tf > 0 GROUP BY path ORDER BY sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) DESC, path LIMIT 50"""


@query(_BM25.replace("\\\\", "\\"), FILES)
def ranked_search(s, d):
    index, _ = graph.kept(text.postings(A.files(s, d)))
    return text.ranked(index, text.word_blocks(index), "the thand wherees", 50).withColumn("score", F.round("score", 8))


@query(_PHRASE.partition(", h AS")[0].replace("found AS", "a AS") + f", b AS (SELECT path FROM files WHERE regexp_matches({_FOLD.format('content')}, ' thand[^ ]* ') OR regexp_matches({_FOLD.format('path')}, ' thand[^ ]* ')) SELECT path, line_count FROM files WHERE path IN (SELECT path FROM a) AND path NOT IN (SELECT path FROM b)", FILES)
def sql_match(s, d):
    files = A.files(s, d)
    return sqlgate.query(s, """SELECT path, line_count FROM files_fts WHERE files_fts MATCH '"of the" NOT thand*'""", {"files_fts": files}, graph.kept(text.postings(files))[0])


@query("found AS (SELECT * FROM files WHERE len(list_filter(string_split(content, chr(10)), lambda x: contains(x, 'thand'))) > 0), " + _HIT.format(p="thand"), FILES)
def scan_substring(s, d):
    return text.scan_search(A.files(s, d), "thand", None)


@query("found AS (SELECT * FROM files WHERE len(list_filter(string_split(content, chr(10)), lambda x: contains(x, 'hstth'))) > 0 ORDER BY path LIMIT 20), " + _HIT.format(p="hstth"), FILES)
def search_code(s, d):
    return text.search_code(A.files(s, d), "hstth")


_LINES = "string_split(regexp_replace(text, '\\n$', ''), chr(10))"


@query(f"l AS (SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE {_LINES} END AS ls FROM documents) SELECT doc_id, CASE WHEN least(4, len(ls)) >= 2 THEN array_to_string(ls[2:4], chr(10)) ELSE text END AS snippet FROM l", "one AS (SELECT 1)")
def snippet(s, d):
    return A.table(s, d, "documents").select("doc_id", text.snippet(F.col("text"), F.lit(2).cast("long"), F.lit(4).cast("long")).alias("snippet"))


_CHUNKS = "c AS (SELECT path, o AS \"offset\", len(ls[o + 1:o + 20])::BIGINT AS line_count, array_to_string(ls[o + 1:o + 20], chr(10)) AS content FROM (SELECT path, ls, unnest(range(0, len(ls), 20)) AS o FROM (SELECT path, string_split(content, chr(10)) AS ls FROM files WHERE content <> '')))"


@query(f"{_CHUNKS} SELECT path, \"offset\"::BIGINT AS \"offset\", line_count, content FROM c", FILES)
def chunk_documents(s, d):
    return text.chunks(A.files(s, d), 20)


@query(f"{_CHUNKS} SELECT path, \"offset\"::BIGINT AS \"offset\", line_count, content FROM c ORDER BY path, \"offset\" LIMIT 3 OFFSET 6", FILES)
def chunk_page(s, d):
    return chunk_documents(s, d).orderBy("path", "offset").offset(6).limit(3)


@query(f"{_CHUNKS} SELECT path, \"offset\"::BIGINT AS \"offset\", line_count, content FROM c WHERE contains(content, 'worthless') OR contains(path, 'worthless') ORDER BY path, \"offset\" LIMIT 20", FILES)
def chunk_peek(s, d):
    return text.peek(chunk_documents(s, d), "worthless")


@query(
    """z AS (SELECT path, CASE WHEN octet_length(encode(content)) > 5000 THEN 'file_too_large' WHEN octet_length(encode(content)) > 3000 THEN 'non_code_large' END AS own, octet_length(encode(content)) AS size FROM files),
    b AS (SELECT path, own, coalesce(sum(CASE WHEN own IS NULL THEN size ELSE 0 END) OVER (ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z)
    SELECT CASE WHEN before >= 300000 THEN 'budget_exhausted' ELSE coalesce(own, 'read') END AS reason, count(*)::BIGINT AS n FROM b GROUP BY 1""",
    FILES,
)
def skip_reasons(s, d):
    return text.scan_reasons(A.files(s, d), total=300_000, file=5_000, other=3_000).groupBy(F.coalesce("reason", F.lit("read")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("e AS (SELECT event_id AS session, ts AS created_at FROM events), m AS (SELECT max(created_at) AS now FROM e) SELECT session FROM e, m WHERE epoch(created_at)::BIGINT >= epoch(now)::BIGINT - 864000 ORDER BY created_at DESC, session LIMIT 50", "one AS (SELECT 1)")
def session_retention(s, d):
    e = A.table(s, d, "events").select(F.col("event_id").alias("session"), F.col("ts").alias("created_at"))
    now = e.agg(F.max("created_at").alias("now"))
    return text.retained(e.join(F.broadcast(now)), F.col("now"), ttl_seconds=864_000).select("session")


@query(
    """SELECT s.path || '::' || label || '::' || s.name || '@L' || line_start AS qualified_name, s.name, label, s.path AS file_path, array_to_string((string_split(content, chr(10)))[line_start:line_end], chr(10)) AS snippet,
      (CASE WHEN c.name IS NULL THEN 0 ELSE 1 END)::BIGINT AS calls FROM symbols s JOIN code USING (path) LEFT JOIN caller c ON c.path = s.path AND c.name = s.name AND c.line = s.line_start""",
    C.BASE_SQL,
    C.SYMBOLS_SQL,
    C.content_sql(),
    C.CALLER_SQL,
)
def read_symbol(s, d):
    files = C.files(s, d)
    found, symbols = passes.read_files(files)
    edges = passes.call_pass("demo", files, found, symbols, symbols.limit(0), EngineConfig())
    return text.read_symbol(symbols, files, edges, symbols.select("qualified_name"))


# --- similarity --------------------------------------------------------------------------------------------------------


def _bags(s: SparkSession, d: str) -> DataFrame:
    return similarity.token_bags(A.table(s, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, token, n FROM bags", BAGS)
def tokenize_counts(s, d):
    return similarity.token_rows(A.table(s, d, "documents"), "doc_id", "text")


_IDF = "i AS (SELECT token, count(*)::BIGINT AS df, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM bags GROUP BY token)"
_TFIDF = f"{_IDF}, t AS (SELECT doc_id, sum(n) AS total FROM bags GROUP BY doc_id), w AS (SELECT doc_id, token, n::DOUBLE / total * idf AS w FROM bags JOIN i USING (token) JOIN t USING (doc_id))"


def _weights(s: SparkSession, d: str) -> DataFrame:
    bags, _ = graph.kept(_bags(s, d))  # the texts are split once
    known, _ = graph.kept(similarity.idf(bags, A.table(s, d, "documents").count()))
    return similarity.tfidf(bags, "doc_id", known)


@query(f"{_IDF} SELECT token, df, round(idf, 6) AS idf FROM i", BAGS)
def idf(s, d):
    return similarity.idf(_bags(s, d), A.table(s, d, "documents").count()).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"{_TFIDF}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, token) AS k FROM w) SELECT doc_id, token, round(w, 6) AS w FROM r WHERE k <= 3", BAGS)
def tfidf_top(s, d):
    order = W.partitionBy("doc_id").orderBy(F.desc(F.round("w", 9)), "token")
    return _weights(s, d).withColumn("k", F.row_number().over(order)).where("k <= 3").select("doc_id", "token", F.round("w", 6).alias("w"))


def _beside(df: DataFrame, value: str) -> DataFrame:
    """Each document's value beside that of the next document."""
    x, y = df.select(F.col("doc_id").alias("a"), F.col(value).alias("u")), df.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col(value).alias("v"))
    return x.join(y, "a")


@query(
    f"""{_TFIDF}, n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id), x AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.w * y.w) AS dot FROM w x JOIN w y ON y.doc_id = x.doc_id + 1 AND y.token = x.token GROUP BY ALL)
    SELECT a, b, round(dot / (p.norm * q.norm), 4) AS cosine FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b""",
    BAGS,
)
def tfidf_cosine(s, d):
    w, _ = graph.kept(_weights(s, d))
    norm = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    x, y = w.select(F.col("doc_id").alias("a"), "token", F.col("w").alias("u")), w.select((F.col("doc_id") - 1).alias("a"), "token", F.col("w").alias("v"))
    # Dealt by document alone, so that the sums of a pair need no shuffle of their own.
    dot = x.repartition("a").join(y.repartition("a"), ["a", "token"]).groupBy("a").agg(F.sum(F.col("u") * F.col("v")).alias("dot"))
    p, q = norm.select(F.col("doc_id").alias("a"), F.col("norm").alias("m")), norm.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("norm").alias("n"))
    return dot.join(p, "a").join(q, "a").select("a", "b", F.round(F.col("dot") / (F.col("m") * F.col("n")), 4).alias("cosine"))


def _fnv_sql(value: str, basis: str = "14695981039346656037") -> str:
    return f"list_reduce(list_prepend({basis}::HUGEINT, list_transform(range(1, length({value}) + 1), lambda i: ascii({value}[i])::HUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@query(f"w AS (SELECT DISTINCT token FROM bags) SELECT token, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS hash FROM (SELECT token, {_fnv_sql('token')} AS h FROM w)", BAGS)
def fnv_hash(s, d):
    return _bags(s, d).select("token").distinct().select("token", similarity.fnv_hash("token").alias("hash"))


def _seeded(seed: int) -> str:
    return _fnv_sql("token", str(0xCBF29CE484222325 ^ seed))


@query(
    f"""{_IDF}, h AS (SELECT token, idf, ({_seeded(0)} % 768)::INT AS p, ({_seeded(1)} % 768)::INT AS q, CASE WHEN {_seeded(2)} % 2 = 0 THEN 1 ELSE -1 END AS sign FROM i),
    v AS (SELECT doc_id, slot, sum(x) AS v FROM (SELECT doc_id, p AS slot, n * idf * sign AS x FROM bags JOIN h USING (token) UNION ALL SELECT doc_id, q, n * idf * sign * 0.5 FROM bags JOIN h USING (token)) GROUP BY ALL)
    SELECT doc_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS v FROM v""",
    BAGS,
)
def ri_vectors(s, d):
    bags, _ = graph.kept(_bags(s, d))
    known, _ = graph.kept(similarity.idf(bags, A.table(s, d, "documents").count()))
    sparse = similarity.ri_sparse(bags, "doc_id", known)
    return sparse.select("doc_id", "slot", F.round("v", 6).alias("v"))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(round(greatest(-1, least(1, x::DOUBLE)) * 127) AS INT)), ',') AS code FROM embeddings")
def quantize(s, d):
    q = X.quantize(F.col("embedding"))
    return A.table(s, d, "embeddings").select("vec_id", F.array_join(F.transform(q, lambda x: x.cast("string")), ",").alias("code"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(s, d):
    e = A.table(s, d, "embeddings")
    x, y = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return x.join(y, "a").select("a", "b", F.round(X.cosine(F.col("u"), F.col("v")), 5).alias("cosine"))


_WORDS_OF = "list_transform(regexp_extract_all({}, '[A-Za-z0-9_]{{2,}}'), lambda x: lower(x))"


@query(f"w AS (SELECT doc_id, {_WORDS_OF.format('text')} AS ws FROM documents) SELECT doc_id, shingle, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, '_')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], '_')) END) AS shingle FROM w) GROUP BY ALL", "one AS (SELECT 1)")
def shingles(s, d):
    return similarity.shingle_counts(A.table(s, d, "documents"), "doc_id", "text")


@query()
def minhash_sim(s, d):
    m = similarity.minhash(A.table(s, d, "documents"), "doc_id", "text")
    return _beside(m, "sketch").select("a", "b", similarity.sketch_similarity(F.col("u"), F.col("v")).alias("similarity"))


# Signals compare each part with the next one, a part's type and name standing for signature and name.
_NEXT = "p AS (SELECT p_partkey AS k, p_name AS name, p_type AS sig, p_brand || '/' || p_type AS path FROM part), n AS (SELECT a.k AS a, b.k AS b, a.name AS na, b.name AS nb, a.sig AS sa, b.sig AS sb, a.path AS pa, b.path AS pb FROM p a JOIN p b ON b.k = a.k + 1)"


def _next(s: SparkSession, d: str) -> DataFrame:
    p = A.table(s, d, "part").select("p_partkey", F.col("p_name").alias("n"), F.col("p_type").alias("s"), F.concat("p_brand", F.lit("/"), "p_type").alias("p"))
    x, y = p.select(F.col("p_partkey").alias("a"), *[F.col(c).alias(f"{c}a") for c in "nsp"]), p.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), *[F.col(c).alias(f"{c}b") for c in "nsp"])
    return x.join(y, "a")


_A, _B = _WORDS_OF.format("na || ' ' || sa"), _WORDS_OF.format("nb || ' ' || sb")


@query(
    f"""{_NEXT}, t AS (SELECT a, b, {_A} AS x, {_B} AS y FROM n), u AS (SELECT *, list_distinct(x) AS dx, list_distinct(y) AS dy FROM t)
    SELECT a, b, round(least(1, coalesce(list_sum(list_transform(list_filter(dx, lambda w: list_contains(dy, w)), lambda w: len(list_filter(x, lambda v: v = w))::DOUBLE / len(x))), 0)
      / greatest(sqrt(list_sum(list_transform(dx, lambda w: pow(len(list_filter(x, lambda v: v = w))::DOUBLE / len(x), 2)))), sqrt(len(dy)::DOUBLE))), 6) AS similarity FROM u""",
    "one AS (SELECT 1)",
)
def api_similarity(s, d):
    x, y = (similarity.api_tokens(F.concat_ws(" ", f"n{c}", f"s{c}")) for c in "ab")
    return _next(s, d).select("a", "b", F.round(similarity.api_similarity(x, y), 6).alias("similarity"))


@query(f"{_NEXT}, s AS (SELECT a, b, pa, pb, string_split(pa, '/') AS x, string_split(pb, '/') AS y FROM n) SELECT a, b, CASE WHEN pa = pb THEN 1.0 WHEN x[1] = y[1] THEN 0.5 ELSE 0.0 END::DOUBLE AS proximity FROM s", "one AS (SELECT 1)")
def path_proximity(s, d):
    return _next(s, d).select("a", "b", X.path_proximity(F.col("pa"), F.col("pb")).alias("proximity"))


_VOLUME = "(length({0}) - length(regexp_replace({0}, '[(){{}}\\[\\];,:<>]', '', 'g')) + len(regexp_extract_all({0}, '[A-Za-z0-9_]{{2,}}')))::DOUBLE"


@query(f"v AS (SELECT x.doc_id AS a, y.doc_id AS b, {_VOLUME.format('x.text')} AS p, {_VOLUME.format('y.text')} AS q FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1) SELECT a, b, round(CASE WHEN p = 0 AND q = 0 THEN 0 ELSE 1 - abs(p - q) / greatest(p, q) END, 6) AS similarity FROM v", "one AS (SELECT 1)")
def halstead(s, d):
    t, _ = graph.kept(A.table(s, d, "documents").select("doc_id", similarity.volume(F.col("text")).alias("volume")))  # a number for each text
    return _beside(t, "volume").select("a", "b", F.round(similarity.volumes_alike(F.col("u"), F.col("v")), 6).alias("similarity"))


@query(f"{_NEXT}, t AS (SELECT a, b, list_distinct(list_filter({_A}, lambda w: length(w) >= 3)) AS x, list_distinct(list_filter({_B}, lambda w: length(w) >= 3)) AS y FROM n) SELECT a, b, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS similarity FROM t", "one AS (SELECT 1)")
def jaccard_tokens(s, d):
    x, y = (F.array_distinct(similarity.identifier_tokens(F.col(f"s{c}"), F.col(f"n{c}"))) for c in "ab")
    return _next(s, d).select("a", "b", F.round(X.jaccard(x, y), 6).alias("similarity"))


_KEYS = ", ".join(f"'{w}'" for w in P.KEYWORDS)


@query(f"w AS (SELECT doc_id, {_WORDS_OF.format('text')} AS ws FROM documents), c AS (SELECT doc_id, len(ws) AS n, len(list_filter(ws, lambda x: x IN ({_KEYS}))) AS keywords, len(list_filter(ws, lambda x: regexp_full_match(x, '[0-9]+'))) AS numbers FROM w) SELECT doc_id, keywords::DOUBLE AS keywords, (n - keywords - numbers)::DOUBLE AS identifiers, numbers::DOUBLE AS numbers FROM c", "one AS (SELECT 1)")
def token_histogram(s, d):
    h = similarity.histogram(F.col("text"), F.lit(""))
    return A.table(s, d, "documents").select("doc_id", h.alias("h")).select("doc_id", F.col("h")[0].alias("keywords"), F.col("h")[1].alias("identifiers"), F.col("h")[3].alias("numbers"))


@query(
    """c AS (SELECT DISTINCT o_custkey AS k, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey), z AS (SELECT k, count(*) AS n FROM c GROUP BY k),
    x AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM c a JOIN c b ON a.p = b.p AND b.k = a.k + 1 GROUP BY ALL)
    SELECT a, b, round(shared::DOUBLE / (m.n + n.n - shared), 6) AS similarity FROM x JOIN z m ON m.k = a JOIN z n ON n.k = b""",
    "one AS (SELECT 1)",
)
def neighbor_jaccard(s, d):
    c = A.table(s, d, "orders").join(A.table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("l_partkey").alias("near"))
    x, y = c.select(F.col("k").alias("a"), F.col("near").alias("u")), c.select((F.col("k") - 1).alias("a"), F.col("k").alias("b"), F.col("near").alias("v"))
    value = X.jaccard(F.col("u"), F.col("v"))
    return x.join(y, "a").select("a", "b", F.round(value, 6).alias("similarity")).where("similarity > 0")


@query(f"{_NEXT}, t AS (SELECT a, b, pa, pb, list_distinct({_A}) AS x, list_distinct({_B}) AS y FROM n) SELECT a, b, round(0.08 * CASE WHEN pa = pb THEN 1.0 WHEN split_part(pa, '/', 1) = split_part(pb, '/', 1) THEN 0.5 ELSE 0 END + 0.08 * len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS score FROM t", "one AS (SELECT 1)")
def combined_score(s, d):
    x, y = (F.array_distinct(X.tokens(F.concat_ws(" ", f"n{c}", f"s{c}"))) for c in "ab")
    score = similarity.combined({"module": X.path_proximity(F.col("pa"), F.col("pb")), "flow": X.jaccard(x, y)})
    return _next(s, d).select("a", "b", F.round(score, 6).alias("score"))


def _compared(s: SparkSession, d: str) -> DataFrame:
    """Functions and classes of the code made from the documents, with what all eleven signals of their pairs are made of."""
    files = C.files(s, d)
    found, symbols = passes.read_files(files)
    edges = passes.call_pass("demo", files, found, symbols, symbols.limit(0), EngineConfig())
    return graph.cut(similarity.prepared(symbols.where("label in ('Function', 'Class')"), edges))


@query()
def pair_scores(s, d):
    return similarity.pair_scores(_compared(s, d)).select("a", "b", F.round("score", 6).alias("score"))


@query()
def greedy_topk_edges(s, d):
    return similarity.greedy_scores(_compared(s, d), digits=6)


@query()
def vector_search(s, d):
    """Symbols of the code made from the documents, stored as vectors, asked for by a text."""
    symbols = graph.cut(extract.extract(C.files(s, d), "symbols"))
    asked = s.createDataFrame([("class run java",)], "text string")
    return similarity.vector_search(similarity.symbol_vectors(symbols), symbols, asked, 20).select("qualified_name", F.round("score", 5).alias("score"))


@query("q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 5) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id LIMIT 20", "one AS (SELECT 1)")
def vector_topk(s, d):
    e = A.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return similarity.vector_topk(e, e.where("id = 7").select(F.col("v").alias("q"))).select("id", F.round("score", 5).alias("score"))


# --- aggregates --------------------------------------------------------------------------------------------------------


@query("SELECT 'symbols' AS name, count(*)::BIGINT AS n FROM symbols UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'files', count(*) FROM files UNION ALL SELECT 'vectors', count(*) FROM embeddings", S, E, FILES)
def table_counts(s, d):
    parts = {"symbols": A.symbols(s, d), "edges": A.edges(s, d), "files": A.files(s, d), "vectors": A.table(s, d, "embeddings")}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT label, count(*)::BIGINT AS n FROM symbols GROUP BY label", S)
def label_counts(s, d):
    return A.symbols(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


@query("SELECT edge_type, count(*)::BIGINT AS n FROM edges GROUP BY edge_type", E)
def edge_type_counts(s, d):
    return A.edges(s, d).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "edge_type")


@query("SELECT DISTINCT edge_type FROM edges", E)
def graph_schema(s, d):
    return A.edges(s, d).select("edge_type").distinct().orderBy("edge_type")


@query(
    """SELECT 'label' AS part, label AS name, count(*)::BIGINT AS n FROM symbols GROUP BY label UNION ALL SELECT 'edge_type', edge_type, count(*) FROM edges GROUP BY edge_type
    UNION ALL SELECT 'first', qualified_name, 1 FROM (SELECT qualified_name FROM symbols WHERE label = 'Part' ORDER BY qualified_name LIMIT 10)""",
    S,
    E,
)
def architecture(s, d):
    first = A.symbols(s, d).where("label = 'Part'").orderBy("qualified_name").limit(10)
    return (
        label_counts(s, d).select(F.lit("label").alias("part"), F.col("label").alias("name"), "n")
        .unionByName(edge_type_counts(s, d).select(F.lit("edge_type").alias("part"), F.col("edge_type").alias("name"), "n"))
        .unionByName(first.select(F.lit("first").alias("part"), F.col("qualified_name").alias("name"), F.lit(1).cast("long").alias("n")))
    )


@query("SELECT (SELECT count(*) FROM symbols)::BIGINT AS symbols, (SELECT count(*) FROM edges)::BIGINT AS edges, (SELECT count(*) FROM files)::BIGINT AS files, (SELECT count(*) FROM symbols) > 0 AS indexed", S, E, FILES)
def index_status(s, d):
    n = table_counts(s, d).groupBy(F.lit(1).alias("one")).pivot("name", ["symbols", "edges", "files"]).agg(F.sum("n"))
    return n.select("symbols", "edges", "files", (F.col("symbols") > 0).alias("indexed"))


@query("n AS (SELECT count(DISTINCT user_id)::BIGINT AS total, (count(DISTINCT user_id) FILTER (user_id IN (SELECT doc_id FROM documents)))::BIGINT AS covered FROM events) SELECT total, covered, round(100.0 * covered / total)::BIGINT AS percent FROM n", "one AS (SELECT 1)")
def index_coverage(s, d):
    return text.coverage(A.files(s, d), A.table(s, d, "events").select(F.concat(F.lit("/"), "user_id", F.lit(".txt")).alias("path")))


@query("SELECT name, count(*)::BIGINT AS n, string_agg(qualified_name, ',' ORDER BY qualified_name) AS names FROM symbols WHERE label = 'Part' GROUP BY name", S)
def name_registry(s, d):
    parts = A.symbols(s, d).where("label = 'Part'")
    return parts.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("qualified_name")), ",").alias("names"))


@query("SELECT src, dst, min(n)::BIGINT AS first FROM (SELECT 'c' || user_id AS src, event_type AS dst, event_id AS n FROM events) GROUP BY ALL")
def edge_insert_ignore(s, d):
    e = A.table(s, d, "events").select(F.concat(F.lit("c"), "user_id").alias("src"), F.col("event_type").alias("dst"), F.col("event_id").alias("first"))
    return graph.first_by(e, ["src", "dst"], ["first"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS last FROM events GROUP BY user_id")
def symbol_upsert(s, d):
    e = A.table(s, d, "events").select("user_id", "event_type", F.col("event_id").alias("last"))
    return graph.first_by(e, ["user_id"], [F.desc("last")])


@query(
    """gone AS (SELECT qualified_name FROM symbols WHERE file_path LIKE 'r1/%') SELECT 'edges' AS name, count(*)::BIGINT AS n FROM edges WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone)
    UNION ALL SELECT 'symbols', count(*) FROM symbols WHERE file_path NOT LIKE 'r1/%' UNION ALL SELECT 'vectors', count(*) FROM symbols WHERE file_path NOT LIKE 'r1/%' UNION ALL SELECT 'files', count(DISTINCT file_path) FROM symbols WHERE file_path NOT LIKE 'r1/%'""",
    S,
    E,
)
def delete_by_file(s, d):
    symbols = A.symbols(s, d)
    files = symbols.select(F.col("file_path").alias("path")).distinct()
    kept = text.delete_files(symbols, A.edges(s, d), files, symbols.select("qualified_name"), files.where(F.col("path").like("r1/%")))
    out = None
    for name, df in kept.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 3 = 0 THEN '??' ELSE 'M' END AS status, false AS deleted FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0")
def merged_changes(s, d):
    p = A.table(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), "page_id")
    status = p.where("page_id % 3 = 0").select("path", F.lit("??").alias("status"), F.lit(False).alias("deleted"))
    return text.merged_changes(p.where("page_id % 2 = 0"), status)


# --- SQL passthrough ---------------------------------------------------------------------------------------------------

_SQL = {
    "sql_edge_type_counts": "SELECT edge_type, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY edge_type",
    "sql_join": "SELECT s.label AS label, e.edge_type AS edge_type, CAST(count(*) AS BIGINT) AS n FROM edges e JOIN symbols s ON s.qualified_name = e.dst GROUP BY s.label, e.edge_type",
    "sql_window": "SELECT qualified_name, label, k FROM (SELECT qualified_name, label, row_number() OVER (PARTITION BY label ORDER BY qualified_name DESC) AS k FROM symbols) t WHERE k <= 3",
    "sql_setops": "SELECT src AS q FROM edges WHERE edge_type = 'CALLS' INTERSECT SELECT dst FROM edges WHERE edge_type = 'CALLS' EXCEPT SELECT dst FROM edges WHERE edge_type = 'IMPORTS'",
    "sql_subquery": "SELECT qualified_name, name FROM symbols s WHERE label = 'Part' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = s.qualified_name AND e.src LIKE '%7' AND e.edge_type = 'CALLS')",
    "sql_left_join": "SELECT s.label AS label, CAST(count(e.dst) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS all_rows FROM symbols s LEFT JOIN edges e ON e.src = s.qualified_name AND e.edge_type = 'CALLS' GROUP BY s.label",
    "sql_full_join": "SELECT coalesce(a.src, b.dst) AS q, coalesce(a.n, 0) AS n, coalesce(b.m, 0) AS m FROM (SELECT src, CAST(count(*) AS BIGINT) AS n FROM edges WHERE edge_type = 'CALLS' GROUP BY src) a FULL OUTER JOIN (SELECT dst, CAST(count(*) AS BIGINT) AS m FROM edges WHERE edge_type = 'CALLS' GROUP BY dst) b ON a.src = b.dst",
    "sql_range_join": "SELECT a.qualified_name AS q, CAST(count(*) AS BIGINT) AS n FROM symbols a JOIN symbols b ON b.line_start < a.line_start AND b.line_start >= a.line_start - 3 WHERE a.label = 'Nation' AND b.label = 'Nation' GROUP BY a.qualified_name",
    "sql_predicates": "SELECT qualified_name FROM symbols WHERE (name LIKE 'order__9' OR name LIKE '%7_') AND line_start BETWEEN 5 AND 900 AND label IN ('Order', 'Part') AND NOT (signature IS NULL OR signature = 'O')",
    "sql_strings": "SELECT upper(substr(name, 1, 3)) AS head, lower(label) || '-' || CAST(length(trim(name)) AS VARCHAR(9)) AS tail, CAST(count(*) AS BIGINT) AS n FROM symbols WHERE label <> 'Order' GROUP BY upper(substr(name, 1, 3)), lower(label) || '-' || CAST(length(trim(name)) AS VARCHAR(9))",
    "sql_math": "SELECT label, round(avg(line_start), 4) AS mean, CAST(max(abs(line_start - 500)) AS BIGINT) AS far, CAST(sum(mod(line_start, 7)) AS BIGINT) AS rest, round(sqrt(CAST(max(line_end) AS DOUBLE)), 6) AS root FROM symbols GROUP BY label",
    "sql_frames": "SELECT qualified_name, CAST(sum(line_start) OVER (PARTITION BY label ORDER BY qualified_name ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS moving, lag(name) OVER (PARTITION BY label ORDER BY qualified_name) AS before, dense_rank() OVER (ORDER BY label) AS place FROM symbols",
    "sql_case": "SELECT CASE WHEN line_start < 10 THEN 'small' WHEN line_start < 1000 THEN 'middle' ELSE 'large' END AS kind, CAST(count(DISTINCT label) AS BIGINT) AS labels, CAST(sum(CASE WHEN label = 'Order' THEN 1 ELSE 0 END) AS BIGINT) AS orders FROM symbols GROUP BY CASE WHEN line_start < 10 THEN 'small' WHEN line_start < 1000 THEN 'middle' ELSE 'large' END HAVING count(*) > 1",
    "sql_cte": "SELECT * FROM (WITH big AS (SELECT src, count(*) AS n FROM edges GROUP BY src HAVING count(*) > 15) SELECT src, CAST(n AS BIGINT) AS n FROM big)",
}
# The end of edges that a statement joins to the name of a symbol.
_JOINED = {"sql_join": "dst", "sql_left_join": "src", "sql_subquery": "dst"}
for _key, _text in _SQL.items():
    query(_text, S, E, name=_key)(lambda s, d, q=_text, by=_JOINED.get(_key): sqlgate.query(s, q, {"symbols": A.symbols(s, d), "edges": A.edges(s, d, by=by)}))


@query("SELECT event_type, count(*)::BIGINT AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def sql_json(s, d):
    return sqlgate.query(s, "SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM traces GROUP BY event_type", {"traces": A.table(s, d, "events")})


@query("SELECT event_type, extract(year FROM ts)::BIGINT AS year, extract(month FROM ts)::BIGINT AS month, count(*)::BIGINT AS n, min(strftime(ts, '%Y-%m-%d')) AS first FROM events WHERE extract(hour FROM ts) < 12 GROUP BY ALL")
def sql_dates(s, d):
    asked = "SELECT event_type, CAST(extract(YEAR FROM ts) AS BIGINT) AS year, CAST(extract(MONTH FROM ts) AS BIGINT) AS month, count(*) AS n, min(date_format(ts, 'yyyy-MM-dd')) AS first FROM traces WHERE extract(HOUR FROM ts) < 12 GROUP BY event_type, extract(YEAR FROM ts), extract(MONTH FROM ts)"
    return sqlgate.query(s, asked, {"traces": A.table(s, d, "events")})


# Functions of other dialects: the statement that the gate gets, and DuckDB's.
_DIALECT = {
    "sql_group_concat": ("SELECT label, CAST(length(group_concat(name, ' | ')) AS BIGINT) AS n, CAST(length(group_concat(DISTINCT label)) AS BIGINT) AS k, total(line_start) AS t FROM symbols GROUP BY label", "SELECT label, length(string_agg(name, ' | ')) AS n, length(label) AS k, sum(line_start)::DOUBLE AS t FROM symbols GROUP BY label"),
    "sql_glob": ("SELECT qualified_name FROM symbols WHERE name GLOB '*r_*[13]?5' OR name GLOB 'part?[^0-8]'", "SELECT qualified_name FROM symbols WHERE name GLOB '*r_*[13]?5' OR regexp_full_match(name, 'part.[^0-8]')"),
    "sql_replace": ("SELECT replace(edge_type, 'CALLS', 'calls it') AS kind, count(*) AS n FROM edges GROUP BY replace(edge_type, 'CALLS', 'calls it')", "SELECT replace(edge_type, 'CALLS', 'calls it') AS kind, count(*) AS n FROM edges GROUP BY ALL"),
}
for _key, (_text, _oracle) in _DIALECT.items():
    query(_oracle, S, E, name=_key)(lambda s, d, q=_text: sqlgate.query(s, q, {"symbols": A.symbols(s, d), "edges": A.edges(s, d)}))
_DIALECT_OF_TRACES = {
    "sql_json_extract": ("SELECT json_extract(props, '$.k') AS k, count(*) AS n FROM traces GROUP BY json_extract(props, '$.k')", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL"),
    "sql_json_each": ("SELECT event_type, j.key AS key, sum(CAST(j.value AS BIGINT)) AS total FROM (SELECT event_type, '[' || event_id || ',' || user_id || ']' AS js FROM traces) e, json_each(e.js) j GROUP BY event_type, j.key", "SELECT event_type, 0 AS key, sum(event_id)::BIGINT AS total FROM events GROUP BY ALL UNION ALL SELECT event_type, 1, sum(user_id)::BIGINT FROM events GROUP BY ALL"),
    "sql_strftime": ("SELECT strftime('%Y/%m at %H', ts) AS at, count(*) AS n, round(min(julianday(ts)), 6) AS j FROM traces GROUP BY strftime('%Y/%m at %H', ts)", "SELECT strftime(ts, '%Y/%m at %H') AS at, count(*) AS n, round(min(julian(ts)) - 0.5, 6) AS j FROM events GROUP BY ALL"),
}
for _key, (_text, _oracle) in _DIALECT_OF_TRACES.items():
    query(_oracle, name=_key)(lambda s, d, q=_text: sqlgate.query(s, q, {"traces": A.table(s, d, "events")}))


_WALK = "SELECT src AS q, 0 AS level FROM edges WHERE src = 'region::Region::1' AND edge_type = 'CONTAINS' UNION SELECT e.dst, w.level + 1 FROM walk w JOIN edges e ON e.src = w.q WHERE e.edge_type = 'CONTAINS' AND w.level < 2"


@query(f"walk AS ({_WALK}) SELECT level, count(DISTINCT q)::BIGINT AS n FROM walk GROUP BY level", E, "recursive")
def sql_recursive(s, d):
    return sqlgate.query(s, f"SELECT * FROM (WITH RECURSIVE walk(q, level) AS ({_WALK.replace('UNION SELECT', 'UNION ALL SELECT').replace('SELECT src', 'SELECT DISTINCT src', 1)}) SELECT level, count(DISTINCT q) AS n FROM walk GROUP BY level)", {"edges": A.edges(s, d, ("CONTAINS",))})


# --- changes and jobs --------------------------------------------------------------------------------------------------


@query("SELECT user_id, md5(string_agg(event_id || ':' || event_type, ',' ORDER BY event_id)) AS signature FROM events GROUP BY user_id")
def change_signatures(s, d):
    rows = F.array_sort(F.collect_list(F.struct("event_id", F.concat("event_id", F.lit(":"), "event_type").alias("x"))))
    e = A.table(s, d, "events").groupBy("user_id").agg(rows.alias("r"))
    return e.select("user_id", F.md5(F.array_join(F.transform("r", lambda x: x["x"]), ",")).alias("signature"))


# Each user is a job: its first event queues it, the second runs it, a third ends it, with an error where the event is one.
@query(
    """e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), l AS (SELECT user_id, max(k) AS n, any_value(event_type) FILTER (k = 3) AS third FROM e WHERE k <= 3 GROUP BY user_id)
    SELECT user_id AS job, CASE WHEN n = 1 THEN 'Queued' WHEN n = 2 THEN 'Running' WHEN third = 'error' THEN 'Failed' ELSE 'Completed' END AS state FROM l""",
    "one AS (SELECT 1)",
)
def job_latest_state(s, d):
    k = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    step = F.when(F.col("k") == 1, "Queued").when(F.col("k") == 2, "Running").when(F.col("event_type") == "error", "Failed").otherwise("Completed")
    log = A.table(s, d, "events").withColumn("k", k).where("k <= 3").select(F.col("user_id").cast("string").alias("project"), F.col("user_id").alias("job"), step.alias("state"), F.col("event_id").alias("at"))
    return job_states(log).select("job", "state")


@query(
    """o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 5 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4)
    SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h""",
    "one AS (SELECT 1)",
)
def detect_changes(s, d):
    t, k = A.table(s, d, "documents"), F.col("doc_id") % 10
    old = t.where(k != 3).select("doc_id", F.md5("text").alias("h"))
    new = t.where(k != 4).select("doc_id", F.md5(F.when(k == 5, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("h"))
    return text.diff(old, new, "doc_id", "h")


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def ext_tumbling(s, d):
    e = A.table(s, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


@query(
    """g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
    k AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g), n AS (SELECT user_id, session, count(*)::BIGINT AS events FROM k GROUP BY ALL) SELECT user_id, events, count(*)::BIGINT AS sessions FROM n GROUP BY ALL""",
    "one AS (SELECT 1)",
)
def ext_session(s, d):
    e = A.table(s, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("events"))
    return e.groupBy("user_id", "events").agg(F.count(F.lit(1)).alias("sessions"))

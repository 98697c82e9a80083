import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeweft.api import Engine
from codeweft.functions import text as X
from codeweft.operators import graph, resolve, search, similarity, text
from codeweft.plans import sqlgate
from codeweft.sources import discover
from codeweft.sources.extract import read
from codeweft.store import Store, across, projects


@pytest.fixture(scope="module")
def small(spark):
    rows = [(f"f.py::Function::{n}@L{k}", n, "Function", "f.py", k, k + 1, sig) for k, (n, sig) in enumerate([("main", None), ("a", "def a(Alpha)"), ("helper", None), ("d", None)], 1)]
    symbols = spark.createDataFrame(rows, "qualified_name string, name string, label string, file_path string, line_start long, line_end long, signature string")
    q = {r[1]: r[0] for r in rows}
    edges = spark.createDataFrame([(q["main"], q["a"], "CALLS"), (q["a"], q["helper"], "CALLS"), (q["helper"], "gone", "CALLS"), (q["d"], q["d"], "CALLS")], "src string, dst string, edge_type string")
    return symbols, edges


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_search(small):
    f = search.SearchFilter
    assert names(search.search(*small, f(query="alpha"))) == ["a"]
    assert names(search.search(*small, f(name_pattern="["))) == []
    assert names(search.search(*small, f(relationship="CALLS", direction="in"))) == ["a", "d", "helper"]
    assert names(search.search(*small, f(min_degree=2))) == ["a", "d", "helper"]
    assert names(search.search(*small, f(exclude_entry_points=True))) == ["a", "d", "helper"]
    assert names(search.search(*small, f(name_pattern="^main$", include_connected=True))) == ["a", "main"]
    assert names(search.search(*small, f(file_pattern="f.[a-z]y"))) == ["a", "d", "helper", "main"]
    assert len(search.search(*small, f(limit=None)).collect()) == 4
    assert [r["has_more"] for r in search.search_page(*small, f(limit=None, offset=1)).collect()] == [False] * 3
    page = search.search_page(*small, f(limit=2, offset=1)).collect()
    assert len(page) == 2 and page[0]["total"] == 4 and page[0]["has_more"]


def test_trace_and_dead_code(small):
    symbols, edges = small
    start = "f.py::Function::main@L1"
    assert [r["level"] for r in graph.trace(symbols, edges, start, "out", 5).orderBy("level").collect()] == [0, 1, 2]
    assert graph.trace(symbols, edges, "nowhere").count() == 0
    assert names(graph.dead_code(symbols, edges)) == []  # main is never called but may be an entry


def test_components_louvain_greedy_against_plain_python(spark):
    rng = random.Random(7)
    n = 40
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(35)})
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(n)], "qualified_name string")
    edges = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", "CALLS") for a, b in pairs], "src string, dst string, edge_type string")
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["qualified_name"]: r["root"] for r in graph.connected_components(nodes, edges).collect()}
    assert got == {f"n{i:02}": f"n{find(i):02}" for i in range(n)}
    near = {i: {} for i in range(n)}
    for a, b in pairs:
        near[a][b] = near[b][a] = 1.0
    home, degree, total = list(range(n)), {i: sum(near[i].values()) for i in range(n)}, len(pairs)
    for _ in range(20):
        moved = False
        for i in range(n):
            options = {home[i]: 0.0}
            for j, w in near[i].items():
                options[home[j]] = options.get(home[j], 0) + w
            mass = {c: sum(degree[j] for j in range(n) if home[j] == c and j != i) for c in options}
            score = {c: w - degree[i] * mass[c] / (2 * total) for c, w in options.items()}
            to = min(c for c in score if score[c] >= max(score.values()) - 1e-12)
            moved, home[i] = moved or to != home[i], to
        if not moved:
            break
    parts = lambda m: sorted(sorted(k for k in m if m[k] == c) for c in set(m.values()))
    assert parts({r["qualified_name"]: r["community"] for r in graph.louvain(nodes, edges).collect()}) == parts({f"n{i:02}": home[i] for i in range(n)})
    scored = [(f"n{a:02}", f"n{b:02}", rng.choice([0.4, 0.5, 0.6, 0.7, 0.8])) for a in range(12) for b in range(a + 1, 12)]
    used, want = {}, set()
    for a, b, s in sorted(scored, key=lambda r: (-r[2], r[0], r[1])):
        kind, cap = ("SIMILAR_TO", 2) if s >= 0.55 else ("SEMANTICALLY_RELATED", 3)
        if used.get((kind, a), 0) < cap and used.get((kind, b), 0) < cap:
            want.add((a, b, kind))
            used[kind, a], used[kind, b] = used.get((kind, a), 0) + 1, used.get((kind, b), 0) + 1
    for finish in (500_000, 20, 0):  # all in one task; groups in tasks of their own; rounds alone
        kept = graph.greedy_pairs(spark.createDataFrame(scored, "a string, b string, score double"), similar_cap=2, related_cap=3, finish=finish, rounds=1 if finish else 99)
        assert {(r["a"], r["b"], r["edge_type"]) for r in kept.collect()} == want
    assert {r["qualified_name"]: r["root"] for r in graph.connected_components(nodes, edges, finish=0).collect()} == got


def test_a_chain_of_pairs_is_no_chain_of_rounds(spark):
    """Each pair waits for the one before it."""
    n = 10_000
    chain = spark.range(n).select(F.format_string("n%06d", F.col("id")).alias("a"), F.format_string("n%06d", F.col("id") + 1).alias("b"), (F.lit(1.0) - F.col("id") / (4 * n)).alias("score"))
    began = time.time()
    kept = graph.greedy_pairs(chain, similar_cap=1, related_cap=1)
    assert {r["a"] for r in kept.select("a").collect()} == {f"n{k:06}" for k in range(0, n, 2)} and time.time() - began < 60


def test_equal_scores_are_no_chain_of_rounds(spark):
    """All pairs of 160 names score the same, so each name waits for those before it; 13 stretches."""
    n = 160
    pairs = [(f"n{a:03}", f"n{b:03}") for a in range(n) for b in range(a + 1, n)]
    used, want = {}, set()
    for a, b in pairs:
        if used.get(a, 0) < 3 and used.get(b, 0) < 3:
            want.add((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("score", F.lit(0.4)).repartition(3, "b")
    began = time.time()
    kept = graph.greedy_pairs(rows, related_cap=3, finish=1000)
    assert {(r["a"], r["b"]) for r in kept.collect()} == want and time.time() - began < 60


def test_order_of_discovery(spark):
    edges = [("s", "c", "CALLS"), ("s", "b", "CALLS"), ("a", "s", "CALLS"), ("b", "d", "CALLS"), ("c", "e", "CALLS"), ("d", "a", "CALLS"), ("x", "c", "CALLS"), ("b", "gone", "CALLS"), ("gone", "far", "CALLS"), ("s", "s", "CALLS"), ("b", "d", "IMPORTS")]
    symbols = spark.createDataFrame([(n,) for n in ["s", "a", "b", "c", "d", "e", "x", "far"]], "qualified_name string")
    df = spark.createDataFrame(edges, "src string, dst string, edge_type string")
    for direction, want in (("both", ["s", "b", "c", "a", "d", "e", "x"]), ("out", ["s", "b", "c", "d", "e", "a"]), ("in", ["s", "a", "d", "b"])):
        rows = graph.discovery(symbols, df, "s", direction, 3).orderBy("place").collect()
        assert [r["qualified_name"] for r in rows] == want and [r["place"] for r in rows] == list(range(len(want)))
    assert graph.discovery(symbols, df, "none").count() == 0


def test_text(spark):
    files = spark.createDataFrame([("a.py", "one\r\nTwo words\nlast\n", "python"), ("b.py", "", "python"), ("c.py", "x\ny", "python")], "path string, content string, language string")
    assert {r["path"]: r["n"] for r in files.select("path", F.size(X.lines(F.col("content"))).alias("n")).collect()} == {"a.py": 3, "b.py": 0, "c.py": 2}
    assert [tuple(r) for r in text.search_code(files, "two words").collect()] == [("a.py", 2, "Two words")]
    assert text.search_code(files, "").count() == 0
    assert [(r["path"], r["offset"], r["content"]) for r in text.chunks(files, 2).orderBy("path", "offset").collect()] == [("a.py", 0, "one\nTwo words"), ("a.py", 2, "last"), ("c.py", 0, "x\ny")]
    row = files.where("path = 'c.py'").select(text.snippet(F.col("content"), F.lit(2).cast("long"), F.lit(9).cast("long")), text.snippet(F.col("content"), F.lit(5).cast("long"), F.lit(9).cast("long"))).first()
    assert tuple(row) == ("y", "x\ny")
    assert X.glob_to_regex("a*[0-9]?.py") == r"(?s)^a.*[0-9].\.py$"


def test_paths_urls_numbers(spark):
    row = spark.range(1).select(
        X.normal_path(F.lit("a/./b/../c\\d")), X.url_path(F.lit("http://h.x/a/b?q=/z")), X.url_path(F.lit("word")), X.route_key(F.lit("a/")), X.longest_identifier(F.lit("grep handleAuth x")),
        X.path_proximity(F.lit("src/a.rs"), F.lit("src/b.rs")), X.quantize(F.array(F.lit(0.5 / 127), F.lit(-0.5 / 127), F.lit(2.0))), X.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))),
    ).first()
    told = spark.range(1).select(*[X.line_of(F.lit("a\nb c"), F.lit(at), compat) for at, compat in ((5, False), (5, True), (3, True), (1, False), (1, True))]).first()
    assert list(told) == [2, 3, 2, 1, 1]
    assert list(row) == ["a/c/d", "/a/b", None, "/a", "handleAuth", 0.5, [1, -1, 127], 0.0]


def test_resolution_tiers(spark):
    registry = spark.createDataFrame([("q1", "f", "a/x.py"), ("q2", "f", "b/y.py"), ("q3", "g", "a/z.py"), ("q4", "h", "c/w.py"), ("q5", "g", "d/v.py")], "qualified_name string, name string, file_path string")
    sites = spark.createDataFrame([(1, "a/x.py", "f"), (2, "e/m.py", "f"), (3, "a/k.py", "g"), (4, "e/m.py", "h"), (5, "e/m.py", "g"), (6, "e/n.py", "f")], "site long, file_path string, callee string")
    imports = spark.createDataFrame([("e/m.py", "b/y.py")], "file_path string, imported string")
    got = {r["site"]: (r["target"], r["strategy"]) for r in resolve.resolve_calls(sites, registry, imports).collect()}
    assert got == {1: ("q1", "same_file"), 2: ("q2", "import_map"), 3: ("q3", "same_directory"), 4: ("q4", "unique_name")}


def test_routes(spark):
    routes = spark.createDataFrame([(0, "/users", 0), (1, "/users/:id", 1), (2, "/users/{id}", 2), (3, "/api/items", 3)], "route long, template string, position long")
    calls = spark.createDataFrame([(1, "users/"), (2, "/users/42"), (3, "/v2/items"), (4, "/none")], "call long, path string")
    assert {r["call"]: (r["route"], r["confidence"]) for r in resolve.link_routes(calls, routes).collect()} == {1: (0, "exact"), 2: (2, "template"), 3: (3, "suffix")}


def test_routes_of_every_rest_client_are_not_one(spark):
    routes = spark.createDataFrame([("r1", "/users/{id}", 1), ("r2", "/old/report.json", 2), ("r3", "/api/items", 3), ("r4", "/a//b", 4), ("r5", "/<x>/y", 5), ("r6", "/:k/y", 6)], "route string, template string, position int")
    paths = {1: "/orders/{id}", 2: "/v2/report.json", 3: "/items", 4: "/x/api/items", 5: "/a/b", 6: "/q/y", 7: "/n/items", 8: "/users/7/", 9: "/p/old/report.json", 10: "/"}
    calls = spark.createDataFrame(list(paths.items()), "call int, path string")
    got = {r["call"]: (r["route"], r["confidence"]) for r in resolve.link_routes(calls, routes).collect()}
    assert got == {3: ("r3", "suffix"), 4: ("r3", "suffix"), 5: ("r4", "template"), 6: ("r6", "template"), 7: ("r3", "suffix"), 8: ("r1", "template"), 9: ("r2", "suffix")}


@pytest.mark.parametrize("seed", range(2))
def test_interval_and_next_joins_against_plain_python(spark, monkeypatch, seed):
    monkeypatch.setattr(resolve, "STRETCH", 16)
    rng = random.Random(seed)
    points = [(i, rng.choice("abc"), rng.randint(-40, 120)) for i in range(300)]
    spans = [(f"s{i % 40}", rng.choice("ab"), lo := rng.randint(-50, 110), lo + rng.choice([-1, 0, 0, 1, 7, 60, 200])) for i in range(80)]
    p = spark.createDataFrame(points, "point int, file_path string, line long")
    s = spark.createDataFrame(spans, "span string, file_path string, low long, high long")
    met = [(i, n, lo) for i, f, x in points for n, g, lo, hi in spans if f == g and lo <= x <= hi]
    assert sorted(map(tuple, resolve.enclosing(p, s).collect())) == sorted((i, n) for i, n, _ in met)
    deep = {}
    for i, n, lo in met:
        deep[i] = max(deep.get(i, (lo, n)), (lo, n))
    assert {r["point"]: r["span"] for r in resolve.innermost(p, s).collect()} == {i: n for i, (_, n) in deep.items()}
    starts = s.select(F.col("span").alias("start"), "file_path", "low")
    for tolerance, inclusive in ((None, False), (5, False), (None, True), (3, True)):
        want = {}
        for i, f, x in points:
            after = [(lo, n) for n, g, lo, _ in spans if f == g and (lo >= x if inclusive else lo > x) and (tolerance is None or lo <= x + tolerance)]
            want |= {i: min(after)[1]} if after else {}
        assert {r["point"]: r["start"] for r in resolve.next_after(p, starts, tolerance, inclusive).collect()} == want


def test_a_hundred_thousand_points_and_nested_spans_of_one_file(spark):
    """All spans cover the middle, so every pair would be a row of a plain join."""
    n = 100_000
    points = spark.range(n).select(F.col("id").alias("point"), F.lit("f").alias("file_path"), F.col("id").alias("line"))
    spans = spark.range(n).select(F.col("id").alias("span"), F.lit("f").alias("file_path"), F.floor(F.col("id") / 2).alias("low"), (F.lit(n) - F.floor(F.col("id") / 2)).alias("high"))
    began = time.time()
    deep = resolve.innermost(points, spans)
    told = deep.agg(F.count(F.lit(1)), F.sum("span")).first()
    want = [min(2 * min(x, n - x) + 1, n - 1) for x in range(n)]
    assert tuple(told) == (n, sum(want))
    after = resolve.next_after(points, spans.select(F.col("span").alias("start"), "file_path", "low"))
    assert tuple(after.agg(F.count(F.lit(1)), F.sum("start")).first()) == (n // 2 - 1, sum(2 * (x + 1) for x in range(n // 2 - 1)))
    assert time.time() - began < 90


def test_parents_of_common_names(spark):
    registry = [(f"q{i}", "Base" if i < 40 else f"N{i}", "Class" if i % 2 else "Function", f"f{i % 7}") for i in range(60)] + [("z", "Only", "Function", "g"), ("y1", "Funcs", "Function", "g"), ("y2", "Funcs", "Function", "h")]
    refs = [(i, f"f{i % 9}", ["Base", "Only", "Funcs", "None", f"N{40 + i % 20}"][i % 5]) for i in range(80)]
    want = set()
    for ref, f, base in refs:
        found = sorted((q, label, home) for q, n, label, home in registry if n == base)
        local = sorted((label != "Class", q) for q, label, home in found if home == f)
        classes = [q for q, label, _ in found if label == "Class"]
        want.add((ref, *((local[0][1], "local") if local else (found[0][0], "unique") if len(found) == 1 else (classes[0], "first_class") if classes else (f"{f}::Class::{base}@L0", "synthetic"))))
    got = resolve.resolve_parents(spark.createDataFrame(refs, "ref int, file_path string, base string"), spark.createDataFrame(registry, "qualified_name string, name string, label string, file_path string"))
    assert set(map(tuple, got.collect())) == want and got.count() == len(refs)


def test_signals(spark):
    assert similarity.fnv1a(["", "a"]).tolist() == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C]
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, "")], "id long, t string")
    m = {r["id"]: r["sketch"] for r in similarity.minhash(docs, "id", "t").collect()}
    assert m[1] == m[2] and 3 not in m


def test_sketches_are_those_of_plain_minhash(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh1", "x"]) for _ in range(rng.choice([0, 1, 2, 3, 9])))) for i in range(12)]

    def fnv(word, seed):
        h = 0xCBF29CE484222325 ^ seed
        for byte in word.encode():
            h = (h ^ byte) * 0x100000001B3 % (1 << 64)
        return h

    want = {}
    for i, t in rows:
        words = [w for w in t.split() if len(w) > 1]
        made = [] if not words else ["_".join(words)] if len(words) < 3 else ["_".join(words[k : k + 3]) for k in range(len(words) - 2)]
        if made:
            want[i] = [min(fnv(x, seed) for x in made) for seed in range(similarity.SLOTS)]
    got = {r["i"]: [x % (1 << 64) ^ (1 << 63) for x in r["sketch"]] for r in similarity.minhash(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()}
    assert got == want


_PAST_THE_GATE = [
    "SELECT ', secret as (' AS t, id FROM secret",
    "SELECT * FROM (WITH secret2 AS (SELECT * FROM secret) SELECT * FROM secret2)",
    "SELECT * FROM (WITH edges AS (SELECT * FROM secret) SELECT * FROM edges)",
    "SELECT * FROM (WITH x AS (SELECT * FROM y), y AS (SELECT 1) SELECT * FROM x)",
    "SELECT (SELECT max(id) FROM secret) AS m FROM edges",
    "SELECT src FROM edges WHERE src IN (SELECT id FROM secret) OR EXISTS (SELECT 1 FROM secret)",
    "SELECT sum(1) OVER (ORDER BY (SELECT max(id) FROM secret)) AS s FROM edges",
    "SELECT * FROM edges, LATERAL (SELECT * FROM secret)",
    "SELECT reflect('java.lang.System', 'getenv')",
    "SELECT `reflect`('a', 'b')",
    "SELECT /* x */ java_method('a', 'b')",
    "SELECT src FROM edges LATERAL VIEW explode(array(reflect('a', 'b'))) t AS z",
    "SELECT TRANSFORM(src) USING 'cat' AS (x) FROM edges",
]


def test_functions_of_other_dialects(spark):
    edges = spark.createDataFrame([("a", "b", "[1,2]", "2024-03-01 12:00:00"), ("a", "c", '["x"]', "2024-03-02 00:00:00")], "src string, dst string, js string, t string")
    cases = {
        "SELECT group_concat(src, ';') AS g, group_concat(DISTINCT src) AS h, total(1) AS t FROM edges": [("a;a", "a", 2.0)],
        "SELECT dst FROM edges WHERE dst GLOB '[bx]*' AND src GLOB '?'": [("b",)],
        "SELECT replace(src, 'a', 'its') AS x FROM edges WHERE dst = 'b'": [("its",)],
        "SELECT json_extract(js, '$[0]') AS x, strftime('%d.%m. T%H', t) AS d, julianday(t) AS j FROM edges": [("1", "01.03. T12", 2460371.0), ("x", "02.03. T00", 2460371.5)],
        "SELECT e.dst, j.key, j.value FROM edges e, json_each(e.js) j": [("b", 0, "1"), ("b", 1, "2"), ("c", 0, "x")],
        "SELECT dst FROM edges WHERE src GLOB 'a' AND js NOT GLOB '*]x' AND 'total(' <> dst AND dst GLOB 'c'": [("c",)],
        "SELECT * FROM (WITH x AS (SELECT dst FROM edges), y AS (SELECT * FROM x) SELECT * FROM y)": [("b",), ("c",)],
    }
    for sql, rows in cases.items():
        assert sorted(map(tuple, sqlgate.query(spark, sql, {"edges": edges}).collect())) == rows, sql
    assert [bool(re.search(sqlgate.glob_pattern(p), x)) for p, x in (("a*", "a\nb"), ("[^a]", "a"), ("[]x]", "]"), ("a.b", "axb"), ("?", ""))] == [True, False, True, False, False]


def test_sql_windows_in_blocks(spark, monkeypatch):
    """Windows over a large table see a bounded number of rows at a time, and find what Spark finds in one task."""
    rows = [(f"n{k:04}", None if k % 11 == 0 else "ab"[k % 50 == 0], None if k % 7 == 0 else k * 37 % 100 / 4, k) for k in range(600)]
    rows += [rows[-1]] * 150
    symbols = spark.createDataFrame(rows, "name string, label string, x double, line int").repartition(5)
    over = "OVER (PARTITION BY label ORDER BY name"
    cases = {
        f"SELECT name, CAST(sum(line) {over} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS moving, lag(name) {over}) AS before, dense_rank() OVER (ORDER BY label) AS place FROM symbols": True,
        f"SELECT name, lead(line, 25, -1) {over}), count(*) {over} ROWS BETWEEN 12 PRECEDING AND 31 FOLLOWING) AS n FROM symbols AS s": True,
        "SELECT label, dense_rank() OVER (PARTITION BY label ORDER BY x DESC NULLS FIRST, line % 3) + 1 AS k FROM symbols": True,
        "SELECT DISTINCT x, dense_rank() OVER (PARTITION BY lower(label), line % 2 ORDER BY x DESC) AS k FROM symbols ORDER BY k, x LIMIT 700": True,
        "SELECT max(x) OVER (ORDER BY line, name ROWS 3 PRECEDING) AS m, rank() OVER (PARTITION BY name, x ORDER BY line) AS k FROM symbols": True,
        f"SELECT name, lag(name) {over}) AS before FROM symbols WHERE line % 2 = 0": False,
        f"SELECT *, lag(name) {over}) AS before FROM symbols": False,
        "SELECT max(line) AS m, dense_rank() OVER (ORDER BY max(line)) AS k FROM symbols": False,
        "SELECT k FROM (SELECT dense_rank() OVER (ORDER BY x) AS k FROM symbols) t": False,
        "SELECT name, sum(line) OVER (ORDER BY name) AS n FROM symbols": False,
        "SELECT name, first_value(x) IGNORE NULLS OVER (ORDER BY name ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM symbols": False,
    }
    plain = {sql: sqlgate.query(spark, sql, {"symbols": symbols}) for sql in cases}
    monkeypatch.setattr("codeweft.operators.windows.ROWS_OF_A_TASK", 100)
    monkeypatch.setattr("codeweft.operators.windows.ROWS_OF_A_BLOCK", 40)
    for sql, spread in cases.items():
        found = sqlgate.query(spark, sql, {"symbols": symbols})
        assert found.dtypes == plain[sql].dtypes and Counter(found.collect()) == Counter(plain[sql].collect()), sql
        plan = found._jdf.queryExecution().toString()
        assert ("over_0_of_symbols" in plan) == spread and not (spread and "Exchange SinglePartition" in plan), sql


def test_sql_joins_in_bounded_tasks(spark, monkeypatch):
    """A statement's join gets tasks by the number of edges, not by the session's number of partitions alone; the rows stay the same."""
    from codeweft.plans import adapters, catalog

    d, n = "/root/testdata/sf0.001", "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(n)
    spark.conf.set(n, "-1")
    try:
        for name in ("sql_join", "sql_left_join", "sql_subquery"):
            plain = catalog.QUERIES[name](spark, d)
            rows = Counter(plain.collect())
            assert not re.search(r"RepartitionByExpression \[(src|dst)#", plain._jdf.queryExecution().analyzed().toString()), name  # few edges: as before
            with monkeypatch.context() as m:
                m.setattr(adapters, "PAIRS_OF_A_TASK", 1000)
                found = catalog.QUERIES[name](spark, d)
                assert Counter(found.collect()) == rows and rows, name
                # nation, customer, supplier, orders, and lineitem twice
                parts = -(-sum(adapters.table(spark, d, t).count() for t in ("nation", "customer", "supplier", "orders", "lineitem", "lineitem")) // 1000)
                joined = re.findall(r"hashpartitioning\((?:dst|src|qualified_name)#\d+, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())
                assert re.search(r"RepartitionByExpression \[(src|dst)#", found._jdf.queryExecution().analyzed().toString()), name
                assert parts > 4 and len(joined) >= 2 and set(joined) == {str(parts)}, name
    finally:
        spark.conf.set(n, before)


def test_sql_guard(spark):
    spark.range(2).createOrReplaceTempView("secret")
    assert sqlgate.check(" SELECT 'UPDATE; x' AS x; ") == "SELECT 'UPDATE; x' AS x"
    bad = ["DELETE FROM edges", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT replace FROM edges", "", "REPLACE INTO edges SELECT 1"]
    for sql in bad:
        with pytest.raises(sqlgate.RejectedSQL):
            sqlgate.check(sql)
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    for sql in ("SELECT * FROM text.`/etc/hostname`", "SELECT * FROM range(3)", "SELECT (SELECT max(value) FROM text.`/etc/hostname`) FROM edges", "SELECT * FROM edges, other", "SELECT * FROM (SELECT * FROM json.`/etc`)", *_PAST_THE_GATE):
        with pytest.raises(sqlgate.RejectedSQL):
            sqlgate.query(spark, sql, {"edges": edges})
    spark.range(3).createOrReplaceTempView("edges")
    assert sqlgate.query(spark, "SELECT upper(src) AS s FROM edges e WHERE EXISTS (SELECT 1 FROM edges x WHERE x.src = e.src) -- ; DROP", {"edges": edges}).collect()[0]["s"] == "A"
    assert spark.table("edges").count() == 3
    spark.catalog.dropTempView("edges")
    sqlgate.query(spark, "SELECT * FROM edges", {"edges": edges})
    assert not spark.catalog.tableExists("edges")


_SOURCES = {
    "rust": ("use a::b;\nmod m;\nstruct S {\n  x: i32,\n}\nimpl Show for S {\n  fn go(&self) -> i32 {\n    help(1) // no()\n  }\n}\n", {("S", "Class", 3, 5), ("S", "Class", 6, 10), ("go", "Function", 7, 9)}, {("help", 8)}, {("a::b", "use"), ("m", "mod")}, {("S", "Show", "IMPLEMENTS")}),
    "go": ('import (\n  "os"\n)\ntype T struct {\n}\nfunc (t *T) Run(a int) error {\n  return help(a)\n}\n', {("T", "Function", 4, 5), ("Run", "Function", 6, 8)}, {("help", 7)}, {("os", "import_block")}, set()),
    "java": ("import a.B;\npublic class A extends B<C> implements D, E {\n  public List<String> find(int id) throws X {\n    return load(id);\n  }\n  abstract void g();\n}\n", {("A", "Class", 2, 7), ("find", "Function", 3, 5), ("g", "Function", 6, 6)}, {("load", 4)}, {("a.B", "import")}, {("A", "B", "INHERITS"), ("A", "D", "IMPLEMENTS"), ("A", "E", "IMPLEMENTS")}),
    "typescript": ('import { x } from "./y";\nclass A extends B implements C {\n  run(a: number): void {\n    go(`(${a}`);\n  }\n}\nexport async function go(a) { return 1; }\n', {("A", "Class", 2, 6), ("run", "Function", 3, 5), ("go", "Function", 7, 7)}, {("go", 4)}, {("./y", "esm")}, {("A", "B", "INHERITS"), ("A", "C", "IMPLEMENTS")}),
    "c": ("#include <stdio.h>\nstruct P { int a; };\nstatic int add(int a) {\n  return sum(a);\n}\n", {("P", "Class", 2, 2), ("add", "Function", 3, 5)}, {("sum", 4)}, {("stdio.h", "include")}, set()),
    "cpp": ("class A : public B {\n  int run() const { return go(); }\n};\n", {("A", "Class", 1, 3), ("run", "Function", 2, 2)}, {("go", 2)}, set(), {("A", "B", "INHERITS")}),
    "csharp": ("using System.Text;\nclass A : B {\n  public int Run(int a) {\n    return Go(a);\n  }\n}\n", {("A", "Class", 2, 6), ("Run", "Function", 3, 5)}, {("Go", 4)}, {("System.Text", "using")}, {("A", "B", "INHERITS")}),
    "php": ("<?php\nuse A\\B;\nclass A extends B {\n  public function run($a) {\n    return go($a); # no()\n  }\n}\n", {("A", "Class", 3, 7), ("run", "Function", 4, 6)}, {("go", 5)}, {("A\\B", "use")}, {("A", "B", "INHERITS")}),
    "ruby": ("require 'set'\nclass A < B\n  def run(a)\n    if a\n      go(a)\n    end\n    x if y\n  end\nend\n", {("A", "Class", 2, 9), ("run", "Function", 3, 8)}, {("go", 5)}, {("set", "require")}, {("A", "B", "INHERITS")}),
    "kotlin": ("import c.d\nopen class A : B() {\n  fun run(a: Int): Int = go(a)\n  fun two() {\n    go(1)\n  }\n}\n", {("A", "Class", 2, 7), ("run", "Function", 3, 3), ("two", "Function", 4, 6)}, {("go", 3), ("go", 5), ("B", 2)}, {("c.d", "import")}, {("A", "B", "INHERITS")}),
    "swift": ("import UIKit\nclass A: B {\n  func run(_ a: Int) -> Int {\n    return go(a)\n  }\n}\n", {("A", "Class", 2, 6), ("run", "Function", 3, 5)}, {("go", 4)}, {("UIKit", "import")}, {("A", "B", "INHERITS")}),
    "shell": ("foo() {\n  bar x # baz() {\n}\nfunction baz {\n  foo\n}\n", {("foo", "Function", 1, 3), ("baz", "Function", 4, 6)}, set(), set(), set()),
    "python": ("import os\nfrom .a import b\nclass A(B):\n    def f(self):\n        b()\n", {("A", "Class", 3, 5), ("f", "Function", 4, 5)}, {("b", 5)}, {("os", "import"), (".a", "from_rel")}, {("A", "B", "INHERITS")}),
    "lua": ("def outer\n  fn inner\n", {("outer", "Function", 1, 2), ("inner", "Function", 2, 2)}, set(), set(), set()),
}


@pytest.mark.parametrize("language", _SOURCES)
def test_extraction(language):
    text, symbols, calls, imports, bases = _SOURCES[language]
    found = read(text, language)
    assert {x[:4] for x in found.symbols} == symbols
    assert {(x[0], x[2]) for x in found.calls} == calls
    assert {x[:2] for x in found.imports} == imports
    assert {(x[0], x[4], x[1]) for x in found.bases} == bases


@pytest.mark.parametrize("language", ["rust", "go", "java", "javascript", "typescript", "c", "cpp", "csharp", "kotlin", "swift", "ruby", "php", "shell", "python", "lua"])
def test_extraction_takes_linear_time(language):
    """Of any repeated piece a text twice as long takes about twice the time."""
    pieces = ["impl <", "fun a(x: Int) ", "def a\n", "class A extends B ", "class A : B ", "a() ", "fn a ", "function f() ", "pub ", "import (\n", "x a() : y ", "type T struct ", "do ", "@a ", "{", "(", "<", "def f(:\n  ", "export class A { a(): b ", "struct S\n", "object X : object ", "app.get('/x') "]
    for piece in pieces:
        text = piece * (40_000 // len(piece))
        began = time.process_time()
        read(text, language)
        assert time.process_time() - began < 1.5, piece


def test_extraction_of_routes_and_odd_files():
    web = lambda text, language: [(x[0], x[1], x[2]) for k in ("routes", "clients") for x in getattr(read(text, language), k)]
    assert web("@app.get('/u/{id}')\ndef u(id):\n    requests.post('http://h/x')\n", "python") == [("/u/{id}", "decorator", 1), ("http://h/x", "requests", 3)]
    assert web('app.get("/u", f);\naxios({ url: "/v" });\nfetch(`/w`);\n', "javascript") == [("/u", "express", 1), ("/v", "axios", 2), ("/w", "fetch", 3)]
    assert web('r.HandleFunc("/u", f)\nhttp.NewRequest("GET", "/v", nil)\n', "go") == [("/u", "go_http", 1), ("/v", "request", 2)]
    assert web('class A {\n@GetMapping(value = "/u")\nvoid f() { Uri.parse("/v"); }\n}', "java") == [("/u", "spring", 2), ("/v", "uri", 3)]
    assert web('r.route("/u", get(f));\nreqwest::get("/v");\n', "rust") == [("/u", "axum", 1), ("/v", "reqwest", 2)]
    assert {x[0] for x in read("def f(:\n  x\nclass B:\n  pass\n", "python").symbols} == {"f", "B"}
    for odd in ("", "}}}})", "((((" * 3000, '"' * 999, "/*", "func", "class", "impl", "fn <", "a" * 10**6, "f(" * 5000, "\r\n\x00"):
        for language in [*_SOURCES, "unknown", ""]:
            read(odd, language)
    began = time.process_time()
    read("function f() { g(1); }\n" * 20_000, "javascript")
    assert time.process_time() - began < 20


def test_import_resolution(spark):
    from codeweft.plans import passes

    config = '{\n// a comment\n"compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*"], "~util": ["util/helper"]}}}'
    names = ["src/util/helper.ts", "src/util/index.ts", "src/main.ts", "pkg/__init__.py", "pkg/a.py", "pkg/sub/b.py", "lib/m.rs", "lib/n/mod.rs", "lib/lib.rs"]
    files = spark.createDataFrame([("tsconfig.json", config), *((n, "") for n in names)], "path string, content string")
    asked = [("src/main.ts", "@/util/helper", "esm", "src/util/helper.ts", "alias"), ("src/main.ts", "./util", "esm", "src/util/index.ts", "path"), ("src/main.ts", "~util", "esm", "src/util/helper.ts", "alias"), ("src/main.ts", "react", "esm", None, "external"),
             ("pkg/sub/b.py", "pkg.a", "from", "pkg/a.py", "path"), ("pkg/a.py", ".sub.b", "from_rel", "pkg/sub/b.py", "path"), ("pkg/a.py", "pkg", "import", "pkg/__init__.py", "path"), ("pkg/sub/b.py", "..a", "from_rel", None, "external"), ("lib/lib.rs", "m", "mod", "lib/m.rs", "path"), ("lib/lib.rs", "n", "mod", "lib/n/mod.rs", "path")]
    specs = spark.createDataFrame([a[:3] for a in asked], "file_path string, specifier string, kind string")
    got = {(r["file_path"], r["specifier"]): (r["path"], r["method"]) for r in passes.resolve_imports(specs, files, passes.path_aliases(files)).collect()}
    assert got == {a[:2]: a[3:] for a in asked}
    assert passes.resolve_imports(specs.where("specifier = '@/util/helper'"), files).first()["method"] == "external"


def test_pair_scores_of_blocks_are_those_of_expressions(spark):
    rng = random.Random(3)
    words = ["load", "User", "by", "id", "save", "Order", "render", "Page", "@cache", "fn"]
    rows = [(f"q{i:02}", rng.choice(["load_user", "save_order", "render"]), rng.choice(["Function", "Class"]), rng.choice(["a/b.py", "a/c.py", "d.py"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))) for i in range(40)]
    symbols = spark.createDataFrame(rows, "qualified_name string, name string, label string, file_path string, signature string")
    edges = spark.createDataFrame([(f"q{rng.randrange(40):02}", f"q{rng.randrange(40):02}", "CALLS") for _ in range(60)], "src string, dst string, edge_type string")
    ready = graph.cut(similarity.prepared(symbols, edges))
    every = symbols.select(F.col("qualified_name").alias("a")).crossJoin(symbols.select(F.col("qualified_name").alias("b"))).where("a < b")
    table = lambda df: {(r["a"], r["b"]): round(r["score"], 9) for r in df.collect()}
    want = table(similarity.pair_scores(ready, every))
    assert len(want) > 50 and table(similarity.pair_scores(ready)) == want == table(similarity.pair_scores(ready, block=7))
    least = sorted(want.values())[-20]
    high = {k: v for k, v in want.items() if v >= least - 1e-9}
    assert 20 <= len(high) < 40 and table(similarity.pair_scores(ready, least=least - 1e-9)) == high
    part = similarity.score_rows(ready).toPandas()
    found, asked = similarity.score_blocks(part, part, least - 1e-9, similarity.SIGNAL_WEIGHTS, True)
    assert len(found) == len(high) and len(high) <= asked["minhash"] < asked["ri"] / 2, asked
    assert similarity.pair_scores(ready.limit(0)).count() == 0


def _plain_search(rows, query, limit):
    """Scores of plain Python: the query and each symbol are a corpus of two texts."""
    from codeweft.functions import patterns as P

    def hash64(w, seed=0):
        h = 0xCBF29CE484222325 ^ seed
        for b in w.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    words = lambda t: [w.lower() for w in re.findall(r"[A-Za-z0-9_]{2,}", t)]
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    cos = lambda a, b: sum(x * b.get(k, 0) for k, x in a.items()) / (norm(a) * norm(b)) if norm(a) * norm(b) else 0.0
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0

    def vector(bag, idf):
        out = {}
        for w in set(bag):
            x = bag.count(w) * idf(w) * (1 if hash64(w, 2) % 2 == 0 else -1)
            for k, f in ((0, 1.0), (1, 0.5)):
                out[hash64(w, k) % 768] = out.get(hash64(w, k) % 768, 0) + x * f
        n = norm(out)
        return {k: v / n for k, v in out.items()} if n > 1e-8 else out

    coded = lambda v: {k: math.copysign(math.floor(abs(x) * 127 + 0.5), x) for k, x in v.items()}

    def sketch(bag):
        made = ["_".join(bag[k : k + 3]) for k in range(max(1, len(bag) - 2))]
        return [min(hash64(m, k) for m in made) for k in range(64)]

    def profile(sig, name):
        bag, both = words(sig), words(sig) + words(name)
        key, number = sum(w in P.KEYWORDS for w in both), sum(w.isdigit() for w in both)
        api = [w for w in bag if w not in P.API_STOP]
        types = [w.lower() for w in re.findall(r"(?<!\w)([A-Z]\w+)", sig) if w not in P.TYPE_STOP]
        marks = [w for line in sig.split("\n") if line.strip()[:1] in ("#", "@") and line.strip() for w in words(line)]
        return {"api": api, "types": types, "marks": marks, "ids": [w for w in both if len(w) >= 3], "kinds": dict(enumerate((key, len(both) - key - number, 0, number))), "volume": sum(sig.count(c) for c in "(){}[];,:<>") + len(bag)}

    bags = {r[0]: words(" ".join([r[1], r[0], r[2], r[4] or ""])) for r in rows}
    seen = {w: sum(w in b for b in bags.values()) for b in bags.values() for w in b}
    asked, mine = words(query), profile(query, "query")
    own = vector(asked, lambda w: 1.0)
    out = []
    for r in rows:
        bag = bags[r[0]]
        if cos(coded(vector(bag, lambda w: math.log((len(rows) + 1) / (seen[w] + 1)) + 1)), coded(own)) < 0.05:
            continue
        idf = lambda w: 1.0 if w in asked else math.log(1.5) + 1
        other = profile(r[4] or "", r[1])
        share = {w: mine["api"].count(w) / len(mine["api"]) for w in mine["api"]}
        api = sum(v for w, v in share.items() if w in other["api"]) / max(norm(share), math.sqrt(len(set(other["api"])))) if share and other["api"] else 0.0
        a, b = mine["volume"], other["volume"]
        parts = {
            "tfidf": cos({w: asked.count(w) / len(asked) for w in asked}, {w: bag.count(w) / len(bag) * idf(w) for w in bag}),
            "ri": cos(own, vector(bag, idf)),
            "minhash": sum(x == y for x, y in zip(sketch(asked), sketch(bag), strict=True)) / 64,
            "api": min(1.0, api),
            "type": jac(mine["types"], other["types"]),
            "ast": cos(mine["kinds"], other["kinds"]),
            "flow": jac(mine["ids"], other["ids"]),
            "decorator": jac(mine["marks"], other["marks"]),
            "halstead": 1 - abs(a - b) / max(a, b) if max(a, b) else 0.0,
        }
        score = sum(similarity.SIGNAL_WEIGHTS[k] * v for k, v in parts.items())
        if score > 0.1:
            out.append((r[0], score))
    return sorted(out, key=lambda t: (-round(t[1], 9), t[0]))[:limit]


def test_vector_search_scores_by_all_signals(spark):
    rng = random.Random(5)
    words = ["load", "User", "by", "id", "save", "Order", "render", "Page", "\n@cache", "fn", "(x: int)", "9", "é"]
    rows = [(f"m{i % 7}.py::Function::q{i:02}", rng.choice(["load_user", "save_order", "render"]), rng.choice(["Function", "Class"]), f"m{i % 7}.py", rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))]) if i % 5 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    # Another column named as one in use inside changes nothing.
    symbols = spark.createDataFrame([(*r, "mine") for r in rows], "qualified_name string, name string, label string, file_path string, signature string, text string")
    vectors = graph.cut(similarity.symbol_vectors(symbols))
    ask = lambda q, limit=20: similarity.vector_search(vectors, symbols, spark.createDataFrame([(q,)], "text string"), limit).collect()
    for query, limit in (("def load(User, id)\n@cache", 20), ("save_order Order Order", 7), ("render Page q07 m3", None)):
        got, want = ask(query, limit), _plain_search(rows, query, limit)
        assert len(want) > 5 and [r["qualified_name"] for r in got] == [n for n, _ in want]
        assert all(abs(r["score"] - w) < 1e-6 for r, (_, w) in zip(got, want, strict=True)) and got[0]["text"] == "mine"
    assert ask("") == ask(None) == ask("é ?") == []
    assert similarity.vector_search(vectors.limit(0), symbols, spark.createDataFrame([("load",)], "text string")).count() == 0


def test_vectors_are_made_and_met_a_batch_at_a_time(spark):
    """The codes and cosines of a batch are those of the expressions, also of vectors that are short, zero, null or miss components."""
    from codeweft.functions import text as X

    rng = random.Random(3)
    rows = [(i, sorted(rng.sample(range(similarity.DIMENSION), n)), [rng.choice([-1.5, -0.5 / 127, 0.5 / 127, 1.5 / 127, rng.uniform(-1, 1)]) for _ in range(n)]) for i, n in enumerate([0, 1, 7, 40] * 10)]
    sparse = spark.createDataFrame(rows, "id int, slots array<int>, vs array<double>")
    dense = F.transform(F.sequence(F.lit(0), F.lit(similarity.DIMENSION - 1)), lambda k: F.coalesce(F.try_element_at(F.map_from_arrays("slots", "vs"), k), F.lit(0.0)))
    assert sparse.where(~similarity.dense_codes("slots", "vs").eqNullSafe(X.quantize(dense))).count() == 0
    odd = spark.createDataFrame([(100, [3, None, 4]), (101, [0, 0]), (102, None), (103, [])], "id int, v array<byte>")
    both = sparse.select("id", similarity.dense_codes("slots", "vs").alias("v")).unionByName(odd)
    for one in (7, 100, 101):
        asked = both.where(F.col("id") == one).select(F.col("v").alias("q"))
        told = both.join(F.broadcast(asked)).select("id", similarity.code_cosine(F.col("v"), asked.first()["q"]).alias("got"), X.cosine(F.col("v"), F.col("q")).alias("want"))
        assert told.where("not got <=> want").collect() == []
    plan = similarity.symbol_vectors(spark.createDataFrame([("a", "a", "Class", None)], "qualified_name string, name string, label string, signature string"))
    assert "try_element_at" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_degrees_are_counted_before_names_meet(spark):
    """With a least degree the join gets only the names that fit, none of the single ends."""
    symbols = spark.createDataFrame([(n, "Class") for n in "abcd"], "qualified_name string, label string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("x", "a")], "src string, dst string").withColumn("edge_type", F.lit("CALLS"))
    ask = lambda low, high: search.matching(symbols, edges, search.SearchFilter(label="Class", relationship="CALLS", min_degree=low, max_degree=high))
    names = lambda df: sorted(r["qualified_name"] for r in df.collect())
    assert names(ask(2, None)) == ["a", "b"] and names(ask(1, 2)) == ["c"] and names(ask(3, 3)) == ["a", "b"] and names(ask(None, 2)) == ["c"]
    plan = ask(2, None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Aggregate") and plan.count("LeftSemi") == 1


def test_louvain_takes_components_as_they_come(monkeypatch):
    """Components of a task are worked on one after another, wherever batches end."""
    import pandas as pd

    rng, rows = random.Random(4), []
    for c in range(60):
        names = [f"c{c:02}n{k}" for k in range(rng.randint(1, 9))]
        rows += [(names[0], n, None, 0.0) for n in names]
        rows += [(names[0], a, b, rng.choice([0.5, 1.0])) for k, a in enumerate(names) for b in names[k + 1 :] if rng.random() < 0.4]
    want = [graph._moves([r[1:] for r in rows if r[0] == root], 90.0, 1.0, 20) for root in dict.fromkeys(r[0] for r in rows)]
    want = [pair for names, heads in want for pair in zip(names, heads, strict=True)]
    assert len(set(want)) == len({r[1] for r in rows}) and any(a != b for a, b in want)
    for size in (1, 7, 10_000):
        parts = (pd.DataFrame(rows[k : k + size], columns=["root", "a", "b", "w"]) for k in range(0, len(rows), size))
        got = pd.concat(graph.moved(parts, 90.0, 1.0, 20))
        assert list(zip(got["qualified_name"], got["head"], strict=True)) == want
    assert len(pd.concat(graph.moved(iter([]), 0.0, 1.0, 20))) == 0


def test_index_vectors_add_up_runs_of_a_key(spark, monkeypatch):
    """Whatever the number of rows that are added up at a time: keys of one and of many rows, a missing key, and one row for each key."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    bags = [(k, w, rng.randint(1, 4)) for k in [None, *range(40)] for w in rng.sample(words, 300 if k in (None, 7) else rng.randint(1, 20))]
    known = [(w, rng.uniform(1, 3)) for w in words]
    idf, slots, want = dict(known), dict(zip(words, similarity._slots(words), strict=True)), {}
    for k, w, n in bags:
        p, q, sign = map(int, slots[w])
        for at, x in ((p, n * idf[w] * sign), (q, n * idf[w] * sign * 0.5)):
            want[k, at] = want.get((k, at), 0.0) + x
    norm = {k: math.sqrt(sum(x * x for (j, _), x in want.items() if j == k)) for k in [None, *range(40)]}
    for size in (1, 64, 30_000):
        monkeypatch.setattr(similarity, "_SUMMED", size)
        lists = similarity.ri_lists(spark.createDataFrame(bags, "k int, token string, n int"), "k", spark.createDataFrame(known, "token string, idf double")).collect()
        assert sorted((r["k"] for r in lists), key=str) == sorted([None, *range(40)], key=str)
        got = {(r["k"], p): v for r in lists for p, v in zip(r["slots"], r["vs"], strict=True)}
        assert got.keys() == want.keys() and all(abs(v - want[k] / norm[k[0]]) < 1e-9 for k, v in got.items())


def test_sparse_products_are_those_of_grids(monkeypatch):
    """Whatever is done pair by pair and whatever in strips."""
    import numpy as np

    rng = np.random.default_rng(2)
    a, b = ((rng.random((n, 90)) < rng.random(90) ** 4) * rng.random((n, 90)) for n in (37, 50))
    flat = lambda m: (*np.nonzero(m), m[np.nonzero(m)])
    for sparse, strip, pairs in ((200, 1024, 1 << 20), (1, 8, 64), (10**9, 7, 5), (20, 1, 1)):
        monkeypatch.setattr(similarity, "_SPARSE", sparse)
        monkeypatch.setattr(similarity, "_STRIP", strip)
        monkeypatch.setattr(similarity, "_PAIRS", pairs)
        assert np.allclose(similarity._products(flat(a), flat(b), 90, (37, 50)), a @ b.T)


def test_common_names_alone_make_pairs(spark):
    """Sixty functions of one name and signature in sixty files share only common words; every pair counts."""
    rows = [(f"f{i}.py::Function::handle@L1", "handle", "Function", f"f{i}.py", "def handle(request)") for i in range(60)]
    symbols = spark.createDataFrame(rows, "qualified_name string, name string, label string, file_path string, signature string")
    ready = graph.cut(similarity.prepared(symbols, spark.createDataFrame([], "src string, dst string, edge_type string")))
    assert similarity.pair_scores(ready).count() == 1770


def test_postings_find_phrases(spark):
    files = spark.createDataFrame([("src/of_the.py", "x"), ("b.py", "One of\nthe two; of\tthe"), ("c.py", "of a the"), ("d.py", ""), ("the/x.py", "of")], "path string, content string")
    index = text.postings(files)
    for phrase in ("of the", "One", "THE two", "the x", "of", "none of", ""):
        assert {r["path"] for r in text.indexed_phrase(index, phrase).collect()} == {r["path"] for r in text.phrase_search(files, phrase, None).collect()}, phrase


def test_ranking_reads_few_blocks_and_is_that_of_all_files(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    rows = [(f"d{i % 9}/f{i}.py", " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 60))), "python", 1) for i in range(500)]
    rows += [(f"hot{i}.py", "w59 w58 " * 20, "python", 1) for i in range(12)] + [("none.py", None, "python", 1)]
    files = spark.createDataFrame(rows, "path string, content string, language string, line_count long")
    index = graph.cut(text.postings(files))
    bags = {p: re.findall(r"[^\W_]+", (p + " " + (c or "")).lower()) for p, c, _, _ in rows}
    mean = sum(map(len, bags.values())) / len(bags)
    for query, limit in (("w59 w58", 10), ("w0 w3", 7), ("W5, hot3", 5), ("nowhere", 3), ("w59", 600)):
        asked = set(re.findall(r"[^\W_]+", query.lower()))
        n = {w: sum(w in b for b in bags.values()) for w in asked}
        idf = {w: max(1e-6, math.log((len(bags) - n[w] + 0.5) / (n[w] + 0.5))) for w in asked if n[w]}
        want = [(p, sum(i * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w, i in idf.items() if w in b)) for p, b in bags.items() if asked & set(b)]
        want = sorted(want, key=lambda r: (-round(r[1], 9), r[0]))[:limit]
        told = {}
        got = [(r["path"], r["score"]) for r in text.ranked(index, text.word_blocks(index), query, limit, told=told).collect()]
        assert [p for p, _ in got] == [p for p, _ in want] and all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(got, want, strict=True))
        if query == "w59 w58":
            assert told["scored"] < told["blocks"] / 2
    found = lambda q: {r["path"] for r in text.matching(index, q).collect()}
    has = lambda p, w: w in bags[p]
    assert found("w50 w10") == {p for p in bags if has(p, "w50") and has(p, "w10")}
    assert found("w50 NOT w0 OR w51") == {p for p in bags if (has(p, "w50") and not has(p, "w0")) or has(p, "w51")}
    assert found('"w59 w58" AND hot*') == {f"hot{i}.py" for i in range(12)} and found("") == found("NOT w1") == set()


def test_changes_jobs_and_numbers(spark):
    from codeweft.streaming.traces import job_states, may_start

    status = spark.createDataFrame([("a", "M", False), ("b", "D", True)], "path string, status string, deleted boolean")
    names = spark.createDataFrame([("a",), ("c",)], "path string")
    assert sorted(tuple(r) for r in text.merged_changes(names, status).collect()) == [("a", "M", False), ("b", "D", True), ("c", "M", False)]
    log = [("p", "j1", "Queued", 1), ("p", "j1", "Running", 2), ("p", "j1", "Completed", 3), ("p", "j1", "Running", 4), ("p", "j2", "Running", 1), ("p", "j3", "Queued", 5), ("q", "j4", "Queued", 1), ("q", "j4", "Failed", 2), ("q", "j5", "Queued", 1), ("q", "j5", "Completed", 2)]
    states = job_states(spark.createDataFrame(log, "project string, job string, state string, at long"))
    assert {(r["project"], r["job"], r["state"]) for r in states.collect()} == {("p", "j1", "Completed"), ("p", "j3", "Queued"), ("q", "j4", "Failed"), ("q", "j5", "Queued")}
    assert not may_start(states, "p") and may_start(states.where("job <> 'j5'"), "q")
    many = spark.range(500).select(F.concat(F.lit("k"), F.col("id") * 7 % 500).alias("k"))
    assert [r["k"] for r in graph.numbered(many, "k", "n").orderBy("n").collect()] == sorted(f"k{i}" for i in range(500))


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path), "p")
    row = lambda name, line: spark.createDataFrame([(name, "n", "Function", "f.py", line)], "qualified_name string, name string, label string, file_path string, line_start long")
    s.upsert("symbols", row("a", 1), ["qualified_name"])
    s.upsert("symbols", row("a", 2).unionByName(row("b", 3)), ["qualified_name"])
    assert sorted((r["qualified_name"], r["line_start"]) for r in s.read("symbols").collect()) == [("a", 2), ("b", 3)]
    e = lambda p: spark.createDataFrame([("a", "b", "CALLS", p)], "src string, dst string, edge_type string, properties string")
    s.insert_edges(e("first"))
    s.insert_edges(e("second"))
    assert [r["properties"] for r in s.read("edges").collect()] == ["first"]
    s.replace_edges(spark.createDataFrame([("a", "c", "CALLS")], "src string, dst string, edge_type string"), ["CALLS"])
    assert [(r["dst"], r["properties"]) for r in s.read("edges").collect()] == [("c", None)]
    s.upsert_files(spark.createDataFrame([("f.py", "one two", "python", 1), ("g.py", "two", "python", 1)], "path string, content string, language string, line_count long"))
    s.upsert_files(spark.createDataFrame([("f.py", "three", "python", 1)], "path string, content string, language string, line_count long"))
    assert sorted((r["word"], r["path"]) for r in s.read("postings").where("places[0] >= 0").collect()) == [("three", "f.py"), ("two", "g.py")]
    told = s.export(str(tmp_path / "out"))
    assert told["files"]["rows"] == 2 and told["files"]["bytes"] > 0
    copy = Store(spark, str(tmp_path), "copy")
    assert copy.import_from(str(tmp_path / "out")) and not copy.import_from(str(tmp_path / "out")) and copy.read("symbols").count() == 2
    assert projects(spark, str(tmp_path)) == ["copy", "p"]
    found = across(spark, str(tmp_path), spark.createDataFrame([("a",), ("x",)], "qualified_name string")).collect()
    assert [(r["qualified_name"], r["project"]) for r in found] == [("a", "copy")]
    copy.delete_labels(["Function"])
    copy.delete_edges(["CALLS"])
    assert copy.read("symbols").count() == copy.read("edges").count() == 0 and copy.read("files").count() == 2
    copy.clear()
    copy.vacuum()
    assert copy.read("files").count() == 0
    copy.delete()
    assert projects(spark, str(tmp_path)) == ["p"]
    s.delete_files(spark.createDataFrame([("f.py",)], "path string"))
    assert s.read("symbols").count() == s.read("edges").count() == 0 and s.read("files").count() == 1


def test_index_a_tree(spark, tmp_path):
    src = tmp_path / "src"
    (src / "lib").mkdir(parents=True)
    (src / "models.py").write_text("class Base:\n    pass\n\n\nclass Child(Base):\n    pass\n\n\ndef make():\n    return build()\n\n\ndef build():\n    return 1\n")
    (src / "main.js").write_text("import { x } from './lib/util';\nfunction load() {\n  return fetch('/users/42');\n}\n")
    (src / "lib" / "util.js").write_text("export function x() { return 1; }\n")
    (src / "server.py").write_text("@app.get('/users/{id}')\ndef users(id):\n    return id\n")
    (src / "skip.log").write_text("x")
    (src / "lib" / "gone.js").write_text("function gone() {}\n")
    (src / "lib" / ".gitignore").write_text("gone.js\n")
    engine = Engine(spark, str(tmp_path / "store"))
    told = engine.index_repository(str(src), project="p")
    assert told["files"] == 4
    edges = {(r["src"].split("::")[-1].split("@")[0], r["dst"].split("::")[-1].split("@")[0], r["edge_type"]) for r in engine.store("p").read("edges").collect()}
    assert {("make", "build", "CALLS"), ("Child", "Base", "INHERITS"), ("load", "/users/{id}", "HTTP_CALLS"), ("users", "/users/{id}", "HTTP_ROUTE"), ("main.js", "lib/util.js", "IMPORTS")} <= edges
    assert engine.get_code_snippet("p", "models.py::Function::build@L13") == "def build():\n    return 1"
    assert engine.query_graph("p", "SELECT count(*) AS n FROM symbols WHERE label = 'Class'").first()["n"] == 2
    walked = engine.trace_path("p", "models.py::Function::make@L9", "out", 2)
    assert [r["level"] for r in walked["nodes"].orderBy("level").collect()] == [0, 1] and [r["edge_type"] for r in walked["trace_edges"].collect()] == ["CALLS"]
    assert engine.semantic_search("p", "build").first()["name"] == "build" and engine.find_symbols(["models.py::Function::make@L9"]).first()["project"] == "p"
    hit = engine.search_code("p", "return build").first()
    assert (hit["path"], hit["line_number"]) == ("models.py", 10) and engine.search_code("p", "uild()").first()["path"] == "models.py" and engine.search_code("p", "").count() == 0
    assert engine.rank_code("p", "users id").first()["path"] == "server.py"
    assert [r["path"] for r in engine.query_graph("p", "SELECT path FROM files_fts WHERE files_fts MATCH 'fetch us*'").collect()] == ["main.js"]
    session = engine.rlm_scan("p")["session"]
    assert engine.rlm_session_list("p").count() == 1 and engine.rlm_peek("p", session, "build").count() == 1 and engine.rlm_chunk("p", session).count() == 3
    assert engine.rlm_read_symbol("p", "models.py::Function::make@L9")["symbol"].first()["snippet"].startswith("def make")
    engine.rlm_session_delete("p", session)
    assert engine.rlm_session_list("p").count() == 0 and engine.rlm_workflow("map")["phase"] == "map"
    changed = spark.createDataFrame([("models.py", "def make():\n    return 2\n", "python")], "path string, content string, language string")
    engine.update_files("p", changed, spark.createDataFrame([("server.py",)], "path string"))
    left = {(r["name"], r["file_path"]) for r in engine.store("p").read("symbols").collect()}
    assert left == {("make", "models.py"), ("load", "main.js"), ("x", "lib/util.js")}
    assert engine.list_projects() == ["p"] and engine.check_index_coverage("p", ["main.js", "none.js"])["percent"] == 50


def _tree(folder):
    """A tree whose files call, import, derive from and ask for each other."""
    files = {
        "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"]}}}',
        "models.py": "class Base:\n    pass\n\n\nclass Child(Base):\n    pass\n\n\ndef make():\n    return build()\n",
        "pkg/build.py": "def build():\n    return 1\n\n\ndef other():\n    return make()\n",
        "pkg/deep/more.py": "from models import Base\n\n\nclass Third(Base):\n    def go(self):\n        return shared()\n",
        "lib/util.js": "export function x() { return shared(); }\n",
        "lib/two.js": "export function shared() { return 2; }\n",
        "main.js": "import { x } from './lib/util';\nimport { y } from '@lib/late';\nfunction load() {\n  x();\n  return fetch('/users/42');\n}\n",
        "server.py": "@app.get('/users/{id}')\ndef users(id):\n    return id\n\n\n@app.get('/items')\ndef items():\n    return users(1)\n",
        "client.js": "function all() {\n  return fetch('/items');\n}\nfunction some() {\n  return fetch('/late/7');\n}\n",
        **{f"many/m{k}.py": f"def f{k}():\n    return f{k + 1}()\n" for k in range(12)},
    }
    for path, content in files.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(content)
    return files


def _tables(store):
    names = ("files", "findings", "symbols", "edges", "members", "vectors", "postings")
    return {n: sorted((tuple(map(str, r)) for r in store.read(n).collect())) for n in names}


def test_an_update_is_a_full_index_of_what_it_leaves(spark, tmp_path):
    """After each of several changes all tables equal those of a fresh index, while other files' texts and parts stay untouched."""
    src = tmp_path / "src"
    _tree(src)
    engine = Engine(spark, str(tmp_path / "store"))
    engine.index_repository(str(src), project="p")
    one = engine.store("p")
    one.insert_edges(spark.createDataFrame([("models.py::Function::make@L9", "kept", "RUNTIME_TRACE"), ("pkg/build.py::Function::build@L1", "gone", "RUNTIME_TRACE")], "src string, dst string, edge_type string"))
    steps = [
        ({"pkg/build.py": "\n\ndef build():\n    return 1\n", "lib/late.ts": "export function y() { return 3; }\n"}, ["lib/two.js"]),
        ({"server.py": "@app.get('/late/{id}')\ndef late(id):\n    return id\n", "models.py": "class Other:\n    pass\n\n\ndef make():\n    return late()\n"}, ["many/m3.py", "lib/util.js"]),
        ({"tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["pkg/*"]}}}', "lib/util.js": "export function shared() { return 5; }\n", "many/m4.py": ""}, ["pkg/deep/more.py"]),
    ]
    for changed, removed in steps:
        before = one._manifest()[1]["tables"]
        for path, content in changed.items():
            (src / path).write_text(content)
        for path in removed:
            (src / path).unlink()
        rows = [(p, c, discover_language(p)) for p, c in changed.items()]
        told = engine.update_files("p", spark.createDataFrame(rows, "path string, content string, language string"), spark.createDataFrame([(p,) for p in removed], "path string"))
        assert told["files"] == len(changed)
        engine.index_repository(str(src), project="fresh")
        got, want = _tables(one), _tables(engine.store("fresh"))
        assert [e for e in got["edges"] if "RUNTIME_TRACE" in e] == [("models.py::Function::make@L9", "kept", "RUNTIME_TRACE", "None")] * (changed.get("models.py") is None and "models.py::Function::make@L9" in str(got["symbols"]))
        got["edges"] = [e for e in got["edges"] if "RUNTIME_TRACE" not in e]
        rename = lambda rows: sorted(tuple(c.replace("fresh::Project::fresh", "p::Project::p") for c in r) for r in rows)
        for name in got:
            assert got[name] == rename(want[name]), name
        after = one._manifest()[1]["tables"]
        touched = set(one.parts_of_files(spark.createDataFrame([(p,) for p in [*changed, *removed]], "path string")))
        for name in ("files", "findings", "symbols", "postings"):
            assert {k: v for k, v in before[name].items() if k not in touched} == {k: v for k, v in after[name].items() if k not in touched}
    assert engine.update_files("p", spark.createDataFrame([], "path string, content string, language string"))["files"] == 0
    assert one.get_meta("indexed_at") and one.get_meta("repo_path") == str(src)


def discover_language(path):
    return {"py": "python", "js": "javascript", "ts": "typescript", "json": "json"}[path.rsplit(".", 1)[1]]


def test_one_of_two_writers_is_told(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path), "w") for _ in range(2))
    a.set_meta("x", "1")
    last, manifest = b._manifest()
    a.set_meta("x", "2")
    b._manifest = lambda writing=False: (last, manifest)
    with pytest.raises(RuntimeError):
        b.set_meta("x", "3")
    assert a.get_meta("x") == "2"


@pytest.mark.parametrize(
    "rules, kept",
    [
        ("*.py", []),
        ("/*.py", ["a/b/d.py", "a/c.py", "doc/f.py"]),
        ("a/*.py", ["a/b/d.py", "doc/f.py", "x.py"]),
        ("a/**/*.py", ["doc/f.py", "x.py"]),
        ("**/b", ["a/c.py", "doc/f.py", "x.py"]),
        ("b/", ["a/c.py", "doc/f.py", "x.py"]),
        ("x.py/", ["a/b/d.py", "a/c.py", "doc/f.py", "x.py"]),
        ("*.py\n!c.py", ["a/c.py"]),
        ("a/\n!a/c.py", ["doc/f.py", "x.py"]),
        ("a/*\n!a/b", ["a/b/d.py", "doc/f.py", "x.py"]),
        ("[a-c]", ["doc/f.py", "x.py"]),
        ("[!x].py\n# y\n\\#z", ["x.py"]),
        ("do?/**", ["a/b/d.py", "a/c.py", "x.py"]),
        ("/b", ["a/b/d.py", "a/c.py", "doc/f.py", "x.py"]),
    ],
)
def test_ignore_rules(spark, tmp_path, rules, kept):
    for path in ("x.py", "a/c.py", "a/b/d.py", "doc/f.py"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text(rules + "\n")
    assert sorted(r["path"] for r in discover.read_tree(spark, str(tmp_path)).select("path").collect()) == kept


def test_discovery_rules(spark):
    files = spark.createDataFrame([("a.py", 1), ("yarn.lock", 1), ("tests/b.py", 1), ("dist/c.js", 1), ("d.png", 1), ("e.md", 1)], "path string, size long")
    paths = lambda mode: [r["path"] for r in discover.wanted(files, mode).collect()]
    assert paths("full") == ["a.py", "dist/c.js", "e.md", "tests/b.py"] and paths("moderate") == ["a.py", "e.md"] and paths("fast") == ["a.py", "tests/b.py"]


def test_changes_of_a_working_tree_and_the_watch(spark, tmp_path):
    import subprocess

    from codeweft.streaming.traces import watch

    src = tmp_path / "src"
    src.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(src), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    (src / "a.py").write_text("def a():\n    pass\n")
    (src / "b.py").write_text("def b():\n    pass\n")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    engine = Engine(spark, str(tmp_path / "store"))
    engine.index_repository(str(src), project="p")
    assert engine.detect_changes("p", str(src)) == {"clean": True, "files": [], "head_changed": False}
    (src / "a.py").write_text("def a2():\n    pass\n")
    git("commit", "-qam", "two")
    (src / "c.py").write_text("")
    assert engine.detect_changes("p", str(src)) == {"clean": False, "files": ["a.py", "c.py"], "head_changed": True}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"path": "a.py", "content": "def a3(): pass", "language": "python"}\n{"path": "b.py", "deleted": true}\n')
    watch(spark, str(tmp_path / "in"), str(tmp_path / "at"), lambda changed, removed: engine.update_files("p", changed, removed))
    assert {(r["name"], r["file_path"]) for r in engine.store("p").read("symbols").collect()} == {("a3", "a.py")}


def test_trace_stream(spark, tmp_path):
    from codeweft.streaming.traces import ingest, next_interval

    inbox, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"caller": "a", "callee": "b"}\n{"from": "a", "to": "b"}\n{"src": "x"}\n')
    ingest(spark, inbox, out, at)
    (tmp_path / "in" / "2.json").write_text('{"src": "a", "dst": "b"}\n{"src": "b", "dst": "c"}\n')
    ingest(spark, inbox, out, at)
    assert sorted((r["src"], r["dst"]) for r in spark.read.parquet(out).collect()) == [("a", "b"), ("b", "c")]
    assert [next_interval(5000, False, False), next_interval(40000, False, False), next_interval(60000, True, False)] == [10000, 60000, 5000]


def test_communities_of_the_whole_graph(spark):
    from codeweft.plans import adapters, catalog

    d = "/root/testdata/sf0.001"
    top = {r["qualified_name"]: r["qualified_name"] for r in adapters.symbols(spark, d).select("qualified_name").collect()}

    def root(n):
        while top[n] != n:
            top[n] = top[top[n]]
            n = top[n]
        return n

    for e in adapters.edges(spark, d).collect():
        if e["src"] in top and e["dst"] in top:
            x, y = sorted((root(e["src"]), root(e["dst"])))
            top[y] = x
    number = {n: k for k, n in enumerate(sorted({root(n) for n in top}))}
    got = {r["qualified_name"]: r["community"] for r in catalog.QUERIES["connected_components"](spark, d).collect()}
    assert got == {n: number[root(n)] for n in top}
    assert {r["qualified_name"] for r in catalog.QUERIES["louvain"](spark, d).collect()} == {r["qualified_name"] for r in catalog.QUERIES["extract_symbols"](spark, d).collect()}


def test_components_by_number(spark, monkeypatch):
    """Hubs, ends outside, components left apart by the first links; nothing is repeated for parts of a hub."""
    rng = random.Random(11)
    names = [f"n{i:03}" for i in range(300)]
    pairs = [("n000", f"n{i:03}") for i in range(1, 90)] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(100, 160)] + [tuple(rng.sample(names[170:280], 2)) for _ in range(90)]
    pairs += [("n005", "gone"), ("gone", "n290"), ("n291", "n291"), ("n000", "n005"), ("n100", "away")]
    top = {n: n for n in names}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in pairs:
        if a in top and b in top:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    nodes = spark.createDataFrame([(n,) for n in names + names[:5]], "qualified_name string")
    edges = spark.createDataFrame([(rng.choice([(a, b), (b, a)])) for a, b in pairs], "src string, dst string")
    for hub, few, finish in ((100_000, 1_000_000, 100), (4, 1_000_000, 0), (4, 0, 0)):
        monkeypatch.setattr(graph, "HUB", hub)
        monkeypatch.setattr(graph, "FEW", few)
        got = graph.connected_components(nodes, edges, finish=finish).collect()
        assert len(got) == 300 and {r["qualified_name"]: r["root"] for r in got} == {n: root(n) for n in names}
    members = graph.number_components(spark.createDataFrame([(n, root(n)) for n in names], "qualified_name string, root string"))
    first = graph.community_summary(members, 2, 3).orderBy("community").collect()
    assert [(r["community"], r["size"], r["members"]) for r in first][0] == (0, 90, "n000,n001,n002")


def test_counts_and_sketches_stay_with_their_text(spark):
    """Nothing is shuffled but the keys; texts of one key are added up, null keys too."""
    rows = [(1, "ab cd ab cd ab"), (2, None), (3, "x é"), (4, "Zz"), (4, "zz yy"), (None, "aa bb"), (None, "aa"), (5, "w1 " * 25_000 + "tail")]
    texts = spark.createDataFrame(rows, "id long, text string")
    words = lambda t: [w.lower() for w in re.findall("[A-Za-z0-9_]{2,}", t or "")]
    made = lambda ws: ["_".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    for got, items in ((similarity.token_rows(texts, "id", "text"), words), (similarity.shingle_counts(texts, "id", "text"), lambda t: made(words(t)))):
        want = Counter((k, x) for k, t in rows for x in items(t))
        assert {tuple(r)[:2]: r["n"] for r in got.collect()} == want and got.count() == len(want)
    alone = texts.where("id < 4")
    for df in (similarity.token_bags(alone, "id", "text"), similarity.shingle_counts(alone, "id", "text")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    sketches = {r["id"]: list(r["sketch"]) for r in similarity.minhash(texts, "id", "text").collect()}
    hashed = lambda t: similarity._sketch_hashes(made(words(t))).min(0)
    assert set(sketches) == {1, 4, None, 5} and sketches[5] == list(hashed(rows[-1][1])) and sketches[4] == list(np.minimum(hashed("Zz"), hashed("zz yy")))
    assert "Generate" not in similarity.minhash(texts, "id", "text")._jdf.queryExecution().executedPlan().toString()


def test_small_frontiers_go_to_the_edges(small, monkeypatch):
    """The edges are neither written nor dealt; large frontiers find the same."""
    symbols, edges = small
    start, found = "f.py::Function::main@L1", []

    def written(df):
        raise AssertionError("written")

    monkeypatch.setattr(graph, "cut", written)
    for near in (500_000, 0):
        monkeypatch.setattr(graph, "NEAR", near)
        met = graph.trace(symbols, edges, start, "both", 3)
        found.append((sorted(map(tuple, met.collect())), sorted(map(tuple, graph.trace_edges(edges, met, "both", 3).collect()))))
    assert found[0] == found[1] and len(found[0][0]) > 1 and found[0][1]


def test_rows_are_dealt_by_groups_of_blocks(spark, monkeypatch):
    rows = [(f"f{i}.py::Function::handle@L1", "handle", "Function", f"f{i}.py", f"def handle(request{i % 4})") for i in range(30)]
    symbols = spark.createDataFrame(rows, "qualified_name string, name string, label string, file_path string, signature string")
    ready = graph.cut(similarity.prepared(symbols, spark.createDataFrame([], "src string, dst string, edge_type string")))
    found = []
    for group in (1, 2, 100):
        monkeypatch.setattr(similarity, "GROUP", group)
        found.append(sorted((r["a"], r["b"], round(r["score"], 9)) for r in similarity.pair_scores(ready, block=5).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_postings_are_made_where_the_file_is_read(spark):
    """Without collecting words by a shuffle; files of one path share their rows."""
    rows = [("a/b.py", "Load the load"), ("c.py", None), ("d/d.py", "x"), ("d/d.py", "x")]
    files = spark.createDataFrame(rows, "path string, content string")
    got = {(r["word"], r["path"]): (list(r["places"]), r["tf"], r["length"]) for r in text.postings(files).where("word <> ''").collect()}
    assert got[("load", "a/b.py")] == ([0, 2], 2, 6) and got[("b", "a/b.py")] == ([-3], 1, 6) and got[("py", "c.py")] == ([-2], 1, 2)
    assert got[("x", "d/d.py")] == ([0, 0], 2, 4) and got[("d", "d/d.py")] == ([-4, -4, -3, -3], 4, 4)
    assert "Exchange" not in text.postings(files.where("path < 'd'"))._jdf.queryExecution().executedPlan().toString()


def test_both_ways_read_the_edges_once(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "b", "CALLS"), (None, "c", "CALLS")], "src string, dst string, edge_type string")
    met = graph._ways(edges, "both")
    assert met._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert sorted(map(tuple, met.collect()), key=str) == sorted([("a", "b", 0), ("b", "a", 1), ("b", "b", 0), ("b", "b", 1), (None, "c", 0), ("c", None, 1)], key=str)
    assert sorted(map(tuple, graph._ways(edges, "in").collect()), key=str) == sorted([("b", "a", 1), ("b", "b", 1), ("c", None, 1)], key=str)


def test_postings_read_a_file_once(spark, tmp_path):
    """Its own row, that of the empty word, comes with those of its words; one for each file of a path."""
    spark.createDataFrame([("a.py", "x"), ("b.py", None), ("c.py", "y"), ("c.py", "y z")], "path string, content string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    own = text.postings(files).where("word = ''")
    assert sorted((r["path"], r["places"], r["tf"], r["length"]) for r in own.collect()) == [("a.py", None, 0, 3), ("b.py", None, 0, 2), ("c.py", None, 0, 3), ("c.py", None, 0, 4)]
    assert text.postings(files.where("path < 'c'"))._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_pairs_of_the_catalogue_are_of_functions_and_classes(spark):
    from codeweft.plans import catalog

    found = catalog.QUERIES["pair_scores"](spark, "/root/testdata/sf0.001").select(*[F.split(c, "::")[1].alias(c) for c in "ab"]).distinct()
    assert {tuple(sorted((r["a"], r["b"]))) for r in found.collect()} == {("Class", "Class"), ("Class", "Function"), ("Function", "Function")}


def test_rows_are_not_dealt_once_for_each_block_they_meet(spark, monkeypatch):
    """What is shuffled for the scoring is each row once and its packed block, whatever the number of blocks."""
    rows = [(f"f{i:03}.py::Function::handle@L1", "handle", "Function", f"f{i:03}.py", f"def handle(request{i % 4})") for i in range(240)]
    symbols = spark.createDataFrame(rows, "qualified_name string, name string, label string, file_path string, signature string")
    ready = graph.cut(similarity.prepared(symbols, spark.createDataFrame([], "src string, dst string, edge_type string")))
    monkeypatch.setattr(similarity, "GROUP", 1)
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway

    def told():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = told()
    found = similarity.pair_scores(ready, block=10).collect()
    time.sleep(1)
    assert 240 <= sum(n for k, n in told().items() if k not in before) < 3 * 240
    whole = similarity.pair_scores(ready, block=1000).collect()
    assert len(whole) > 5000 and sorted((r["a"], r["b"], round(r["score"], 9)) for r in found) == sorted((r["a"], r["b"], round(r["score"], 9)) for r in whole)


def test_capped_pairs_are_chosen_without_writing_all(spark, monkeypatch):
    """A few pairs of each task at a time: the same edges as from all pairs at once, and never as many pairs written."""
    rows = [(f"d{i % 7}/f{i:02}.py::Function::handle@L1", "handle", "Function", f"d{i % 7}/f{i:02}.py", f"def handle(request, {'x' * (i % 3)})") for i in range(60)]
    symbols = spark.createDataFrame(rows, "qualified_name string, name string, label string, file_path string, signature string")
    ready = graph.cut(similarity.prepared(symbols, spark.createDataFrame([], "src string, dst string, edge_type string")))
    table = lambda df: sorted((r["a"], r["b"], round(r["score"], 9), r["edge_type"]) for r in df.collect())
    scored = similarity.pair_scores(ready).select("a", "b", F.round("score", 2).alias("score")).collect()
    similar = sorted(r["score"] for r in scored)[len(scored) * 2 // 3]
    want = table(graph.greedy_pairs(spark.createDataFrame(scored), similar, 2, 3))
    assert len(scored) > 500 and {w[3] for w in want} == {"SIMILAR_TO", "SEMANTICALLY_RELATED"}
    written, kept, rounds = [], graph.kept, []

    def counted(df):
        out = kept(df)
        written.append(out[0].count() if "score" in df.columns else 0)
        rounds.append("cut" in df.columns)
        return out

    monkeypatch.setattr(graph, "kept", counted)
    caps = {"similar": similar, "similar_cap": 2, "related_cap": 3, "digits": 2}
    assert table(similarity.greedy_scores(ready, **caps)) == want and rounds.count(True) == 1
    for most, block in ((150, 1000), (400, 20)):
        written.clear(), rounds.clear()
        assert table(similarity.greedy_scores(ready, **caps, block=block, pairs=most, each=1)) == want
        assert rounds.count(True) > 1 and max(written) <= 2 * most < len(scored)
    assert similarity.greedy_scores(ready.limit(0)).count() == 0


def test_scores_are_rounded_as_by_spark(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(2000)] + [k / 2e6 for k in range(700_001, 701_001)] + [0.0, 1.0, 0.5499995, 0.3500005]
    want = [r["r"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(F.round("v", 6).alias("r")).collect()]
    import numpy as np

    assert similarity._rounded(np.array(values), 6).tolist() == want

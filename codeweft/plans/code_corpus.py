"""Source code made from the documents: a file for each, in one of seven languages, and what is to be found in it.

The files stand in for a code base of the size of the tables. The same templates give the file's text in Spark and, for the
oracle, the text and all that extraction has to find in SQL: {i} is doc_id, {j} doc_id modulo 5, {w} the first word of at least
four small letters in the document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions.text import lines
from codeweft.plans.adapters import table


@dataclass
class Case:
    """A template and the rows found in it: symbols (name, label, first line, last line, signature), imports (specifier, kind,
    file meant or empty), calls (name, line), routes and clients (text, kind, line), bases (class, base, type), decorators (name, line)."""

    language: str
    folder: str
    ending: str
    text: str
    symbols: list[tuple] = field(default_factory=list)
    imports: list[tuple] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)
    routes: list[tuple] = field(default_factory=list)
    clients: list[tuple] = field(default_factory=list)
    bases: list[tuple] = field(default_factory=list)
    decorators: list[tuple] = field(default_factory=list)
    #: The function that calls do_{w}, the handler of the route, the function around the client call: (name, line).
    caller: tuple | None = None
    handler: tuple | None = None
    asker: tuple | None = None


CASES = [
    Case(
        "python", "py", "py",
        "import os\nfrom code.py{j}.f{j} import helper\n\nclass C{i}(Base{j}):\n    def run(self):\n        return do_{w}(self)\n\n@app.get('/items/{w}/{id}')\ndef do_{w}(x):\n    return requests.get('http://h/items/{w}/{i}')\n",
        [("C{i}", "Class", 4, 6, "class C{i}(Base{j}): def run(self):"), ("run", "Function", 5, 6, "    def run(self): return do_{w}(self)"), ("do_{w}", "Function", 9, 10, "def do_{w}(x): return requests.get('http://h/items/{w}/{i}')")],
        [("os", "import", ""), ("code.py{j}.f{j}", "from", "code/py{j}/f{j}.py")], [("do_{w}", 6), ("get", 8), ("get", 10)],
        [("/items/{w}/{id}", "decorator", 8)], [("http://h/items/{w}/{i}", "requests", 10)], [("C{i}", "Base{j}", "INHERITS")], [("app.get", 8)],
        ("run", 5), ("do_{w}", 9), ("do_{w}", 9),
    ),
    Case(
        "javascript", "js", "js",
        "import { x } from './f{j}';\nconst lib = require('lib{j}');\n\nexport function do_{w}(a) {\n  return fetch('/items/{w}/{j}');\n}\nclass C{i} extends Base{j} {\n  run() {\n    do_{w}(1); // gone(2)\n  }\n}\napp.post('/js/{w}', do_{w});\n",
        [("do_{w}", "Function", 4, 6, "export function do_{w}(a) {"), ("C{i}", "Class", 7, 11, "class C{i} extends Base{j} {"), ("run", "Function", 8, 10, "  run() {")],
        [("./f{j}", "esm", "code/js{j}/f{j}.js"), ("lib{j}", "cjs", "")], [("fetch", 5), ("do_{w}", 9), ("post", 12)],
        [("/js/{w}", "express", 12)], [("/items/{w}/{j}", "fetch", 5)], [("C{i}", "Base{j}", "INHERITS")], [],
        ("run", 8), None, ("do_{w}", 4),
    ),
    Case(
        "go", "go", "go",
        'package main\nimport (\n  "os"\n  "code/go{j}/f{j}"\n)\ntype C{i} struct {\n  x int\n}\nfunc (c *C{i}) Run(a int) int {\n  return do_{w}(a)\n}\nfunc do_{w}(a int) int {\n  http.Get("http://h/js/{w}")\n  return a\n}\nfunc main() {\n  r.HandleFunc("/go/{w}/", do_{w})\n}\n',
        [("C{i}", "Function", 6, 8, "type C{i} struct {"), ("Run", "Function", 9, 11, "func (c *C{i}) Run(a int) int {"), ("do_{w}", "Function", 12, 15, "func do_{w}(a int) int {"), ("main", "Function", 16, 18, "func main() {")],
        [("os", "import_block", ""), ("code/go{j}/f{j}", "import_block", "code/go{j}/f{j}.go")], [("do_{w}", 10), ("Get", 13), ("HandleFunc", 17)],
        [("/go/{w}/", "go_http", 17)], [("http://h/js/{w}", "http", 13)], [], [],
        ("Run", 9), None, ("do_{w}", 12),
    ),
    Case(
        "java", "java", "java",
        'package code.java{j};\nimport code.Base{j};\npublic class C{i} extends Base{j} implements Runnable {\n  @GetMapping("/java/{w}/{id}")\n  public int do_{w}(int a) {\n    return load(a);\n  }\n  public void run() {\n    do_{w}(1);\n    client.get("http://h/java/{w}/7");\n  }\n}\n',
        [("C{i}", "Class", 3, 12, "public class C{i} extends Base{j} implements Runnable {"), ("do_{w}", "Function", 5, 7, "  public int do_{w}(int a) {"), ("run", "Function", 8, 11, "  public void run() {")],
        [("code.Base{j}", "import", "")], [("load", 6), ("do_{w}", 9), ("get", 10)],
        [("/java/{w}/{id}", "spring", 4)], [("http://h/java/{w}/7", "client", 10)], [("C{i}", "Base{j}", "INHERITS"), ("C{i}", "Runnable", "IMPLEMENTS")], [("GetMapping", 4)],
        ("run", 8), ("do_{w}", 5), ("run", 8),
    ),
    Case(
        "rust", "rs", "rs",
        'use crate::util{j};\nmod f{j};\npub struct C{i} {\n  x: i32,\n}\nimpl Show for C{i} {\n  fn run(&self) -> i32 {\n    do_{w}(1)\n  }\n}\npub fn do_{w}(a: i32) -> i32 {\n  client.get("/go/{w}")\n}\n',
        [("C{i}", "Class", 3, 5, "pub struct C{i} {"), ("C{i}", "Class", 6, 10, "impl Show for C{i} {"), ("run", "Function", 7, 9, "  fn run(&self) -> i32 {"), ("do_{w}", "Function", 11, 13, "pub fn do_{w}(a: i32) -> i32 {")],
        [("crate::util{j}", "use", ""), ("f{j}", "mod", "code/rs{j}/f{j}.rs")], [("do_{w}", 8), ("get", 12)],
        [("/go/{w}", "axum_method", 12)], [("/go/{w}", "client", 12)], [("C{i}", "Show", "IMPLEMENTS")], [],
        ("run", 7), None, ("do_{w}", 11),
    ),
    Case(
        "ruby", "rb", "rb",
        "require_relative 'f{j}'\nclass C{i} < Base{j}\n  def run(a)\n    if a\n      do_{w}(a)\n    end\n  end\nend\ndef do_{w}(x)\n  x\nend\n",
        [("C{i}", "Class", 2, 8, "class C{i} < Base{j} def run(a) if a do_{w}(a) end end"), ("run", "Function", 3, 7, "  def run(a) if a do_{w}(a) end end"), ("do_{w}", "Function", 9, 11, "def do_{w}(x) x end")],
        [("f{j}", "require_relative", "code/rb{j}/f{j}.rb")], [("do_{w}", 5)],
        [], [], [("C{i}", "Base{j}", "INHERITS")], [],
        ("run", 3), None, None,
    ),
    Case(
        "lua", "lua", "lua", "def do_{w}\nfn gen_{i}\n",
        [("do_{w}", "Function", 1, 2, "def do_{w} fn gen_{i}"), ("gen_{i}", "Function", 2, 2, "fn gen_{i}")],
    ),
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (path, content, language, line_count), one for each document."""
    d = table(spark, sf_dir, "documents")
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "[a-z]{4,}", 0)
    rows = d.select(F.col("doc_id").alias("i"), (F.col("doc_id") % 5).alias("j"), F.when(word == "", "none").otherwise(word).alias("w"), (F.col("doc_id") % len(CASES)).alias("k"))
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("k").cast("int"))
    text = of([c.text for c in CASES])
    for name in ("i", "j", "w"):
        text = F.replace(text, F.lit("{" + name + "}"), F.col(name).cast("string"))
    path = F.concat(F.lit("code/"), of([c.folder for c in CASES]), "j", F.lit("/f"), "i", F.lit("."), of([c.ending for c in CASES]))
    out = rows.select(path.alias("path"), text.alias("content"), of([c.language for c in CASES]).alias("language"))
    return out.withColumn("line_count", F.size(lines(F.col("content"))).cast("long"))


# --- the same in SQL ---------------------------------------------------------------------------------------------------


def _quoted(x: object) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x)


def _filled(column: str) -> str:
    return f"replace(replace(replace({column}, '{{i}}', i::VARCHAR), '{{j}}', j::VARCHAR), '{{w}}', w)"


#: base: a row for each document with its placeholders, its number of the template and its path.
BASE_SQL = f"""base AS (SELECT doc_id AS i, doc_id % 5 AS j, coalesce(nullif(regexp_extract(coalesce(text, ''), '[a-z]{{4,}}'), ''), 'none') AS w, doc_id % {len(CASES)} AS k,
      'code/' || [{", ".join(_quoted(c.folder) for c in CASES)}][(doc_id % {len(CASES)} + 1)::INT] || (doc_id % 5) || '/f' || doc_id || '.' || [{", ".join(_quoted(c.ending) for c in CASES)}][(doc_id % {len(CASES)} + 1)::INT] AS path FROM documents)"""


def found_sql(kind: str, columns: str) -> str:
    """A common table named `kind` with what has to be found: path and the given columns of the cases' rows, texts filled in."""
    rows = []
    for k, c in enumerate(CASES):
        told = getattr(c, kind) or []
        rows += [(k, *r) for r in ([told] if isinstance(told, tuple) else told)]
    names = columns.split(", ")
    values = ",\n".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)
    texts = {n for place, n in enumerate(names, 1) if isinstance(rows[0][place], str)}
    told = ", ".join(f"{_filled('t.' + n)} AS {n}" if n in texts else f"t.{n}::BIGINT AS {n}" for n in names)
    return f"{kind} AS (SELECT base.path, base.i, base.j, base.w, {told} FROM base JOIN (VALUES {values}) AS t(k, {columns}) ON t.k = base.k)"


def content_sql() -> str:
    values = ", ".join("(" + f"{k}, {_quoted(c.text)}".replace("\n", "' || chr(10) || '") + ")" for k, c in enumerate(CASES))
    return f"code AS (SELECT path, {_filled('t.text')} AS content FROM base JOIN (VALUES {values}) AS t(k, text) ON t.k = base.k)"


SYMBOLS_SQL = found_sql("symbols", "name, label, line_start, line_end, signature")
IMPORTS_SQL = found_sql("imports", "specifier, kind, meant")
CALLS_SQL = found_sql("calls", "callee, line")
ROUTES_SQL = found_sql("routes", "route, framework, line")
CLIENTS_SQL = found_sql("clients", "url, client, line")
BASES_SQL = found_sql("bases", "name, base, edge_type")
DECORATORS_SQL = found_sql("decorators", "decorator, line")
CALLER_SQL, HANDLER_SQL, ASKER_SQL = (found_sql(kind, "name, line") for kind in ("caller", "handler", "asker"))

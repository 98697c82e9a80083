"""The passes that turn files into a graph, each a function from tables to edges; each replaces its own edge types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import normal_path, parent_folder, url_path
from codeweft.operators import graph, resolve, similarity
from codeweft.schema import EngineConfig
from codeweft.sources.extract import findings, of_kind

_CONFIG = "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"


def path_aliases(files: DataFrame) -> DataFrame:
    """Rows (prefix, target) from `paths` of tsconfig.json and jsconfig.json: what stands for the part before the star.

    Comments of whole lines are left out; a file that is no JSON has none.
    """
    name = F.element_at(F.split("path", "/", -1), -1)
    told = files.where(name.isin("tsconfig.json", "jsconfig.json")).select("path", F.from_json(F.regexp_replace("content", r"(?m)^\s*//.*$", ""), _CONFIG)["compilerOptions"].alias("o"))
    each = told.select("path", F.coalesce("o.baseUrl", F.lit(".")).alias("base"), F.explode("o.paths").alias("pattern", "targets"))
    one = each.select("path", "base", "pattern", F.explode("targets").alias("to"))
    before = lambda c: F.split_part(F.col(c), F.lit("*"), F.lit(1))
    folder = F.concat(parent_folder(F.col("path")), F.lit("/"), "base", F.lit("/"), before("to"))
    ended = F.when(F.col("to").contains("*") & ((before("to") == "") | before("to").endswith("/")), F.concat(normal_path(folder), F.lit("/"))).otherwise(normal_path(folder))
    return one.select(before("pattern").alias("prefix"), ended.alias("target")).where("prefix <> ''").distinct()


def file_keys(files: DataFrame) -> DataFrame:
    """Rows (key, class, path): names a file is found by: its path (0), its path without the ending, or the folder that it
    stands for as index, mod or __init__ (1)."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    entry = F.regexp_replace(stem, r"/(index|mod|__init__)$", "")
    names = F.array_distinct(F.array(F.struct(F.col("path").alias("key"), F.lit(0).alias("class")), F.struct(stem.alias("key"), F.lit(1).alias("class")), F.struct(entry.alias("key"), F.lit(1).alias("class"))))
    return files.select("path").distinct().select("path", F.explode(names).alias("k")).select("k.key", "k.class", "path").distinct()


def resolve_imports(specs: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Rows (file_path, specifier, kind, dst, method, path): the file an import means, else an outside module.

    Candidates in order: beside the importing file, through a path alias (if given), from the root. Each is looked up as
    written, then without an ending and as a folder's entry file; ties go to the smaller path; no file imports itself.
    """
    is_dotted = F.col("kind").isin("from", "from_rel", "import")
    one_dot = F.regexp_replace("specifier", r"^\.(?!\.)", "")
    plain = F.when(is_dotted & ~F.col("specifier").contains("/"), F.regexp_replace(one_dot, r"(?<!\.)\.(?!\.)", "/")).otherwise(F.regexp_replace("specifier", "::", "/"))
    beside = F.concat(parent_folder(F.col("file_path")), F.lit("/"), plain)
    listed = specs.withColumn("row", F.struct("file_path", "specifier"))
    options = F.array(F.struct(F.lit(0).alias("at"), beside.alias("try")), F.struct(F.lit(2).alias("at"), plain.alias("try")))
    tried = listed.select("row", F.explode(options).alias("o")).select("row", "o.at", normal_path(F.col("o.try")).alias("key"))
    if aliases is not None:  # every part of a specifier that ends before a slash may be an alias
        spec = F.col("row.specifier")
        ends = F.transform(F.sequence(F.lit(1), F.length(spec)), lambda k: F.left(spec, k))
        prefixes = F.filter(ends, lambda x: x.endswith("/") | (F.length(x) == 1) | (x == spec))
        met = listed.select("row", F.explode(F.array_distinct(prefixes)).alias("prefix")).join(aliases, "prefix")
        tried = tried.unionByName(met.select("row", F.lit(1).alias("at"), normal_path(F.concat("target", F.substr(F.col("row.specifier"), F.length("prefix") + 1))).alias("key")))
    found = tried.join(file_keys(files), "key").where("path <> row.file_path")
    first = found.groupBy("row").agg(F.min(F.struct("at", "class", "path")).alias("m")).select("row", "m.at", "m.path")
    out = listed.join(first, "row", "left")
    method = F.when(F.col("path").isNull(), "external").when(F.col("at") == 1, "alias").otherwise("path")
    return out.select("file_path", "specifier", "kind", F.coalesce(F.concat("path", F.lit("::File::"), "path"), F.concat("specifier", F.lit("::Module::"), "specifier")).alias("dst"), method.alias("method"), "path")


def _edge(df: DataFrame, src: str, dst: str, edge_type: str, **properties) -> DataFrame:
    told = F.to_json(F.struct(*[v.alias(k) for k, v in properties.items()])) if properties else F.lit(None).cast("string")
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(edge_type).alias("edge_type"), told.alias("properties"))


def structure_pass(project: str, files: DataFrame, found: DataFrame, symbols: DataFrame, edges: DataFrame, config: EngineConfig) -> DataFrame:
    return _edge(graph.structure(project, files, symbols)[1], "src", "dst", "CONTAINS")


def import_pass(project: str, files: DataFrame, found: DataFrame, symbols: DataFrame, edges: DataFrame, config: EngineConfig) -> DataFrame:
    meant = resolve_imports(of_kind(found, "imports"), files, path_aliases(files)).withColumn("src", F.concat("file_path", F.lit("::File::"), "file_path"))
    return _edge(meant, "src", "dst", "IMPORTS", specifier=F.col("specifier"), kind=F.col("kind"), method=F.col("method"))


def call_pass(project: str, files: DataFrame, found: DataFrame, symbols: DataFrame, edges: DataFrame, config: EngineConfig) -> DataFrame:
    sites = graph.cut(of_kind(found, "calls").distinct().withColumn("site", F.concat_ws("|", "file_path", "callee", "line")))
    functions = symbols.where("label = 'Function'")
    imports = resolve_imports(of_kind(found, "imports"), files).where("path is not null").select("file_path", F.col("path").alias("imported")).distinct()
    meant = resolve.resolve_calls(sites.select("site", "file_path", "callee"), functions.select("qualified_name", "name", "file_path"), imports)
    spans = functions.select(F.struct("qualified_name", "name").alias("span"), "file_path", F.col("line_start").alias("low"), F.col("line_end").alias("high"))
    inside = resolve.enclosing(sites.select(F.struct("site", "callee").alias("point"), "file_path", "line"), spans).where("point.callee <> span.name")
    called = inside.select(F.col("point.site").alias("site"), F.col("span.qualified_name").alias("caller")).join(meant, "site")
    return _edge(graph.first_by(called, ["caller", "target"], ["site"]), "caller", "target", "CALLS", strategy=F.col("strategy"))


def _points(rows: DataFrame, *names: str) -> DataFrame:
    return rows.distinct().withColumn("point", F.struct(*names))


def handlers(routes: DataFrame, functions: DataFrame) -> DataFrame:
    """Rows (route, path, start): a route node for each route of a file, and the next function below it, at most five lines on."""
    points = _points(routes, "file_path", "route", "line")
    starts = functions.select(F.col("qualified_name").alias("start"), "file_path", F.col("line_start").alias("low"))
    node = F.concat("point.file_path", F.lit("::Route::"), "point.route", F.lit("@L"), "point.line")
    return resolve.next_after(points.select("point", "file_path", "line"), starts, 5).select(node.alias("route"), F.col("point.route").alias("path"), "start")


def client_calls(clients: DataFrame, functions: DataFrame) -> DataFrame:
    """Rows (span, path): the innermost function around each client call, and the path of the URL that it asks for."""
    points = _points(clients, "file_path", "url", "line")
    spans = functions.select(F.col("qualified_name").alias("span"), "file_path", F.col("line_start").alias("low"), F.col("line_end").alias("high"))
    inside = resolve.innermost(points.select("point", "file_path", "line"), spans)
    return inside.select("span", url_path(F.col("point.url")).alias("path")).where("path is not null").distinct()


def decorated(marks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows (src, dst): the next symbol below each decorator, and a node for the decorator."""
    starts = symbols.select(F.col("qualified_name").alias("start"), "file_path", F.col("line_start").alias("low"))
    below = resolve.next_after(_points(marks, "file_path", "decorator", "line").select("point", "file_path", "line"), starts)
    return below.select(F.col("start").alias("src"), F.concat("point.file_path", F.lit("::Decorator::"), "point.decorator", F.lit("@L"), "point.line").alias("dst"))


def linked_calls(clients: DataFrame, functions: DataFrame, routes: DataFrame) -> DataFrame:
    """HTTP_CALLS edges from the innermost function around each client call to the route (route, path) that it means."""
    calls = graph.cut(client_calls(clients, functions).withColumn("call", F.concat_ws("|", "span", "path")))
    known = routes.select("route", F.col("path").alias("template"), F.col("route").alias("position"))
    linked = resolve.link_routes(calls.select("call", "path").distinct(), known).join(calls.select("call", "span").distinct(), "call")
    return _edge(graph.first_by(linked, ["span", "route"], ["call"]), "span", "route", "HTTP_CALLS", confidence=F.col("confidence"))


def served_routes(routes: DataFrame, functions: DataFrame) -> DataFrame:
    """HTTP_ROUTE edges from the next function below each route."""
    return _edge(handlers(routes, functions), "start", "route", "HTTP_ROUTE", path=F.col("path"))


def route_pass(project: str, files: DataFrame, found: DataFrame, symbols: DataFrame, edges: DataFrame, config: EngineConfig) -> DataFrame:
    """HTTP_ROUTE from the next function below a route, HTTP_CALLS from the innermost function around a client call."""
    functions = symbols.where("label = 'Function'")
    served = graph.cut(served_routes(of_kind(found, "routes"), functions))
    known = served.select(F.col("dst").alias("route"), F.get_json_object("properties", "$.path").alias("path"))
    return served.unionByName(linked_calls(of_kind(found, "clients"), functions, known))


def inheritance_pass(project: str, files: DataFrame, found: DataFrame, symbols: DataFrame, edges: DataFrame, config: EngineConfig) -> DataFrame:
    classes = symbols.where("label = 'Class'")
    bases = graph.cut(of_kind(found, "bases").distinct().withColumn("ref", F.concat_ws("|", "file_path", "name", "base", "edge_type")))
    parents = resolve.resolve_parents(bases.select("ref", "file_path", "base"), classes.select("qualified_name", "name", "label", "file_path"))
    child = classes.select("file_path", "name", F.col("qualified_name").alias("src"))
    known = bases.join(parents, "ref").join(child, ["file_path", "name"]).where("src <> target")
    derived = known.select("src", F.col("target").alias("dst"), "edge_type", F.to_json(F.struct("strategy")).alias("properties"))
    return derived.unionByName(_edge(decorated(of_kind(found, "decorators"), symbols), "src", "dst", "DECORATES"))


def semantic_pass(project: str, files: DataFrame, found: DataFrame, symbols: DataFrame, edges: DataFrame, config: EngineConfig) -> DataFrame:
    if not config.semantic_enabled:
        return edges.limit(0).select("src", "dst", "edge_type", F.lit(None).cast("string").alias("properties"))
    ready = graph.cut(similarity.prepared(symbols.where("label in ('Function', 'Class')"), edges))
    kept = similarity.greedy_scores(ready, config.similar_threshold, least=config.related_threshold, weights=config.weights)
    return kept.select(F.col("a").alias("src"), F.col("b").alias("dst"), "edge_type", F.to_json(F.struct("score")).alias("properties"))


Pass = Callable[[str, DataFrame, DataFrame, DataFrame, DataFrame, EngineConfig], DataFrame]
#: In this order; the edge types each one replaces.
PASSES: list[tuple[str, Pass, list[str]]] = [
    ("structure", structure_pass, ["CONTAINS"]),
    ("imports", import_pass, ["IMPORTS"]),
    ("calls", call_pass, ["CALLS"]),
    ("routes", route_pass, ["HTTP_ROUTE", "HTTP_CALLS"]),
    ("inheritance", inheritance_pass, ["INHERITS", "IMPLEMENTS", "DECORATES"]),
    ("semantic", semantic_pass, ["SIMILAR_TO", "SEMANTICALLY_RELATED"]),
]


def derive(project: str, files: DataFrame, found: DataFrame, symbols: DataFrame, config: EngineConfig) -> DataFrame:
    """All edges of a project, from its files, what was found in them, and its symbols."""
    out: DataFrame | None = None
    for _, run, _ in PASSES:
        known = out if out is not None else symbols.limit(0).select(F.lit("").alias("src"), F.lit("").alias("dst"), F.lit("").alias("edge_type"), F.lit("").alias("properties"))
        new = run(project, files, found, symbols, known, config)
        out = graph.cut(new if out is None else out.unionByName(new))
    return out


def _within(found: DataFrame, files: DataFrame) -> DataFrame:
    """Findings in some files (path)."""
    return found.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")


def changed_edges(project: str, paths: DataFrame, configs: DataFrame, gone: DataFrame, moved: DataFrame, reconfigured: bool, found: DataFrame, symbols: DataFrame, before: DataFrame, routes: DataFrame, config: EngineConfig) -> list[tuple[list[str], DataFrame, DataFrame]]:
    """Edges that a change of some files can alter: (types, new edges, path of the files that they are all such edges of).

    paths: all files after the change (path). configs: those that set path aliases, with their texts. gone: files that were changed,
    added or removed; moved: those added or removed. found, symbols: all after the change; before: symbols of `gone` before it.
    routes: HTTP_ROUTE edges before it.

    References are resolved again in the changed files, and elsewhere only where they name something that the change defines or
    did define: calls and bases by name, imports by the keys under which an added or removed file is found.
    """
    keys = ["name", "label", "qualified_name"]
    after = graph.cut(symbols.join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(*keys))
    before = graph.cut(before.select(*keys))
    names = graph.cut(after.subtract(before).unionByName(before.subtract(after)).select("name").distinct())
    naming = lambda kind, column: of_kind(found, kind).join(names.withColumnRenamed("name", column), column, "left_semi").select(F.col("file_path").alias("path"))
    specs, aliases = of_kind(found, "imports"), path_aliases(configs)
    if reconfigured:
        importing = graph.cut(gone.unionByName(specs.select(F.col("file_path").alias("path"))).distinct())
    else:  # an import can mean another file now if an added or removed one is among its candidates
        importing = graph.cut(gone.unionByName(resolve_imports(specs, moved, aliases).where("path is not null").select(F.col("file_path").alias("path"))).distinct())
    calling = graph.cut(importing.unionByName(naming("calls", "callee")).distinct())
    deriving = graph.cut(gone.unionByName(naming("bases", "base")).distinct())

    meant = resolve_imports(of_kind(_within(found, importing), "imports"), paths, aliases).withColumn("src", F.concat("file_path", F.lit("::File::"), "file_path"))
    imports = _edge(meant, "src", "dst", "IMPORTS", specifier=F.col("specifier"), kind=F.col("kind"), method=F.col("method"))
    calls = call_pass(project, paths, _within(found, calling), symbols, names, config)
    derived = inheritance_pass(project, paths, _within(found, deriving), symbols, names, config)

    functions = symbols.where("label = 'Function'")
    fresh = _within(found, gone)
    served = graph.cut(served_routes(of_kind(fresh, "routes"), functions))
    path = F.get_json_object("properties", "$.path").alias("path")
    is_gone = F.split_part("src", F.lit("::"), F.lit(1)) == F.col("path")
    old = graph.cut(routes.join(gone, is_gone, "left_semi").select(F.col("dst").alias("route"), path))
    new = served.select(F.col("dst").alias("route"), path)
    changed = not (new.subtract(old).isEmpty() and old.subtract(new).isEmpty())
    asking = graph.cut((gone.unionByName(of_kind(found, "clients").select(F.col("file_path").alias("path"))) if changed else gone).distinct())
    known = routes.join(gone, is_gone, "left_anti").select(F.col("dst").alias("route"), path).unionByName(new)
    linked = linked_calls(of_kind(_within(found, asking), "clients"), functions, known)

    # Folders above a changed file may come and go; each is an origin of its own.
    parts = F.split("path", "/", -1)
    above = lambda df: df.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path")).distinct()
    holding = graph.cut(above(gone))
    own = symbols.join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    contained = _edge(graph.structure(project, paths, own)[1], "src", "dst", "CONTAINS").join(holding, F.split_part("dst", F.lit("::"), F.lit(1)) == F.col("path"), "left_semi")
    return [
        (["CONTAINS"], contained, holding),
        (["IMPORTS"], imports, importing),
        (["CALLS"], calls, calling),
        (["HTTP_ROUTE"], served, gone),
        (["HTTP_CALLS"], linked, asking),
        (["INHERITS", "IMPLEMENTS", "DECORATES"], derived, deriving),
    ]


def read_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is found in the files, each read once, and the symbols among it (of equal names the one that ends first)."""
    found = graph.cut(findings(files))
    return found, graph.cut(graph.first_by(of_kind(found, "symbols"), ["qualified_name"], ["line_end", "signature"]))

"""One object with a method for each tool of the engine."""

from __future__ import annotations

import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeweft.operators import graph, resolve, search, similarity, text
from codeweft.plans import passes, sqlgate
from codeweft.schema import EngineConfig
from codeweft.sources import discover
from codeweft.store import BUCKETS, Store, across, projects
from codeweft.streaming import watcher

#: Bytes of text that a part of a project holds about.
PART_BYTES = 64 << 20


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: EngineConfig | None = None) -> None:
        self.spark, self.root, self.config = spark, root, config or EngineConfig()

    def store(self, project: str) -> Store:
        return Store(self.spark, self.root, project)

    def index_repository(self, path: str, mode: str = "full", project: str | None = None) -> dict[str, int | str]:
        """Read a source tree, extract its symbols, derive its edges and switch the project to the result."""
        full = os.path.realpath(path)
        if self.config.allowed_root and not full.startswith(os.path.realpath(self.config.allowed_root) + os.sep):
            raise PermissionError(f"{path} lies outside {self.config.allowed_root}")
        store = self.store(project or discover.project_name(path))
        files = discover.read_tree(self.spark, path, mode)
        return self._index(store, files, discover.git_changes(self.spark, path)[0], full)

    def _index(self, store: Store, files: DataFrame, head: str, path: str = "") -> dict[str, int | str]:
        files = graph.cut(files)
        found, symbols = passes.read_files(files)
        edges = passes.derive(store.project, files, found, symbols, self.config)
        edges = graph.cut(graph.first_by(edges, ["src", "dst", "edge_type"], ["properties"]))
        members, vectors = self._statistics(symbols, edges)
        size = files.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("n")).first()["n"]
        buckets = max(BUCKETS, min(text.N_BLOCKS, 1 << (int(size) // PART_BYTES).bit_length()))
        words = graph.cut(text.postings(files))
        store.replace(buckets, files=files, findings=found, symbols=symbols, edges=edges, members=members, vectors=vectors, postings=words, blocks=text.word_blocks(words))
        self._mark(store, path, head)
        return {"project": store.project, "files": files.count(), "symbols": symbols.count(), "edges": edges.count()}

    def _statistics(self, symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Communities and vectors, which follow from the symbols and edges of the whole project and no text."""
        members = graph.communities(symbols, edges, self.config.community_algorithm, self.config.community_resolution)
        return members, similarity.symbol_vectors(symbols.where("label in ('Function', 'Class')"))

    def _mark(self, store: Store, path: str, head: str) -> None:
        """When and from where the project was indexed."""
        now = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        told = {"indexed_at": now, "indexed_head": head} | ({"repo_path": path} if path else {})
        store.upsert("meta", self.spark.createDataFrame(list(told.items()), "key string, value string"), ["key"])

    def index_changes(self, path: str, project: str | None = None) -> dict[str, int | str]:
        """Bring a project up to date with its tree: only files that differ from the commit indexed last are read."""
        name = project or discover.project_name(path)
        head, status = discover.git_changes(self.spark, path)
        told = text.merged_changes(discover.changed_since(self.spark, path, self.store(name).get_meta("indexed_head") or ""), status)
        return self._index_paths(name, path, told.select("path"), head)

    def _index_paths(self, name: str, path: str, paths: DataFrame, head: str) -> dict[str, int | str]:
        """Read these paths of a tree again, and forget those that are no longer there or not wanted."""
        told = paths.distinct()
        there = graph.cut(discover.wanted(discover.sized(self.spark, path, told)).select("path", "language"))
        lost = told.join(there, "path", "left_anti").join(self.store(name).read("files").select("path"), "path", "left_semi")
        return self.update_files(name, discover.read_listed(self.spark, path, there), lost, head=head)

    def watch(self, path: str, checkpoint: str, project: str | None = None, once: bool = False, base_ms: int = watcher.BASE_MS) -> StreamingQuery:
        """Keep a project up to date with its git tree: looked at with back-off, each batch of changed paths indexed.

        It begins at the commit indexed last. With `once` the stream ends when it has caught up. A batch that fails stops the query
        with its error; started again on the same checkpoint it takes the batch up anew.
        """
        name = project or discover.project_name(path)

        def batch(rows: DataFrame, number: int) -> None:
            # Looked up first: a commit made while the batch runs is then found again by index_changes().
            head = discover.git_changes(self.spark, path)[0]
            told = graph.cut(rows.select("path"))
            if not told.isEmpty():
                self._index_paths(name, path, told, head)

        changes = watcher.tree_changes(self.spark, path, self.store(name).get_meta("indexed_head") or None, base_ms)
        writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=watcher.TICK)).start()

    def update_files(self, project: str, changed: DataFrame, removed: DataFrame | None = None, statistics: bool = True, head: str | None = None) -> dict[str, int | str]:
        """Merge changed (path, content, language) and removed (path) files; no change, no work.

        Only the changed files' texts are read. Findings of all files are kept, so references elsewhere that name what has changed
        are resolved again from those, and only the parts of tables that hold touched files are written. The result is that of
        indexing the tree anew. statistics: find communities and vectors, which hang on all symbols and edges, again; else they stay
        as they are until refresh(). With semantic_enabled, pairs of alike symbols are scored again with them.
        """
        store = self.store(project)
        lined = changed.withColumn("line_count", F.size(text.lines(F.col("content"))).cast("long")).select("path", "content", "language", "line_count")
        lined = graph.cut(graph.first_by(lined, ["path"], ["content", "language"]))
        gone = lined.select("path") if removed is None else lined.select("path").unionByName(removed.select("path"))
        gone = graph.cut(gone.distinct())
        if gone.isEmpty():
            return {"project": project, "files": 0}
        names = store.read("files").select("path")
        paths = graph.cut(names.join(gone, "path", "left_anti").unionByName(lined.select("path")))
        moved = graph.cut(lined.select("path").join(names, "path", "left_anti").unionByName(gone.join(lined, "path", "left_anti").join(names, "path", "left_semi")))
        before = graph.cut(store.read("symbols", store.parts_of_files(gone)).join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi"))
        fresh, fresh_symbols = passes.read_files(lined)
        changes = [
            store.rows_of_files("files", lined, gone),
            store.rows_of_files("findings", fresh, gone),
            store.rows_of_files("symbols", fresh_symbols.withColumn("properties", F.lit(None).cast("string")), gone),
            *store.words_of_files(graph.cut(text.postings(lined)), gone),
        ]
        away = gone.select(F.col("path").alias("file_path"))
        found = store.read("findings").join(away, "file_path", "left_anti").unionByName(fresh)
        symbols = store.read("symbols").join(away, "file_path", "left_anti").unionByName(fresh_symbols.withColumn("properties", F.lit(None).cast("string")))
        config_names = F.element_at(F.split("path", "/", -1), -1).isin("tsconfig.json", "jsconfig.json")
        holders = graph.cut(paths.where(config_names))
        configs = store.read("files", store.parts_of_files(holders)).join(gone, "path", "left_anti").unionByName(lined).join(holders, "path", "left_semi")
        reconfigured = not gone.where(config_names).isEmpty()
        for types, rows, origins in passes.changed_edges(project, paths, configs, gone, moved, reconfigured, found, symbols, before, store.read_edges(["HTTP_ROUTE"]), self.config):
            changes.append(store.edges_of_files(graph.cut(graph.first_by(rows, ["src", "dst", "edge_type"], ["properties"])), types, origins))
        lost = before.select("qualified_name").join(fresh_symbols, "qualified_name", "left_anti")
        traces = store.read_edges(["RUNTIME_TRACE"])
        for end in ("src", "dst"):
            traces = traces.join(lost.withColumnRenamed("qualified_name", end), end, "left_anti")
        if store._of_types(["RUNTIME_TRACE"]):
            changes.append(("edges", traces, store._of_types(["RUNTIME_TRACE"])))
        store.commit(changes)
        if statistics:
            self.refresh(project)
        self._mark(store, "", store.get_meta("indexed_head") or "" if head is None else head)
        return {"project": project, "files": lined.count(), "symbols": fresh_symbols.count(), "edges": store.read("edges").count()}

    def refresh(self, project: str) -> None:
        """Find communities, vectors and (with semantic_enabled) alike symbols again, from symbols and edges alone."""
        store = self.store(project)
        symbols, edges = store.read("symbols"), store.read("edges")
        if self.config.semantic_enabled:
            kinds = ["SIMILAR_TO", "SEMANTICALLY_RELATED"]
            rest = edges.where(~F.col("edge_type").isin(*kinds))
            store.replace_edges(graph.cut(passes.semantic_pass(project, store.read("files"), store.read("findings"), symbols, rest, self.config)), kinds)
            edges = store.read("edges")
        members, vectors = self._statistics(symbols, edges)
        store.replace(members=members, vectors=vectors)

    def search_graph(self, project: str, **conditions) -> DataFrame:
        s = self.store(project)
        return search.search_page(s.read("symbols"), s.read("edges"), search.SearchFilter(**conditions))

    def trace_path(self, project: str, start: str, direction: str = "both", depth: int = 3) -> dict[str, DataFrame]:
        """nodes (qualified_name, level, place in order of discovery) and trace_edges, those met on the way."""
        s = self.store(project)
        if s.read("symbols").where(F.col("qualified_name") == start).isEmpty():
            raise KeyError(start)
        nodes = graph.discovery(s.read("symbols"), s.read("edges"), start, direction, depth)
        return {"nodes": nodes, "trace_edges": graph.trace_edges(s.read("edges"), nodes, direction, depth)}

    def semantic_search(self, project: str, query: str, limit: int = 20) -> DataFrame:
        """Symbols that the query's words find, best first, with their score and its signals."""
        s = self.store(project)
        return similarity.vector_search(s.read("vectors"), s.read("symbols"), self.spark.createDataFrame([(query,)], "text string"), limit, weights=self.config.weights)

    def find_symbols(self, names: list[str]) -> DataFrame:
        """Symbols of these names in any project."""
        return across(self.spark, self.root, self.spark.createDataFrame([(n,) for n in names], "qualified_name string"))

    def get_code_snippet(self, project: str, name: str) -> str:
        s = self.store(project)
        one = s.read("symbols").where(F.col("qualified_name") == name).join(s.read("files"), F.col("file_path") == F.col("path"))
        row = one.select(text.snippet(F.col("content"), F.col("line_start"), F.col("line_end")).alias("x")).first()
        return row["x"] if row else ""

    def search_code(self, project: str, pattern: str, limit: int = 20) -> DataFrame:
        """Files with the words of the pattern in a row, by the inverted index; texts are read of the files shown only. Where there is
        none, files that hold the pattern as it is written."""
        s = self.store(project)
        if not pattern or limit <= 0:
            return text.previews(s.read("files").limit(0), pattern or "")
        found = graph.cut(text.indexed_phrase(s.read("postings"), pattern).orderBy("path").limit(limit))  # at most `limit` rows
        if found.isEmpty():
            return text.scan_search(s.read("files"), pattern, limit)
        return text.previews(s.read("files", s.parts_of_files(found)).join(F.broadcast(found), "path", "left_semi"), pattern)

    def rank_code(self, project: str, query: str, limit: int = 20) -> DataFrame:
        """Rows (path, score): the files that fit the words of a query best, from the inverted index alone."""
        s = self.store(project)
        return text.ranked(s.read("postings"), s.read("blocks"), query, limit)

    def get_graph_schema(self, project: str) -> list[str]:
        return [r[0] for r in self.store(project).read("edges").select("edge_type").distinct().orderBy("edge_type").collect()]

    def get_architecture(self, project: str) -> dict[str, DataFrame]:
        s = self.store(project)
        symbols, edges = s.symbols_in_communities(), s.read("edges")
        members = symbols.select("qualified_name", F.get_json_object("properties", "$.community").cast("long").alias("community")).where("community is not null")
        return {
            "labels": symbols.groupBy("label").count().orderBy(F.desc("count"), "label"),
            "edge_types": edges.groupBy("edge_type").count().orderBy(F.desc("count"), "edge_type"),
            "first": symbols.where("label = 'Function'").orderBy("qualified_name").limit(10),
            "communities": graph.community_summary(members),
            "dead_code": graph.dead_code(symbols, edges),
        }

    def query_graph(self, project: str, sql: str) -> DataFrame:
        s = self.store(project)
        return sqlgate.query(self.spark, sql, {"symbols": s.symbols_in_communities(), "files_fts": s.read("files")} | {n: s.read(n) for n in ("edges", "files", "vectors", "meta")}, s.read("postings"))

    def list_projects(self) -> list[str]:
        return projects(self.spark, self.root)

    def delete_project(self, project: str) -> None:
        self.store(project).delete()

    def index_status(self, project: str) -> dict[str, int | bool]:
        s = self.store(project)
        counts = {n: s.read(n).count() for n in ("files", "symbols", "edges", "vectors")}
        return counts | {"indexed": counts["symbols"] > 0}

    def check_index_coverage(self, project: str, paths: list[str]) -> dict[str, int]:
        """How many of the paths are indexed, a path counting if an indexed one ends in it; 100 percent of none."""
        asked = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return text.coverage(self.store(project).read("files"), asked).first().asDict()

    def ingest_traces(self, project: str, traces: DataFrame) -> int:
        """Add RUNTIME_TRACE edges; returns how many complete items came in."""
        pairs = graph.runtime_edges(traces)
        self.store(project).insert_edges(pairs)
        return traces.where(" and ".join(f"coalesce({', '.join(c for c in names if c in traces.columns)}) is not null" for names in (("caller", "from", "src"), ("callee", "to", "dst")))).count()

    def manage_adr(self, project: str, action: str, content: str = "") -> str:
        s = self.store(project)
        if action == "set" and len(content.encode()) > 8000:
            raise ValueError("at most 8000 bytes")
        if action in ("set", "delete"):
            s.set_meta("adr", content if action == "set" else "")
        return s.get_meta("adr") or ""

    def detect_changes(self, project: str, path: str) -> dict[str, object]:
        """Files that differ from the commit indexed last or are changed in the working tree, each once."""
        head, changes = discover.git_changes(self.spark, path)
        before = self.store(project).get_meta("indexed_head") or ""
        merged = text.merged_changes(discover.changed_since(self.spark, path, before), changes)
        files = [r["path"] for r in merged.orderBy("path").collect()]
        return {"clean": not files, "files": files, "head_changed": bool(head) and head != before}

    # --- scan sessions ---------------------------------------------------------------------------------------------------

    def rlm_scan(self, project: str, size: int | None = None) -> dict[str, int | str]:
        """Read the project's files in chunks and keep them as a session; expired sessions and all but the newest ones go."""
        s, session = self.store(project), uuid.uuid4().hex
        told = graph.cut(text.scan_reasons(s.read("files")))
        read = told.where("reason is null")
        rows = graph.cut(text.chunks(read, size or self.config.chunk_lines).withColumn("session", F.lit(session)))
        reasons = {r["reason"]: r["n"] for r in told.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
        sums = read.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
        one = self.spark.createDataFrame([(session, project, sums["b"], sums["n"], sum(reasons.values()), reasons)], "session string, root_path string, total_bytes long, files_scanned long, files_skipped long, skip_reasons map<string, long>")
        all_sessions = s.read("sessions").unionByName(one.withColumn("created_at", F.current_timestamp()).select(*s.read("sessions").columns))
        kept = graph.cut(text.retained(all_sessions, F.current_timestamp(), self.config.session_ttl_seconds, self.config.session_limit))
        s.replace(sessions=kept, chunks=s.read("chunks").unionByName(rows.select(*s.read("chunks").columns)).join(kept.select("session"), "session", "left_semi"))
        return {"session": session, "chunks": rows.count(), "files_scanned": sums["n"], "total_bytes": sums["b"]}

    def rlm_session_list(self, project: str) -> DataFrame:
        """Sessions that have not expired, the newest first."""
        return text.retained(self.store(project).read("sessions"), F.current_timestamp(), self.config.session_ttl_seconds, self.config.session_limit)

    def rlm_session_delete(self, project: str, session: str) -> None:
        s = self.store(project)
        if s.read("sessions").where(F.col("session") == session).isEmpty():
            raise KeyError(session)
        s.replace(sessions=s.read("sessions").where(F.col("session") != session), chunks=s.read("chunks").where(F.col("session") != session))

    def _chunks(self, project: str, session: str) -> DataFrame:
        return self.store(project).read("chunks").where(F.col("session") == session)

    def rlm_chunk(self, project: str, session: str, offset: int = 0, limit: int = 3) -> DataFrame:
        return self._chunks(project, session).orderBy("path", "offset").offset(offset).limit(limit)

    def rlm_peek(self, project: str, session: str, query: str) -> DataFrame:
        return text.peek(self._chunks(project, session), query)

    def rlm_filter(self, project: str, **conditions) -> DataFrame:
        """The symbols to read next, with their total."""
        return self.search_graph(project, **conditions)

    def rlm_read_symbol(self, project: str, name: str) -> dict[str, DataFrame]:
        """A symbol with its code and the edges that leave it."""
        s = self.store(project)
        one = self.spark.createDataFrame([(name,)], "qualified_name string")
        return {"symbol": text.read_symbol(s.read("symbols"), s.read("files"), s.read("edges"), one), "calls": s.read("edges").where(F.col("src") == name)}

    def rlm_reduce(self, project: str) -> dict[str, DataFrame]:
        return self.get_architecture(project)

    @staticmethod
    def rlm_workflow(phase: str = "filter") -> dict[str, object]:
        """What to do in a phase: narrow down, read symbol by symbol, put together."""
        steps = {
            "filter": ["index the repository", "narrow symbols down with rlm_filter or search_graph", "keep their qualified names"],
            "map": ["read each symbol with rlm_read_symbol", "follow calls with trace_path", "read other files with rlm_scan and rlm_chunk"],
            "reduce": ["take the architecture with rlm_reduce", "put the findings together"],
        }
        if phase not in steps:
            raise ValueError(f"phase is one of {', '.join(steps)}")
        return {"phase": phase, "steps": steps[phase]}

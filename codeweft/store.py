"""Projects as versioned Parquet tables in parts: a write makes new versions of the parts it touches, and a small numbered file then
names the version of each part.

A part holds the rows of some files (edges: of some files and one type), so a change of a few files rewrites a few parts. All files
are reached through Hadoop's file systems, so a project can lie wherever Spark reads and writes.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft import schema
from codeweft.operators import text
from codeweft.operators.graph import cut, first_by

_TABLES = {
    "symbols": schema.SYMBOLS, "edges": schema.EDGES, "files": schema.FILES, "vectors": schema.VECTORS, "meta": schema.META,
    "sessions": schema.SESSIONS, "chunks": schema.CHUNKS, "jobs": schema.JOBS, "postings": schema.POSTINGS, "findings": schema.FINDINGS, "members": schema.MEMBERS, "blocks": schema.BLOCKS,
}
_POINTER = "current-"
#: Parts that a project's files are dealt to unless it says otherwise (a power of two); seconds that a writer waits for another one's pointer.
BUCKETS, PATIENCE = 16, 5.0


def origin(name: str | Column) -> Column:
    """The file (or folder) that a qualified name begins with."""
    return F.split_part(F.col(name) if isinstance(name, str) else name, F.lit("::"), F.lit(1))


def edge_origin() -> Column:
    """The file that an edge was found in: that of its source, but of its target for what contains it."""
    return origin(F.when(F.col("edge_type") == "CONTAINS", F.col("dst")).otherwise(F.col("src")))


class Folder:
    """Small files and names in a folder of any of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, content: str) -> bool:
        """Whether the file is new: an existing one is left as it is, which the file system sees to."""
        try:
            stream = self.fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        stream.write(bytearray(content.encode()))
        stream.close()
        return True

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._at(name), True)

    def size(self, name: str) -> int:
        at = self._at(name)
        return self.fs.getContentSummary(at).getLength() if self.fs.exists(at) else 0


class Store:
    """Tables of one project in a folder. Readers see the versions named last; versions before them are left until vacuum()."""

    def __init__(self, spark: SparkSession, root: str, project: str) -> None:
        self.spark, self.project, self.path = spark, project, f"{root.rstrip('/')}/project={project}"
        self.folder = Folder(spark, self.path)

    # --- the pointer -----------------------------------------------------------------------------------------------------

    def _pointers(self) -> list[int]:
        return sorted(int(n[len(_POINTER) :]) for n in self.folder.names() if n.startswith(_POINTER) and n[len(_POINTER) :].isdigit())

    def _manifest(self, writing: bool = False) -> tuple[int, dict]:
        """Number and content of the last pointer. One that is still being written does not count for readers; a writer waits for it,
        and takes it for abandoned after a while."""
        began, nothing = time.time(), {"buckets": BUCKETS, "loose": False, "tables": {}}
        while True:
            last = self._pointers()
            for n in reversed(last):
                try:
                    return last[-1], json.loads(self.folder.read(f"{_POINTER}{n}"))
                except ValueError:
                    if writing and time.time() - began < PATIENCE:
                        break
            else:
                return (last[-1] if last else 0), nothing
            time.sleep(0.2)

    def commit(self, changes: list[tuple[str, DataFrame, Iterable[str] | None]], buckets: int | None = None, loose: bool = False) -> None:
        """Write rows of tables and switch to all of them at once; another writer's switch in between is an error.

        A change is a table, its rows, and the parts that these are all rows of (None: of all parts). buckets: deal files to so many
        parts from now on, for which all tables of files have to be written.
        """
        last, manifest = self._manifest(writing=True)
        manifest["buckets"], manifest["loose"] = buckets or manifest["buckets"], manifest["loose"] or loose
        for name, df, touched in changes:
            version = uuid.uuid4().hex
            rows = df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in _TABLES[name]])
            dealt = rows.withColumn("part", self.part(name, manifest["buckets"])).repartition("part")
            dealt = dealt.sortWithinPartitions("part", "word") if name == "postings" else dealt  # a word is then in few row groups
            dealt.write.partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/{name}/{version}")
            there = {n[len("part=") :]: version for n in self.folder.names(f"{name}/{version}") if n.startswith("part=")}
            gone = set(touched) if touched is not None else None
            stay = {} if gone is None else {p: v for p, v in manifest["tables"].get(name, {}).items() if p not in gone}
            manifest["tables"][name] = stay | there
        if not self.folder.write(f"{_POINTER}{last + 1}", json.dumps(manifest)):
            raise RuntimeError(f"project {self.project} was written by someone else meanwhile")

    # --- parts -----------------------------------------------------------------------------------------------------------

    @property
    def buckets(self) -> int:
        return self._manifest()[1]["buckets"]

    @staticmethod
    def bucket(file: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(file), F.lit(buckets)).cast("string")

    @staticmethod
    def part(name: str, buckets: int) -> Column:
        """The part that a row of a table belongs to."""
        file = {"files": F.col("path"), "postings": F.col("path"), "findings": F.col("file_path"), "symbols": origin("qualified_name"), "vectors": origin("qualified_name")}.get(name)
        if name == "edges":
            return F.concat(F.regexp_replace("edge_type", "[^A-Za-z0-9_]", "_"), F.lit("-"), Store.bucket(edge_origin(), buckets))
        if name == "chunks":
            return F.col("session")
        if name == "blocks":
            return F.pmod(F.col("block"), F.lit(buckets)).cast("string")  # runs of blocks are those of the paths' own hashes
        return F.lit("all") if file is None else Store.bucket(F.coalesce(file, F.lit("")), buckets)

    def parts_of(self, name: str, rows: DataFrame) -> list[str]:
        """The parts that rows with the columns of a table's key lie in; at most as many as there are parts."""
        return [r["part"] for r in rows.select(self.part(name, self.buckets).alias("part")).distinct().collect()]

    def parts_of_files(self, paths: DataFrame, types: list[str] | None = None) -> list[str]:
        """The parts of some files' (path) rows, or of their edges of some types."""
        found = [r["b"] for r in paths.select(self.bucket(F.col("path"), self.buckets).alias("b")).distinct().collect()]
        return found if types is None else [f"{t}-{b}" for t in types for b in found]

    def read(self, name: str, parts: Iterable[str] | None = None) -> DataFrame:
        """A table, or some of its parts."""
        there = self._manifest()[1]["tables"].get(name, {})
        paths = [f"{self.path}/{name}/{v}/part={p}" for p, v in there.items() if parts is None or p in set(parts)]
        return self.spark.read.schema(_TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], _TABLES[name])

    def read_edges(self, types: Iterable[str]) -> DataFrame:
        """Edges of some types: only their parts are opened."""
        types = list(types)
        starts = tuple(f"{t}-" for t in types)
        parts = [p for p in self._manifest()[1]["tables"].get("edges", {}) if p.startswith(starts)]
        return self.read("edges", parts).where(F.col("edge_type").isin(*types))

    # --- writes ----------------------------------------------------------------------------------------------------------

    def replace(self, buckets: int | None = None, **tables: DataFrame) -> None:
        """New versions of whole tables."""
        self.commit([(n, df, None) for n, df in tables.items()], buckets)

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Last write wins: rows of these keys are replaced. Only the parts that they lie in are read and written."""
        schema_ = _TABLES[name]
        full = cut(rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema_]))
        touched = self.parts_of(name, full)
        loose = name == "symbols" and not full.where(F.col("file_path").isNull() | (origin("qualified_name") != F.col("file_path"))).isEmpty()
        self.commit([(name, self.read(name, touched).join(full.select(*keys), keys, "left_anti").select(*full.columns).unionByName(full), touched)], loose=loose)

    @staticmethod
    def _edges(rows: DataFrame) -> DataFrame:
        return rows.select("src", "dst", "edge_type", F.col("properties") if "properties" in rows.columns else F.lit(None).cast("string").alias("properties"))

    def insert_edges(self, rows: DataFrame) -> None:
        """First write wins: an edge of the same ends and type stays as it is."""
        new = cut(self._edges(rows))
        touched = self.parts_of("edges", new)
        both = self.read("edges", touched).withColumn("__old", F.lit(0)).unionByName(new.withColumn("__old", F.lit(1)))
        self.commit([("edges", first_by(both, ["src", "dst", "edge_type"], ["__old", "properties"]).drop("__old"), touched)])

    def _of_types(self, types: list[str]) -> list[str]:
        starts = tuple(f"{t}-" for t in types)
        return [p for p in self._manifest()[1]["tables"].get("edges", {}) if p.startswith(starts)]

    def replace_edges(self, rows: DataFrame, types: list[str]) -> None:
        """All edges of these types become these rows; parts of other types are not read."""
        self.commit([("edges", self._edges(rows), [*self._of_types(types), *self.parts_of("edges", self._edges(rows))])])

    def edges_of_files(self, rows: DataFrame, types: list[str], paths: DataFrame) -> tuple[str, DataFrame, list[str]]:
        """The change after which the edges of these types found in these files (path) are these rows, for commit()."""
        touched = self.parts_of_files(paths, types)
        stay = self.read("edges", touched).join(paths.select(F.col("path").alias("__o")), edge_origin() == F.col("__o"), "left_anti")
        return "edges", self._edges(stay).unionByName(self._edges(rows)), touched

    def rows_of_files(self, name: str, rows: DataFrame, paths: DataFrame) -> tuple[str, DataFrame, list[str]]:
        """The change after which a table's rows of these files (path) are these rows, for commit()."""
        key = {"files": F.col("path"), "postings": F.col("path"), "findings": F.col("file_path"), "symbols": F.col("file_path"), "vectors": origin("qualified_name")}[name]
        loose = name == "symbols" and self._manifest()[1]["loose"]
        touched = list(self._manifest()[1]["tables"].get(name, {})) if loose else self.parts_of_files(paths)
        stay = self.read(name, touched).join(paths.select(F.col("path").alias("__p")), key == F.col("__p"), "left_anti")
        return name, stay.unionByName(rows.select(*stay.columns)), list({*touched, *self.parts_of_files(paths)})

    def upsert_files(self, files: DataFrame) -> None:
        """Replace these files' rows and their postings in the inverted index; parts of other files are not touched."""
        lined = cut(files)
        gone = lined.select("path")
        self.commit([self.rows_of_files("files", lined.select(*[f.name for f in schema.FILES]), gone), *self.words_of_files(text.postings(lined), gone)])

    def words_of_files(self, rows: DataFrame, paths: DataFrame) -> list[tuple[str, DataFrame, list[str]]]:
        """The changes after which the postings of these files (path) are these rows; bounds of blocks follow."""
        name, new, touched = self.rows_of_files("postings", rows, paths)
        return [(name, new, touched), ("blocks", text.word_blocks(new), touched)]

    def delete_files(self, paths: DataFrame) -> None:
        """Drop files, their findings, symbols, vectors and postings, and the edges that touch those symbols."""
        paths = cut(paths.select("path").distinct())
        changes = [self.rows_of_files(n, self.read(n).limit(0), paths) for n in ("files", "findings", "symbols")]
        changes += self.words_of_files(self.read("postings").limit(0), paths)
        known = self.read("symbols", None if self._manifest()[1]["loose"] else self.parts_of_files(paths))
        gone = cut(known.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("qualified_name"))
        vectors = self.parts_of("vectors", gone)
        changes.append(("vectors", self.read("vectors", vectors).join(gone, "qualified_name", "left_anti"), vectors))
        ends = lambda c: F.col(c) == F.col("qualified_name")
        edges = self.read("edges")
        struck = cut(edges.join(gone, ends("src"), "left_semi").unionByName(edges.join(gone, ends("dst"), "left_semi")).distinct())
        touched = self.parts_of("edges", struck)
        changes.append(("edges", self.read("edges", touched).join(struck, ["src", "dst", "edge_type"], "left_anti"), touched))
        self.commit(changes)

    def delete_edges(self, types: list[str]) -> None:
        self.replace_edges(self.spark.createDataFrame([], schema.EDGES), types)

    def delete_labels(self, labels: list[str]) -> None:
        """Drop the symbols of these labels; their edges stay."""
        self.replace(symbols=self.read("symbols").where(~F.col("label").isin(*labels)))

    def clear_vectors(self) -> None:
        self.replace(vectors=self.spark.createDataFrame([], schema.VECTORS))

    def clear(self) -> None:
        """Empty every table; the project stays."""
        self.replace(**{n: self.spark.createDataFrame([], t) for n, t in _TABLES.items()})

    # --- reads -----------------------------------------------------------------------------------------------------------

    def symbols_in_communities(self) -> DataFrame:
        """Symbols with the number of their community in properties, where communities were found."""
        if not self._manifest()[1]["tables"].get("members"):
            return self.read("symbols")
        told = self.read("members").select("qualified_name", F.to_json(F.struct("community")).alias("__told"))
        return self.read("symbols").join(told, "qualified_name", "left").withColumn("properties", F.coalesce("__told", "properties")).select(*[f.name for f in schema.SYMBOLS])

    def vectors_with_symbols(self) -> DataFrame:
        return self.read("vectors").join(self.read("symbols"), "qualified_name")

    def set_meta(self, key: str, value: str) -> None:
        self.upsert("meta", self.spark.createDataFrame([(key, value)], "key string, value string"), ["key"])

    def get_meta(self, key: str) -> str | None:
        row = self.read("meta").where(F.col("key") == key).first()
        return row["value"] if row else None

    def vacuum(self) -> None:
        """Remove versions that are not current."""
        for k in self._pointers()[:-1]:
            self.folder.delete(f"{_POINTER}{k}")
        for name, parts in self._manifest()[1]["tables"].items():
            for version in self.folder.names(name):
                gone = set(self.folder.names(f"{name}/{version}")) - {f"part={p}" for p, v in parts.items() if v == version}
                for part in gone if version in parts.values() else ():
                    self.folder.delete(f"{name}/{version}/{part}")
                if version not in parts.values():
                    self.folder.delete(f"{name}/{version}")

    def export(self, folder: str) -> dict[str, dict[str, int]]:
        """Write the tables and a manifest with their rows and bytes; import_from reads them where there is no project yet."""
        told, out = {}, Folder(self.spark, folder)
        for name, parts in self._manifest()[1]["tables"].items():
            if not parts:
                continue
            df = self.symbols_in_communities() if name == "symbols" else self.read(name)
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
            told[name] = {"rows": df.count(), "bytes": out.size(name)}
        out.delete("manifest.json")
        out.write("manifest.json", json.dumps({"project": self.project, "tables": told, "bytes": sum(t["bytes"] for t in told.values())}))
        return told

    def import_from(self, folder: str) -> bool:
        at = Folder(self.spark, folder)
        if self._manifest()[1]["tables"] or "manifest.json" not in at.names():
            return False
        names = set(at.names())
        self.replace(**{n: self.spark.read.parquet(f"{folder}/{n}") for n in _TABLES if n in names})
        return True

    def delete(self) -> None:
        self.folder.delete()


def projects(spark: SparkSession, root: str) -> list[str]:
    return [n.partition("=")[2] for n in Folder(spark, root).names() if n.startswith("project=")]


def across(spark: SparkSession, root: str, names: DataFrame) -> DataFrame:
    """Symbols of these names (qualified_name) in any project, with the project; of several the first project by name counts.

    One scan over the parts of all projects in which the names can lie, whatever the number of projects; the project is read off
    the files' places.
    """
    names, paths, known = cut(names), [], {}
    for name in projects(spark, root):
        store = Store(spark, root, name)
        _, manifest = store._manifest()
        if manifest["buckets"] not in known:  # projects of as many parts have the names in the same ones
            known[manifest["buckets"]] = set(store.parts_of("symbols", names))
        parts = None if manifest["loose"] else known[manifest["buckets"]]
        paths += [f"{store.path}/symbols/{v}/part={p}" for p, v in manifest["tables"].get("symbols", {}).items() if parts is None or p in parts]
    if not paths:
        return spark.createDataFrame([], schema.SYMBOLS).withColumn("project", F.lit(None).cast("string"))
    rows = spark.read.schema(schema.SYMBOLS).parquet(*paths).withColumn("project", F.regexp_extract("_metadata.file_path", "/project=([^/]+)/", 1))
    return first_by(rows.join(F.broadcast(names) if names.count() <= 100_000 else names, "qualified_name", "left_semi"), ["qualified_name"], ["project"])

"""Text search, snippets and chunks over files (path, content, ...)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import patterns as P
from codeweft.functions.text import lines
from codeweft.operators.graph import cut


def _folded(text: Column) -> Column:
    """Words parted by one space, with a space at both ends: a phrase is then a substring."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _hit(files: DataFrame, pattern: str) -> DataFrame:
    """path, line_number and preview of the first line with the pattern: as written, else whatever its case, else line 1."""
    rows = lines(F.col("content"))
    exact = F.array_position(F.transform(rows, lambda x: x.contains(F.lit(pattern))), True)
    loose = F.array_position(F.transform(rows, lambda x: F.lower(x).contains(F.lower(F.lit(pattern)))), True)
    at = F.when(exact > 0, exact).when(loose > 0, loose).otherwise(F.lit(1)).cast("long")
    return files.withColumn("line_number", at).select("path", "line_number", F.left(F.coalesce(F.get(rows, at.cast("int") - 1), F.lit("")), F.lit(200)).alias("preview"))


def phrase_search(files: DataFrame, pattern: str, limit: int | None = 20) -> DataFrame:
    """Files in whose path or content the words of the pattern follow each other, in order of path; limit None: all."""
    words = _folded(F.lit(pattern))
    found = files.where((F.length(F.trim(words)) > 0) & (_folded(F.col("path")).contains(words) | _folded(F.col("content")).contains(words)))
    return _hit(found if limit is None else found.orderBy("path").limit(limit), pattern)


def scan_search(files: DataFrame, pattern: str, limit: int | None = 20) -> DataFrame:
    """Files with the pattern as written inside one line, in order of path, with the first such line."""
    found = files.where(F.exists(lines(F.col("content")), lambda x: x.contains(F.lit(pattern))) & (F.lit(pattern) != ""))
    return _hit(found if limit is None else found.orderBy("path").limit(limit), pattern)


def previews(files: DataFrame, pattern: str) -> DataFrame:
    """Rows (path, line_number, preview) of these files for a pattern that was found in them."""
    return _hit(files, pattern)


def search_code(files: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    """Phrase search, and where it finds nothing the scan."""
    if not pattern or limit <= 0:
        return _hit(files.limit(0), pattern or "")
    found = cut(phrase_search(files, pattern, limit))  # at most `limit` rows
    return scan_search(files, pattern, limit) if found.isEmpty() else found


#: Blocks that files fall into by the hash of their path; a project's parts are runs of them.
N_BLOCKS = 4_096


def postings(files: DataFrame) -> DataFrame:
    """Rows (word, path, places, tf, length, block): the inverted index of contents and paths.

    Places count from 0; those of the path are negative. tf: how many there are; length: words of the file, path among them. The
    row of the empty word is the file itself.
    """
    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    split = files.select("path", F.coalesce(words("content"), F.array().cast("array<string>")).alias("inside"), words("path").alias("named"))
    split = split.withColumns({"length": F.size("inside") + F.size("named"), "block": F.pmod(F.xxhash64("path"), F.lit(N_BLOCKS)).cast("int")})
    schema = "word string, path string, places array<int>, tf int, length int, block int"

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A file's words with their places, made where the file is read."""

        def told() -> pa.RecordBatch:
            other = [batch.column(k).take(pa.array(np.repeat(rows, sizes))) for k in (0, 3, 4)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tf)]), pa.int32()), pa.array(at, pa.int32()), mask=pa.array(np.array(tf) == 0))
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), other[0], lists, pa.array(tf, pa.int32()), other[1], other[2]], names=["word", "path", "places", "tf", "length", "block"])

        for batch in batches:
            rows, sizes, found, tf, at = [], [], [], [], []
            for row, (inside, named) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                named, own = named.as_py() or [], {}
                for k, word in enumerate(named, -len(named) - 1):
                    own.setdefault(word, []).append(k)
                for k, word in enumerate(inside.as_py()):
                    own.setdefault(word, []).append(k)
                rows.append(row)
                sizes.append(len(own) + 1)
                found += ["", *own.keys()]
                tf.append(0)  # the file itself
                for where in own.values():
                    tf.append(len(where))
                    at += where
                if len(at) >= 100_000:
                    yield told()
                    rows, sizes, found, tf, at = [], [], [], [], []
            if found:
                yield told()

    whole = split.select("path", "inside", "named", "length", "block")
    several = files.groupBy("path").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("path").alias("__path"))
    keys = ["path", "length", "block"]
    if several.isEmpty():
        return whole.mapInArrow(places, schema)
    # Files of one path share their rows.
    same = F.col("path").eqNullSafe(F.col("__path"))
    shared = whole.join(several, same, "left_semi").mapInArrow(places, schema)
    merged = shared.select("word", *keys, F.explode("places").alias("at")).groupBy("word", *keys).agg(F.sort_array(F.collect_list("at")).alias("places")).select("word", "path", "places", F.size("places").alias("tf"), "length", "block")
    return whole.join(several, same, "left_anti").mapInArrow(places, schema).unionByName(merged).unionByName(shared.where("word = ''"))


def word_blocks(index: DataFrame) -> DataFrame:
    """Rows (word, block, files, most, least): of the files of a block that have a word, their number, the most occurrences and the
    fewest words. From these follows how well a file of the block can fit at best."""
    return index.where("word <> ''").groupBy("word", "block").agg(F.count(F.lit(1)).alias("files"), F.max("tf").alias("most"), F.min("length").alias("least"))


def _words(pattern: str) -> list[str]:
    return re.findall(r"[^\W_]+", pattern.lower())


def indexed_phrase(index: DataFrame, pattern: str) -> DataFrame:
    """Rows (path) of the files in which the words of the pattern follow each other, from the inverted index alone.

    Only the postings of the pattern's words are read; a file's places are shifted by the word's place in the pattern, and a
    place that all words share is an occurrence.
    """
    words = _words(pattern)
    if not words:
        return index.select("path").limit(0)
    shifts = index.sparkSession.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, shift int")
    known = index.where(F.col("word").isin(*words)).select("word", "path", "places")
    met = known.join(F.broadcast(shifts), "word").select("path", "shift", F.explode("places").alias("p")).withColumn("start", F.col("p") - F.col("shift"))
    return met.where((F.col("p") >= 0) == (F.col("start") >= 0)).groupBy("path", "start").agg(F.countDistinct("shift").alias("n")).where(F.col("n") == len(words)).select("path").distinct()


def matching(index: DataFrame, query: str) -> DataFrame:
    """Rows (path) of the files that fit a full-text query, from the inverted index alone.

    Terms are words, "phrases" and beginnings*; all of them have to fit, none after NOT may, and OR parts alternatives.
    """
    out = None
    for group in re.split(r"\s+OR\s+", query.strip()):
        found, refused, no = None, [], False
        for term in re.findall(r'"[^"]*"\*?|\S+', group):
            if term in ("AND", "NOT"):
                no = term == "NOT"
                continue
            words = _words(term)
            if len(words) == 1 and term.rstrip('"').endswith("*"):
                paths = index.where(F.col("word").startswith(words[0])).select("path").distinct()
            else:
                paths = indexed_phrase(index, term)
            if no:
                refused.append(paths)
            else:
                found = paths if found is None else found.join(paths, "path", "left_semi")
            no = False
        if found is None:  # nothing is asked for
            found = index.select("path").limit(0)
        for paths in refused:
            found = found.join(paths, "path", "left_anti")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def ranked(index: DataFrame, blocks: DataFrame, query: str, limit: int = 20, k1: float = 1.2, b: float = 0.75, told: dict[str, int] | None = None) -> DataFrame:
    """Rows (path, score), best first: the files that fit the words of a query best by bm25, ties by path; from the index alone.

    The blocks of the highest bounds are scored first; blocks whose bound lies under the last score of these are not read. told, if
    given, gets the number of blocks that hold a word (blocks) and of those scored (scored).
    """
    spark, words = index.sparkSession, sorted(set(_words(query)))
    if not words or limit <= 0:
        return spark.createDataFrame([], "path string, score double")
    size = index.where("word = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    met = cut(blocks.where(F.col("word").isin(*words)))  # at most N_BLOCKS rows for each word of the query
    counts = {r["word"]: r["n"] for r in met.groupBy("word").agg(F.sum("files").alias("n")).collect()}
    weight = {w: max(1e-6, math.log((size["n"] - n + 0.5) / (n + 0.5))) for w, n in counts.items()}
    if not weight:
        return spark.createDataFrame([], "path string, score double")
    by_word = F.create_map(*[F.lit(x) for pair in weight.items() for x in pair])
    fit = lambda tf, length: by_word[F.col("word")] * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(length) / F.lit(float(size["mean"] or 1))))
    bounds = met.groupBy("block").agg(F.sum(fit("most", "least")).alias("bound"), F.max("files").alias("files")).collect()
    bounds.sort(key=lambda r: (-r["bound"], r["block"]))

    def best(chosen: list[int]) -> DataFrame:
        rows = index.where(F.col("word").isin(*words) & F.col("block").isin(*chosen)).select("word", "path", "tf", "length")
        return rows.groupBy("path").agg(F.sum(fit("tf", "length")).alias("score")).orderBy(F.desc("score"), "path").limit(limit)

    first, files = [], 0
    while len(first) < len(bounds) and files < 2 * limit:
        files += bounds[len(first)]["files"]
        first.append(bounds[len(first)]["block"])
    found = cut(best(first))  # at most `limit` rows
    scores = sorted((r["score"] for r in found.collect()), reverse=True)
    least = scores[limit - 1] if len(scores) >= limit else 0.0
    more = [r["block"] for r in bounds[len(first) :] if r["bound"] >= least * (1 - 1e-9)]
    if told is not None:
        told |= {"blocks": len(bounds), "scored": len(first) + len(more)}
    both = found.unionByName(best(more)) if more else found
    return both.orderBy(F.desc("score"), "path").limit(limit)


def snippet(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end; all of the text if the range is empty."""
    rows = lines(content)
    last = F.least(end, F.size(rows).cast("long"))
    part = F.array_join(F.slice(rows, start.cast("int"), F.greatest(last - start + 1, F.lit(0)).cast("int")), "\n")
    return F.when((start >= 1) & (last >= start), part).otherwise(content)


def chunks(files: DataFrame, size: int = 200) -> DataFrame:
    """Rows (path, offset, line_count, content) of `size` lines each; a file without lines has none."""
    rows = lines(F.col("content"))
    full = files.withColumn("__lines", rows).where(F.size("__lines") > 0)
    at = full.select("path", "__lines", F.explode(F.sequence(F.lit(0), F.size("__lines") - 1, F.lit(size))).alias("offset"))
    part = F.slice("__lines", F.col("offset") + 1, F.lit(size))
    return at.select("path", F.col("offset").cast("long").alias("offset"), F.size(part).cast("long").alias("line_count"), F.array_join(part, "\n").alias("content"))


def peek(pieces: DataFrame, query: str, first: int = 20) -> DataFrame:
    """The first chunks whose content or path holds the query."""
    return pieces.where(F.col("content").contains(query) | F.col("path").contains(query)).orderBy("path", "offset").limit(first)


def scan_reasons(files: DataFrame, total: int = P.SCAN_TOTAL_BYTES, file: int = P.SCAN_FILE_BYTES, other: int = P.SCAN_OTHER_BYTES) -> DataFrame:
    """Add reason: why a scan in order of path skips a file, null if it reads it. Paths are unique.

    The budget counts the files read before; once it is used up every later file is skipped.
    """
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    size = F.octet_length("content").cast("long")
    known = suffix.isin(*[f".{x}" for x in P.LANGUAGES])
    own = (
        F.when(name.isin(*P.SKIP_FILENAMES), "skip_filename")
        .when(suffix.isin(*P.SKIP_SUFFIXES), "binary_or_asset")
        .when(F.col("content").isNull(), "unreadable")
        .when(size > file, "file_too_large")
        .when(F.instr("content", "\0") > 0, "binary_or_unreadable")
        .when(~known & (size > other), "non_code_large")
    )
    sized = files.withColumn("__own", own).withColumn("__size", F.when(F.col("__own").isNull(), size).otherwise(0))
    # Paths are sorted in ranges; the sums of ranges, one row for each, give what was read before them.
    ranged = cut(sized.select("path", "__own", "__size").repartitionByRange("path").withColumn("__part", F.spark_partition_id()))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__part").agg(F.sum("__size").alias("__s")).select("__part", F.coalesce(F.sum("__s").over(upto), F.lit(0)).alias("__earlier"))
    inside = Window.partitionBy("__part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__earlier") + F.coalesce(F.sum("__size").over(inside), F.lit(0))
    told = ranged.join(F.broadcast(sums), "__part").select("path", F.when(before >= total, "budget_exhausted").otherwise(F.col("__own")).alias("reason"))
    return files.join(told, "path")


def retained(sessions: DataFrame, now: Column, ttl_seconds: int = 3600, newest: int = 50) -> DataFrame:
    """Sessions (session, created_at) not older than the time to live, the newest of them."""
    young = sessions.where(F.unix_timestamp("created_at") >= F.unix_timestamp(now) - ttl_seconds)
    return young.orderBy(F.desc("created_at"), "session").limit(newest)


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, change) of snapshots that differ: added, removed or modified."""
    a, b = old.select(F.col(key), F.col(value).alias("o"), F.lit(1).alias("p")), new.select(F.col(key), F.col(value).alias("n"), F.lit(1).alias("q"))
    change = F.when(F.col("p").isNull(), "added").when(F.col("q").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def merged_changes(*listed: DataFrame) -> DataFrame:
    """Rows (path, status, deleted) of several change lists, such as name-only differences and the working tree: of a path that
    is in more than one the last list counts."""
    out = None
    for k, df in enumerate(listed):
        rows = df.select("path", F.col("status") if "status" in df.columns else F.lit("M").alias("status"), F.col("deleted") if "deleted" in df.columns else F.lit(False).alias("deleted"), F.lit(k).alias("__k"))
        out = rows if out is None else out.unionByName(rows)
    last = out.groupBy("path").agg(F.max(F.struct("__k", "status", "deleted")).alias("m"))
    return last.select("path", "m.status", "m.deleted")


def coverage(files: DataFrame, asked: DataFrame) -> DataFrame:
    """One row (total, covered, percent): how many of the asked paths (path) are indexed, a path counting if an indexed one ends
    in it; 100 percent of none. Suffixes are met as keys, so both sides can be large."""
    wanted = asked.select("path").distinct()
    ends = F.transform(F.sequence(F.lit(1), F.length("path")), lambda k: F.substr(F.col("path"), k))
    sizes = [r[0] for r in wanted.select(F.length("path")).distinct().collect()]  # lengths of paths: a few hundred at most
    known = files.select(F.explode(F.filter(ends, lambda x: F.length(x).isin(*(sizes or [-1])))).alias("path")).distinct().withColumn("k", F.lit(1))
    n = wanted.join(known, "path", "left").agg(F.count(F.lit(1)).alias("total"), F.count("k").alias("covered"))
    percent = F.when(F.col("total") == 0, 100).otherwise(F.round(100 * F.col("covered") / F.col("total")))
    return n.select("total", "covered", percent.cast("long").alias("percent"))


def read_symbol(symbols: DataFrame, files: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (qualified_name, name, label, file_path, snippet, calls): the symbols of these names (qualified_name) with their
    lines of code and how many edges of each leave them."""
    mine = symbols.join(names, "qualified_name", "left_semi").select("qualified_name", "name", "label", "file_path", "line_start", "line_end")
    code = mine.join(files.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
    out = edges.join(names, F.col("src") == names["qualified_name"], "left_semi").groupBy(F.col("src").alias("qualified_name")).agg(F.count(F.lit(1)).alias("calls"))
    joined = code.join(out, "qualified_name", "left")
    return joined.select("qualified_name", "name", "label", "file_path", snippet(F.col("content"), F.col("line_start"), F.col("line_end")).alias("snippet"), F.coalesce("calls", F.lit(0)).cast("long").alias("calls"))


def delete_files(symbols: DataFrame, edges: DataFrame, files: DataFrame, vectors: DataFrame, paths: DataFrame) -> dict[str, DataFrame]:
    """The four tables without these files (path), their symbols and vectors, and the edges that touch those symbols."""
    gone = symbols.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("qualified_name")
    return {
        "edges": edges.join(gone.withColumnRenamed("qualified_name", "src"), "src", "left_anti").join(gone.withColumnRenamed("qualified_name", "dst"), "dst", "left_anti"),
        "vectors": vectors.join(gone, "qualified_name", "left_anti"),
        "files": files.join(paths.select("path"), "path", "left_anti"),
        "symbols": symbols.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti"),
    }

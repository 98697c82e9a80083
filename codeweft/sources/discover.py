"""Files of a source tree and their languages."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import patterns as P
from codeweft.functions.text import lines

PROJECT_PREFIX = "cw-"


def extension(path: Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(path, "/", -1), -1), r"\.([^.]+)$", 1)


def language(path: Column) -> Column:
    """Language of a path by its extension, null if unknown."""
    pairs = F.create_map(*[F.lit(x) for item in P.LANGUAGES.items() for x in item])
    return F.try_element_at(pairs, extension(path))


def wanted(files: DataFrame, mode: str = "full") -> DataFrame:
    """Files (path, size) that a mode indexes, with their language, in order of path.

    Known languages only, without lock files, binaries and skipped folders. moderate leaves out test and document folders;
    fast takes code up to 512 KiB only.
    """
    parts = F.split("path", "/", -1)
    folders, name = F.slice(parts, F.lit(1), F.size(parts) - 1), F.element_at(parts, -1)
    skip = P.SKIP_DIRS if mode != "full" else tuple(x for x in P.SKIP_DIRS if x not in ("dist", "build"))
    out = files.withColumn("language", language(F.col("path"))).where("language is not null")
    out = out.where(~name.isin(*P.SKIP_FILENAMES) & ~F.concat(F.lit("."), extension(F.col("path"))).isin(*P.SKIP_SUFFIXES))
    out = out.where(~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in skip])))
    if mode == "moderate":
        out = out.where(~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in P.MODERATE_SKIP_DIRS])))
    if mode == "fast":
        out = out.where((F.col("size") <= P.FAST_MAX_BYTES) & extension(F.col("path")).isin(*P.CODE_EXTENSIONS))
    return out.orderBy("path")


def _rule(text: str) -> tuple[bool, bool, re.Pattern] | None:
    """One line of an ignore file: whether it keeps, whether it is for folders only, and what paths below its folder it fits."""
    text = re.sub(r"(?<!\\)\s+$", "", text.rstrip("\r\n"))
    if not text or text.startswith("#"):
        return None
    keep, text = text.startswith("!"), text.removeprefix("!")
    folder, text = text.endswith("/"), text.rstrip("/")
    anchored, text = "/" in text, text.lstrip("/")
    out = "" if anchored or text.startswith("**/") else "(?:.*/)?"
    for part in re.findall(r"^\*\*/|/\*\*/|/\*\*$|\*+|\?|\[[!^]?\]?[^\]]*\]|\\.|[\s\S]", text):
        if part == "**/":
            out += "(?:.*/)?"
        elif part == "/**/":
            out += "/(?:.*/)?"
        elif part == "/**":
            out += "/.*"
        elif part[0] == "*":
            out += "[^/]*"
        elif part == "?":
            out += "[^/]"
        elif len(part) > 2 and part[0] == "[":
            out += "(?!/)[" + re.sub(r"^[!^]", "^", part[1:-1]).replace("\\", "\\\\") + "]"
        else:
            out += re.escape(part[-1])
    try:
        return keep, folder, re.compile(out)
    except re.error:  # a set that is none fits nothing
        return None


def _ignored(path: str, is_folder: bool, rules: list[tuple[str, tuple[bool, bool, re.Pattern]]]) -> bool:
    """Whether the last rule that fits a path excludes it. rules: the folder each stands in ('.' at the top), outer ones first."""
    hit = False
    for at, (keep, folder, pattern) in rules:
        below = path if at == "." else path[len(at) + 1 :] if path.startswith(at + "/") else None
        if below is not None and (is_folder or not folder) and pattern.fullmatch(below):
            hit = not keep
    return hit


def read_tree(spark: SparkSession, root: str, mode: str = "full") -> DataFrame:
    """Files (path, content, language, line_count) below a folder that driver and executors see. The driver lists names and
    sizes and reads ignore files, of which each counts for its folder and those below; executors read the texts."""

    def read_rules(at: str, *names: str) -> list[tuple[str, tuple[bool, bool, re.Pattern]]]:
        found = []
        for full in (n for n in names if os.path.isfile(n)):
            with open(full, encoding="utf-8", errors="replace") as f:
                found += [(at, rule) for rule in map(_rule, f) if rule]
        return found

    rules: dict[str, list] = {}  # of a folder: those of the folders above and its own
    listed = []
    for folder, names, files in os.walk(root):
        here = os.path.relpath(folder, root).replace(os.sep, "/")
        extra = [os.path.join(root, ".git/info/exclude")] if here == "." else []
        above = [] if here == "." else rules[os.path.dirname(here) or "."]
        rules[here] = above + read_rules(here, *extra, *(os.path.join(folder, n) for n in (".gitignore", ".codeweftignore")))
        below = lambda n: n if here == "." else f"{here}/{n}"  # noqa: B023, E731
        # What lies in an excluded folder can't be brought back, so it isn't looked at.
        names[:] = sorted(n for n in names if n not in (".git", "node_modules") and not _ignored(below(n), True, rules[here]))
        listed += [(below(f), os.path.getsize(os.path.join(folder, f))) for f in files if os.path.isfile(os.path.join(folder, f)) and not _ignored(below(f), False, rules[here])]
    kept = wanted(spark.createDataFrame(listed, "path string, size long"), mode).select("path", "language")
    return read_listed(spark, root, kept)


def sized(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """Those of the paths that are files below root, with their sizes; executors look."""
    base = os.path.realpath(root)

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            there = [(p, os.path.getsize(os.path.join(base, p))) for p in part["path"] if os.path.isfile(os.path.join(base, p))]
            yield pd.DataFrame(there, columns=["path", "size"]).astype({"size": "int64"})

    return paths.select("path").mapInPandas(look, "path string, size long")


def read_listed(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """Files (path, content, language, line_count) of the listed paths (path, language) below root, which executors read; texts
    that are not UTF-8 are left out."""
    base = os.path.realpath(root)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, kind in part.itertuples(index=False):
                try:
                    with open(os.path.join(base, path), encoding="utf-8", newline="") as f:
                        rows.append((path, f.read(), kind))
                except (UnicodeDecodeError, OSError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "content", "language"])

    texts = listed.select("path", "language").mapInPandas(read, "path string, content string, language string")
    return texts.withColumn("line_count", F.size(lines(F.col("content"))).cast("long"))


def parse_porcelain(lines: DataFrame) -> DataFrame:
    """Rows (status, path) from lines of `git status --porcelain`: a rename counts as its new path."""
    status, rest = F.trim(F.substring("line", 1, 2)), F.substring("line", 4, 1 << 20)
    path = F.when(F.instr(rest, " -> ") > 0, F.element_at(F.split(rest, " -> "), -1)).otherwise(rest)
    return lines.where(F.length("line") > 3).select(status.alias("status"), F.translate(path, '"', "").alias("path"), status.contains("D").alias("deleted"))


def git_changes(spark: SparkSession, root: str) -> tuple[str, DataFrame]:
    """HEAD and the porcelain status of a working tree; no git, no changes."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=False)
    head, status = run("rev-parse", "HEAD"), run("status", "--porcelain")
    rows = [(x,) for x in status.stdout.splitlines()] if status.returncode == 0 else []
    return head.stdout.strip() if head.returncode == 0 else "", parse_porcelain(spark.createDataFrame(rows, "line string"))


def changed_since(spark: SparkSession, root: str, commit: str) -> DataFrame:
    """Rows (path) of the files that differ from a commit, by name only; no git or no such commit, no rows."""
    told = subprocess.run(["git", "-C", root, "diff", "--name-only", commit], capture_output=True, text=True, check=False) if commit else None
    rows = [(x,) for x in told.stdout.splitlines() if x] if told is not None and told.returncode == 0 else []
    return spark.createDataFrame(rows, "path string")


def project_name(path: str) -> str:
    import hashlib

    full = os.path.realpath(path)
    return f"{PROJECT_PREFIX}{os.path.basename(full)}-{hashlib.sha256(full.encode()).hexdigest()[:12]}"

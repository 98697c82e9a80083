"""Scalar expressions over strings, paths and URLs; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9_]{2,}"
# Marks counted as operators in a signature.
OPERATOR_MARKS = "(){}[];,:<>"


def glob_to_regex(pattern: str) -> str:
    """Anchored regex of a GLOB: * and ? cross every character, [..] and [^..] are sets; case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{inner}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def valid_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def ascii_fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines(content: Column) -> Column:
    """Lines without their ends; a last line break ends a line and begins none; the empty text has none."""
    body = F.regexp_replace(content, r"\r?\n\z", "")
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def line_of(text: Column, at: Column, compat: bool = False) -> Column:
    """Line of the character at a place (from 1). compat: a place inside a line counts as on the next one, as where a match
    that does not begin its line is told by the lines before it and one more."""
    before = F.substr(text, F.lit(1), (at - 1).cast("int"))
    ends = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    inside = (F.length(before) > 0) & ~before.endswith("\n")
    return (ends + 1 + (F.when(inside, 1).otherwise(0) if compat else 0)).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more ASCII letters, digits and underscores."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), F.lower)


def url_path(url: Column) -> Column:
    """Path of a URL without scheme, host and query (a fragment stays); null if there is no slash."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.split_part(bare, F.lit("?"), F.lit(1))
    return F.when(F.instr(path, "/") > 0, path).when(F.instr(url, "://") > 0, F.lit("/"))


def route_key(path: Column) -> Column:
    """Path with one leading slash and without one trailing slash; the root stays."""
    led = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when((F.length(led) > 1) & led.endswith("/"), F.substring(led, F.lit(1), F.length(led) - 1)).otherwise(led)


def normal_path(path: Column) -> Column:
    """Path with forward slashes and without empty, '.' and resolvable '..' parts."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        back = F.when((F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(part.isin("", "."), done).when(part == "..", F.when(F.size(done) > 0, back).otherwise(done)).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, empty, step), "/")


def parent_folder(path: Column) -> Column:
    """Everything before the last slash, empty at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit(""))


def path_proximity(a: Column, b: Column) -> Column:
    """Leading parts that two paths share, over the parts of the deeper one; 0 if either is empty."""
    x, y = F.split(a, "/", -1), F.split(b, "/", -1)
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, False)
    shared = F.when(first == 0, F.size(same)).otherwise(first - 1)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(shared / F.greatest(F.size(x), F.size(y)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all members of two sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, the longer one cut; 0 if either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def quantize(v: Column) -> Column:
    """Components cut to [-1, 1], times 127, rounded half away from zero."""
    return F.transform(v, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 127).cast("tinyint"))


def longest_identifier(text: Column) -> Column:
    """The first of the longest identifiers of at least four characters, cut to 96; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    fit = F.filter(found, lambda w: F.length(w) >= 4)
    best = F.aggregate(fit, F.lit(""), lambda b, w: F.when(F.length(w) > F.length(b), w).otherwise(b))
    return F.when(best != "", F.left(best, F.lit(96)))

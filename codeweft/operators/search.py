"""Structured symbol search with graph predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions.text import ascii_fold, glob_to_regex, valid_regex
from codeweft.operators.graph import cut


@dataclass
class SearchFilter:
    """All conditions must hold. limit None returns all matches. relationship restricts the graph conditions to one edge type; direction is out, in or any."""

    label: str | None = None
    file_pattern: str | None = None
    query: str | None = None
    name_pattern: str | None = None
    qn_pattern: str | None = None
    relationship: str | None = None
    direction: str = "any"
    min_degree: int | None = None
    max_degree: int | None = None
    exclude_entry_points: bool = False
    include_connected: bool = False
    limit: int | None = 200
    offset: int = 0


def _direction(name: str) -> str:
    return {"out": "out", "outbound": "out", "in": "in", "inbound": "in"}.get((name or "").lower(), "any")


def of_type(edges: DataFrame, relationship: str | None) -> DataFrame:
    return edges if relationship is None else edges.where(F.col("edge_type") == relationship)


def endpoints(edges: DataFrame, direction: str) -> DataFrame:
    """One row (qualified_name) for each end of an edge that the direction looks at, repeated ends kept."""
    out, into = edges.select(F.col("src").alias("qualified_name")), edges.select(F.col("dst").alias("qualified_name"))
    return {"out": out, "in": into}.get(direction, out.unionByName(into))


def degrees(edges: DataFrame, direction: str = "any") -> DataFrame:
    return endpoints(edges, direction).groupBy("qualified_name").agg(F.count(F.lit(1)).alias("degree"))


def _text(column: str, pattern: str) -> Column:
    return F.col(column).rlike(pattern) if valid_regex(pattern) else F.lit(False)


def matching(symbols: DataFrame, edges: DataFrame, f: SearchFilter) -> DataFrame:
    """All symbols that pass, before ordering and paging."""
    out = symbols
    if f.label is not None:
        out = out.where(F.col("label") == f.label)
    if f.file_pattern is not None:
        out = out.where(F.col("file_path").rlike(glob_to_regex(f.file_pattern)))
    if f.query:
        needle = ascii_fold(F.lit(f.query))
        fields = [ascii_fold(F.coalesce(F.col(c), F.lit(""))).contains(needle) for c in ("name", "qualified_name", "signature")]
        out = out.where(fields[0] | fields[1] | fields[2])
    if f.name_pattern is not None:
        out = out.where(_text("name", f.name_pattern))
    if f.qn_pattern is not None:
        out = out.where(_text("qualified_name", f.qn_pattern))
    direction, bound = _direction(f.direction), f.min_degree is not None or f.max_degree is not None
    if f.relationship is not None and not (bound and (f.min_degree or 0) >= 1):  # at least one edge implies it
        out = out.join(endpoints(of_type(edges, f.relationship), direction), "qualified_name", "left_semi")
    if bound:
        # Ends are counted where they stand before names meet, so a join sorts a row for each name rather than for each end.
        counted = degrees(of_type(edges, f.relationship), direction)
        degree = F.coalesce(F.col("degree"), F.lit(0))
        fit = (degree >= (f.min_degree or 0)) & (F.lit(True) if f.max_degree is None else degree <= f.max_degree)
        if (f.min_degree or 0) >= 1:
            out = out.join(counted.where(fit), "qualified_name", "left_semi")
        else:
            out = out.join(counted, "qualified_name", "left").where(fit).drop("degree")
    if f.exclude_entry_points:
        out = out.join(endpoints(of_type(edges, f.relationship or "CALLS"), "in"), "qualified_name", "left_semi")
    if f.include_connected:
        near = of_type(edges, f.relationship or "CALLS").select("src", "dst")
        found = cut(out.select("qualified_name"))
        ahead = near.join(found, F.col("src") == F.col("qualified_name"), "left_semi").select(F.col("dst").alias("qualified_name"))
        behind = near.join(found, F.col("dst") == F.col("qualified_name"), "left_semi").select(F.col("src").alias("qualified_name"))
        out = symbols.join(found.unionByName(ahead).unionByName(behind), "qualified_name", "left_semi")
    return out


def search(symbols: DataFrame, edges: DataFrame, f: SearchFilter) -> DataFrame:
    """The page of the matches in order of qualified_name."""
    page = matching(symbols, edges, f).orderBy("qualified_name")
    page = page.offset(f.offset) if f.offset else page
    return page if f.limit is None else page.limit(f.limit)


def search_page(symbols: DataFrame, edges: DataFrame, f: SearchFilter) -> DataFrame:
    """The page with total, limit, offset and has_more beside each row."""
    found = matching(symbols, edges, f)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    page = found.orderBy("qualified_name").offset(f.offset)
    page = page if f.limit is None else page.limit(f.limit)
    more = (F.lit(False) if f.limit is None else F.lit(f.offset + f.limit).cast("long") < F.col("total")).alias("has_more")
    return page.join(F.broadcast(total)).select(*symbols.columns, "total", F.lit(f.limit).cast("long").alias("limit"), F.lit(f.offset).cast("long").alias("offset"), more)


def lookup(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Symbols whose qualified_name is in the given rows (qualified_name)."""
    return symbols.join(names, "qualified_name", "left_semi")


def node_detail(edges: DataFrame, name: str) -> DataFrame:
    """Edges into and out of a node with their direction."""
    touching = edges.where((F.col("src") == name) | (F.col("dst") == name))
    return touching.select("src", "dst", "edge_type", F.when(F.col("src") == name, "out").otherwise("in").alias("direction"))

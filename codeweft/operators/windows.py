"""Window functions over partitions of any size: rows get their place in order by ranges, then blocks of them are worked on, each with
the rows near by that its own need. No task sees a whole partition of the window."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators.graph import kept

ROWS_OF_A_TASK = 500_000
ROWS_OF_A_BLOCK = 50_000


@dataclass(frozen=True)
class Call:
    """A call over a window: what is called, the window's PARTITION BY and ORDER BY, its frame of rows, and how many rows before and
    after its own it reads (None: dense_rank)."""

    text: str
    by: tuple[str, ...]
    order: tuple[str, ...]
    frame: str = ""
    reach: tuple[int, int] | None = None


def _order(term: str) -> tuple[str, str]:
    """The expression of a term of ORDER BY, and the method of a column that sorts so."""
    m = re.fullmatch(r"(?is)\s*(.*?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?\s*", term)
    way = (m[2] or "asc").lower()
    return m[1], f"{way}_nulls_{(m[3] or ('first' if way == 'asc' else 'last')).lower()}"


def _parts(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_OF_A_TASK))


def in_order(rows: DataFrame, order: list[Column], out: str, parts: int) -> DataFrame:
    """Add `out`: the place of each row in order, from 0. Ranges are sorted each in a task and kept; their sizes give their first places."""
    ranged, _ = kept(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id()))
    part = F.shiftright(out, 33).cast("int")
    sizes = dict(ranged.groupBy(part.alias("part")).count().collect())  # one row for each range
    starts = list(accumulate((sizes.get(k, 0) for k in range(max(sizes, default=0))), initial=0))
    return ranged.withColumn(out, F.get(F.lit(starts).cast("array<bigint>"), part) + F.col(out).bitwiseAND(F.lit((1 << 33) - 1)))


def _dense_rank(df: DataFrame, name: str, call: Call, parts: int) -> DataFrame:
    """The place of a row's key among the different keys of its partition."""
    terms = [(x, "asc_nulls_first") for x in call.by] + [_order(x) for x in call.order]
    keys = {f"{name}_{k}": x for k, (x, _) in enumerate(terms)}
    by, at = list(keys)[: len(call.by)], f"{name}_at"
    found = in_order(df.select(*[F.expr(x).alias(k) for k, x in keys.items()]).distinct(), [getattr(F.col(k), way)() for k, (_, way) in zip(keys, terms, strict=True)], at, parts)
    rank = F.col(at) + 1
    if by:
        first = found.groupBy(*[F.col(k).alias(f"{k}_by") for k in by]).agg(F.min(at).alias(f"{name}_first"))
        found = found.join(first, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_by")) for k in by]))
        rank -= F.col(f"{name}_first")
    found = found.select(*keys, rank.cast("int").alias(name))
    return df.join(found, reduce(Column.__and__, [F.expr(x).eqNullSafe(F.col(k)) for k, x in keys.items()]), "left").drop(*keys)


def _near(df: DataFrame, calls: dict[str, Call], parts: int) -> DataFrame:
    """Calls of one PARTITION BY and ORDER BY that read rows near by. Rows that compare equal keep the order in which they came, so that
    they too can be in several ranges."""
    one = next(iter(calls.values()))
    before, after = (max(c.reach[k] for c in calls.values()) for k in (0, 1))
    order = [F.expr(x).asc_nulls_first() for x in one.by] + [getattr(F.expr(x), way)() for x, way in map(_order, one.order)]
    placed = in_order(df.withColumn("__tie", F.monotonically_increasing_id()), [*order, F.col("__tie")], "__at", parts).drop("__tie")
    # Rows at the end of a block are read in the next one too, those at its beginning in the one before.
    size = max(ROWS_OF_A_BLOCK, before, after)
    own, inside = F.expr(f"__at div {size}"), F.col("__at") % size
    blocks = F.array_compact(F.array(own, F.when(inside >= size - before, own + 1), F.when(inside < after, own - 1)))
    dealt = placed.withColumn("__block", F.explode(blocks)).repartition(parts, "__block")
    windows = [f"{c.text} OVER (PARTITION BY {', '.join(('__block', *c.by))} ORDER BY __at {c.frame}) AS {name}" for name, c in calls.items()]
    return dealt.selectExpr("*", *windows).where(F.col("__block") == own).drop("__block", "__at")


def with_calls(df: DataFrame, calls: dict[str, Call], rows: int) -> DataFrame:
    """Add a column for each call. rows: how many df has."""
    parts, alike = _parts(df, rows), {}
    for name, call in calls.items():
        if call.reach is None:
            df = _dense_rank(df, name, call, parts)
        else:
            alike.setdefault((call.by, call.order), {})[name] = call
    for same in alike.values():
        df = _near(df, same, parts)
    return df

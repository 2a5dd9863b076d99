"""Ordered scans over rows of a key that may be too many for one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts all rows of a key in one task. Here each
key's rows are cut into chunks that follow the order (a span of seconds, a span of word
positions). Every chunk is scanned by its own window, one small row per chunk is aggregated
(with partial aggregation before the shuffle), those rows are scanned per key, and what each
chunk needs from its neighbours is joined back on (key, chunk). The chunk column is a pure
function of the row, so a recomputed task sees the same chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.session import materialize

SECONDS_PER_CHUNK = 6 * 3600
WORDS_PER_CHUNK = 1 << 14


@dataclass(frozen=True)
class Ordering:
    """Rows grouped by ``keys``, ordered by ``order``; ``chunk`` never decreases along it."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: str

    @property
    def group(self) -> list[str]:
        return [*self.keys, self.chunk]

    def window(self):
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def chunks(self):
        return Window.partitionBy(*self.keys).orderBy(self.chunk)


def by_seconds(df: DataFrame, keys: tuple[str, ...], ts: str, *ties: str,
               seconds: int = SECONDS_PER_CHUNK) -> tuple[DataFrame, Ordering]:
    """Order by a seconds column, in chunks of a fixed time span."""
    return (df.withColumn("_chunk", F.floor(F.col(ts) / F.lit(seconds))),
            Ordering(keys, (ts, *ties), "_chunk"))


def by_position(df: DataFrame, keys: tuple[str, ...], position: str,
                rows: int = WORDS_PER_CHUNK) -> tuple[DataFrame, Ordering]:
    """Order by an integer position, in chunks of a fixed number of positions."""
    return (df.withColumn("_chunk", F.floor(F.col(position) / F.lit(rows))),
            Ordering(keys, (position,), "_chunk"))


def by_range(df: DataFrame, *order: str) -> DataFrame:
    """``df``, stored, with a ``_chunk`` that follows ``order`` and holds about equally many rows.

    Chunks are range partitions, so they need no knowledge of how the values are spread; rows that
    are equal in ``order`` share one.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn("_chunk", F.spark_partition_id()), "ranged")


def scan(df: DataFrame, o: Ordering, previous: dict[str, Column] | None = None,
         following: dict[str, Column] | None = None, last: dict[str, Column] | None = None,
         total: dict[str, Column] | None = None) -> DataFrame:
    """Several ordered columns from one pass over the chunks and one join of their edges.

    ``previous``/``following``: the value on the row before/after. ``last``: the last known (not
    NULL) value up to the row, each with its own memory; pass one struct to keep fields together,
    NULL inside included. ``total``: the running total, the row included.

    The input is read twice, for the rows and for the edges. Where it is itself costly, or the
    result of another scan, store it first (``session.materialize``).
    """
    previous, following, last, total = previous or {}, following or {}, last or {}, total or {}
    at = F.col(o.order[0]) if len(o.order) == 1 else F.struct(*o.order)
    before_chunk = o.chunks().rowsBetween(Window.unboundedPreceding, -1)
    upto_row = o.window().rowsBetween(Window.unboundedPreceding, 0)

    # (name, aggregate of a chunk, what a chunk gets from its neighbours, in-chunk value, merge)
    parts: list[tuple[str, Column, Column, Column, Column]] = []
    for values, pick, step in ((previous, F.max_by, F.lag), (following, F.min_by, F.lead)):
        for n, c in values.items():
            # boxed, so that a NULL value and a missing neighbour stay apart
            box, e, i = F.struct(c.alias("v")), F.col(f"_edge_{n}"), F.col(f"_in_{n}")
            parts.append((n, pick(box, at), step(e).over(o.chunks()), step(box).over(o.window()), F.coalesce(i, e)["v"]))
    for n, c in last.items():
        e, i = F.col(f"_edge_{n}"), F.col(f"_in_{n}")
        parts.append((n, F.max_by(c, F.when(c.isNotNull(), at)), F.last(e, ignorenulls=True).over(before_chunk),
                      F.last(c, ignorenulls=True).over(upto_row), F.coalesce(i, e)))
    for n, c in total.items():
        e, i = F.col(f"_edge_{n}"), F.col(f"_in_{n}")
        parts.append((n, F.sum(c), F.sum(e).over(before_chunk), F.sum(c).over(upto_row),
                      F.coalesce(i, F.lit(0)) + F.coalesce(e, F.lit(0))))

    edges = df.groupBy(*o.group).agg(*[agg.alias(f"_edge_{n}") for n, agg, *_ in parts]).withColumns(
        {f"_edge_{n}": carried for n, _, carried, *_ in parts})
    out = df.withColumns({f"_in_{n}": inside for n, _, _, inside, _ in parts}).join(edges, o.group)
    out = out.withColumns({n: merged for n, *_, merged in parts})
    return out.drop(*[f"{p}{n}" for n, *_ in parts for p in ("_in_", "_edge_")])


def previous(df: DataFrame, o: Ordering, **values: Column) -> DataFrame:
    """Add each value as it was on the previous row of the key (NULL on the first row)."""
    return scan(df, o, previous=values)


def following(df: DataFrame, o: Ordering, **values: Column) -> DataFrame:
    """Add each value as it is on the next row of the key (NULL on the last row)."""
    return scan(df, o, following=values)


def last_known(df: DataFrame, o: Ordering, **values: Column) -> DataFrame:
    """Add each value as last known (not NULL) at each row of the key."""
    return scan(df, o, last=values)


def running_sum(df: DataFrame, o: Ordering, **values: Column) -> DataFrame:
    """Add the running total of each value, the row included."""
    return scan(df, o, total=values)


def clamped_sum(df: DataFrame, o: Ordering, value: str, name: str) -> DataFrame:
    """Add the running total of ``value`` that starts again from zero wherever it falls below.

    It is the plain running total less its least prefix, if that is negative. A chunk hands on its
    sum and its least prefix; pairs of these compose, so chunks are scanned apart.
    """
    before = o.chunks().rowsBetween(Window.unboundedPreceding, -1)
    upto = o.window().rowsBetween(Window.unboundedPreceding, 0)
    inside = materialize(df.withColumn("_in", F.sum(value).over(upto)), "inside")
    inside = inside.withColumn("_low", F.min("_in").over(upto))
    edges = inside.groupBy(*o.group).agg(F.sum(value).alias("_sum"), F.min("_in").alias("_least"))
    edges = edges.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    edges = edges.withColumn("_past", F.min(F.col("_base") + F.col("_least")).over(before)).drop("_sum", "_least")
    total, least = F.col("_base") + F.col("_in"), F.least(F.col("_past"), F.col("_base") + F.col("_low"), F.lit(0.0))
    return inside.join(edges, o.group).withColumn(name, total - least).drop("_in", "_low", "_base", "_past")


def islands(df: DataFrame, o: Ordering, starts: Column, name: str = "island") -> DataFrame:
    """Number the islands of each key: a row where ``starts`` holds opens a new one.

    ``starts`` comes from a scan itself, so its rows are stored rather than computed twice.
    """
    marked = materialize(df.withColumn("_start", F.when(starts, 1).otherwise(0).cast("bigint")), "marked")
    return running_sum(marked, o, **{name: F.col("_start")}).drop("_start")

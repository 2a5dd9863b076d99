"""Dedup, upsert and membership.

All are aggregates by key, so copies of one key collapse before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], latest: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if latest else F.min_by
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return (df.groupBy(*keys).agg(pick(F.struct(*rest), at).alias("_row"))
            .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``."""
    return _pick(df, keys, order, latest=False)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``."""
    return _pick(df, keys, order, latest=True)


def union_all(*frames: DataFrame) -> DataFrame:
    """Union of same-schema frames by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def _with_source(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return existing.withColumn("_source", F.lit(0)).unionByName(
        incoming.withColumn("_source", F.lit(1)))


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str],
                  order: list[str]) -> DataFrame:
    """Merge by key; an incoming row replaces an existing one, later rows win."""
    return keep_last(_with_source(existing, incoming), keys, ["_source", *order]).drop("_source")


def merge_keep_first(existing: DataFrame, incoming: DataFrame, keys: list[str],
                     order: list[str]) -> DataFrame:
    """Merge by key; existing and earlier rows win (D3)."""
    return keep_first(_with_source(existing, incoming), keys, ["_source", *order]).drop("_source")


def dedup_ticks(ticks: DataFrame) -> DataFrame:
    """One tick per (ticker, recv_utc, seq)."""
    return ticks.dropDuplicates(["ticker", "recv_utc", "seq"])


def dedup_tick_stream(ticks: DataFrame, delay_s: int) -> DataFrame:
    """One tick per (ticker, recv_utc, seq) of a stream, copies of other batches included.

    A tick is remembered until the watermark, ``delay_s`` behind the latest, has passed it by as
    much; copies may land so much later, and the state stays as small as such a span of ticks.
    """
    timed = ticks.withColumn("_time", F.timestamp_seconds("recv_utc")).withWatermark("_time", f"{delay_s} seconds")
    return timed.dropDuplicatesWithinWatermark(["ticker", "recv_utc", "seq"]).drop("_time")


def last_tick_per_second(ticks: DataFrame) -> DataFrame:
    """The last tick of each second by ``seq``."""
    return keep_last(ticks, ["ticker", "recv_utc"], ["seq"])


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left`` absent from ``right``."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")

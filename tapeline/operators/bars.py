"""Ticks to bars (A1, W2, T1) and derived bar columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.prices import known
from tapeline.functions.times import bucket_end

PERIOD_S = 60
SIDES = ("yes_bid", "yes_ask")
PARTS = ("open", "high", "low", "close")
BAR_COLUMNS = ["ticker", "ts", *[f"{s}_{p}" for s in SIDES for p in PARTS], "volume"]


def bucket_bars(ticks: DataFrame, period_s: int = PERIOD_S) -> DataFrame:
    """OHLC of the known quotes of each side per (ticker, bucket) (A1).

    Seconds are reduced by ``seq`` and buckets by second: each step orders by one plain number,
    whatever its size, and so stays a hash aggregate.
    """
    rows = ticks.select("ticker", bucket_end(F.col("recv_utc"), period_s).alias("ts"), F.col("recv_utc").alias("_s"), "seq",
                        *[known(F.col(s)).alias(s) for s in SIDES])
    inside, across = [], []
    for side in SIDES:
        at = F.when(F.col(side).isNotNull(), F.col("seq"))
        second = F.when(F.col(f"{side}_high").isNotNull(), F.col("_s"))
        inside += [F.min_by(side, at).alias(f"{side}_open"), F.max(side).alias(f"{side}_high"),
                   F.min(side).alias(f"{side}_low"), F.max_by(side, at).alias(f"{side}_close")]
        across += [F.min_by(f"{side}_open", second).alias(f"{side}_open"), F.max(f"{side}_high").alias(f"{side}_high"),
                   F.min(f"{side}_low").alias(f"{side}_low"), F.max_by(f"{side}_close", second).alias(f"{side}_close")]
    return rows.groupBy("ticker", "ts", "_s").agg(*inside).groupBy("ticker", "ts").agg(*across)


def assemble_bars(ticks: DataFrame, period_s: int = PERIOD_S, start_ts: int | None = None,
                  end_ts: int | None = None) -> DataFrame:
    """A bar for every boundary of a ticker's range once a first real bar exists.

    Each real bar emits itself and the flat bars up to the next real one, so no time spine is
    joined. A flat bar repeats the previous close of both sides, a missing side included.
    Without bounds the range is the ticker's own first to last bucket. Buckets before
    ``start_ts`` are neither emitted nor carried. The window works on bars, of which a ticker
    has at most one per period, not on ticks.
    """
    bars = bucket_bars(ticks, period_s)
    if start_ts is not None:
        bars = bars.filter(F.col("ts") >= bucket_end(F.lit(start_ts), period_s))
    if end_ts is not None:
        bars = bars.filter(F.col("ts") <= bucket_end(F.lit(end_ts), period_s))
    after = F.lead("ts").over(Window.partitionBy("ticker").orderBy("ts"))
    last = F.col("ts") if end_ts is None else bucket_end(F.lit(end_ts), period_s)
    spread = bars.withColumn("_until", F.coalesce(after - period_s, last)).withColumn(
        "_ts", F.explode(F.sequence("ts", "_until", F.lit(period_s).cast("bigint"))))
    real = F.col("_ts") == F.col("ts")
    return spread.select(
        "ticker", F.col("_ts").alias("ts"),
        *[F.when(real, F.col(f"{s}_{p}")).otherwise(F.col(f"{s}_close")).alias(f"{s}_{p}")
          for s in SIDES for p in PARTS],
        F.lit(None).cast("double").alias("volume"),
    )


def bar_jumps(bars: DataFrame, value: str, threshold: float) -> DataFrame:
    """Bars whose value moved by more than a threshold from the bar before."""
    w = Window.partitionBy("ticker").orderBy("ts")
    return (
        bars.withColumn("delta", F.col(value) - F.lag(value).over(w))
        .filter(F.abs("delta") > threshold)
    )

"""Close-over-close spikes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SpikeConfig:
    magnitude: float = 0.05
    band_lo: float = 0.05
    band_hi: float = 0.95
    level_cap: float = 0.98
    lookback_bars: tuple[int, ...] = (1, 2)


def detect_spikes(bars: DataFrame, config: SpikeConfig = SpikeConfig(),
                  window: tuple[int, int] | None = None) -> DataFrame:
    """Largest in-band move per bar over the lookbacks, kept where it clears the magnitude.

    Equal moves keep the earlier lookback; a move with an unknown mid never counts. The window
    is applied before lagging. Input is one row per bar, so a key's window holds at most one row
    per period.
    """
    cfg = config
    if window is not None:
        bars = bars.filter(F.col("ts").between(*window))
    order = Window.partitionBy("ticker").orderBy("ts")
    mid = (F.col("yes_bid_close") + F.col("yes_ask_close")) / 2.0
    rows = bars.select("ticker", "ts", mid.alias("mid")).withColumn(
        "_n", F.row_number().over(order))
    best = F.lit(0.0)
    lags = {f"_lag{k}": F.lag("mid", k).over(order) for k in cfg.lookback_bars}
    for k in cfg.lookback_bars:
        move = F.col("mid") - F.col(f"_lag{k}")
        ok = F.col(f"_lag{k}").between(cfg.band_lo, cfg.band_hi)
        best = F.when(ok & (F.abs(move) > F.abs(best)), move).otherwise(best)
    return (
        rows.withColumns(lags)
        .filter(F.col("_n") > max(cfg.lookback_bars, default=0))
        .withColumn("dmid", best)
        .filter((F.abs("dmid") >= cfg.magnitude) & (F.col("mid") <= cfg.level_cap))
        .select(
            F.col("ticker").alias("market_ticker"), F.col("ts").alias("S"),
            F.when(F.col("dmid") > 0, "up").otherwise("down").alias("direction"),
            "dmid", F.col("mid").alias("mid_S"),
        )
    )

"""Streaming bars and standing quotes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tapeline.functions.prices import known
from tapeline.operators.bars import BAR_COLUMNS, PARTS, PERIOD_S, SIDES

_CLOSES = [f"{s}_close" for s in SIDES]
BAR_SCHEMA = "ticker string, ts bigint, " + ", ".join(f"{s}_{p} double" for s in SIDES for p in PARTS) + ", volume double"


def stream_bars(ticks: DataFrame, period_s: int = PERIOD_S) -> DataFrame:
    """OHLC per (ticker, bucket), emitted once the bucket is closed."""
    return _timed_bars(ticks, period_s).drop("at")


def _timed_bars(ticks: DataFrame, period_s: int) -> DataFrame:
    """Closed bars with their event time ``at``.

    Time is shifted by one second, so that ``(S - period, S]`` is a window and the watermark
    passes ``S`` when a tick of ``S + 1`` has been seen. Ticks that come after the bar was emitted
    are dropped.
    The watermark follows the data, not the wall clock.
    """
    sides = {s: known(F.col(s)) for s in SIDES}
    rows = ticks.select("ticker", F.timestamp_seconds(F.col("recv_utc") - 1).alias("at"),
                        *[c.alias(s) for s, c in sides.items()],
                        F.struct("recv_utc", "seq").alias("_at"))
    aggs = []
    for side in SIDES:
        at = F.when(F.col(side).isNotNull(), F.col("_at"))
        aggs += [F.min_by(side, at).alias(f"{side}_open"), F.max(side).alias(f"{side}_high"),
                 F.min(side).alias(f"{side}_low"), F.max_by(side, at).alias(f"{side}_close")]
    bars = rows.withWatermark("at", "0 seconds").groupBy(
        "ticker", F.window("at", f"{period_s} seconds").alias("w")).agg(*aggs)
    return bars.select("ticker", F.unix_seconds("w.end").alias("ts"),
                       *[f"{s}_{p}" for s in SIDES for p in PARTS], F.lit(None).cast("double").alias("volume"),
                       F.window_time("w").alias("at"))


class _Carry(StatefulProcessor):
    """Holds the last close pair of a ticker and emits a flat bar for every silent bucket."""

    def __init__(self, period_s: int) -> None:
        self.period_s = period_s

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts bigint, bid double, ask double")

    def _flat(self, ticker: str, ts: int, pair: tuple) -> dict:
        row = {"ticker": ticker, "ts": ts, "volume": None}
        for side, close in zip(SIDES, pair):
            row.update({f"{side}_{p}": close for p in PARTS})
        return row

    def _timer(self, ts: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((ts + self.period_s) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one row per bucket, so a micro-batch holds few for a ticker
        bars = pd.concat(rows).sort_values("ts")
        out, seen = [], self.last.get() if self.last.exists() else None
        for bar in bars.to_dict("records"):
            ts = int(bar["ts"])
            if seen is not None:
                out += [self._flat(key[0], s, seen[1:]) for s in range(seen[0] + self.period_s, ts, self.period_s)]
            pair = tuple(None if pd.isna(bar[c]) else float(bar[c]) for c in _CLOSES)
            if seen is None or ts > seen[0]:
                out.append(bar)
                seen = (ts, *pair)
        self.last.update(seen)
        self._timer(seen[0])
        yield pd.DataFrame(out, columns=BAR_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = self.last.get()
        upto = timerValues.getCurrentWatermarkInMs() // 1000
        ends = range(seen[0] + self.period_s, upto + 1, self.period_s)
        if len(ends):
            self.last.update((ends[-1], *seen[1:]))
            self._timer(ends[-1])
        else:
            self._timer(seen[0])
        yield pd.DataFrame([self._flat(key[0], s, seen[1:]) for s in ends], columns=BAR_COLUMNS)

    def close(self) -> None:
        pass


def stream_filled_bars(ticks: DataFrame, period_s: int = PERIOD_S) -> DataFrame:
    """Closed bars with flat bars for silent buckets.

    A flat bar comes when the watermark has passed its bucket, or with the next real bar.
    """
    return _timed_bars(ticks, period_s).groupBy("ticker").transformWithStateInPandas(
        _Carry(period_s), BAR_SCHEMA, "Append", "EventTime")


def standing_quotes(ticks: DataFrame) -> DataFrame:
    """Latest known quote and depth of each side per ticker, in update mode."""
    at = F.struct("recv_utc", "seq")
    values = {c: known(F.col(c)) for c in ("yes_bid", "yes_ask", "depth_bid", "depth_ask")}
    return ticks.groupBy("ticker").agg(*[
        F.max_by(v, F.when(v.isNotNull(), at)).alias(c) for c, v in values.items()])

"""Bars, spikes and tick-level queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import bars, dedup, spikes
from tapeline.plans import views
from tapeline.plans.catalog import query
from tapeline.plans.sqlviews import sql

BARS_CTES = {
    "agg": """
        SELECT ticker, recv_utc + (-recv_utc % 60 + 60) % 60 AS ts,
               arg_min(yes_bid, (recv_utc, seq)) AS bo, max(yes_bid) AS bh, min(yes_bid) AS bl,
               arg_max(yes_bid, (recv_utc, seq)) AS bc,
               arg_min(yes_ask, (recv_utc, seq)) FILTER (yes_ask IS NOT NULL) AS ao,
               max(yes_ask) AS ah, min(yes_ask) AS al,
               arg_max(yes_ask, (recv_utc, seq)) FILTER (yes_ask IS NOT NULL) AS ac
        FROM ticks GROUP BY ALL""",
    "spine": """
        SELECT ticker, unnest(range(lo, hi + 60, 60)) AS ts
        FROM (SELECT ticker, min(ts) AS lo, max(ts) AS hi FROM agg GROUP BY ticker)""",
    "bars": """
        SELECT s.ticker, s.ts,
               CASE WHEN real THEN bo ELSE c.b END AS yes_bid_open, CASE WHEN real THEN bh ELSE c.b END AS yes_bid_high,
               CASE WHEN real THEN bl ELSE c.b END AS yes_bid_low, CASE WHEN real THEN bc ELSE c.b END AS yes_bid_close,
               CASE WHEN real THEN ao ELSE c.a END AS yes_ask_open, CASE WHEN real THEN ah ELSE c.a END AS yes_ask_high,
               CASE WHEN real THEN al ELSE c.a END AS yes_ask_low, CASE WHEN real THEN ac ELSE c.a END AS yes_ask_close
        FROM (SELECT s.ticker, s.ts, a.ticker IS NOT NULL AS real, bo, bh, bl, bc, ao, ah, al, ac,
                     last_value(CASE WHEN a.ticker IS NOT NULL THEN {'b': bc, 'a': ac} END IGNORE NULLS)
                       OVER (PARTITION BY s.ticker ORDER BY s.ts ROWS UNBOUNDED PRECEDING) AS c
              FROM spine s LEFT JOIN agg a ON a.ticker = s.ticker AND a.ts = s.ts) s""",
}


@query("bars_1min", sql("SELECT * FROM bars", "ticks", **BARS_CTES))
def bars_1min(spark, sf_dir):
    return bars.assemble_bars(views.ticks(spark, sf_dir)).drop("volume")


SPIKES_SQL = sql("""
    SELECT ticker AS market_ticker, ts AS S, CASE WHEN d > 0 THEN 'up' ELSE 'down' END AS direction,
           d AS dmid, mid AS mid_S
    FROM (SELECT *, CASE WHEN b2 BETWEEN 0.05 AND 0.95 AND abs(mid - b2) > abs(d1) THEN mid - b2 ELSE d1 END AS d
          FROM (SELECT *, CASE WHEN b1 BETWEEN 0.05 AND 0.95 AND abs(mid - b1) > 0 THEN mid - b1 ELSE 0.0 END AS d1
                FROM (SELECT ticker, ts, (yes_bid_close + yes_ask_close) / 2.0 AS mid,
                             lag((yes_bid_close + yes_ask_close) / 2.0, 1) OVER w AS b1,
                             lag((yes_bid_close + yes_ask_close) / 2.0, 2) OVER w AS b2,
                             row_number() OVER w AS n
                      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts))
                WHERE n > 2))
    WHERE abs(d) >= 0.05 AND mid <= 0.98""", "ticks", **BARS_CTES)


@query("spikes", SPIKES_SQL)
def spike_events(spark, sf_dir):
    return spikes.detect_spikes(bars.assemble_bars(views.ticks(spark, sf_dir)))


@query("tick_dedup", sql("""
    SELECT ticker, count(*) AS n FROM (SELECT DISTINCT ticker, recv_utc, seq FROM ticks) GROUP BY ticker""",
    "ticks"))
def tick_dedup(spark, sf_dir):
    t = views.ticks(spark, sf_dir)
    return dedup.dedup_ticks(dedup.union_all(t, t)).groupBy("ticker").agg(F.count("*").alias("n"))


_HALVES = {
    "old": "SELECT *, 0 AS src FROM candles WHERE ts <= 1704067200 + 20 * 86400",
    "new": """SELECT ticker, ts, period_minutes, yes_bid_close + 0.5 AS yes_bid_close, volume, 1 AS src
              FROM candles WHERE ts > 1704067200 + 10 * 86400""",
}


def _old_and_new(spark, sf_dir):
    c = views.candles(spark, sf_dir).select("ticker", "ts", "period_minutes", "yes_bid_close", "volume")
    old = c.filter(F.col("ts") <= views.T0 + 20 * 86400)
    new = c.filter(F.col("ts") > views.T0 + 10 * 86400).withColumn(
        "yes_bid_close", F.col("yes_bid_close") + 0.5)
    return old, new, ["ticker", "ts", "period_minutes"]


def _merge_sql(direction: str) -> str:
    return sql(f"""
        SELECT ticker, ts, period_minutes, yes_bid_close, volume
        FROM (SELECT ticker, ts, period_minutes, yes_bid_close, volume, src FROM old UNION ALL
              SELECT ticker, ts, period_minutes, yes_bid_close, volume, src FROM new)
        QUALIFY row_number() OVER (PARTITION BY ticker, ts, period_minutes ORDER BY src {direction}) = 1""",
        "candles", **_HALVES)


@query("upsert_latest", _merge_sql("DESC"))
def upsert_latest(spark, sf_dir):
    old, new, keys = _old_and_new(spark, sf_dir)
    return dedup.upsert_latest(old, new, keys, ["volume"])


@query("keep_first", _merge_sql("ASC"))
def keep_first(spark, sf_dir):
    old, new, keys = _old_and_new(spark, sf_dir)
    return dedup.merge_keep_first(old, new, keys, ["volume"])

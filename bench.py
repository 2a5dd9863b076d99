"""Headline timings: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the local cores. Registered queries run
over the provided tables. The ``scale_*`` entries repeat the published workloads' sizes (one
million ticks to bars; 15,000 markets with 2.8 million daily bars, one replay and a 200-point
sweep) on data Spark derives from those tables and writes out before the clock starts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tapeline.operators import bars, replay  # noqa: E402
from tapeline.plans import views  # noqa: E402
from tapeline.plans.catalog import load  # noqa: E402
from tapeline.session import build_session  # noqa: E402

HEADLINES = (
    "bars_1min", "spikes", "asof_quote", "first_touch", "replay", "replay_sweep", "book_minutes", "state_runs", "rest_share",
    "spread_quantiles", "phrase_matches", "mention_events", "occurrence_index", "gap_scan", "loop_flags", "reprice", "fast_moves",
    "align_anchors", "registry", "candle_json", "captions_json", "upsert_latest", "stream_bars", "stream_book",
)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def clock(run, repeat: int = 1) -> float:
    times = []
    for _ in range(repeat):
        t0 = time.perf_counter()
        run()
        times.append(time.perf_counter() - t0)
    return round(statistics.median(times), 3)


def million_ticks(spark, sf_dir: str):
    """The ticks of all events as one market over six hours, copied up to a million."""
    t = views.ticks(spark, sf_dir)
    copies = max(1, round(1_000_000 / t.count()))
    return t.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select(
        F.lit("HOT").alias("ticker"), (F.lit(views.TAPE_T0) + (F.col("recv_utc") - views.TAPE_T0) * 5 + F.col("_i") % 5).alias("recv_utc"),
        (F.col("seq") * copies + F.col("_i")).alias("seq"), "yes_bid", "yes_ask", "depth_bid", "depth_ask")


def market_frames(spark, sf_dir: str, markets: int = 15_000, days: int = 189):
    """Daily bars, predictions and a registry for a fixed number of markets, from the customers."""
    c = views.table(spark, sf_dir, "customer")
    per = max(1, -(-markets // c.count()))
    keys = c.select(F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("i"), "c_custkey").select(
        F.concat_ws("-", F.lit("M"), "c_custkey", "i").alias("ticker")).limit(markets)
    h = F.pmod(F.xxhash64("ticker", "d"), F.lit(50))
    lo = (F.lit(20) + h).cast("bigint")
    daily = keys.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(days)))).select(
        "ticker", (F.lit(views.T0) + F.col("d") * 86_400).cast("bigint").alias("ts"), F.lit(1440).alias("period_minutes"),
        (lo / 100.0).alias("yes_bid_close"), ((lo + 2) / 100.0).alias("yes_ask_close"), ((lo - 1) / 100.0).alias("price_low"),
        ((lo + 3) / 100.0).alias("price_high"))
    p = F.pmod(F.xxhash64("ticker"), F.lit(100)) / 100.0
    preds = keys.select(
        F.col("ticker").alias("market_ticker"), (F.lit(views.T0) + (F.pmod(F.xxhash64("ticker", F.lit(1)), F.lit(days)) + 1) * 86_400 + 3600).cast("bigint").alias("decision_ts"),
        F.lit("test").alias("split"), F.pmod(F.xxhash64("ticker", F.lit(2)), F.lit(2)).cast("int").alias("y"), p.alias("p_base"), p.alias("p_topic"), p.alias("p_cal"))
    reg = keys.select(F.col("ticker").alias("market_ticker"), F.lit("o").alias("occasion"), F.lit("s").alias("speaker"), F.lit("speech").alias("format"),
                      F.lit("low").alias("resolution_risk"), F.lit(0).alias("ingest_seq"))
    return daily, preds, reg


def stored(spark, df, folder: str, name: str):
    path = os.path.join(folder, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def scale_runs(spark, sf_dir: str) -> dict[str, float]:
    folder = tempfile.mkdtemp(prefix="spark-")
    ticks = stored(spark, million_ticks(spark, sf_dir).repartition(8), folder, "ticks")
    daily, preds, reg = (stored(spark, df, folder, n) for df, n in zip(market_frames(spark, sf_dir), ("daily", "preds", "reg")))
    thetas = [round(0.01 * i, 2) for i in range(20)]
    los = [round(0.05 + 0.05 * i, 2) for i in range(10)]
    runs = {
        "scale_ticks_1m_to_bars": lambda: drain(bars.assemble_bars(ticks)),
        "scale_replay_15k_markets": lambda: drain(replay.replay(preds, daily, reg)),
        "scale_sweep_200_points": lambda: drain(replay.sweep(preds, daily, reg, thetas, los)),
    }
    out = {}
    for name, run in runs.items():
        run()
        out[name] = clock(run, 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    drain(queries["bars_1min"](spark, sf_dir))  # warm-up: JVM and file listing
    times = {name: clock(lambda n=name: drain(queries[n](spark, sf_dir))) for name in HEADLINES}
    times.update(scale_runs(spark, sf_dir))
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

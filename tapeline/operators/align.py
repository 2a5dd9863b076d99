"""Placing a transcript on the clock by anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.prices import known
from tapeline.session import materialize

CROSS_LEVEL = 0.90
TOLERANCE_S = 120.0
MIN_SHARE = max(0.5, 2 / 3 - 0.2)


def first_cross(bars: DataFrame, level: float = CROSS_LEVEL,
                window: tuple[int, int] | None = None) -> DataFrame:
    """First bar of each ticker whose print, or else mid, is at or above a level."""
    if window is not None:
        bars = bars.filter(F.col("ts").between(*window))
    mid = (known(F.col("yes_bid_close")) + known(F.col("yes_ask_close"))) / 2.0
    return bars.filter(F.coalesce(known(F.col("price_close")), mid) >= level).groupBy("ticker").agg(
        F.min("ts").alias("cross_ts"))


def anchor_offsets(said_ms: DataFrame, crosses: DataFrame) -> DataFrame:
    """Candidate video start of each anchor: its cross minus the time it was said."""
    return said_ms.join(crosses.withColumnRenamed("ticker", "series_key"), "series_key").select(
        "occasion_id", "series_key", (F.col("cross_ts") - F.col("said") / 1000.0).alias("offset"))


def estimate_alignment(occasions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Video start, quality and method per occasion.

    ``occasions``: occasion_id, release_start_utc (NULL when unknown). The median offset is taken
    again over the offsets within tolerance of it. A release time that agrees is the clock;
    otherwise the price anchors are, and need three concordant ones; a release time without any
    anchor is accepted as it is.
    """
    offsets = materialize(offsets, "offsets")  # one row per anchor, read four times
    center = offsets.groupBy("occasion_id").agg(F.percentile("offset", F.lit(0.5)).alias("_m0"))
    inliers = offsets.join(center, "occasion_id").filter(F.abs(F.col("offset") - F.col("_m0")) <= TOLERANCE_S)
    refined = inliers.groupBy("occasion_id").agg(F.percentile("offset", F.lit(0.5)).alias("_m1"))
    clock = (
        occasions.join(center, "occasion_id", "left").join(refined, "occasion_id", "left")
        .withColumn("_price", F.coalesce("_m1", "_m0"))
    )
    release = F.col("release_start_utc")
    agrees = F.abs(release - F.col("_price")) <= TOLERANCE_S
    clock = clock.withColumn(
        "method",
        F.when(F.col("_price").isNull() & release.isNull(), "")
        .when(F.col("_price").isNull(), "release_only")
        .when(release.isNull(), "price_only")
        .when(agrees, "release+price_qa").otherwise("price_over_release"),
    ).withColumn("_start", F.when(F.col("method").isin("release_only", "release+price_qa"), release.cast("double"))
                 .otherwise(F.col("_price")))
    residual = F.col("offset") - F.col("_start")
    counts = offsets.join(clock.select("occasion_id", "_start"), "occasion_id").groupBy("occasion_id").agg(
        F.count("*").alias("n_anchors"), F.count_if(F.abs(residual) <= TOLERANCE_S).alias("n_ok"),
        F.max(F.abs(residual)).alias("max_abs_residual_s"))
    n_ok, n = F.col("n_ok"), F.col("n_anchors")
    aligned = (
        F.when(F.col("method") == "", False).when(F.col("method") == "release_only", True)
        .when(F.col("method") == "release+price_qa", n_ok >= 1)
        .otherwise((n_ok >= 3) & (n_ok / n >= MIN_SHARE)))
    return clock.join(counts, "occasion_id", "left").withColumns({
        "n_anchors": F.coalesce(n, F.lit(0)), "n_ok": F.coalesce(n_ok, F.lit(0))}).select(
        "occasion_id", F.bround("_start").cast("bigint").alias("video_start_utc"), "n_anchors", "n_ok",
        "max_abs_residual_s", aligned.alias("aligned"), "method", "release_start_utc")


def anchor_residuals(offsets: DataFrame, alignment: DataFrame) -> DataFrame:
    """Residual and relative reaction lag of each anchor.

    The residual is against the rounded clock of ``alignment``.
    """
    least = offsets.groupBy("occasion_id").agg(F.min("offset").alias("_least"))
    return offsets.join(alignment.select("occasion_id", "video_start_utc"), "occasion_id").join(
        least, "occasion_id").select(
        "occasion_id", "series_key", (F.col("offset") - F.col("video_start_utc")).alias("residual_s"),
        (F.col("offset") - F.col("_least")).alias("reaction_lag_s"))


def utc_seconds(start: Column, ms: Column) -> Column:
    """Video-relative milliseconds on the clock, halves to even."""
    return start + F.bround(ms / 1000.0).cast("bigint")


def clocked(rows: DataFrame, alignment: DataFrame, occasion: str = "occasion_id") -> DataFrame:
    """``rows`` of the occasions that have a clock, with its start: words, or what words are made of."""
    clock = alignment.filter(F.col("video_start_utc").isNotNull()).select(F.col("occasion_id").alias(occasion), "video_start_utc")
    return rows.join(clock, occasion)


def on_clock(words: DataFrame, source: str) -> DataFrame:
    """Transcript rows of words that carry the start of their clock."""
    start = F.col("video_start_utc")
    return words.select(
        "occasion_id", "word_idx", "word", utc_seconds(start, F.col("t_start_ms")).alias("t_start_utc"),
        utc_seconds(start, F.col("t_end_ms")).alias("t_end_utc"), F.lit(source).alias("source"),
        F.lit(None).cast("double").alias("asr_conf"))


def to_utc_transcript(words: DataFrame, alignment: DataFrame, source: str) -> DataFrame:
    """Transcript rows of the occasions that have a clock.

    The words themselves are joined; where they are made of fewer rows, ``clocked`` takes those.
    """
    return on_clock(clocked(words, alignment), source)

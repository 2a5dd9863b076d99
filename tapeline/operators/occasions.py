"""Upcoming occasions and stream candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import text, times
from tapeline.operators.universe import unsettled

DISAGREE_S = 48 * 3600
WITHIN_S = 6 * 3600
TIMED_MAX_GAP_S = 6 * 3600
DAY_ONLY_MAX_GAP_S = 16 * 3600
LIVE_JOIN_MAX_S = 45 * 60
SCHEDULE_LAPSE_S = 5 * 60


def with_occasion_time(registry: DataFrame) -> DataFrame:
    """Best known time of each market's occasion.

    A date in the event ticker that disagrees with the stated time by over two days, or stands
    alone, wins: the row is then known by day only, anchored at that day's noon.
    """
    when = F.coalesce("occurrence_ts", "close_ts") if "close_ts" in registry.columns else F.col("occurrence_ts")
    df = registry.withColumns({"_when": when, "_day": times.ticker_date(F.col("event_ticker"))})
    noon = times.day_noon(F.col("_day"))
    day_only = F.col("_day").isNotNull() & (F.col("_when").isNull() | (F.abs(F.col("_when") - noon) > DISAGREE_S))
    df = df.withColumn("day_only", F.coalesce(day_only, F.lit(False)))
    return df.withColumns({
        "when_ts": F.when(F.col("day_only"), noon).otherwise(F.col("_when")),
        "day_start": times.day_start(F.col("_day")), "day_end": times.day_end(F.col("_day")),
    }).drop("_when", "_day")


def upcoming_markets(registry: DataFrame, now_ts: int, within_s: int = WITHIN_S) -> DataFrame:
    """Eligible unsettled speech markets whose occasion starts within the horizon (P5).

    Timed rows need a start in ``(now, now + within]``; rows known by day only need their civil
    day to overlap it.
    """
    df = with_occasion_time(registry)
    base = (F.col("format") == "speech") & F.col("eligible") & unsettled(F.col("result"))
    if "template" in registry.columns:
        base = base & (F.col("template") == "speech")
    timed = ~F.col("day_only") & (F.col("when_ts") > now_ts) & (F.col("when_ts") <= now_ts + within_s)
    by_day = F.col("day_only") & (F.col("day_end") > now_ts) & (F.col("day_start") <= now_ts + within_s)
    return df.filter(base & (timed | by_day))


def select_occasions(registry: DataFrame, now_ts: int, within_s: int = WITHIN_S) -> DataFrame:
    """One row per upcoming occasion, timed rows deciding its start.

    An occasion's markets are the rows of ``upcoming_markets`` with its event ticker.
    """
    at = F.when(~F.col("day_only"), F.col("when_ts"))
    return upcoming_markets(registry, now_ts, within_s).groupBy("event_ticker").agg(
        F.min_by("speaker", "market_ticker").alias("speaker"),
        text.event_kind(F.min_by("series_title", "market_ticker")).alias("event_type"),
        F.coalesce(F.min(at), F.min("when_ts")).alias("occurrence_ts"),
        F.count("*").alias("n_markets"), F.bool_or(~F.col("day_only")).alias("time_known"))


def event_markets(registry: DataFrame, event_ticker: str) -> DataFrame:
    """Every eligible unsettled market of one event, without a time window."""
    return registry.filter((F.col("event_ticker") == event_ticker) & F.col("eligible") & unsettled(F.col("result")))


def select_event(registry: DataFrame, event_ticker: str) -> DataFrame:
    """One named event as an occasion."""
    when = F.coalesce("occurrence_ts", "close_ts") if "close_ts" in registry.columns else F.col("occurrence_ts")
    out = event_markets(registry, event_ticker).groupBy("event_ticker").agg(
        F.min_by(F.struct("speaker"), "market_ticker").alias("_s"),
        F.coalesce(F.min(when), F.lit(0)).alias("occurrence_ts"), F.count("*").alias("n_markets"))
    speaker = F.when(F.trim(F.col("_s.speaker")) != "", F.col("_s.speaker")).otherwise(F.col("event_ticker"))
    return out.select("event_ticker", speaker.alias("speaker"), F.lit("sports").alias("event_type"),
                      "occurrence_ts", "n_markets", F.lit(False).alias("time_known"))


def next_occasion(occasions: DataFrame, n: int = 1) -> DataFrame:
    """The earliest occasions."""
    return occasions.orderBy("occurrence_ts", "event_ticker").limit(n)


def _gap(release: Column, occurrence: Column) -> Column:
    return F.abs(release - occurrence)


def pick_streams(candidates: DataFrame, occasions: DataFrame) -> DataFrame:
    """Best candidate stream per occasion: live before scheduled, then nearest.

    Archived streams and those without a start, or too far from the occasion, never count.
    ``candidates``: event_ticker, video_id, is_live, was_live, release_ts.
    """
    limit = F.when(F.col("time_known"), TIMED_MAX_GAP_S).otherwise(DAY_ONLY_MAX_GAP_S)
    gap = _gap(F.col("release_ts"), F.col("occurrence_ts"))
    ok = ~F.col("was_live") & F.col("release_ts").isNotNull() & (gap <= limit)
    rows = candidates.join(occasions.select("event_ticker", "occurrence_ts", "time_known"), "event_ticker").filter(ok)
    best = F.struct((~F.col("is_live")).alias("l"), gap.alias("g"), F.col("video_id").alias("v"))
    return rows.groupBy("event_ticker").agg(
        F.min_by(F.struct("video_id", "is_live", "release_ts", "occurrence_ts", "time_known"), best).alias("r")
    ).select("event_ticker", "r.*")


def resolve_times(picked: DataFrame, now_ts: int, not_before_ts: int | None = None) -> DataFrame:
    """Start times taken from picked streams; stale ones are dropped for day-only occasions (P10)."""
    release = F.col("release_ts")
    ok = F.when(F.col("is_live"), F.lit(now_ts) - release <= LIVE_JOIN_MAX_S).otherwise(
        release >= now_ts - SCHEDULE_LAPSE_S)
    if not_before_ts is not None:
        ok = ok & (release >= not_before_ts)
    known = F.col("time_known")
    return picked.filter(known | ok).withColumn(
        "occurrence_ts", F.when(known, F.col("occurrence_ts")).otherwise(release)).withColumn("time_known", F.lit(True))


def resolve_pinned(pinned: DataFrame, now_ts: int, not_before_ts: int | None = None) -> DataFrame:
    """Start time of pinned videos: their own start, or now if already live (P10)."""
    start = F.coalesce("release_ts", F.when(F.col("is_live"), F.lit(now_ts)))
    out = pinned.withColumn("start_ts", start).filter(F.col("start_ts").isNotNull())
    return out if not_before_ts is None else out.filter(F.col("start_ts") >= not_before_ts)


def rank_videos(videos: DataFrame, by: list[str], target_s: int = 4500) -> DataFrame:
    """Candidate videos in order: live recordings with a start first, then a likely length."""
    order = Window.partitionBy(*by).orderBy(
        F.coalesce(~(F.col("was_live") & F.col("release_ts").isNotNull()), F.lit(True)),
        F.abs(F.col("duration_s") - target_s), "video_id")
    return videos.withColumn("rank", F.row_number().over(order))

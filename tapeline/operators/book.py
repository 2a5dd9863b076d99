"""Book-shape survey: states, per-second grid, runs and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.prices import (STATES, book_state, depth_bucket, known, mid_by_depth,
                                       price_band, touch_depth)
from tapeline.operators.ordered import by_seconds, islands, scan
from tapeline.session import materialize

INVALID_FOR_BUYERS = ("CROSSED", "EMPTY_ASK", "EMPTY_BOTH")
QUANTILES = (0.25, 0.5, 0.75, 0.90)


def without_suffix(ticks: DataFrame, suffix: str) -> DataFrame:
    """Drop tickers ending with a suffix; an empty suffix drops nothing."""
    return ticks.filter(~F.col("ticker").endswith(suffix)) if suffix else ticks


def classify(ticks: DataFrame) -> DataFrame:
    """Effective depths, state, mid and spread of each tick."""
    depths = [c for c in ("depth_bid", "depth_ask", "depth_bid2", "depth_ask2") if c in ticks.columns]
    t = ticks.withColumns({"yes_bid": known(F.col("yes_bid")), "yes_ask": known(F.col("yes_ask")),
                           **{f"{c}_eff": touch_depth(known(F.col(c))) for c in depths}})
    sides = [F.col(c) for c in ("yes_bid", "yes_ask", "depth_bid_eff", "depth_ask_eff")]
    return t.withColumns({
        "state": book_state(*sides),
        "mid_tick": mid_by_depth(*sides),
        "spread": F.col("yes_ask") - F.col("yes_bid"),
    })


def last_second(classified: DataFrame) -> DataFrame:
    """State and mid of the last tick of each (ticker, second).

    The state travels as its number: with numbers only, this stays a hash aggregate.
    """
    codes = F.array(*[F.lit(s) for s in STATES])
    return classified.groupBy("ticker", "recv_utc").agg(
        F.max_by(F.array_position(codes, F.col("state")).cast("int"), "seq").alias("_code"),
        F.max_by("mid_tick", "seq").alias("mid_tick"),
    ).select("ticker", "recv_utc", F.element_at(codes, F.col("_code")).alias("state"), "mid_tick")


def spans(classified: DataFrame) -> DataFrame:
    """The per-second grid as spans: one row per known second with its next one.

    A span ``[t, until)`` holds one state. ``mid_lkm`` is the last known mid, taken from the
    first known one at the head; ``prev_state`` is the state of the span before. The grid of every ticker ends at the last second of the tape.
    """
    seconds = materialize(last_second(classified), "seconds")  # at most one row per ticker and second
    tape_end = seconds.agg(F.max("recv_utc") + 1).scalar()
    rows, order = by_seconds(seconds, ("ticker",), "recv_utc")
    scanned = scan(rows, order, previous={"prev_state": F.col("state")}, following={"_next": F.col("recv_utc")},
                   last={"_carried": F.col("mid_tick")})
    head = seconds.groupBy("ticker").agg(
        F.min_by("mid_tick", F.when(F.col("mid_tick").isNotNull(), F.col("recv_utc"))).alias("_head"))
    return (
        scanned.join(head, "ticker")
        .select("ticker", F.col("recv_utc").alias("t"),
                F.coalesce("_next", tape_end).alias("until"), "state", "prev_state",
                F.coalesce("_carried", "_head").alias("mid_lkm"))
    )


def second_grid(classified: DataFrame) -> DataFrame:
    """One row per ticker and second from its first tick to the end of the tape."""
    return spans(classified).select(
        "ticker", F.explode(F.sequence("t", F.col("until") - 1)).alias("t"), "state", "mid_lkm")


def _minute_pieces(span_rows: DataFrame) -> DataFrame:
    """Spans cut at minute boundaries, with the seconds of each piece."""
    first = F.floor(F.col("t") / 60) * 60
    last = F.floor((F.col("until") - 1) / 60) * 60
    cut = span_rows.withColumn("minute_ts", F.explode(F.sequence(first, last, F.lit(60).cast("bigint"))))
    lo = F.greatest("t", "minute_ts")
    hi = F.least("until", F.col("minute_ts") + 60)
    return cut.withColumn("n", hi - lo)


def minutes(span_rows: DataFrame) -> DataFrame:
    """Majority state, mean mid and state fractions per ticker and minute (A3).

    Works on spans, so a quiet minute costs one row, not sixty. Equal counts are resolved in the
    order of ``STATES``.
    """
    per = _minute_pieces(span_rows).groupBy("ticker", "minute_ts").agg(
        F.sum("n").alias("n_seconds"),
        (F.sum(F.col("mid_lkm") * F.col("n")) / F.sum(F.when(F.col("mid_lkm").isNotNull(), F.col("n")))).alias("mid"),
        *[F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0)).alias(f"_n_{s}")
          for s in STATES])
    top = F.greatest(*[F.col(f"_n_{s}") for s in STATES])
    majority = F.coalesce(*[F.when(F.col(f"_n_{s}") == top, s) for s in STATES])
    return per.select(
        "ticker", "minute_ts", majority.alias("state_majority"), "mid", "n_seconds",
        *[(F.col(f"_n_{s}") / F.col("n_seconds")).alias(f"frac_{s.lower()}") for s in STATES])


def shares(rows: DataFrame, by: list[str], state: str = "state_majority",
           count: str = "n_minutes") -> DataFrame:
    """Percentage of rows in each state per group, with the group size (A4)."""
    return rows.groupBy(*by).agg(
        F.count("*").alias(count),
        *[(F.count_if(F.col(state) == s) * 100.0 / F.count("*")).alias(s) for s in STATES])


def weighted_shares(minute_rows: DataFrame) -> DataFrame:
    """Percentage of market-seconds in each state over all minutes (A4)."""
    return minute_rows.agg(*[
        (F.sum(F.col(f"frac_{s.lower()}") * F.col("n_seconds")) / F.sum("n_seconds") * 100).alias(s)
        for s in STATES])


def gated(minute_rows: DataFrame, start: float, end: float, lo: float, hi: float) -> DataFrame:
    """Minutes of a window whose previous minute's mid lies in a band.

    One row per ticker and minute, so the window per ticker is bounded by the tape's minutes.
    """
    prev = F.lag("mid").over(Window.partitionBy("ticker").orderBy("minute_ts"))
    return (
        minute_rows.withColumn("prev_mid", prev)
        .filter((F.col("minute_ts") >= start) & (F.col("minute_ts") < end)
                & F.col("prev_mid").between(lo, hi))
        .withColumn("invalid", F.col("state_majority").isin(*INVALID_FOR_BUYERS))
    )


def quantiles(rows: DataFrame, columns: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """Exact linear quantiles of several columns per group.

    The aggregate keeps one counter per distinct value; prices on a cent grid and contract counts
    have few.
    """
    return rows.groupBy(*by).agg(*[
        F.percentile(c, F.array(*[F.lit(q) for q in QUANTILES])).alias(n)
        for n, c in columns.items()])


def depth_histogram(valid: DataFrame) -> DataFrame:
    """Counts of valid ticks per depth bucket and side."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"depth_{s}_eff").alias("depth"))
                      for s in ("ask", "bid")])
    return (
        valid.select(F.inline(sides))
        .groupBy("side", depth_bucket(F.col("depth")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def numbered_spans(span_rows: DataFrame) -> DataFrame:
    """Spans with the number of the run of one state they belong to."""
    rows, order = by_seconds(span_rows, ("ticker",), "t")
    change = F.col("prev_state").isNull() | (F.col("prev_state") != F.col("state"))
    return islands(rows, order, change, "run")


def state_runs(span_rows: DataFrame) -> DataFrame:
    """Maximal runs of one state per ticker, in seconds."""
    return numbered_spans(span_rows).groupBy("ticker", "run").agg(
        F.any_value("state").alias("state"), F.min("t").alias("start_t"),
        F.max("until").alias("end_t"),
    ).withColumn("length_s", F.col("end_t") - F.col("start_t"))


def run_stability(runs: DataFrame) -> DataFrame:
    """Longest, median and number of VALID runs and their breaks per hour, per ticker."""
    valid = F.col("state") == "VALID"
    per = runs.groupBy("ticker").agg(
        F.max(F.when(valid, F.col("length_s"))).alias("longest_valid_run_s"),
        F.percentile(F.when(valid, F.col("length_s")), F.lit(0.5)).alias("median_valid_run_s"),
        F.count_if(valid).alias("n_valid_runs"),
        F.max_by("state", "run").alias("_last"),
        (F.sum("length_s") / 3600.0).alias("tape_hours"))
    breaks = F.col("n_valid_runs") - F.when(F.col("_last") == "VALID", 1).otherwise(0)
    return (
        per.filter(F.col("n_valid_runs") > 0)
        .withColumn("transitions_valid_to_invalid", breaks)
        .withColumn("transitions_per_hour", breaks / F.col("tape_hours")).drop("_last")
    )


def pooled_runs(runs: DataFrame) -> DataFrame:
    """Median, p75, p90 and maximum VALID run over all tickers."""
    q = F.percentile("length_s", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    return runs.filter(F.col("state") == "VALID").agg(q.alias("q"), F.max("length_s").alias("longest")).select(
        F.col("q")[0].alias("median"), F.col("q")[1].alias("p75"), F.col("q")[2].alias("p90"), "longest")


def rest_share(span_rows: DataFrame, lo: float, hi: float,
               thresholds: tuple[int, ...] = (5, 15, 30, 60, 120)) -> DataFrame:
    """Percentage of each band's seconds inside a VALID run of at least T seconds.

    The run's length is joined to the spans of its ticker by the run they belong to.
    """
    numbered = numbered_spans(span_rows).withColumn("n", F.col("until") - F.col("t"))
    lengths = numbered.groupBy("ticker", "run").agg(F.sum("n").alias("length_s"))
    joined = numbered.join(lengths, ["ticker", "run"]).withColumn(
        "band", price_band(F.col("mid_lkm"), lo, hi)).filter(F.col("band").isNotNull())
    valid = F.col("state") == "VALID"
    return joined.groupBy("band").agg(
        F.sum("n").alias("n_seconds"),
        *[(F.coalesce(F.sum(F.when(valid & (F.col("length_s") >= t), F.col("n"))), F.lit(0)) * 100.0
           / F.sum("n")).alias(f"ge_{t}s") for t in thresholds])

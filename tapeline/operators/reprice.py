"""Book reaction to spoken phrases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.prices import DEPTH_EPS, known, mid_by_price
from tapeline.operators.dedup import dedup_ticks
from tapeline.operators.joins import asof_backward, within_seconds
from tapeline.operators.ordered import Ordering, running_sum
from tapeline.session import materialize

MOVE_CHUNK_S = 6 * 3600


@dataclass(frozen=True)
class RepriceParams:
    baseline_lookback_s: int = 600
    baseline_cut_s: int = 120
    before_s: int = 300
    after_s: int = 300
    threshold: float = 0.03


def prepare(ticks: DataFrame) -> DataFrame:
    """Distinct ticks with a mid and without float-noise depths."""
    depths = [c for c in ("depth_bid", "depth_ask", "depth_bid2", "depth_ask2") if c in ticks.columns]
    t = dedup_ticks(ticks).withColumns({
        "yes_bid": known(F.col("yes_bid")), "yes_ask": known(F.col("yes_ask")),
        **{d: F.when(F.abs(known(F.col(d))) < DEPTH_EPS, 0.0).otherwise(known(F.col(d))) for d in depths}})
    return t.withColumn("mid", mid_by_price(F.col("yes_bid"), F.col("yes_ask")))


def measure(events: DataFrame, ticks: DataFrame, p: RepriceParams = RepriceParams()) -> DataFrame:
    """Reaction of a market's book to each mention of its phrase.

    ``events``: occasion_id, market_ticker, t_word and anything else, one row per mention.
    ``ticks``: as from ``prepare``. A mention without a usable baseline, or without ticks, keeps
    NULL measurements. Ticks are reduced to one row per second and mid before any join - times are
    whole seconds and prices lie on a grid, so a crowded second stays small - and mentions of one
    market are a gap apart, so a second falls into few windows.
    """
    # a book's reaction depends on its market and the second alone, which many occasions share
    key = ["market_ticker", "t_word"]
    events = materialize(events, "mentions")  # few rows from a long scan, read by every branch
    e = materialize(events.select(*key).distinct().withColumn("ticker", F.col("market_ticker")), "moments")
    t = F.col("t_word")
    span = p.before_s + p.after_s
    series = ticks.select("ticker", "recv_utc", "seq", "yes_bid", "yes_ask", "depth_bid", "depth_ask", "mid").join(
        e.select("ticker").distinct(), "ticker", "left_semi")

    pulled = (F.coalesce(F.col("depth_ask") < DEPTH_EPS, F.lit(False)) | F.col("yes_ask").isNull()
              | F.coalesce(F.col("yes_bid") >= F.col("yes_ask"), F.lit(False)))
    seconds = series.groupBy("ticker", "recv_utc", "mid").agg(
        F.count("*").alias("n"), F.min("seq").alias("seq"), F.bool_or(pulled).alias("pulled"))

    base = within_seconds(e, seconds, ["ticker"], t - p.baseline_lookback_s, t - p.baseline_cut_s,
                          "recv_utc", span).groupBy(*key).agg(
        F.percentile("mid", F.lit(0.5), F.col("n")).alias("baseline"))
    base = materialize(base, "baselines")
    last = seconds.groupBy("ticker").agg(F.max("recv_utc").alias("_last"))

    at = F.struct("recv_utc", "seq")
    deviation = F.col("mid") - F.col("baseline")
    hit = F.when(F.abs(deviation) >= p.threshold, at)
    usable = e.join(base.filter(F.col("baseline").isNotNull()), key)
    moved = within_seconds(usable, seconds, ["ticker"], t - p.before_s, t + p.after_s, "recv_utc",
                           span).groupBy(*key).agg(
        F.min_by("recv_utc", hit).alias("t_reprice"),
        F.min_by(deviation, hit).alias("reprice_move"),
        F.min(F.when(F.col("pulled"), F.col("recv_utc"))).alias("t_pull"))

    # three lookups per mention on one time line: mids after 60 s and 300 s, the book before
    asked = usable.withColumn("_off", F.explode(F.array(F.lit(60), F.lit(300), F.lit(-1))))
    seen = asof_backward(asked, series, "ticker", F.col("t_word") + F.col("_off"), F.col("recv_utc"),
                         "seq", ["mid", "yes_bid", "yes_ask", "depth_bid", "depth_ask"], "q")

    def at_offset(offset: int, value: Column) -> Column:
        return F.max(F.when(F.col("_off") == offset, value))

    valid = F.coalesce((F.col("q.yes_bid") < F.col("q.yes_ask")) & (F.col("q.depth_bid") >= 1)
                       & (F.col("q.depth_ask") >= 1), F.lit(False))
    states = seen.groupBy(*key).agg(
        at_offset(60, F.col("q.mid") - F.col("baseline")).alias("move_60s"),
        at_offset(300, F.col("q.mid") - F.col("baseline")).alias("move_300s"),
        at_offset(-1, F.when(F.col("q").isNotNull(), valid)).alias("book_valid_at_word"))

    covered = F.col("_has_base") & (F.col("_last") >= t + (p.after_s - 10))
    measured = (
        e.drop("ticker").join(last.withColumnRenamed("ticker", "market_ticker"), "market_ticker", "left")
        .join(base.withColumn("_has_base", F.lit(True)), key, "left")
        .join(moved, key, "left").join(states, key, "left")
        .withColumn("lag_s", F.col("t_reprice") - t)
        .withColumn("tick_coverage", F.coalesce(covered, F.lit(False)))
        .select(*key, "t_reprice", "t_pull", "lag_s", "move_60s", "move_300s", "reprice_move",
                "book_valid_at_word", "tick_coverage")
    )
    out = events.join(materialize(measured, "measured"), key, "left").withColumn("tick_coverage", F.coalesce("tick_coverage", F.lit(False)))
    return out.select(*events.columns, *measured.columns[len(key):])


def lag_stats(measured: DataFrame, by: list[str] = ()) -> DataFrame:
    """Distribution of reaction lags of covered mentions."""
    q = F.percentile("lag_s", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return measured.filter(F.col("tick_coverage") & F.col("lag_s").isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), q.alias("q"), F.min("lag_s").alias("min_s"), F.max("lag_s").alias("max_s"),
        F.avg(F.when(F.col("lag_s") < 0, 100.0).otherwise(0.0)).alias("pct_negative"),
    ).select(*by, "n", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"),
             "min_s", "max_s", "pct_negative")


def step_moves(ticks: DataFrame, lookback_s: int) -> DataFrame:
    """Absolute move of each tick from the first tick at or after ``t - lookback_s``.

    The first tick of a window is the first tick of its first second, so the range frame runs over
    one row per second. Chunks of time carry a halo of the lookback. A tick that is itself the
    first of its window has no move; tickers with fewer than three ticks are left out.
    """
    t = ticks.select("ticker", "recv_utc", "seq", "mid")
    enough = t.groupBy("ticker").agg(F.count("*").alias("_n")).filter(F.col("_n") >= 3).select("ticker")
    firsts = t.groupBy("ticker", "recv_utc").agg(
        F.min("seq").alias("seq0"), F.min_by("mid", "seq").alias("m0"))
    chunk = F.floor(F.col("recv_utc") / MOVE_CHUNK_S)
    halo_of = F.floor((F.col("recv_utc") + lookback_s) / MOVE_CHUNK_S)
    chunked = firsts.withColumn("_chunk", F.explode(F.sequence(chunk, halo_of)))
    back = Window.partitionBy("ticker", "_chunk").orderBy("recv_utc").rangeBetween(-lookback_s, 0)
    opens = chunked.withColumn("_open", F.first(F.struct("recv_utc", "seq0", "m0")).over(back)).filter(
        F.col("_chunk") == chunk).select("ticker", "recv_utc", "_open").join(enough, "ticker")
    own = (F.col("_open.recv_utc") == F.col("recv_utc")) & (F.col("_open.seq0") == F.col("seq"))
    before = F.col("_open.m0")
    return (
        t.join(opens, ["ticker", "recv_utc"]).filter(~own)  # no ticker-second holds many ticks
        .select("ticker", "recv_utc", "seq", before.alias("mid_before"), F.col("mid").alias("mid_after"),
                F.abs(F.col("mid") - before).alias("move_abs"))
        .filter(F.col("move_abs").isNotNull())
    )


def fastest_moves(moves: DataFrame, top_n: int = 10, apart_s: int = 300) -> DataFrame:
    """Largest moves, at most one per ticker within ``apart_s``.

    Per ticker the ``3 * top_n`` largest are walked from the largest down and those near a kept
    one dropped; the limit per ticker is applied before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("move_abs"), "recv_utc", "seq"))
    top = moves.withColumn("_n", place).filter(F.col("_n") <= 3 * top_n)
    lists = top.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(
        "_n", "recv_utc", "move_abs", "mid_before", "mid_after"))).alias("rows"))
    kept = F.expr(f"""aggregate(rows, slice(rows, 1, 0),
        (acc, x) -> if(exists(acc, k -> abs(k.recv_utc - x.recv_utc) < {apart_s}), acc, array_append(acc, x)))""")
    return (
        lists.select("ticker", F.inline(kept))
        .select("ticker", F.col("recv_utc").alias("t_event"), "move_abs", "mid_before", "mid_after")
        .orderBy(F.desc("move_abs"), "ticker", "t_event").limit(top_n)
    )


def earliest_reaction(calls: DataFrame, moves: DataFrame, before_s: int = 90, after_s: int = 180,
                      threshold: float = 0.04) -> DataFrame:
    """Earliest sharp move of any ticker around each call.

    ``calls``: call_id, t_call. Moves are cut to one per second first (lowest ticker), so the join
    by time chunk meets a bounded number of them.
    """
    sharp = moves.filter(F.col("move_abs") >= threshold).groupBy("recv_utc").agg(
        F.min_by(F.struct("ticker", (F.col("mid_after") - F.col("mid_before")).alias("move")),
                 F.struct("ticker", "seq")).alias("m"))
    near = within_seconds(calls, sharp, [], F.col("t_call") - before_s, F.col("t_call") + after_s,
                          "recv_utc", before_s + after_s)
    first = near.groupBy("call_id").agg(F.min("recv_utc").alias("t_react"), F.min_by("m", "recv_utc").alias("m"))
    return calls.join(first, "call_id", "left").select(
        *calls.columns, F.col("m.ticker").alias("ticker"), "t_react", F.col("m.move").alias("move"),
        (F.col("t_react") - F.col("t_call")).alias("lag_s"))


def covered_calls(calls: DataFrame, ticks: DataFrame, before_s: int = 90, after_s: int = 180) -> DataFrame:
    """Calls whose whole reaction window lies inside the tape."""
    first, last = ticks.agg(F.min("recv_utc")).scalar(), ticks.agg(F.max("recv_utc")).scalar()
    return calls.filter((F.col("t_call") - before_s >= first) & (F.col("t_call") + after_s <= last))


def mentions_near(moves: DataFrame, words: DataFrame, matches: DataFrame, window_s: int = 120,
                  pad: int = 3) -> DataFrame:
    """Phrase matches around each move.

    A move looks two positions up in every transcript: its first word not before ``t_event -
    window_s`` and its first not before ``t_event + window_s``. The words between them, ``pad`` more
    on both sides, are its slice, so there is one even where no word falls in the window; matches
    that lie wholly inside the slice are reported. As few moves are asked for, all positions are counted
    in one aggregate over the words.
    ``moves``: ticker, t_event, ..., the few that ``top_moves`` picks; ``words`` have gap-free
    positions in order of time; ``matches`` as from ``measured_matches``.
    """
    events = moves.select("ticker", "t_event").distinct().collect()
    before = [F.count_if(F.col("t_start_utc") < r.t_event + off) for r in events for off in (-window_s, window_s)]
    at = words.groupBy("occasion_id").agg(F.array(*before).alias("_n")) if before else words.select("occasion_id", F.array().cast("array<bigint>").alias("_n")).limit(0)
    asked = F.array(*[F.struct(F.lit(r.ticker).alias("ticker"), F.lit(r.t_event).cast(moves.schema["t_event"].dataType).alias("t_event"), F.greatest(F.lit(0), F.col("_n")[2 * i] - pad).alias("_lo"),
                               (F.col("_n")[2 * i + 1] + pad).alias("_hi")) for i, r in enumerate(events)])
    spans = at.select("occasion_id", F.inline(asked)) if events else at.selectExpr("occasion_id", "'' AS ticker", "0L AS t_event", "0L AS _lo", "0L AS _hi")
    # positions are joined in chunks, as times are
    size = 1024
    copied = spans.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size))))
    m = matches.select("occasion_id", "market_ticker", "phrase", "word_idx", "t_start_utc", "n_tokens", F.floor(F.col("word_idx") / size).alias("_c"))
    inside = (F.col("word_idx") >= F.col("_lo")) & (F.col("word_idx") + F.col("n_tokens") <= F.col("_hi"))
    return copied.join(m, ["occasion_id", "_c"]).filter(inside).select(
        "ticker", "t_event", "occasion_id", "market_ticker", "phrase", "word_idx", "t_start_utc",
        (F.col("t_start_utc") - F.col("t_event")).alias("dt_s"))

"""Book-shape queries over the tick view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions.prices import STATES, phase, price_band
from tapeline.operators import book
from tapeline.plans import views
from tapeline.plans.catalog import query
from tapeline.plans.sqlviews import sql

# Off every mean a minute of cent prices can have, so the edges never depend on rounding.
LO, HI = 0.45037, 0.60037
ANCHOR = views.TAPE_T0
BREAKS, LABELS = [15.0, 30.0, 50.0], ["before", "first", "second", "after"]

BAND = ("CASE WHEN {m} > -0.01 AND {m} <= 0.45037 THEN '<0.45037' WHEN {m} > 0.45037 AND {m} <= 0.60037 "
        "THEN '0.45037-0.60037' WHEN {m} > 0.60037 AND {m} <= 1.01 THEN '>0.60037' END")
CLASSIFIED = """
    SELECT *, CASE WHEN db <= 0 AND da <= 0 THEN 'EMPTY_BOTH' WHEN da <= 0 THEN 'EMPTY_ASK'
                   WHEN db <= 0 THEN 'EMPTY_BID' WHEN yes_bid >= yes_ask THEN 'CROSSED' ELSE 'VALID' END AS state,
           CASE WHEN db > 0 AND da > 0 THEN (yes_bid + yes_ask) / 2.0 WHEN db > 0 THEN yes_bid
                WHEN da > 0 THEN yes_ask END AS mid_tick, yes_ask - yes_bid AS spread
    FROM (SELECT *, CASE WHEN depth_bid > 1e-6 THEN depth_bid ELSE 0 END AS db,
                 CASE WHEN depth_ask > 1e-6 THEN depth_ask ELSE 0 END AS da FROM ticks)"""
GRID_CTES = {
    "classified": CLASSIFIED,
    "lastsec": "SELECT * FROM classified QUALIFY row_number() OVER (PARTITION BY ticker, recv_utc ORDER BY seq DESC) = 1",
    "secs": """SELECT ticker, unnest(range(min(recv_utc), (SELECT max(recv_utc) FROM ticks) + 1)) AS t
               FROM lastsec GROUP BY ticker""",
    "grid": """
        SELECT s.ticker, s.t, last_value(l.state IGNORE NULLS) OVER w AS state,
               coalesce(last_value(l.mid_tick IGNORE NULLS) OVER w,
                        first_value(l.mid_tick IGNORE NULLS) OVER (PARTITION BY s.ticker ORDER BY s.t
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS mid_lkm
        FROM secs s LEFT JOIN lastsec l ON l.ticker = s.ticker AND l.recv_utc = s.t
        WINDOW w AS (PARTITION BY s.ticker ORDER BY s.t ROWS UNBOUNDED PRECEDING)""",
}
_COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS c_{s.lower()}" for s in STATES)
_TOP = "greatest(" + ", ".join(f"c_{s.lower()}" for s in STATES) + ")"
_MAJOR = "CASE " + " ".join(f"WHEN c_{s.lower()} = {_TOP} THEN '{s}'" for s in STATES) + " END"
_FRACS = ", ".join(f"c_{s.lower()} / n_seconds AS frac_{s.lower()}" for s in STATES)
MINUTE_CTES = {**GRID_CTES, "mins": f"""
    SELECT ticker, minute_ts, {_MAJOR} AS state_majority, mid, n_seconds, {_FRACS}
    FROM (SELECT ticker, t // 60 * 60 AS minute_ts, count(*) AS n_seconds, avg(mid_lkm) AS mid, {_COUNTS}
          FROM grid GROUP BY ALL)"""}
RUN_CTES = {**GRID_CTES,
    "numbered": """SELECT *, sum(chg) OVER (PARTITION BY ticker ORDER BY t) AS run
                   FROM (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY ticker ORDER BY t)
                                   THEN 1 ELSE 0 END AS chg FROM grid)""",
    "runs": """SELECT ticker, CAST(run AS BIGINT) AS run, any_value(state) AS state, min(t) AS start_t,
                      max(t) + 1 AS end_t, count(*) AS length_s FROM numbered GROUP BY ticker, run"""}


def _classified(spark, sf_dir):
    return book.classify(book.without_suffix(views.ticks(spark, sf_dir), "-NQE"))


def _spans(spark, sf_dir):
    return book.spans(_classified(spark, sf_dir))


def _minutes(spark, sf_dir):
    return book.minutes(_spans(spark, sf_dir))


@query("book_states", sql(f"""
    SELECT state, {BAND.format(m='mid_tick')} AS band, count(*) AS n FROM classified GROUP BY ALL""", "ticks",
    classified=CLASSIFIED))
def book_states(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy(
        "state", price_band(F.col("mid_tick"), LO, HI).alias("band")).agg(F.count("*").alias("n"))


@query("second_grid", sql("""SELECT ticker, state, count(*) AS n, min(t) AS lo, max(t) AS hi,
    CAST(sum(round(mid_lkm * 200)) AS BIGINT) AS half_cents FROM grid GROUP BY ALL""", "ticks", **GRID_CTES))
def second_grid(spark, sf_dir):
    return book.second_grid(_classified(spark, sf_dir)).groupBy("ticker", "state").agg(
        F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"),
        F.sum(F.round(F.col("mid_lkm") * 200).cast("bigint")).alias("half_cents"))


@query("book_minutes", sql("SELECT * REPLACE (round(mid, 9) AS mid) FROM mins", "ticks", **MINUTE_CTES))
def book_minutes(spark, sf_dir):
    return _minutes(spark, sf_dir).withColumn("mid", F.round("mid", 9))


_SHARES = ", ".join(f"count(*) FILTER (state_majority = '{s}') * 100.0::DOUBLE / count(*) AS \"{s}\"" for s in STATES)


@query("state_share", sql(f"""
    SELECT 'ticker' AS cut, ticker AS label, count(*) AS n_minutes, {_SHARES} FROM mins GROUP BY ticker UNION ALL
    SELECT 'band', {BAND.format(m='mid')}, count(*), {_SHARES} FROM mins GROUP BY 2 UNION ALL
    SELECT 'phase', CASE WHEN minute_ts <= 1700000900 THEN 'before' WHEN minute_ts <= 1700001800 THEN 'first'
                         WHEN minute_ts <= 1700003000 THEN 'second' ELSE 'after' END, count(*), {_SHARES} FROM mins GROUP BY 2 UNION ALL
    SELECT 'all', 'all', count(*), {_SHARES} FROM mins""", "ticks", **MINUTE_CTES))
def state_share(spark, sf_dir):
    m = _minutes(spark, sf_dir).withColumns({
        "band": price_band(F.col("mid"), LO, HI),
        "phase": phase(F.col("minute_ts"), ANCHOR, BREAKS, LABELS)})
    # the four breakdowns in one pass: every minute counts once in each
    cuts = F.array(*[F.struct(F.lit(n).alias("cut"), c.alias("label")) for n, c in (
        ("ticker", F.col("ticker")), ("band", F.col("band")), ("phase", F.col("phase")), ("all", F.lit("all")))])
    return book.shares(m.select("state_majority", F.inline(cuts)), ["cut", "label"])


@query("state_seconds", sql("SELECT " + ", ".join(
    f"round(count(*) FILTER (state = '{s}') * 100.0 / count(*), 9) AS \"{s}\"" for s in STATES) + " FROM grid",
    "ticks", **GRID_CTES))
def state_seconds(spark, sf_dir):
    out = book.weighted_shares(_minutes(spark, sf_dir))
    return out.select(*[F.round(s, 9).alias(s) for s in STATES])


@query("gated_invalid", sql("""
    SELECT state_majority, invalid, count(*) AS n
    FROM (SELECT *, lag(mid) OVER (PARTITION BY ticker ORDER BY minute_ts) AS prev_mid,
                 state_majority IN ('CROSSED', 'EMPTY_ASK', 'EMPTY_BOTH') AS invalid FROM mins)
    WHERE minute_ts >= 1700000600 AND minute_ts < 1700003600 AND prev_mid BETWEEN 0.45037 AND 0.60037
    GROUP BY ALL""", "ticks", **MINUTE_CTES))
def gated_invalid(spark, sf_dir):
    return book.gated(_minutes(spark, sf_dir), ANCHOR + 600, ANCHOR + 3600, LO, HI).groupBy(
        "state_majority", "invalid").agg(F.count("*").alias("n"))


_Q = "[0.25, 0.5, 0.75, 0.9]"


@query("spread_quantiles", sql(f"""
    SELECT band, k, round(spread_c[k], 6) AS spread_c, round(bid_d[k], 6) AS depth_bid, round(ask_d[k], 6) AS depth_ask
    FROM (SELECT {BAND.format(m='mid_tick')} AS band, quantile_cont(spread * 100, {_Q}) AS spread_c,
                 quantile_cont(db, {_Q}) AS bid_d, quantile_cont(da, {_Q}) AS ask_d
          FROM classified WHERE state = 'VALID' GROUP BY 1), (SELECT unnest(range(1, 5)) AS k) WHERE band IS NOT NULL""", "ticks",
    classified=CLASSIFIED))
def spread_quantiles(spark, sf_dir):
    valid = _classified(spark, sf_dir).filter(F.col("state") == "VALID").withColumn(
        "band", price_band(F.col("mid_tick"), LO, HI)).filter(F.col("band").isNotNull())
    q = book.quantiles(valid, {"spread_c": F.col("spread") * 100, "depth_bid": F.col("depth_bid_eff"),
                               "depth_ask": F.col("depth_ask_eff")}, ["band"])
    return q.select("band", F.posexplode(F.arrays_zip("spread_c", "depth_bid", "depth_ask"))).select(
        "band", (F.col("pos") + 1).cast("bigint").alias("k"),
        *[F.round(F.col(f"col.{c}"), 6).alias(c) for c in ("spread_c", "depth_bid", "depth_ask")])


@query("depth_histogram", sql("""
    SELECT side, CASE WHEN d <= 1 THEN '<=1' WHEN d <= 5 THEN '(1,5]' WHEN d <= 20 THEN '(5,20]'
                      WHEN d <= 100 THEN '(20,100]' ELSE '>100' END AS bucket, count(*) AS n
    FROM (SELECT 'ask' AS side, da AS d FROM classified WHERE state = 'VALID' UNION ALL
          SELECT 'bid', db FROM classified WHERE state = 'VALID') GROUP BY ALL""", "ticks", classified=CLASSIFIED))
def depth_histogram(spark, sf_dir):
    return book.depth_histogram(_classified(spark, sf_dir).filter(F.col("state") == "VALID"))


@query("state_runs", sql("SELECT * FROM runs", "ticks", **RUN_CTES))
def state_runs(spark, sf_dir):
    return book.state_runs(_spans(spark, sf_dir))


@query("run_stability", sql("""
    SELECT ticker, max(length_s) FILTER (state = 'VALID') AS longest_valid_run_s,
           quantile_cont(length_s, 0.5) FILTER (state = 'VALID') AS median_valid_run_s,
           count(*) FILTER (state = 'VALID') AS n_valid_runs,
           CAST(sum(length_s) / 3600.0 AS DOUBLE) AS tape_hours,
           count(*) FILTER (state = 'VALID' AND run < last_run) AS transitions_valid_to_invalid,
           count(*) FILTER (state = 'VALID' AND run < last_run) / CAST(sum(length_s) / 3600.0 AS DOUBLE) AS transitions_per_hour
    FROM (SELECT *, max(run) OVER (PARTITION BY ticker) AS last_run FROM runs)
    GROUP BY ticker HAVING n_valid_runs > 0""", "ticks", **RUN_CTES))
def run_stability(spark, sf_dir):
    return book.run_stability(book.state_runs(_spans(spark, sf_dir)))


@query("pooled_runs", sql("""
    SELECT quantile_cont(length_s, 0.5) AS median, quantile_cont(length_s, 0.75) AS p75,
           round(quantile_cont(length_s, 0.9), 9) AS p90, max(length_s) AS longest
    FROM runs WHERE state = 'VALID'""", "ticks", **RUN_CTES))
def pooled_runs(spark, sf_dir):
    return book.pooled_runs(book.state_runs(_spans(spark, sf_dir))).withColumn("p90", F.round("p90", 9))


_T = (5, 15, 30, 60, 120)


@query("rest_share", sql("SELECT band, count(*) AS n_seconds, " + ", ".join(
    f"count(*) FILTER (state = 'VALID' AND length_s >= {t}) * 100.0::DOUBLE / count(*) AS ge_{t}s" for t in _T) + f"""
    FROM (SELECT n.*, {BAND.format(m='mid_lkm')} AS band, r.length_s FROM numbered n
          JOIN runs r ON r.ticker = n.ticker AND r.run = n.run) WHERE band IS NOT NULL GROUP BY band""",
    "ticks", **RUN_CTES))
def rest_share(spark, sf_dir):
    return book.rest_share(_spans(spark, sf_dir), LO, HI, _T)

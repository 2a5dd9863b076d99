"""As-of lookup, fills, replay, sweep and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import calibrate, joins, replay
from tapeline.functions import prices
from tapeline.plans import views
from tapeline.plans.catalog import query
from tapeline.plans.sqlviews import sql

REPLAY_CTES = {
    "meta": """SELECT market_ticker, occasion, speaker, format, resolution_risk FROM registry
               QUALIFY row_number() OVER (PARTITION BY market_ticker ORDER BY ingest_seq) = 1""",
    "quoted": """
        SELECT p.*, CASE WHEN b.yes_ask_close >= b.yes_bid_close THEN (b.yes_bid_close + b.yes_ask_close) / 2.0 END AS market_prob,
               b.yes_bid_close AS bid, b.yes_ask_close AS ask
        FROM predictions p LEFT JOIN LATERAL (
               SELECT * FROM candles c WHERE c.ticker = p.market_ticker AND c.ts <= p.decision_ts
               ORDER BY c.ts DESC LIMIT 1) b ON p.decision_ts - b.ts <= 604800""",
    "sided": """
        SELECT *, CASE WHEN p_cal - market_prob > 0 THEN 'yes' WHEN p_cal - market_prob <= 0 THEN 'no' END AS side_,
               CASE WHEN p_cal - market_prob > 0 AND round((bid + 0.01) * 100) / 100.0 < ask THEN round((bid + 0.01) * 100) / 100.0
                    WHEN p_cal - market_prob <= 0 AND round((ask - 0.01) * 100) / 100.0 > bid THEN round((ask - 0.01) * 100) / 100.0
               END AS quote_
        FROM quoted""",
    "touched": """
        SELECT s.*, (SELECT min(c.ts) FROM candles c WHERE c.ticker = s.market_ticker AND c.ts > s.decision_ts
                     AND CASE WHEN side_ = 'yes' THEN c.price_low <= quote_ ELSE c.price_high >= quote_ END) AS touch
        FROM sided s""",
}


def _replay_ctes(split: str | None) -> dict[str, str]:
    gate = "true" if split is None else f"split = '{split}'"
    fee = "ceil(0.0175 * 1.0 * quote_price * (1.0 - quote_price) * 100.0) / 100.0"
    stake = "CASE WHEN side = 'yes' THEN quote_price ELSE 1.0 - quote_price END"
    payout = "CAST(CASE WHEN side = 'yes' AND y = 1 THEN 1 WHEN side = 'no' AND y = 0 THEN 1 ELSE 0 END AS DOUBLE)"
    return {**REPLAY_CTES, "traded_rows": f"""
        SELECT *, CASE WHEN traded THEN side_ END AS side, CASE WHEN traded THEN quote_ END AS quote_price,
               traded AND touch IS NOT NULL AS filled
        FROM (SELECT *, coalesce({gate} AND market_prob BETWEEN 0.15 AND 0.60
                                 AND abs(p_cal - market_prob) > 0.05 AND quote_ IS NOT NULL, false) AS traded
              FROM touched)""",
        "replayed": f"""
        SELECT t.market_ticker, occasion, speaker, coalesce(format, 'other') AS format,
               coalesce(resolution_risk, 'low') AS resolution_risk, decision_ts, split, y, market_prob,
               p_base, p_topic, p_cal, traded, side, quote_price, filled,
               CASE WHEN filled THEN touch END AS fill_ts, CASE WHEN filled THEN quote_price END AS fill_price,
               CASE WHEN filled THEN {fee} ELSE 0.0 END AS fee, CAST(filled AS INT)::DOUBLE AS contracts,
               CASE WHEN filled THEN {stake} ELSE 0.0 END AS stake, CASE WHEN filled THEN {payout} ELSE 0.0 END AS payout,
               CASE WHEN filled THEN {payout} - ({stake}) - {fee} ELSE 0.0 END AS pnl,
               filled AND coalesce(resolution_risk, 'low') IN ('medium', 'high') AS decided_by_technicality
        FROM traded_rows t LEFT JOIN meta USING (market_ticker)"""}


def _inputs(spark, sf_dir):
    return (views.predictions(spark, sf_dir), views.candles(spark, sf_dir),
            views.registry(spark, sf_dir))


@query("asof_quote", sql("""
    SELECT market_ticker, decision_ts, b.ts AS bar_ts, b.yes_bid_close, b.yes_ask_close
    FROM predictions p JOIN LATERAL (
      SELECT * FROM candles c WHERE c.ticker = p.market_ticker AND c.ts <= p.decision_ts
      ORDER BY c.ts DESC LIMIT 1) b ON p.decision_ts - b.ts <= 43200""", "predictions", "candles"))
def asof_quote(spark, sf_dir):
    points = views.predictions(spark, sf_dir).select(F.col("market_ticker").alias("ticker"), "decision_ts")
    return joins.latest_bar(points, views.candles(spark, sf_dir), ["yes_bid_close", "yes_ask_close"],
                            43_200).withColumnRenamed("ticker", "market_ticker")


@query("first_touch", sql("""
    SELECT market_ticker AS ticker, decision_ts, side_ AS side, quote_ AS quote_price, touch AS fill_ts
    FROM touched WHERE touch IS NOT NULL AND quote_ IS NOT NULL""", "predictions", "candles", "registry", **REPLAY_CTES))
def first_touch(spark, sf_dir):
    preds, bars, _ = _inputs(spark, sf_dir)
    rows = replay.priced(preds, bars, replay.ReplayParams()).filter(F.col("_quote").isNotNull())
    return joins.first_touch(rows.select(
        F.col("market_ticker").alias("ticker"), "decision_ts", F.col("_side").alias("side"),
        F.col("_quote").alias("quote_price")), bars)


@query("replay", sql("SELECT * FROM replayed", "predictions", "candles", "registry", **_replay_ctes("test")))
def replay_test(spark, sf_dir):
    return replay.replay(*_inputs(spark, sf_dir))


_FEE = "ceil(0.0175 * 1.0 * quote_price * (1.0 - quote_price) * 100.0) / 100.0"
_REPEATS = {"twice": """SELECT * FROM predictions UNION ALL
                 SELECT market_ticker, decision_ts, split, y, p_base, p_topic, CAST(substr(market_ticker, 2) AS BIGINT) * 91 % 100 / 100.0 AS p_cal FROM predictions""",
            **{k: v.replace("FROM predictions p", "FROM twice p").replace(_FEE, f"CASE WHEN CAST(substr(t.market_ticker, 2) AS BIGINT) % 3 = 1 THEN 0.0 ELSE {_FEE} END")
               for k, v in _replay_ctes(None).items()}}


@query("replay_repeats", sql("SELECT * FROM replayed", "predictions", "candles", "registry", **_REPEATS))
def replay_repeats(spark, sf_dir):
    """Two predictions per market and time, and a fee map that lists most series twice."""
    preds, bars, registry = _inputs(spark, sf_dir)
    u = F.substring("market_ticker", 2, 20).cast("bigint")
    preds = preds.unionByName(preds.withColumn("p_cal", u * 91 % 100 / 100.0))
    charged, free = F.lit(prices.MAKER_FEE_TYPE), F.lit("none")
    listed = F.when(u % 3 == 0, F.array(free, charged)).when(u % 3 == 1, F.array(charged, free))
    fees = preds.select(F.col("market_ticker").alias("series"), F.posexplode(listed).alias("ingest_seq", "fee_type"))
    return replay.replay(preds, bars, registry, replay.ReplayParams(trade_split=None), fees)


THETAS = [0.0, 0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4]
BAND_LOS = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]
_GRID = f"""SELECT * FROM (SELECT CAST(unnest([{', '.join(map(str, THETAS))}]) AS DOUBLE) AS theta),
            (SELECT CAST(unnest([{', '.join(map(str, BAND_LOS))}]) AS DOUBLE) AS band_lo)"""
_ALL = _replay_ctes(None)
_ALL_ROWS = _ALL["traded_rows"].replace("BETWEEN 0.15 AND 0.60", "BETWEEN 0.0 AND 0.60").replace("> 0.05", "> 0.0")


@query("replay_sweep", sql("""
    SELECT theta, band_lo, count(*) AS n_traded, count(*) FILTER (filled) AS n_filled,
           CAST(sum(CAST(round(stake * 100) AS BIGINT)) AS BIGINT) AS stake_cents,
           CAST(sum(CAST(round(fee * 100) AS BIGINT)) AS BIGINT) AS fee_cents,
           CAST(sum(CAST(round(pnl * 100) AS BIGINT)) AS BIGINT) AS pnl_cents,
           count(*) FILTER (filled AND pnl > 0) AS n_won
    FROM grid g JOIN replayed r ON r.market_prob >= g.band_lo AND abs(p_cal - market_prob) > g.theta AND traded
    GROUP BY ALL""", "predictions", "candles", "registry",
    **{**_ALL, "traded_rows": _ALL_ROWS}, grid=_GRID))
def replay_sweep(spark, sf_dir):
    params = replay.ReplayParams(trade_split=None)
    out = replay.sweep(*_inputs(spark, sf_dir), THETAS, BAND_LOS, params)
    cents = [F.round(F.col(c) * 100).cast("bigint").alias(f"{c}_cents") for c in ("stake", "fee", "pnl")]
    return out.select("theta", "band_lo", "n_traded", "n_filled", *cents, "n_won")


@query("replay_rollup", sql("""
    SELECT split, occasion, count(*) AS n_rows, count(market_prob) AS n_priced,
           count(*) FILTER (traded) AS n_traded, count(*) FILTER (filled) AS n_filled,
           round(sum((p_cal - y) * (p_cal - y)), 9) AS sq_err_model,
           round(sum((market_prob - y) * (market_prob - y)), 9) AS sq_err_market, round(sum(pnl), 9) AS pnl
    FROM replayed GROUP BY split, occasion""", "predictions", "candles", "registry", **_replay_ctes(None)))
def replay_rollup(spark, sf_dir):
    rows = replay.replay(*_inputs(spark, sf_dir), replay.ReplayParams(trade_split=None))
    per = replay.rollup_by_occasion(rows)
    traded = rows.groupBy("split", "occasion").agg(F.count_if("traded").alias("n_traded"))
    same = (F.col("a.split") == F.col("b.split")) & F.col("a.occasion").eqNullSafe(F.col("b.occasion"))
    return per.alias("a").join(traded.alias("b"), same).select(
        "a.*", "n_traded").withColumns(
        {c: F.round(c, 9) for c in ("sq_err_model", "sq_err_market", "pnl")})


@query("fee_quote_settle", sql("""
    SELECT side, bid, ask, y, q AS quote, ceil(0.0175 * 1.0 * q * (1.0 - q) * 100.0) / 100.0 AS fee,
           CASE WHEN side = 'yes' THEN q ELSE 1.0 - q END AS stake,
           CAST((side = 'yes') = (y = 1) AS INT)::DOUBLE AS payout, n
    FROM (SELECT *, CASE WHEN side = 'yes' AND round((bid + 0.01) * 100) / 100.0 < ask THEN round((bid + 0.01) * 100) / 100.0
                         WHEN side = 'no' AND round((ask - 0.01) * 100) / 100.0 > bid THEN round((ask - 0.01) * 100) / 100.0 END AS q
          FROM (SELECT yes_bid_close AS bid, yes_ask_close AS ask, count(*) AS n FROM candles GROUP BY ALL),
               (SELECT unnest(['yes', 'no']) AS side), (SELECT unnest([0, 1]) AS y))
    WHERE q IS NOT NULL""", "candles"))
def fee_quote_settle(spark, sf_dir):
    grid = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(y).alias("y"))
                     for s in ("yes", "no") for y in (0, 1)])
    rows = views.candles(spark, sf_dir).groupBy(
        F.col("yes_bid_close").alias("bid"), F.col("yes_ask_close").alias("ask")).agg(
        F.count("*").alias("n")).withColumn("g", F.explode(grid)).select("bid", "ask", "n", "g.*")
    rows = rows.withColumn("quote", prices.maker_quote(F.col("side"), F.col("bid"), F.col("ask"), 0.01))
    return rows.filter(F.col("quote").isNotNull()).select(
        "side", "bid", "ask", "y", "quote",
        prices.maker_fee(F.col("quote"), 1.0, F.lit(True)).alias("fee"),
        prices.settle_stake(F.col("side"), F.col("quote")).alias("stake"),
        prices.settle_payout(F.col("side"), F.col("y")).alias("payout"), "n")


@query("time_split", sql("""
    SELECT doc_id, CASE WHEN ts <= (SELECT quantile_cont(ts, 0.6) FROM scores) + 1e-6 THEN 'train' ELSE 'test' END AS split
    FROM scores""", "scores"))
def time_split(spark, sf_dir):
    return calibrate.time_split(views.scores(spark, sf_dir), "ts", ["doc_id"]).select("doc_id", "split")


@query("brier_logloss", sql("""
    SELECT y, count(*) AS n, round(avg((p_raw - y) * (p_raw - y)), 10) AS brier,
           round(-avg(y * ln(q) + (1.0 - y) * ln(1.0 - q)), 8) AS log_loss
    FROM (SELECT *, greatest(1e-12, least(1.0 - 1e-12, p_raw)) AS q FROM scores) GROUP BY y""", "scores"))
def brier_logloss(spark, sf_dir):
    out = calibrate.score(views.scores(spark, sf_dir), "p_raw", "y", by=["y"])
    return out.withColumns({"brier": F.round("brier", 10), "log_loss": F.round("log_loss", 8)})


@query("prob_transforms", sql("""
    SELECT doc_id, round(ln(q / (1.0 - q)), 9) AS logit, round(1.0 / (1.0 + exp(-p_raw)), 12) AS sigmoid
    FROM (SELECT *, greatest(1e-6, least(1.0 - 1e-6, p_raw)) AS q FROM scores)""", "scores"))
def prob_transforms(spark, sf_dir):
    return views.scores(spark, sf_dir).select(
        "doc_id", F.round(prices.logit(F.col("p_raw")), 9).alias("logit"),
        F.round(prices.sigmoid(F.col("p_raw")), 12).alias("sigmoid"))


def _calibrated(spark, sf_dir, method):
    rows = calibrate.time_split(views.scores(spark, sf_dir), "ts", ["doc_id"])
    out = calibrate.calibrate(rows, "p_raw", "y", "split", "doc_id", method)
    return out.select("doc_id", "split", F.round("p_cal", 6).alias("p_cal"))


_SPLIT = """SELECT *, CASE WHEN ts <= (SELECT quantile_cont(ts, 0.6) FROM scores) + 1e-6 THEN 'train' ELSE 'test' END AS split FROM scores"""

# The fit at a row is the greatest, over all stretches' starts up to it, of the least mean of a stretch to or past it.
ISOTONIC_CTES = {
    "sides": _SPLIT,
    "train": "SELECT row_number() OVER (ORDER BY p_raw, doc_id) AS i, p_raw AS x, CAST(y AS DOUBLE) AS y FROM sides WHERE split = 'train'",
    "sums": "SELECT i, sum(y) OVER (ORDER BY i) AS upto, sum(y) OVER (ORDER BY i) - y AS before FROM train",
    "least": """SELECT a.i AS a, b.i AS i, min((b.upto - a.before) / (b.i - a.i + 1)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS m
                FROM sums a JOIN sums b ON a.i <= b.i""",
    "fit": "SELECT i, max(m) AS f FROM least GROUP BY i",
    "knots": "SELECT x, avg(f) AS yhat FROM train JOIN fit USING (i) GROUP BY x",
    "asked": "SELECT *, greatest(0.0, least(1.0, p_raw)) AS q FROM sides",
    "met": """SELECT s.*, a.x AS x0, a.yhat AS y0, b.x AS x1, b.yhat AS y1 FROM asked s
              ASOF LEFT JOIN knots a ON s.q >= a.x ASOF LEFT JOIN knots b ON s.q <= b.x"""}


@query("isotonic", sql("""
    SELECT doc_id, split, round(greatest(0.001, least(0.999, CASE WHEN x0 < x1 THEN y0 + (y1 - y0) / (x1 - x0) * (q - x0) ELSE coalesce(y0, y1) END)), 6) AS p_cal FROM met""",
    "scores", **ISOTONIC_CTES))
def isotonic(spark, sf_dir):
    return _calibrated(spark, sf_dir, "isotonic")


def _newton(steps: int) -> dict[str, str]:
    """Plain Newton steps from (0, 0)."""
    out = {"sides": _SPLIT, "train": """SELECT ln(q / (1.0 - q)) AS x, count(*) AS n, sum(y) AS y
               FROM (SELECT *, greatest(1e-6, least(1.0 - 1e-6, p_raw)) AS q FROM sides WHERE split = 'train') GROUP BY ALL""",
           "b0": "SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS a"}
    for k in range(steps):
        out[f"w{k}"] = f"SELECT b, a, x, y - n / (1.0 + exp(-b - a * x)) AS r, n * exp(-b - a * x) / (1.0 + exp(-b - a * x)) ** 2 AS w FROM train, b{k}"
        out[f"s{k}"] = f"SELECT any_value(b) AS b, any_value(a) AS a, sum(r) AS g0, sum(r * x) AS g1, sum(w) AS h00, sum(w * x) AS h01, sum(w * x * x) AS h11 FROM w{k}"
        out[f"b{k + 1}"] = f"""SELECT b + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b, a + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS a FROM s{k}"""
    return out


@query("platt", sql("""
    SELECT doc_id, split, round(greatest(0.001, least(0.999, 1.0 / (1.0 + exp(-b - a * ln(q / (1.0 - q)))))), 6) AS p_cal
    FROM (SELECT *, greatest(1e-6, least(1.0 - 1e-6, p_raw)) AS q FROM sides), b8""", "scores", **_newton(8)))
def platt(spark, sf_dir):
    return _calibrated(spark, sf_dir, "platt")


@query("replay_counts", sql("""
    SELECT split, count(*) AS n_rows, count(market_prob) AS n_priced, count(*) FILTER (traded) AS n_traded, count(*) FILTER (filled) AS n_filled,
           round(sum(pnl), 9) AS pnl FROM replayed GROUP BY split""", "predictions", "candles", "registry", **_replay_ctes(None)))
def replay_counts(spark, sf_dir):
    rows = replay.replay(*_inputs(spark, sf_dir), replay.ReplayParams(trade_split=None))
    return replay.rollup(rows).withColumn("pnl", F.round("pnl", 9))

"""Replay of predictions against recorded bars with strict maker fills."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.prices import (MAKER_FEE_TYPE, known, maker_fee, maker_quote,
                                       settle_payout, settle_stake)
from tapeline.operators.dedup import keep_first, keep_last
from tapeline.operators.joins import BLOCK_S, first_touch, latest_bar
from tapeline.session import materialize


@dataclass(frozen=True)
class ReplayParams:
    band_lo: float = 0.15
    band_hi: float = 0.60
    theta: float = 0.05
    tick: float = 0.01
    max_staleness_days: float = 7.0
    model_col: str = "p_cal"
    trade_split: str | None = "test"
    contracts: float = 1.0
    # The fee of a fill is a total over its contracts, and pnl multiplies it by the contracts
    # again. Set this to charge it once.
    fee_per_contract: bool = False
    period_minutes: int | None = None  # None mixes all granularities of a ticker
    block_s: int = BLOCK_S  # of the index that first touches are looked up in


META = ["occasion", "speaker", "format", "resolution_risk"]


def with_meta(preds: DataFrame, registry: DataFrame, order: list[str]) -> DataFrame:
    """Predictions with the first registry row of their market."""
    meta = keep_first(registry.select("market_ticker", *META, *order), ["market_ticker"], order)
    return (
        preds.join(meta.select("market_ticker", *META), "market_ticker", "left")
        .withColumn("format", F.coalesce("format", F.lit("other")))
        .withColumn("resolution_risk", F.coalesce("resolution_risk", F.lit("low")))
    )


def priced(preds: DataFrame, bars: DataFrame, p: ReplayParams) -> DataFrame:
    """Predictions with their decision quote, market probability, edge, side and resting quote (M5).

    A missing, stale, crossed or out-of-range decision bar leaves ``market_prob`` NULL.
    """
    if p.period_minutes is not None:
        bars = bars.filter(F.col("period_minutes") == p.period_minutes)
    bars = bars.select("ticker", "ts", "period_minutes", known(F.col("yes_bid_close")).alias("bid"),
                       known(F.col("yes_ask_close")).alias("ask"))
    quotes = latest_bar(
        preds.select(F.col("market_ticker").alias("ticker"), "decision_ts"), bars,
        ["bid", "ask"], p.max_staleness_days * 86_400.0)
    mid = (F.col("bid") + F.col("ask")) / 2.0
    usable = (F.col("ask") >= F.col("bid")) & (mid > 0.0) & (mid < 1.0)
    out = preds.join(
        quotes.withColumnRenamed("ticker", "market_ticker"), ["market_ticker", "decision_ts"], "left")
    out = out.withColumn("market_prob", F.when(usable, mid)).withColumn(
        "_edge", F.col(p.model_col) - F.col("market_prob"))
    side = F.when(F.col("_edge") > 0, "yes").when(F.col("_edge") <= 0, "no")
    return out.withColumn("_side", side).withColumn(
        "_quote", maker_quote(F.col("_side"), F.col("bid"), F.col("ask"), p.tick))


def signal(p: ReplayParams, band_lo: Column | float | None = None,
           theta: Column | float | None = None) -> Column:
    """Whether a priced row trades: split, price band (closed), edge above theta, a quote (M5)."""
    lo = F.lit(p.band_lo) if band_lo is None else band_lo
    th = F.lit(p.theta) if theta is None else theta
    ok = (
        (F.col("market_prob") >= lo) & (F.col("market_prob") <= F.lit(p.band_hi))
        & (F.abs("_edge") > th) & F.col("_quote").isNotNull()
    )
    if p.trade_split is not None:
        ok = ok & (F.col("split") == p.trade_split)
    return F.coalesce(ok, F.lit(False))


def with_fill_time(rows: DataFrame, bars: DataFrame, wanted: Column, block_s: int) -> DataFrame:
    """Priced rows with the first touch of their own resting quote.

    A market may have several predictions of one time; each row meets its own side and quote.
    """
    orders = rows.filter(wanted).select(
        F.col("market_ticker").alias("ticker"), "decision_ts", F.col("_side").alias("side"),
        F.col("_quote").alias("quote_price"))
    bars = bars.select("ticker", "ts", known(F.col("price_low")).alias("price_low"),
                       known(F.col("price_high")).alias("price_high"))
    touched = first_touch(orders, bars, block_s).select(
        F.col("ticker").alias("market_ticker"), "decision_ts", F.col("side").alias("_side"),
        F.col("quote_price").alias("_quote"), F.col("fill_ts").alias("_touch"))
    return rows.join(touched, ["market_ticker", "decision_ts", "_side", "_quote"], "left")


def with_fee_flag(rows: DataFrame, fee_types: DataFrame | None) -> DataFrame:
    """Whether a market's series pays the maker fee; unknown series do.

    Of a series listed twice the last row stands: by ``ingest_seq`` if there is one, else by the
    fee type's name.
    """
    if fee_types is None:
        return rows.withColumn("_charged", F.lit(True))
    order = [c for c in ("ingest_seq", "fee_type") if c in fee_types.columns]
    fees = keep_last(fee_types.select("series", *order), ["series"], order).select(F.col("series").alias("_series"), "fee_type")
    return (
        rows.withColumn("_series", F.split("market_ticker", "-")[0])
        .join(fees, "_series", "left")
        .withColumn("_charged", F.coalesce("fee_type", F.lit(MAKER_FEE_TYPE)) == MAKER_FEE_TYPE)
        .drop("_series", "fee_type")
    )


def settled(rows: DataFrame, traded: Column, p: ReplayParams) -> DataFrame:
    """Fill, fee, payout and pnl columns; untraded and unfilled rows keep the defaults (M6)."""
    c = p.contracts
    out = rows.withColumn("traded", traded).withColumn(
        "filled", F.col("traded") & F.col("_touch").isNotNull())
    out = out.withColumns({
        "side": F.when(F.col("traded"), F.col("_side")),
        "quote_price": F.when(F.col("traded"), F.col("_quote")),
        "fill_ts": F.when(F.col("filled"), F.col("_touch")),
        "fill_price": F.when(F.col("filled"), F.col("_quote")),
    })
    fee = maker_fee(F.col("fill_price"), c, F.col("_charged"))
    payout = settle_payout(F.col("side"), F.col("y"))
    stake = settle_stake(F.col("side"), F.col("fill_price"))
    pnl = ((payout - stake) * F.lit(c) - fee) if p.fee_per_contract else (payout - stake - fee) * F.lit(c)

    def if_filled(value: Column) -> Column:
        return F.when(F.col("filled"), value).otherwise(F.lit(0.0))

    return out.withColumns({
        "fee": if_filled(fee),
        "contracts": if_filled(F.lit(float(c))),
        "stake": if_filled(stake * F.lit(c)),
        "payout": if_filled(payout * F.lit(c)),
        "pnl": if_filled(pnl),
        "decided_by_technicality":
            F.col("filled") & F.col("resolution_risk").isin("medium", "high"),
    })


REPLAY_COLUMNS = [
    "market_ticker", "occasion", "speaker", "format", "resolution_risk", "decision_ts", "split",
    "y", "market_prob", "p_base", "p_topic", "p_cal", "traded", "side", "quote_price", "filled",
    "fill_ts", "fill_price", "fee", "contracts", "stake", "payout", "pnl",
    "decided_by_technicality",
]


def replay(preds: DataFrame, bars: DataFrame, registry: DataFrame,
           params: ReplayParams = ReplayParams(), fee_types: DataFrame | None = None,
           registry_order: tuple[str, ...] = ("ingest_seq",)) -> DataFrame:
    """One row per prediction with its market price, trade, fill and result (M7)."""
    # one row per prediction, read by both sides of the next step; without it bars are read again
    rows = materialize(priced(with_meta(preds, registry, list(registry_order)), bars, params), "priced")
    rows = with_fill_time(rows, bars, signal(params), params.block_s)
    return settled(with_fee_flag(rows, fee_types), signal(params), params).select(*REPLAY_COLUMNS)


def sweep(preds: DataFrame, bars: DataFrame, registry: DataFrame,
          thetas: list[float], band_los: list[float], params: ReplayParams = ReplayParams(),
          fee_types: DataFrame | None = None,
          registry_order: tuple[str, ...] = ("ingest_seq",)) -> DataFrame:
    """Replay totals for every (theta, band_lo) of a grid (M8).

    A row's quote, side and first touch do not depend on the grid, so bars are read for them
    once. A row trades at every theta below its edge and every band start up to its price, so it
    goes into one cell of the grid, cells are added up, and each grid point is a sum over cells:
    the cost in rows does not grow with the grid.
    """
    loosest = signal(params, F.lit(min(band_los)), F.lit(min(thetas)))
    rows = priced(with_meta(preds, registry, list(registry_order)), bars, params).filter(loosest)
    rows = with_fee_flag(with_fill_time(materialize(rows, "priced"), bars, F.lit(True), params.block_s), fee_types)
    rows = settled(rows, F.lit(True), params)

    def passed(values: list[float], passes) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(v)) for v in values]), passes))

    theta_list, lo_list = sorted(set(thetas)), sorted(set(band_los))
    cells = rows.groupBy(passed(theta_list, lambda t: F.abs("_edge") > t).alias("_t"), passed(lo_list, lambda b: F.col("market_prob") >= b).alias("_b")).agg(
        F.count("*").alias("n_traded"),
        F.count_if("filled").alias("n_filled"),
        F.sum("stake").alias("stake"), F.sum("fee").alias("fee"), F.sum("pnl").alias("pnl"),
        F.count_if(F.col("filled") & (F.col("pnl") > 0)).alias("n_won"),
    )
    reached = cells.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_t")))).withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_b"))))
    at = lambda values, i: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(i))
    return reached.groupBy(at(theta_list, "_i").alias("theta"), at(lo_list, "_j").alias("band_lo")).agg(
        *[F.sum(c).alias(c) for c in ("n_traded", "n_filled", "stake", "fee", "pnl", "n_won")])


def rollup(replayed: DataFrame) -> DataFrame:
    """Priced, traded and filled counts by split."""
    return replayed.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.count("market_prob").alias("n_priced"),
        F.count_if("traded").alias("n_traded"),
        F.count_if("filled").alias("n_filled"),
        F.sum("pnl").alias("pnl"),
    )


def rollup_by_occasion(replayed: DataFrame) -> DataFrame:
    """Per split and occasion sums, the unit for later block resampling (M9)."""
    return replayed.groupBy("split", "occasion").agg(
        F.count("*").alias("n_rows"),
        F.count("market_prob").alias("n_priced"),
        F.sum(F.pow(F.col("p_cal") - F.col("y"), 2)).alias("sq_err_model"),
        F.sum(F.when(F.col("market_prob").isNotNull(),
                     F.pow(F.col("market_prob") - F.col("y"), 2))).alias("sq_err_market"),
        F.count_if("filled").alias("n_filled"),
        F.sum("pnl").alias("pnl"),
    )

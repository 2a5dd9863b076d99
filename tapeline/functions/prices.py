"""Price, book-state and trade arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH_EPS = 1e-6
STATES = ("VALID", "CROSSED", "EMPTY_ASK", "EMPTY_BID", "EMPTY_BOTH")

# Fee schedule.
MAKER_FEE_RATE = 0.0175
MAKER_FEE_TYPE = "quadratic_with_maker_fees"


def number(value: Column) -> Column:
    """Lenient double: unparseable text and NaN are NULL."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def known(value: Column) -> Column:
    """A stored double with NaN read as missing."""
    return F.when(~F.isnan(value), value)


def mid_by_price(bid: Column, ask: Column) -> Column:
    """Mid with one-sided fallback on price presence."""
    return F.coalesce((bid + ask) / 2.0, bid, ask)


def touch_depth(depth: Column) -> Column:
    """Depth with missing and float-noise values as zero."""
    return F.when(depth > DEPTH_EPS, depth).otherwise(F.lit(0.0))


def book_state(bid: Column, ask: Column, depth_bid: Column, depth_ask: Column) -> Column:
    """Book state from touch depths and prices (X28). Depths must come from ``touch_depth``."""
    has_bid, has_ask = depth_bid > 0, depth_ask > 0
    return (
        F.when(~has_bid & ~has_ask, "EMPTY_BOTH")
        .when(~has_ask, "EMPTY_ASK")
        .when(~has_bid, "EMPTY_BID")
        .when(bid >= ask, "CROSSED")
        .otherwise("VALID")
    )


def mid_by_depth(bid: Column, ask: Column, depth_bid: Column, depth_ask: Column) -> Column:
    """Mid from the sides that hold depth."""
    has_bid, has_ask = depth_bid > 0, depth_ask > 0
    return F.when(has_bid & has_ask, (bid + ask) / 2.0).when(has_bid, bid).when(has_ask, ask)


def price_band(mid: Column, lo: float, hi: float) -> Column:
    """Right-closed price band label."""
    return (
        F.when((mid > -0.01) & (mid <= lo), f"<{lo}")
        .when((mid > lo) & (mid <= hi), f"{lo}-{hi}")
        .when((mid > hi) & (mid <= 1.01), f">{hi}")
    )


def phase(ts: Column, anchor: int, breaks_min: list[float], labels: list[str]) -> Column:
    """Phase label of a time relative to an anchor; breaks are right-closed."""
    if len(labels) != len(breaks_min) + 1:
        raise ValueError("need one more phase label than breaks")
    out = None
    for minutes, label in zip(breaks_min, labels):
        inside = ts <= F.lit(anchor + minutes * 60)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return F.lit(labels[-1]) if out is None else out.otherwise(labels[-1])


def depth_bucket(depth: Column) -> Column:
    """Right-closed depth bucket."""
    return (
        F.when((depth > 0) & (depth <= 1), "<=1")
        .when((depth > 1) & (depth <= 5), "(1,5]")
        .when((depth > 5) & (depth <= 20), "(5,20]")
        .when((depth > 20) & (depth <= 100), "(20,100]")
        .when(depth > 100, ">100")
    )


def sigmoid(x: Column) -> Column:
    """Logistic function with its argument held in [-40, 40]."""
    held = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-held))


def logit(p: Column, eps: float = 1e-6) -> Column:
    """Log-odds of a probability clipped to [eps, 1 - eps]."""
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def round_cents(x: Column) -> Column:
    """Two-decimal rounding of the exact binary value, ties to even, for x in [0, 1.02].

    Scales the double to an integer without loss, so the half-way test is exact; SQL ``round``
    and ``bround`` work on the printed decimal and differ off the cent grid.
    """
    small = x < 0.0625
    bits = F.when(small, F.lit(60)).otherwise(F.lit(56))
    unit = F.when(small, F.lit(float(2**60))).otherwise(F.lit(float(2**56)))
    scaled = (x * unit).cast("bigint") * F.lit(100)
    whole = F.call_function("shiftright", scaled, bits)
    rest = scaled - F.call_function("shiftleft", whole, bits)
    half = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits - 1)
    odd = F.pmod(whole, F.lit(2).cast("bigint")) == 1
    up = (rest > half) | ((rest == half) & odd)
    return (whole + F.when(up, 1).otherwise(0)).cast("double") / F.lit(100.0)


def maker_quote(side: Column, bid: Column, ask: Column, tick: float) -> Column:
    """Resting price one tick better than the best quote; NULL if it would lock or cross."""
    buy = round_cents(bid + F.lit(tick))
    sell = round_cents(ask - F.lit(tick))
    return F.when((side == "yes") & (buy < ask), buy).when((side == "no") & (sell > bid), sell)


def maker_fee(price: Column, contracts: float, charged: Column,
              rate: float = MAKER_FEE_RATE) -> Column:
    """Fee rounded up to the cent; zero where the series charges none."""
    raw = F.lit(rate * contracts) * price * (F.lit(1.0) - price)
    if contracts <= 0:
        return F.lit(0.0)
    return F.when(charged, F.ceil(raw * F.lit(100.0)).cast("double") / F.lit(100.0)).otherwise(0.0)


def settle_payout(side: Column, y: Column) -> Column:
    """Payout per contract held to resolution."""
    return F.when((side == "yes") & (y == 1), 1.0).when((side == "no") & (y == 0), 1.0).otherwise(0.0)


def settle_stake(side: Column, fill_price: Column) -> Column:
    """Stake per contract."""
    return F.when(side == "yes", fill_price).otherwise(F.lit(1.0) - fill_price)

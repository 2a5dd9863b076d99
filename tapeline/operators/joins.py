"""Time joins: as-of, first touch and bounded ranges.

Keys may be hot, so no join here is on the key alone but for one on a few rows per key. Bounded
lookups are joined on (key, time chunk); an open-ended one finds its chunk in an index of chunks
first. Whether a side is broadcast is left to Spark's statistics.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.operators.ordered import Ordering, last_known
from tapeline.session import materialize

BLOCK_S = 7 * 86_400


def join_small(big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str],
               salts: int = 16, how: str = "inner") -> DataFrame:
    """Join a large side to a small keyed one when a key may hold much of the large side.

    The large side is spread over salts taken from ``spread_by`` (stable under recomputation),
    the small side is copied per salt. If statistics show the small side fits, Spark broadcasts
    it and the copies cost nothing.
    """
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def latest_bar(points: DataFrame, bars: DataFrame, values: Iterable[str], max_age_s: float) -> DataFrame:
    """Last bar at or before each point's ``decision_ts``, if it is young enough.

    Only that bar is looked at: its values are returned as they are, NULLs included, and an
    earlier bar never stands in. A bar older than the limit is no bar, so older bars can be left
    out before picking, and points meet bars in time chunks of that age. Bars of equal time are
    ordered by ``period_minutes``. Returns ``ticker, decision_ts, bar_ts`` and the values, for
    points that have such a bar.
    """
    values = list(values)
    points = points.select("ticker", "decision_ts").distinct()
    hits = within_seconds(points, bars.select("ticker", "ts", "period_minutes", *values), ["ticker"], F.col("decision_ts") - F.lit(float(max_age_s)), F.col("decision_ts"),
                          "ts", max(1, int(max_age_s)))
    best = hits.groupBy("ticker", "decision_ts").agg(F.max(F.struct("ts", "period_minutes", *values)).alias("_bar"))
    return best.select("ticker", "decision_ts", F.col("_bar.ts").alias("bar_ts"), *[F.col(f"_bar.{v}").alias(v) for v in values])


def first_touch(orders: DataFrame, bars: DataFrame, block_s: int = BLOCK_S) -> DataFrame:
    """First later bar whose trade prints cross a resting order.

    A buy (``yes``) is touched by ``price_low <= quote``, a sell by ``price_high >= quote``; an
    unknown print touches nothing. Returns ``ticker, decision_ts, side, quote_price, fill_ts``.

    Bars are reduced to one row per ticker and block of ``block_s`` seconds, with the least low and
    greatest high. An order looks its first crossing block up among those after its own, and then
    meets the bars of two blocks only: that one, and its own, where earlier bars may have made the
    extremes.
    """
    def crosses(low: str, high: str) -> Column:
        return ((F.col("side") == "yes") & (F.col(low) <= F.col("quote_price"))) | ((F.col("side") == "no") & (F.col(high) >= F.col("quote_price")))

    keys = ["ticker", "decision_ts", "side", "quote_price"]
    block = F.floor(F.col("ts") / F.lit(block_s)).cast("bigint")
    bars = bars.select("ticker", "ts", "price_low", "price_high").withColumn("_block", block)
    index = bars.groupBy("ticker", "_block").agg(F.min("price_low").alias("_least"), F.max("price_high").alias("_most"))
    orders = orders.select(*keys).distinct().withColumn("_own", F.floor(F.col("decision_ts") / F.lit(block_s)).cast("bigint"))
    later = (F.col("_block") > F.col("_own")) & crosses("_least", "_most")
    first = orders.join(index, "ticker").groupBy(*keys, "_own").agg(F.min(F.when(later, F.col("_block"))).alias("_first"))
    # stored: two rows an order, so that their size is known when the join with the bars is planned
    asked = materialize(first.select(*keys, F.explode(F.array_compact(F.array("_own", "_first"))).alias("_block")), "asked")
    hits = bars.join(asked, ["ticker", "_block"]).where((F.col("ts") > F.col("decision_ts")) & crosses("price_low", "price_high"))
    return hits.groupBy(*keys).agg(F.min("ts").alias("fill_ts"))


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_ts: Column, right_ts: Column,
                  tie: str, values: list[str], name: str,
                  chunk_s: int = 3600) -> DataFrame:
    """Each left row with the last right row at or before its time, as a struct ``name``.

    Times are whole seconds, so of the right rows of a second only the last by ``tie`` can be the
    answer: they are reduced to it first, before the shuffle. Then both sides are unioned on one time line
    per key and the right rows carried forward chunk by chunk; any number of left rows per key
    costs one pass and no pairs are formed. The struct is NULL where nothing precedes; NULLs
    inside it are the right row's own.
    """
    # one aggregate per value and a plain number to order by keep this a hash aggregate
    r = right.groupBy(F.col(key), right_ts.cast("bigint").alias("_t")).agg(
        *[F.max_by(v, tie).alias(v) for v in values])
    r = r.select(key, "_t", F.lit(0).alias("_left"), F.struct(*values).alias("_right"), F.lit(None).cast(left.schema).alias("_row"))
    lrow = left.select(
        F.col(key), F.floor(left_ts).cast("bigint").alias("_t"), F.lit(1).alias("_left"),
        F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct(*left.columns).alias("_row"))
    line = r.unionByName(lrow).withColumn("_chunk", F.floor(F.col("_t") / F.lit(chunk_s)))
    order = Ordering((key,), ("_t", "_left"), "_chunk")
    carried = last_known(line, order, **{name: F.col("_right")})
    return carried.filter(F.col("_left") == 1).select("_row.*", name)


def within_seconds(left: DataFrame, right: DataFrame, keys: list[str], lo: Column, hi: Column,
                   right_ts: str, chunk_s: int) -> DataFrame:
    """Pairs of a left row and the right rows of its key with time in ``[lo, hi]``.

    Joined on (keys, time chunk): a left row is copied to the chunks its bounded interval spans.
    """
    spread = left.withColumn("_lo", lo).withColumn("_hi", hi).withColumn(
        "_chunk", F.explode(F.sequence(F.floor(F.col("_lo") / chunk_s).cast("bigint"),
                                       F.floor(F.col("_hi") / chunk_s).cast("bigint"))))
    chunked = right.withColumn("_chunk", F.floor(F.col(right_ts) / chunk_s).cast("bigint"))
    return (
        spread.join(chunked, [*keys, "_chunk"])
        .filter((F.col(right_ts) >= F.col("_lo")) & (F.col(right_ts) <= F.col("_hi")))
        .drop("_lo", "_hi", "_chunk")
    )

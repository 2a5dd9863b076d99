"""Order book rebuilt from all recorded frames at once (R1, R2 in batch).

The stream form applies one frame after the other. Here the same rows come from scans and joins:

* A level is a running sum of its changes that is pushed back to zero whenever it falls below. Such
  sums compose: of a stretch of changes only its sum and its least prefix matter, so a level's
  changes are cut into chunks, each is scanned alone, and one row per chunk carries the pair on.
* After a frame the best two prices of a side are asked for. The frames of a market are cut into
  short windows. A level that keeps its count through a whole window competes there once, and only
  the best two of those remain; levels that change inside it meet its frames by place. No frame meets
  the whole book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators.ordered import Ordering, by_range, clamped_sum, following, scan
from tapeline.session import materialize, settled

FRAMES_PER_WINDOW = 64
FRAMES_PER_CHUNK = 1 << 14


def placed(frames: DataFrame) -> DataFrame:
    """Frames with their place in the market's order (by ``seq``, ``recv_utc``) and their epoch, the
    number of snapshots up to them. Frames equal in both keep an order by their content."""
    ranged = by_range(frames.withColumn("_tie", F.xxhash64("snapshot", "side", "price", "delta")), "ticker", "seq", "recv_utc", "_tie")
    order = Ordering(("ticker",), ("seq", "recv_utc", "_tie"), "_chunk")
    return scan(ranged, order, total={"place": F.lit(1).cast("bigint"), "epoch": F.col("snapshot").cast("bigint")}).drop("_chunk", "_tie")


def level_counts(frames: DataFrame) -> DataFrame:
    """(ticker, side, price, count, place, until): what a level holds from one frame up to another.

    Only levels above zero; a snapshot ends all levels before it.
    """
    own = F.struct("side", "price", F.col("delta").alias("count"))
    known = F.col("side").isin("yes", "no") & F.col("price").isNotNull() & F.col("delta").isNotNull()

    def listed(side: str) -> Column:
        return F.transform(side, lambda x: F.struct(F.lit(side).alias("side"), x["price"].alias("price"), x["count"].alias("count")))

    changes = frames.select("ticker", "epoch", "place", F.explode(F.when(F.col("snapshot"), F.concat(listed("yes"), listed("no"))).when(known, F.array(own))).alias("x")).select(
        "ticker", "epoch", "place", "x.side", "x.price", F.col("x.count").alias("change"), F.floor(F.col("place") / F.lit(FRAMES_PER_CHUNK)).alias("_chunk"))
    level = Ordering(("ticker", "epoch", "side", "price"), ("place",), "_chunk")
    held = materialize(clamped_sum(materialize(changes, "changes"), level, "change", "count"), "levels")
    ends = frames.groupBy("ticker", "epoch").agg((F.max("place") + 1).alias("end"))
    spans = following(held, level, _next=F.col("place")).where("count > 0").join(ends, ["ticker", "epoch"])
    return spans.select("ticker", "side", "price", "count", "place", F.coalesce("_next", "end").alias("until"))


def _best_two(levels: Column) -> Column:
    return F.slice(F.sort_array(levels, asc=False), 1, 2)


def rebuild(frames: DataFrame, window: int = FRAMES_PER_WINDOW) -> DataFrame:
    """Top of book and the level behind it after every frame, as the stream form gives them.

    ``frames`` are those of ``streaming.book.frames``, all frames of each market; ``seq`` orders
    them, then ``recv_utc``. Only built-in functions run.
    """
    def pieces() -> DataFrame:
        spans = level_counts(rows)
        lo, hi = F.floor(F.col("place") / F.lit(window)), F.floor((F.col("until") - 1) / F.lit(window))
        cut = spans.select("ticker", "side", "price", "count", "place", "until", F.explode(F.sequence(lo, hi)).alias("window"))
        cut = materialize(cut.withColumn("whole", (F.col("place") <= F.col("window") * window) & (F.col("until") >= (F.col("window") + 1) * window)), "pieces")
        best = Window.partitionBy("ticker", "window", "side").orderBy(F.col("price").desc())
        lasting = cut.where("whole").withColumn("_k", F.row_number().over(best)).where("_k <= 2").drop("_k")
        return lasting.unionByName(cut.where(~F.col("whole"))).drop("whole")

    rows = materialize(placed(frames), "placed")
    asked = rows.select("ticker", "place", F.floor(F.col("place") / F.lit(window)).alias("window"))
    live = settled(pieces, "live")
    met = asked.join(live.withColumnRenamed("place", "since"), ["ticker", "window"]).where("since <= place AND place < until")
    tops = met.groupBy("ticker", "place").agg(*[_best_two(F.collect_list(F.when(F.col("side") == s, F.struct("price", "count")))).alias(f"_{s}") for s in ("yes", "no")])
    out = rows.select("ticker", "recv_utc", "seq", "place").join(tops, ["ticker", "place"], "left")

    def at(side: str, k: int, field: str) -> Column:
        return F.get(f"_{side}", F.lit(k - 1))[field]

    def ask(k: int) -> Column:
        return F.round(F.lit(1.0) - at("no", k, "price"), 4)

    return out.select("ticker", "recv_utc", "seq", at("yes", 1, "price").alias("yes_bid"), ask(1).alias("yes_ask"), at("yes", 1, "count").alias("depth_bid"), at("no", 1, "count").alias("depth_ask"),
                      at("yes", 2, "price").alias("yes_bid2"), ask(2).alias("yes_ask2"), at("yes", 2, "count").alias("depth_bid2"), at("no", 2, "count").alias("depth_ask2"))

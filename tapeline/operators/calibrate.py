"""Time split, calibration and scoring."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions.prices import clip, logit, sigmoid
from tapeline.operators.joins import join_small
from tapeline.operators.ordered import Ordering, by_range, last_known, running_sum
from tapeline.session import materialize, settled

CLIP = 1e-3
TIES_PER_CHUNK = 1 << 16
RANGES = 1024  # of one histogram, so of the rows that one pass of a rank selection sends to the driver
NEWTON_STEPS = 40


def exact_quantile(df: DataFrame, value: Column, q: float) -> float | None:
    """The ``q`` quantile of the known values, interpolated between its two neighbours (M1).

    Ranks are selected by histograms of ranges: each pass counts the values of ``RANGES`` equal
    ranges, and only the range that holds the rank is counted again, until it holds one value.
    Counts are pre-aggregated, so no task sees all values, however they are spread.
    """
    known = df.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    lo, hi, n = known.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return None
    place = q * (n - 1)
    rank, after = math.floor(place), None  # of the lower neighbour; the least value beyond the range
    left, inside = rank, n
    while lo < hi:
        part = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(hi - lo) * RANGES), F.lit(RANGES - 1))
        ranges = sorted(known.where(F.col("v").between(lo, hi)).groupBy(part.alias("part")).agg(
            F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["part"])
        at = 0
        while left >= ranges[at]["n"]:
            left -= ranges[at]["n"]
            at += 1
        if at + 1 < len(ranges):
            after = ranges[at + 1]["lo"]
        lo, hi, inside = ranges[at]["lo"], ranges[at]["hi"], ranges[at]["n"]
        if left + 1 < inside and len(ranges) == 1:  # neighbouring numbers that one division can't part
            values = sorted(known.where(F.col("v").between(lo, hi)).groupBy("v").count().collect())
            for v, count in values:
                if left < count:
                    lo, inside = v, count
                    after = next((w for w, _ in values if w > v), after)
                    break
                left -= count
            break
    upper = lo if left + 1 < inside or after is None else after
    return lo + (upper - lo) * (place - rank)


def time_split(df: DataFrame, ts: str, tie: list[str], train_frac: float = 0.6) -> DataFrame:
    """Add ``split``: times up to the quantile train, the rest test, equal times together (M1).

    An unknown time tests; with no known time everything trains. Where the quantile leaves no
    test rows the split is by rank instead: the first ``round(n * frac)`` rows by time and
    ``tie`` train. ``tie[0]`` must be an integer.
    """
    t = F.col(ts)
    times = materialize(df.select(ts), "times")
    s = times.agg(F.max(t).alias("hi"), F.count(t).alias("known"), F.count("*").alias("n")).first()
    if s["known"] == 0:
        return df.withColumn("split", F.lit("train"))
    # The quantile is interpolated in floating point; stored times are whole seconds.
    cutoff = exact_quantile(times, t, train_frac) + 1e-6
    if s["known"] < s["n"] or s["hi"] > cutoff:
        return df.withColumn("split", F.when(t <= cutoff, "train").otherwise("test"))
    wanted = max(1, min(s["n"] - 1, round(s["n"] * train_frac)))
    # Every time is at most the quantile, so the last time alone holds the boundary.
    before = df.filter(t < s["hi"]).count()
    last = df.filter(t == s["hi"]).withColumn("_chunk", F.floor(F.col(tie[0]) / TIES_PER_CHUNK))
    ranked = running_sum(last, Ordering((), tuple(tie), "_chunk"), _rank=F.lit(1))
    label = F.when(F.col("_rank") <= wanted - before, "train").otherwise("test")
    return (df.filter(t < s["hi"]).withColumn("split", F.lit("train"))
            .unionByName(ranked.withColumn("split", label).select(*df.columns, "split")))


#: A block of pooled rows. Rows are ordered by (score, tie); ``n_first`` and ``n_last`` count those of
#: the block's first and last score, ``second`` and ``fore`` are the scores next to them inside it.
BLOCK = "first double, tie long, last double, n_first long, n_last long, second double, fore double, n long, total double"


def pooled(b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Neighbouring blocks whose means do not rise, pooled until all means rise.

    A chain of means that do not rise lies in one block of the final fit, so whole chains are
    pooled at once; the order of pooling does not matter.
    """
    while len(b["n"]) > 1:
        mean = b["total"] / b["n"]
        new = np.concatenate([[True], mean[1:] > mean[:-1]])
        if new.all():
            break
        at = np.flatnonzero(new)
        end = np.concatenate([at[1:], [len(new)]]) - 1
        own = np.cumsum(new) - 1
        first, last = b["first"][at][own], b["last"][end][own]
        second = np.where(b["first"] > first, b["first"], np.where(b["second"] > first, b["second"], np.inf))
        second = np.where((second == np.inf) & (b["last"] > first), b["last"], second)
        fore = np.where(b["last"] < last, b["last"], np.where(b["fore"] < last, b["fore"], -np.inf))
        fore = np.where((fore == -np.inf) & (b["first"] < last), b["first"], fore)
        b = {"first": b["first"][at], "tie": b["tie"][at], "last": b["last"][end],
             "n_first": np.add.reduceat(np.where(b["first"] == first, b["n_first"], 0), at), "n_last": np.add.reduceat(np.where(b["last"] == last, b["n_last"], 0), at),
             "second": np.minimum.reduceat(second, at), "fore": np.maximum.reduceat(fore, at), "n": np.add.reduceat(b["n"], at), "total": np.add.reduceat(b["total"], at)}
    return b


def _pool_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of one sorted partition; the blocks so far are carried from batch to batch."""
    held: dict[str, np.ndarray] | None = None
    for b in batches:
        new = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
        new = pooled(new)
        held = new if held is None else pooled({n: np.concatenate([held[n], new[n]]) for n in new})
    if held is not None and len(held["n"]):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.values()], names=list(held))


def isotonic_blocks(train: DataFrame, score: str, outcome: str, tie: str, partitions: int | None = None) -> DataFrame:
    """The blocks of the isotonic fit of ``outcome`` on (score, tie), by distributed pooling (M2).

    Rows are range-partitioned by (score, tie), so many rows of one score lie in many tasks, and
    every partition pools its rows to a stack of blocks. Where the means of neighbouring partitions
    do not rise the stacks are dealt to half as many partitions and pooled again: a reduction tree
    that ends as soon as all edges rise. The driver sees two means per partition. Rows without a
    score or outcome are left out.
    """
    x, y = F.col(score).cast("double"), F.col(outcome).cast("double")
    rows = train.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    one = F.lit(1).cast("bigint")
    blocks = rows.select(x.alias("first"), F.col(tie).cast("bigint").alias("tie"), x.alias("last"), one.alias("n_first"), one.alias("n_last"),
                         F.lit(float("inf")).alias("second"), F.lit(float("-inf")).alias("fore"), one.alias("n"), y.alias("total"))
    n = partitions or int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        dealt = blocks.repartitionByRange(n, "first", "tie").sortWithinPartitions("first", "tie").mapInArrow(_pool_partitions, BLOCK)
        blocks = materialize(dealt.withColumn("part", F.spark_partition_id()), "blocks")
        mean, place = F.col("total") / F.col("n"), F.struct("first", "tie")
        edges = blocks.groupBy("part").agg(F.min_by(mean, place).alias("lo"), F.max_by(mean, place).alias("hi"), F.min(place).alias("at")).orderBy("at").collect()
        blocks = blocks.drop("part")
        if all(a["hi"] < b["lo"] for a, b in zip(edges, edges[1:])):
            return blocks
        n = max(1, n // 2)


def isotonic_curve(train: DataFrame, score: str, outcome: str, tie: str, partitions: int | None = None) -> DataFrame:
    """(x, yhat): the fitted curve's corners (M2); between two of them it is a straight line.

    Equal scores enter in row order and are averaged after pooling. Inside a block the curve is
    flat; a score at the edge of blocks has the mean of its rows, so a block has four corners.
    """
    blocks = isotonic_blocks(train, score, outcome, tie, partitions)
    mean = F.col("total") / F.col("n")

    def corner(x: str, weight: Column, wanted: Column | bool = True) -> Column:
        return F.when(wanted, F.struct(F.col(x).alias("x"), mean.alias("mean"), weight.cast("double").alias("weight")))

    inner = (F.col("second") < F.col("last")) & (F.col("second") > F.col("first"))
    corners = F.array(corner("first", F.col("n_first"), F.lit(True)), corner("last", F.col("n_last"), F.col("last") > F.col("first")),
                      corner("second", F.lit(1), inner), corner("fore", F.lit(1), inner & (F.col("fore") > F.col("second"))))
    knots = blocks.select(F.explode(F.filter(corners, lambda c: c.isNotNull())).alias("k")).select("k.*")
    return knots.groupBy("x").agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("yhat"))


def interpolate(points: DataFrame, curve: DataFrame) -> DataFrame:
    """Linear interpolation of ``curve(x, yhat)`` at each distinct ``x``, clamped at the ends.

    Points and corners lie on one line, cut into chunks of equal numbers of rows.
    """
    line = points.select("x", F.lit(True).alias("_ask"), F.lit(None).cast("struct<x:double,yhat:double>").alias("_knot")).unionByName(
        curve.select("x", F.lit(False).alias("_ask"), F.struct("x", "yhat").alias("_knot"))).withColumn("_back", -F.col("x"))
    line = by_range(line, "x").withColumn("_chunk_back", -F.col("_chunk"))
    both = last_known(line, Ordering((), ("x", "_ask"), "_chunk"), _lo=F.col("_knot"))
    both = last_known(both, Ordering((), ("_back", "_ask"), "_chunk_back"), _hi=F.col("_knot"))
    lo, hi = F.col("_lo"), F.col("_hi")
    slope = (hi["yhat"] - lo["yhat"]) / F.nullif(hi["x"] - lo["x"], F.lit(0.0))
    value = F.coalesce(lo["yhat"] + slope * (F.col("x") - lo["x"]), lo["yhat"], hi["yhat"])
    return both.filter("_ask").select("x", value.alias("yhat"))


def platt_coefficients(train: DataFrame, score: str, outcome: str) -> tuple[float, float]:
    """Slope and intercept of an unregularised logistic fit on the score's log-odds (M3).

    Newton's method over the distinct scores with their counts: each step is one aggregate of a
    few sums. A step that does not raise the likelihood is halved. Outcomes that the score
    separates have no finite fit; then the last of ``NEWTON_STEPS`` steps stands.
    """
    grouped = materialize(train.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).groupBy(logit(F.col(score)).alias("x")).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col(outcome).cast("double")).alias("y")), "scores")
    slope, intercept, best, step = 0.0, 0.0, -math.inf, (0.0, 0.0)
    for _ in range(NEWTON_STEPS):
        z = F.lit(intercept) + F.lit(slope) * F.col("x")
        f = sigmoid(z)
        # log(1 + exp(z)) without overflow
        soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        w, r = F.col("n") * f * (F.lit(1.0) - f), F.col("y") - F.col("n") * f
        like, g0, g1, h00, h01, h11 = (v or 0.0 for v in grouped.agg(
            F.sum(F.col("y") * z - F.col("n") * soft), F.sum(r), F.sum(r * F.col("x")), F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x"))).first())
        if like < best - 1e-9 * abs(best):
            step = (step[0] / 2, step[1] / 2)
            intercept, slope = intercept - step[0], slope - step[1]
            continue
        best = like
        det = h00 * h11 - h01 * h01
        if det <= 1e-12 * max(1.0, h00 * h11):  # a single score: only the intercept can be fitted
            step = (g0 / h00 if h00 > 0 else 0.0, 0.0)
        else:
            step = ((h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det)
        intercept, slope = intercept + step[0], slope + step[1]
        if max(map(abs, step)) < 1e-12 * max(1.0, abs(intercept), abs(slope)):
            break
    return slope, intercept


def calibrate(df: DataFrame, score: str, outcome: str, split: str, tie: str,
              method: str = "isotonic", eps: float = CLIP) -> DataFrame:
    """Add ``p_cal``: a calibrator fit on train rows and applied to all, clipped (M4)."""
    if method not in ("isotonic", "platt"):
        raise ValueError(f"unknown calibration method: {method!r} (use 'isotonic' or 'platt')")
    train = df.filter(F.col(split) == "train")
    if train.isEmpty():
        return df.withColumn("p_cal", clip(F.col(score), eps, 1.0 - eps))
    if method == "platt":
        slope, intercept = platt_coefficients(train, score, outcome)
        raw = sigmoid(F.lit(intercept) + F.lit(slope) * logit(F.col(score)))
        return df.withColumn("p_cal", clip(raw, eps, 1.0 - eps))
    rows = df.withColumn("x", clip(F.col(score), 0.0, 1.0))
    curve = settled(lambda: isotonic_curve(train, score, outcome, tie), "curve")
    fitted = interpolate(rows.select("x").distinct(), curve)
    return (join_small(rows, fitted, ["x"], [tie])
            .withColumn("p_cal", clip(F.col("yhat"), eps, 1.0 - eps)).drop("x", "yhat"))


def score(df: DataFrame, p: str, y: str, by: list[str] = (), eps: float = 1e-12) -> DataFrame:
    """Brier score and log-loss, NULL on no rows."""
    q = clip(F.col(p), eps, 1.0 - eps)
    hit = F.col(y) * F.ln(q) + (F.lit(1.0) - F.col(y)) * F.ln(F.lit(1.0) - q)
    miss = clip(F.col(p), 0.0, 1.0) - F.col(y)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(miss * miss).alias("brier"),
                               (-F.avg(hit)).alias("log_loss"))

"""Replay, time joins and calibration against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.operators import calibrate, joins, replay

DAY = 86_400
BARS = "ticker string, ts bigint, period_minutes int, yes_bid_close double, yes_ask_close double, price_low double, price_high double"
PREDS = "market_ticker string, decision_ts bigint, split string, y int, p_base double, p_topic double, p_cal double"
META = "market_ticker string, occasion string, speaker string, format string, resolution_risk string, ingest_seq bigint"


def adversarial(seed, markets=60):
    rng = np.random.default_rng(seed)
    bars, preds, meta = [], [], []
    for m in range(markets):
        t = f"S{m % 5}-M{m}"
        times = [] if rng.random() < 0.06 else sorted(set(int(x) for x in rng.integers(1, 40, 20)))
        for d in times:
            bid = round(float(rng.uniform(0.05, 0.7)), 2)
            ask = round(bid + (-0.02 if rng.random() < 0.05 else 0.02), 2)
            lo, hi = round(bid - 0.03, 2), round(ask + 0.03, 2)
            q = [float("nan") if rng.random() < p else v for v, p in ((bid, 0.09), (ask, 0.09), (lo, 0.08), (hi, 0.08))]
            bars.append((t, d * DAY, 1440, *q))
        u = rng.random()
        dts = None if u < 0.05 else (times[3] * DAY if u < 0.2 and len(times) > 3 else int(rng.integers(0, 55)) * DAY + int(rng.integers(0, 2)) * 1800)
        preds.append((t, dts, "test" if rng.random() < 0.6 else "train", int(rng.integers(0, 2)), 0.5, 0.5, round(float(rng.random()), 3)))
        if rng.random() > 0.08:
            for i in range(2 if rng.random() < 0.1 else 1):
                meta.append((t, f"o{i}", "s", None if rng.random() < 0.1 else "speech", None if rng.random() < 0.1 else ["low", "medium", "high"][i], i))
    return bars, preds, meta


def by_hand(bars, preds, meta, p, fees, contracts):
    out = {}
    for t, dts, split, y, _, _, model in preds:
        row = {"market_prob": None, "traded": False, "side": None, "quote_price": None, "fill_ts": None, "fee": 0.0, "stake": 0.0, "payout": 0.0, "pnl": 0.0}
        out[t] = row
        mine = sorted(b for b in bars if b[0] == t)
        past = [b for b in mine if dts is not None and b[1] <= dts]
        if not past:
            continue
        _, ts, _, bid, ask, _, _ = past[-1]
        if dts - ts > p.max_staleness_days * DAY or math.isnan(bid) or math.isnan(ask) or ask < bid or not 0 < (bid + ask) / 2 < 1:
            continue
        mid = row["market_prob"] = (bid + ask) / 2
        edge = model - mid
        if (p.trade_split and split != p.trade_split) or not p.band_lo <= mid <= p.band_hi or not abs(edge) > p.theta:
            continue
        side = "yes" if edge > 0 else "no"
        q = round(bid + p.tick, 2) if side == "yes" else round(ask - p.tick, 2)
        if not (q < ask if side == "yes" else q > bid):
            continue
        row.update(traded=True, side=side, quote_price=q)
        hits = [b[1] for b in mine if b[1] > dts and (b[5] <= q if side == "yes" else b[6] >= q)]
        if hits:
            charged = fees is None or fees.get(t.split("-")[0], "quadratic_with_maker_fees") == "quadratic_with_maker_fees"
            fee = math.ceil(0.0175 * contracts * q * (1 - q) * 100) / 100 if charged else 0.0
            stake = q if side == "yes" else 1 - q
            payout = float(y == (1 if side == "yes" else 0))
            row.update(fill_ts=hits[0], fee=fee, stake=stake * contracts, payout=payout * contracts, pnl=(payout - stake - fee) * contracts)
    return out


@pytest.mark.parametrize("seed,contracts,split,fees", [
    (0, 1.0, "test", None), (1, 3.0, None, {"S0": "none", "S1": "quadratic_with_maker_fees"}), (2, 1.0, None, None)])
def test_replay_matches(spark, seed, contracts, split, fees):
    bars, preds, meta = adversarial(seed)
    p = replay.ReplayParams(contracts=contracts, trade_split=split, max_staleness_days=5)
    fee_df = None if fees is None else spark.createDataFrame(list(fees.items()), "series string, fee_type string")
    got = replay.replay(spark.createDataFrame(preds, PREDS), spark.createDataFrame(bars, BARS), spark.createDataFrame(meta, META), p, fee_df)
    rows = {r.market_ticker: r.asDict() for r in got.collect()}
    want = by_hand(bars, preds, meta, p, fees, contracts)
    assert len(rows) == len(want)
    assert any(w["fill_ts"] for w in want.values())
    for t, w in want.items():
        assert {k: rows[t][k] for k in w} == w
        assert rows[t]["filled"] == (w["fill_ts"] is not None)
    first = {}
    for m in meta:
        first.setdefault(m[0], m)
    for t, r in rows.items():
        assert r["resolution_risk"] == ((first.get(t) or (0,) * 6)[4] or "low") and r["format"] == ((first.get(t) or (0,) * 6)[3] or "other")


def test_block_lookups_equal_plain_ones(spark):
    bars, preds, _ = adversarial(5)
    b, pts = spark.createDataFrame(bars, BARS), spark.createDataFrame(preds, PREDS).selectExpr("market_ticker ticker", "decision_ts")
    orders = pts.filter("decision_ts is not null").selectExpr("ticker", "decision_ts", "'yes' side", "0.3D quote_price")
    both = [sorted(map(str, joins.first_touch(orders, b, block_s=n).collect())) for n in (1, 40, 10**9)]
    assert both[0] == both[1] == both[2]


def test_sweep_equals_single_replays(spark):
    bars, preds, meta = adversarial(9)
    dfs = spark.createDataFrame(preds, PREDS), spark.createDataFrame(bars, BARS), spark.createDataFrame(meta, META)
    grid = {(r.theta, r.band_lo): r for r in replay.sweep(*dfs, [0.0, 0.1], [0.15, 0.3], replay.ReplayParams(trade_split=None)).collect()}
    for (theta, lo), r in grid.items():
        one = replay.replay(*dfs, replay.ReplayParams(theta=theta, band_lo=lo, trade_split=None)).agg(
            F.count_if("traded").alias("n"), F.count_if("filled").alias("f"), F.sum("pnl").alias("pnl")).first()
        assert (r.n_traded, r.n_filled) == (one.n, one.f) and abs(r.pnl - one.pnl) < 1e-9


def test_asof_keeps_unknown_values(spark):
    left = spark.createDataFrame([("A", 10), ("A", 25), ("A", 5), ("B", 9)], "k string, t bigint")
    right = spark.createDataFrame([("A", 10, 1, 0.5), ("A", 10, 2, None), ("A", 20, 1, 0.7)], "k string, rt bigint, seq bigint, v double")
    out = {(r.k, r.t): r.q for r in joins.asof_backward(left, right, "k", F.col("t"), F.col("rt"), "seq", ["v", "seq"], "q", chunk_s=3).collect()}
    assert out["A", 10].v is None and out["A", 10].seq == 2
    assert out["A", 25].v == 0.7 and out["A", 5] is None and out["B", 9] is None


def pava(ys):
    blocks = []
    for y in ys:
        blocks.append([y, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (a, n), (b, m) = blocks[-2:]
            blocks[-2:] = [[(a * n + b * m) / (n + m), n + m]]
    return [v for v, n in blocks for _ in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_isotonic_matches(spark, seed):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p ** 1.5).astype(int)
    split = np.where(rng.random(300) < 0.7, "train", "test")
    rows = [(i, float(a), int(b), str(s)) for i, (a, b, s) in enumerate(zip(p, y, split))]
    got = {r.i: r.p_cal for r in calibrate.calibrate(spark.createDataFrame(rows, "i bigint, p double, y int, split string"), "p", "y", "split", "i").collect()}
    train = sorted((a, i, b) for i, a, b, s in rows if s == "train")
    fit = pava([float(b) for _, _, b in train])
    xs = sorted({a for a, _, _ in train})
    means = [np.mean([f for (a, _, _), f in zip(train, fit) if a == x]) for x in xs]
    want = np.clip(np.interp(p, xs, means), 1e-3, 1 - 1e-3)
    assert len(got) == 300
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-9


@pytest.mark.parametrize("partitions", [1, 7])
def test_isotonic_blocks_over_partitions(spark, partitions):
    """All scores in one narrow band, most of them shared, over many partitions; and no trend at all."""
    rng = np.random.default_rng(partitions)
    for p in (rng.integers(0, 9, 800) * 1e-6, rng.random(800) * 2e-4, np.full(300, 1e-5)):
        for y in ((rng.random(len(p)) < 0.5).astype(float), np.round(rng.normal(p * 1e4, 1.0), 3), -p, np.zeros(len(p))):
            rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, y))]
            df = spark.createDataFrame(rows, "i bigint, p double, y double").repartition(3)
            curve = sorted(calibrate.isotonic_curve(df, "p", "y", "i", partitions).collect())
            rows.sort(key=lambda r: (r[1], r[0]))
            fit = np.array(pava([r[2] for r in rows]))
            xs = np.unique(p)
            want = np.array([fit[[r[1] == x for r in rows]].mean() for x in xs])
            assert np.abs(np.interp(xs, [c.x for c in curve], [c.yhat for c in curve]) - want).max() < 1e-9
        # a corner is a score, and between two corners the curve is straight
        assert {c.x for c in curve} <= set(xs.tolist())


def test_isotonic_rows_stay_spread(spark):
    """Rows of one narrow band of scores are pooled by many tasks."""
    df = spark.range(20_000).selectExpr("id AS i", "id * 1e-9 AS p", "CAST(id % 7 < id / 4000 AS DOUBLE) AS y")
    blocks = df.selectExpr("p AS first", "i AS tie").repartitionByRange(8, "first", "tie")
    assert blocks.selectExpr("spark_partition_id() AS part").groupBy("part").count().agg(F.max("count")).first()[0] < 6000
    assert abs(calibrate.isotonic_blocks(df, "p", "y", "i").agg(F.sum("total")).first()[0] - df.agg(F.sum("y")).first()[0]) < 1e-6


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0] * 40, [float(i % 7) for i in range(100)], [1e-300 * i for i in range(50)], [10.0 ** i for i in range(-12, 12)],
    [1.0, 1.0 + 2**-52, 1.0 + 2**-51], [0.0] * 99 + [1e18], [None, float("nan"), 2.0, 9.0]])
def test_exact_quantile(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    known = [v for v in values if v is not None and v == v]
    for q in (0.0, 0.1, 0.6, 1.0):
        assert calibrate.exact_quantile(df, F.col("v"), q) == pytest.approx(float(np.quantile(known, q)), rel=1e-12, abs=0.0)
    assert calibrate.exact_quantile(df.limit(0), F.col("v"), 0.5) is None


def test_isotonic_ties_enter_in_row_order(spark):
    rows = [(0, 0.4, 1, "train"), (1, 0.5, 0, "train"), (2, 0.5, 1, "train")]
    got = {r.i: round(r.p_cal, 9) for r in calibrate.calibrate(spark.createDataFrame(rows, "i bigint, p double, y int, split string"), "p", "y", "split", "i").collect()}
    assert got == {0: 0.5, 1: 0.75, 2: 0.75}


def test_platt_matches(spark):
    rng = np.random.default_rng(4)
    p = np.clip(rng.random(400), 0.02, 0.98)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + 0.6 * np.log(p / (1 - p)))))).astype(int)
    rows = [(i, float(a), int(b), "train") for i, (a, b) in enumerate(zip(p, y))]
    got = {r.i: r.p_cal for r in calibrate.calibrate(spark.createDataFrame(rows, "i bigint, p double, y int, split string"), "p", "y", "split", "i", "platt").collect()}
    x = np.column_stack([np.ones(400), np.log(p / (1 - p))])
    b = np.zeros(2)
    for _ in range(50):  # Newton steps
        f = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (f * (1 - f))[:, None]).T @ x, x.T @ (y - f))
    want = 1 / (1 + np.exp(-x @ b))
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-4


@pytest.mark.parametrize("ts,train", [
    ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], 6), ([1, 1, 1, 9, 9], 3), ([None, None], 2), ([5, 5, 5, 5, 5], 3), ([1, 2, 9, 9, 9, 9], 4), ([1, 2, 3, None], 2)])
def test_time_split(spark, ts, train):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i bigint, t bigint")
    rows = sorted(calibrate.time_split(df, "t", ["i"]).collect())
    assert sum(r.split == "train" for r in rows) == train
    labels = [r.split for r in rows]
    assert labels == sorted(labels, reverse=True)  # train first


def test_no_train_rows_only_clip(spark):
    df = spark.createDataFrame([(0, 0.0, 1, "test"), (1, 0.4, 0, "test")], "i bigint, p double, y int, split string")
    assert sorted(r.p_cal for r in calibrate.calibrate(df, "p", "y", "split", "i").collect()) == [0.001, 0.4]
    with pytest.raises(ValueError):
        calibrate.calibrate(df, "p", "y", "split", "i", "other")


def test_scores(spark):
    df = spark.createDataFrame([(0.8, 1), (0.3, 0), (1.0, 0)], "p double, y int")
    r = calibrate.score(df, "p", "y").first()
    assert abs(r.brier - (0.04 + 0.09 + 1.0) / 3) < 1e-12 and r.log_loss > 9
    assert calibrate.score(df.filter("p > 2"), "p", "y").first().brier is None

"""Bars, ordered scans, spikes and book spans against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.operators import bars, book, ordered, spikes

NAN = float("nan")
T0 = 1_800_000_000


def bars_by_hand(ticks, start, stop, p=60):
    buckets = {}
    for ts, _seq, bid, ask in sorted(ticks, key=lambda t: (t[0], t[1])):
        buckets.setdefault(-(-ts // p) * p, []).append((bid, ask))
    out, close = [], None
    for s in range(-(-start // p) * p, -(-stop // p) * p + 1, p):
        sides = []
        if s in buckets:
            for k in (0, 1):
                v = [q[k] for q in buckets[s] if not math.isnan(q[k])]
                sides.append((v[0], max(v), min(v), v[-1]) if v else (None,) * 4)
            close = [x[3] for x in sides]
        elif close is not None:
            sides = [(c,) * 4 for c in close]
        else:
            continue
        out.append((s, *sides[0], *sides[1]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_bars_match(spark, seed):
    rng = np.random.default_rng(seed)
    n = 800
    ts = T0 + rng.integers(0, 7200, n)
    ts = np.where(rng.random(n) < 0.1, ts // 60 * 60, ts)
    price = np.round(rng.random((n, 2)), 2)
    price[rng.random((n, 2)) < 0.07] = NAN
    rows = [("A", int(t), i, float(b), float(a)) for i, (t, (b, a)) in enumerate(zip(ts, price))]
    start, stop = T0 + (300 if seed % 2 else 0), T0 + 7200 + (600 if seed > 1 else 0)
    df = spark.createDataFrame(rows, "ticker string, recv_utc bigint, seq bigint, yes_bid double, yes_ask double")
    got = sorted(tuple(r)[1:-1] for r in bars.assemble_bars(df, 60, start, stop).collect())
    assert got == bars_by_hand([r[1:] for r in rows], start, stop)


def test_nanosecond_seq_orders_bars(spark):
    big = 1_700_000_000_000_000_000
    df = spark.createDataFrame([("A", T0, big + 3, 0.3, 0.4), ("A", T0, big + 1, 0.1, 0.2), ("A", T0, big + 2, 0.2, None), ("A", T0 + 1, big + 9, 0.25, 0.5)],
                               "ticker string, recv_utc bigint, seq bigint, yes_bid double, yes_ask double")
    rows = bars.bucket_bars(df, 60).orderBy("ts").collect()
    first = rows[0]
    assert (first.yes_bid_open, first.yes_bid_high, first.yes_ask_open) == (0.1, 0.3, 0.2)
    assert rows[-1].yes_bid_close == 0.25 and rows[-1].yes_ask_close == 0.5


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_scans_do_not_depend_on_chunks(spark, width):
    rng = np.random.default_rng(width)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "b", "c"], 400, p=[0.8, 0.1, 0.1]), "t": rng.integers(0, 300, 400)})
    pdf["i"] = range(400)
    pdf["v"] = np.where(rng.random(400) < 0.5, np.nan, rng.integers(0, 9, 400))
    cells = [(k, int(t), int(i), None if math.isnan(v) else float(v)) for k, t, i, v in pdf[["k", "t", "i", "v"]].itertuples(index=False)]
    df = spark.createDataFrame(cells, "k string, t bigint, i bigint, v double")
    rows, o = ordered.by_seconds(df, ("k",), "t", "i", seconds=width)
    out = ordered.scan(rows, o, previous={"pv": F.col("v")}, following={"nt": F.col("t")}, last={"lv": F.col("v")}, total={"s": F.col("t")})
    got = out.toPandas().sort_values("i").reset_index(drop=True)
    s = pdf.sort_values(["k", "t", "i"])
    g = s.groupby("k")
    want = s.assign(pv=g.v.shift(1), nt=g.t.shift(-1), lv=g.v.ffill(), s=g.t.cumsum()).sort_values("i").reset_index(drop=True)
    for c in ("pv", "nt", "lv", "s"):
        pd.testing.assert_series_equal(got[c].astype(float), want[c].astype(float), check_names=False)


def _bar_frame(spark, mids, start=T0):
    rows = [("A", start + 60 * i, None if m is None else m - 0.01, None if m is None else m + 0.01) for i, m in enumerate(mids)]
    return spark.createDataFrame(rows, "ticker string, ts bigint, yes_bid_close double, yes_ask_close double")


@pytest.mark.parametrize("mids,want", [
    ([0.20] * 5 + [0.32], [("up", 0.12)]),
    ([0.80] * 5 + [0.68], [("down", -0.12)]),
    ([0.97] * 5 + [0.80], []),            # starts outside the band
    ([0.90] * 5 + [0.99], []),            # ends above the cap
    ([0.20, 0.32], []),                   # too little history
    ([0.2, 0.2, None, 0.3, 0.3], [("up", 0.1)]),  # an unknown mid never counts
])
def test_spikes(spark, mids, want):
    got = [(r.direction, round(r.dmid, 9)) for r in spikes.detect_spikes(_bar_frame(spark, mids)).orderBy("S").collect()]
    assert got == want


def test_spike_window_comes_before_lagging(spark):
    b = _bar_frame(spark, [0.2, 0.2, 0.2, 0.4, 0.4])
    assert spikes.detect_spikes(b, window=(T0 + 120, T0 + 240)).count() == 1
    assert spikes.detect_spikes(b, window=(T0 + 180, T0 + 240)).count() == 0


def test_grid_fills_to_the_end_of_the_tape(spark):
    rows = [("A", T0 + 2, 1, 0.4, 0.5, 5.0, 5.0), ("A", T0 + 2, 2, 0.4, 0.5, 5.0, 0.0), ("A", T0 + 5, 3, 0.6, 0.5, 5.0, 5.0),
            ("B", T0 + 1, 4, None, None, None, None), ("B", T0 + 7, 5, 0.2, 0.3, 1.0, 1.0)]
    t = spark.createDataFrame(rows, "ticker string, recv_utc bigint, seq bigint, yes_bid double, yes_ask double, depth_bid double, depth_ask double")
    grid = {(r.ticker, r.t - T0): (r.state, r.mid_lkm) for r in book.second_grid(book.classify(t)).collect()}
    assert [grid["A", s][0] for s in range(2, 8)] == ["EMPTY_ASK"] * 3 + ["CROSSED"] * 3
    assert grid["A", 2][1] == 0.4 and ("A", 1) not in grid
    assert grid["B", 1] == ("EMPTY_BOTH", 0.25)  # the head takes the first known mid
    runs = [(r.ticker, r.state, r.length_s) for r in book.state_runs(book.spans(book.classify(t))).orderBy("ticker", "start_t").collect()]
    assert runs == [("A", "EMPTY_ASK", 3), ("A", "CROSSED", 3), ("B", "EMPTY_BOTH", 6), ("B", "VALID", 1)]

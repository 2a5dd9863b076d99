"""Streams against the batch operators and plain Python."""

from __future__ import annotations

import json
import random

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tapeline.operators import levels
from tapeline.operators.bars import bucket_bars
from tapeline.operators.dedup import dedup_tick_stream
from tapeline.plans import stream_queries, views
from tapeline.streaming import bars, book, capture, commits
from tapeline.streaming.run import append_to_table, dealt_by_key, landed, state_partitions

TICKS = "ticker string, recv_utc bigint, seq bigint, yes_bid double, yes_ask double, depth_bid double, depth_ask double"
T0 = 1_800_000_000


def as_stream(spark, tmp_path, batches, ddl, name="in"):
    """Each batch as one file, one file per micro-batch, in order."""
    path = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(path))
    schema = spark.createDataFrame([], ddl).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_late_ticks_never_reach_a_closed_bar(spark, tmp_path):
    first = [("A", T0 + 5, 1, 0.4, 0.5, 1.0, 1.0), ("A", T0 + 60, 2, 0.41, 0.5, 1.0, 1.0), ("A", T0 + 61, 3, 0.42, 0.5, 1.0, 1.0)]
    late = [("A", T0 + 59, 4, 0.9, 0.95, 1.0, 1.0), ("A", T0 + 200, 5, 0.5, 0.6, 1.0, 1.0), ("A", T0 + 500, 6, 0.5, 0.6, 1.0, 1.0)]
    between = [("A", T0 + 90, 9, 0.42, 0.5, 1.0, 1.0)]  # the batch that emits the first bar
    out = append_to_table(bars.stream_bars(as_stream(spark, tmp_path, [first, between, late], TICKS)), "b").orderBy("ts").collect()
    assert [(r.ts - T0, r.yes_bid_open, r.yes_bid_high, r.yes_bid_close) for r in out] == [
        (60, 0.4, 0.41, 0.41), (120, 0.42, 0.42, 0.42), (240, 0.5, 0.5, 0.5)]


def test_repeated_ticks_of_other_batches(spark, tmp_path):
    """Copies inside the delay go, in the same batch or a later one; what differs in any key stays."""
    tick = lambda t, seq, ticker="A": (ticker, T0 + t, seq, 0.4, 0.5, 1.0, 1.0)
    batches = [[tick(0, 1), tick(0, 1), tick(0, 2)], [tick(0, 1), tick(0, 1, "B"), tick(1, 1)], [tick(40, 3), tick(1, 1)], [tick(40, 3), tick(0, 2), tick(41, 3)]]
    out = append_to_table(dedup_tick_stream(as_stream(spark, tmp_path, batches, TICKS), 600), "d")
    assert sorted((r.ticker, r.recv_utc - T0, r.seq) for r in out.collect()) == [("A", 0, 1), ("A", 0, 2), ("A", 1, 1), ("A", 40, 3), ("A", 41, 3), ("B", 0, 1)]


def test_silent_buckets_repeat_the_close_pair(spark, tmp_path):
    rows = [("A", T0 + 5, 1, 0.4, None, 1.0, 1.0), ("A", T0 + 250, 2, 0.6, 0.7, 1.0, 1.0), ("B", T0 + 400, 3, 0.1, 0.2, 1.0, 1.0)]
    out = append_to_table(bars.stream_filled_bars(as_stream(spark, tmp_path, [rows], TICKS)), "f").filter("ticker = 'A'").orderBy("ts").collect()
    got = [(r.ts - T0, r.yes_bid_close, r.yes_ask_close) for r in out]
    assert got[:5] == [(60, 0.4, None), (120, 0.4, None), (180, 0.4, None), (240, 0.4, None), (300, 0.6, 0.7)]
    assert all(g[1:] == (0.6, 0.7) for g in got[5:]) and len({g[0] for g in got}) == len(got)


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("AB"), T0 + i // 2, i, rng.random(), rng.random(), 1.0, 1.0) for i in range(1500)]
    stream = as_stream(spark, tmp_path, [rows[:600], rows[600:1200], rows[1200:]], TICKS)
    got = append_to_table(bars.stream_bars(stream), "s").drop("volume")
    closed = T0 + 1499 // 2 - 1
    want = bucket_bars(spark.createDataFrame(rows, TICKS)).filter(F.col("ts") <= closed)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def frame_text(kind, seq, **msg):
    import json
    return (T0 + seq, json.dumps({"type": kind, "seq": seq, "msg": {"market_ticker": "A", **msg}}))


def test_book_rebuild(spark, tmp_path):
    delta = lambda seq, side, price, d: frame_text("orderbook_delta", seq, side=side, price_dollars=price, delta_fp=d)
    first = [frame_text("orderbook_snapshot", 1, yes_dollars_fp=[["0.40", "5"], ["0.35", "7"], ["0.50", "0"]], no_dollars_fp=[["0.55", "3"]]),
             delta(3, "yes", "0.40", "-9"), delta(2, "yes", "0.42", "4"), frame_text("ticker", 4)]
    second = [delta(5, "no", "0.57", "2"), delta(6, "up", "0.1", "2"), frame_text("orderbook_snapshot", 7, yes=[[20, 6]], no=[])]
    stream = as_stream(spark, tmp_path, [first, second], "recv_utc bigint, body string")
    out = {r.seq: r for r in append_to_table(book.rebuild(book.frames(stream)), "k").collect()}
    assert sorted(out) == [1, 2, 3, 5, 6, 7]
    assert (out[1].yes_bid, out[1].depth_bid, out[1].yes_bid2, out[1].yes_ask, out[1].yes_ask2) == (0.40, 5.0, 0.35, 0.45, None)
    assert (out[2].yes_bid, out[2].yes_bid2) == (0.42, 0.40)
    assert (out[3].yes_bid, out[3].yes_bid2) == (0.42, 0.35)
    assert (out[5].yes_ask, out[5].depth_ask, out[5].yes_ask2) == (0.43, 2.0, 0.45)
    assert (out[6].yes_bid, out[6].yes_ask) == (out[5].yes_bid, out[5].yes_ask)
    assert (out[7].yes_bid, out[7].yes_ask) == (0.20, None)


def plain_book(frames):
    """Top two levels of both sides after each (ticker, recv, seq, snapshot, yes, no, side, price, delta)."""
    out, books = [], {}
    for ticker, recv, seq, snapshot, yes, no, side, price, delta in sorted(frames, key=lambda f: (f[0], f[2])):
        both = books.setdefault(ticker, {"yes": {}, "no": {}})
        if snapshot:
            both["yes"], both["no"] = dict(yes), dict(no)
        elif side in both and price is not None and delta is not None:
            both[side][price] = both[side].get(price, 0.0) + delta
            if both[side][price] <= 0:
                del both[side][price]
        (b1, d1), (b2, d2) = (sorted(both["yes"].items(), reverse=True) + [(None, None)] * 2)[:2]
        (n1, m1), (n2, m2) = (sorted(both["no"].items(), reverse=True) + [(None, None)] * 2)[:2]
        ask = lambda p: None if p is None else round(1 - p, 4)
        out.append((ticker, recv, seq, b1, ask(n1), d1, m1, b2, ask(n2), d2, m2))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,chunk", [(2, 3), (64, 16), (1, 1)])
def test_batch_rebuild_equals_plain_book(spark, monkeypatch, window, chunk):
    """Levels that fall below zero and come back, snapshots inside windows, one market with most frames."""
    monkeypatch.setattr(levels, "FRAMES_PER_CHUNK", chunk)
    rng, frames = random.Random(window), []
    for i in range(700):
        ticker = "HOT" if rng.random() < 0.8 else rng.choice("AB")
        prices = [round(0.01 * rng.randint(1, 12), 2) for _ in range(4)]
        snapshot = rng.random() < 0.03
        frames.append((ticker, T0 + i // 3, i, snapshot, {p: float(rng.randint(1, 9)) for p in prices[:2]} if snapshot else {}, {p: 4.0 for p in prices[2:]} if snapshot else {},
                       rng.choice(["yes", "no", "up", None]), rng.choice(prices + [None]), rng.choice([None, *map(float, range(-9, 10))])))
    rows = [(*f[:4], [{"price": p, "count": n} for p, n in f[4].items()], [{"price": p, "count": n} for p, n in f[5].items()], *f[6:]) for f in frames]
    side = "array<struct<price:double,count:double>>"
    df = spark.createDataFrame(rows, f"ticker string, recv_utc bigint, seq bigint, snapshot boolean, yes {side}, no {side}, side string, price double, delta double").repartition(5)
    out = levels.rebuild(df, window)
    assert sorted(map(tuple, out.collect()), key=str) == plain_book(frames)
    assert "Python" not in out._jdf.queryExecution().toString() and levels.rebuild(df.limit(0), window).collect() == []


def test_watch_and_its_batch_twins(spark, tmp_path):
    lim = capture.CaptureLimits(min_capture_s=120, max_capture_s=100_000, quiet_s=200, blind_s=90, move_threshold=0.08)
    words = [(1, T0 + t, None, None) for t in range(0, 400, 20)]
    quotes = [(1, T0 + 30, "A", 0.40), (1, T0 + 420, "A", 0.50), (1, T0 + 1000, "A", 0.5)]
    rows = sorted(words + quotes, key=lambda r: r[1])
    stream = as_stream(spark, tmp_path, [rows[:9], rows[9:]], "occasion_id bigint, ts bigint, ticker string, mid double")
    alerts = sorted((r.at - T0, r.kind) for r in append_to_table(capture.watch(stream, lim), "w").collect())
    # the last word ends at 380; checks come at 1, 61, 121, ...
    assert [a for a in alerts if a[1] != "blind"] == [(601, "speech_ended")]
    assert [a for a, k in alerts if k == "blind"] == [481, 541, 601]
    w = spark.createDataFrame([(1, T0 + t) for t in range(0, 400, 20)], "occasion_id bigint, t_end_utc bigint")
    occ = spark.createDataFrame([(1, T0, T0)], "occasion_id bigint, capture_start_utc bigint, occurrence_ts bigint")
    r = capture.stop_times(w, occ, lim).first()
    assert (r.stop_utc - T0, r.stop_reason) == (601, "speech_ended")
    mids = [(1, "A", T0 + at, 0.40 if at < 420 else 0.50) for at in range(61, 1000, 60)]
    q = spark.createDataFrame(mids, "occasion_id bigint, ticker string, at bigint, mid double")
    blind = sorted(x.at - T0 for x in capture.blind_minutes(q, w, occ, lim).collect())
    assert blind == [481, 541, 601, 661]
    capped = capture.stop_times(w, occ, capture.CaptureLimits(max_capture_s=300)).first()
    assert (capped.stop_utc - T0, capped.stop_reason) == (301, "max_duration")


def test_silent_occasions_stop_too(spark, tmp_path):
    """Occasions without a ticker, or whose rows end, get the stop of the batch rule, however rows are cut into batches."""
    lim = capture.CaptureLimits(min_capture_s=120, max_capture_s=900, quiet_s=200)
    rng = random.Random(8)
    spoken = {k: sorted(T0 + rng.randrange(10 + 120 * k) for _ in range(30 * k)) for k in range(1, 9)}
    rows = [(k, t, None, None) for k, ts in spoken.items() for t in ts]
    rng.shuffle(rows)
    mark = [(None, T0 + 200_000, None, None)]
    stream = as_stream(spark, tmp_path, [rows[:300], rows[300:700], rows[700:], mark], "occasion_id bigint, ts bigint, ticker string, mid double")
    got = sorted(map(tuple, append_to_table(capture.watch(stream, lim, delay_s=100_000), "q").collect()))
    w = spark.createDataFrame([(k, t) for k, ts in spoken.items() for t in ts], "occasion_id bigint, t_end_utc bigint")
    occ = spark.createDataFrame([(k, ts[0], ts[0]) for k, ts in spoken.items()], "occasion_id bigint, capture_start_utc bigint, occurrence_ts bigint")
    want = sorted(map(tuple, capture.stop_times(w, occ, lim).collect()))
    assert got == want and {k for _, _, k in want} == {"speech_ended", "max_duration"}


def test_rows_that_no_check_sees_leave_before_the_state(spark):
    """Of the words and of each ticker the last row before a check stays, and the first row of each period."""
    rng = random.Random(11)
    rows = [(k, T0 + rng.randrange(600), t, None if rng.random() < 0.1 else float(i)) for i in range(9000) for k in (1, 2) for t in (None, "A", "B")]
    ddl = "occasion_id bigint, ts bigint, ticker string, mid double"
    kept = [tuple(r) for r in capture._thinned(spark.createDataFrame(rows, ddl).coalesce(1), 60).collect()]
    period = lambda r: (r[0], -(-(r[1] - 1) // 60))
    last, first = {}, {}
    for part in (rows[i:i + 10_000] for i in range(0, len(rows), 10_000)):
        for j, r in enumerate(sorted(part, key=lambda r: r[1])):
            last[(id(part[0]), *period(r), r[2])] = r
            first.setdefault((id(part[0]), *period(r)), r)
    assert sorted(set(kept), key=str) == sorted(set(last.values()) | set(first.values()), key=str)
    assert len(kept) < 1000 < len(rows) / 50


def test_watch_reads_the_words(spark):
    """The stops of the registered query are those of the batch rule over the words of the documents."""
    data = "/root/testdata/sf0.001"
    got = sorted(map(tuple, stream_queries.stream_watch(spark, data).filter("kind != 'blind'").collect()))
    w = views.words(spark, data).select("occasion_id", "t_end_utc")
    quoted = views.ticks(spark, data).select(F.substring("ticker", 2, 20).cast("bigint"), "recv_utc")
    occ = w.union(quoted).groupBy("occasion_id").agg(F.min("t_end_utc").alias("capture_start_utc"), F.min("t_end_utc").alias("occurrence_ts"))
    assert got == sorted(map(tuple, capture.stop_times(w, occ, stream_queries._WATCH).collect()))


def commits_by_hand(passes, max_dt=2.0, limit=75.0, hold=10.0, window=15.0):
    done, prev, dropped, out = [], [], 0.0, []
    for end, hyp in passes:
        last = done[-1][2] if done else -1.0
        a = [w for w in prev if w[2] > last + 1e-6]
        b = [w for w in hyp if w[2] > last + 1e-6]
        for x, y in zip(a, b):
            if x[0].strip().lower() != y[0].strip().lower() or abs(x[1] - y[1]) > max_dt:
                break
            done.append(y)
            out.append((y[0], None))
        prev = hyp
        anchor = max(done[-1][2] if done else 0.0, dropped)
        if end - anchor > limit:
            forced = [w for w in hyp if anchor + 1e-6 < w[2] <= end - hold]
            done += forced
            out += [(w[0], -1.0) for w in forced]
            if not forced:
                dropped = max(dropped, end - window)
    return out


def test_commits_match(spark, tmp_path):
    rng = random.Random(6)
    passes, rows = [], []
    for p in range(60):
        end = 4.0 * (p + 1)
        lo = max(0.0, end - 30)
        mode = "never" if 15 <= p < 40 else "silent" if 40 <= p < 62 else "agree"
        hyp = [] if mode == "silent" else [
            (f"w{int(t)}" + (str(p) if mode == "never" else "?" if rng.random() < 0.1 else ""), t, t + 0.8) for t in [lo + k for k in range(int(end - lo))]]
        passes.append((end, hyp))
        rows.append((1, p, end, T0, hyp))
    ddl = "occasion_id bigint, pass_no bigint, end_s double, capture_start_utc bigint, hyp array<struct<word:string,t_start:double,t_end:double>>"
    out = append_to_table(commits.commit_words(as_stream(spark, tmp_path, [rows[:25], rows[25:]], ddl)), "c").orderBy("word_idx").collect()
    want = commits_by_hand(passes)
    assert [r.word_idx for r in out] == list(range(len(want)))
    assert [(r.word, r.asr_conf) for r in out] == want
    assert any(c == -1.0 for _, c in want) and any(c is None for _, c in want)


def test_passes_do_not_carry_their_document(spark):
    """All passes of a document are made before the explode, so no row of it holds the whole text."""
    docs = spark.createDataFrame([(5, "a b c " * 30), (4, " ".join(f"w{i}" for i in range(25))), (3, None), (2, "")], "doc_id bigint, text string")
    out = stream_queries.hypotheses_of(docs)
    generate = next(n for n in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in n)
    assert "hyp" in generate
    rows = {(r.occasion_id, r.pass_no): r for r in out.collect()}
    assert sorted(rows) == [(2, 0), *[(4, p) for p in range(3)], *[(5, p) for p in range(10)]]
    assert [w.word for w in rows[4, 2].hyp] == [f"w{i}" for i in range(23)] + ["w23?", "w24?"]
    assert [(w.word, w.t_start) for w in rows[5, 4].hyp[:2]] == [("c4", 20 * 0.4), ("a4", 21 * 0.4)]


def test_standing_quote_keeps_each_side(spark):
    rows = [("A", T0, 1, 0.4, 0.5, 1.0, None), ("A", T0 + 1, 2, None, 0.6, 2.0, 3.0), ("A", T0 + 1, 3, float("nan"), None, None, None)]
    r = bars.standing_quotes(spark.createDataFrame(rows, TICKS)).first()
    assert tuple(r) == ("A", 0.4, 0.6, 2.0, 3.0)


def test_tickers_of_a_bucket_keep_their_books():
    """One call takes the frames of several tickers in any order; each has one state entry, written where it changed."""
    state, writes = {}, []

    class Entries:
        def getValue(self, key):
            return state.get(key)

        def updateValue(self, key, value):
            writes.append(key)
            state[key] = value

    class Handle:
        def getMapState(self, *_):
            return Entries()

    def frame(ticker, seq, snapshot=False, yes=(), side=None, price=float("nan"), delta=float("nan")):
        return dict(ticker=ticker, recv_utc=100 + seq, seq=seq, snapshot=snapshot, yes_price=[p for p, _ in yes], yes_count=[n for _, n in yes],
                    no_price=[], no_count=[], side=side, price=price, delta=delta)

    def rows(*frames):
        got, = p.handleInputRows((0,), iter([pd.DataFrame([f]) for f in frames]), None)
        return [(r.ticker, r.seq, r.yes_bid, r.depth_bid) for r in got.itertuples()]

    p = book._Rebuild()
    p.init(Handle())
    first = rows(frame("B", 2, side="yes", price=0.5, delta=3.0), frame("A", 1, True, [(0.4, 7.0)]), frame("B", 1, True, [(0.3, 2.0)]))
    assert sorted(first) == [("A", 1, 0.4, 7.0), ("B", 1, 0.3, 2.0), ("B", 2, 0.5, 3.0)] and sorted(writes) == [("A",), ("B",)]
    second = rows(frame("A", 2, side="no", price=float("nan"), delta=1.0), frame("B", 3, side="yes", price=0.5, delta=-3.0))
    assert sorted(second) == [("A", 2, 0.4, 7.0), ("B", 3, 0.3, 2.0)] and writes[2:] == [("B",)]


def test_passes_are_made_where_their_state_is(spark, tmp_path):
    """Texts are the only rows shuffled before the commits; a micro-batch takes about as many bytes of files as it is told."""
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(45))) for k in range(12)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stream = landed(spark, str(tmp_path), "documents", bytes_per_trigger=1).select("doc_id", "text")
    with state_partitions(spark, 16):
        query = (commits.commit_words(stream_queries.hypotheses_of(dealt_by_key(stream, "doc_id"))).writeStream.format("noop").outputMode("append")
                 .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
        query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3


def test_state_keeps_no_committed_words():
    """Of the previous pass only the words after the commit point are kept, as no others are compared again."""
    kept = []

    class Value:
        def get(self):
            return kept[-1] if kept else None

        def update(self, value):
            kept.append(value)

    processor = commits._Commit(commits.CommitRules())
    processor.init(type("Handle", (), {"getValueState": lambda *_: Value()})())
    words = [(f"w{i}", i * 0.4, i * 0.4 + 0.3) for i in range(40)]
    out = []
    for p in range(3):
        hyp = words[max(0, p * 10 - 20):p * 10 + 10]
        rows = pd.DataFrame({"pass_no": [p], "end_s": [p * 4.0 + 4], "capture_start_utc": [0],
                             **{c: [np.array([w[k] for w in hyp])] for k, c in enumerate(("words", "starts", "ends"))}})
        out += [w for d in processor.handleInputRows((1,), iter([rows]), None) for w in d["word"]]
    assert out == [w[0] for w in words[:20]]
    assert [w[0] for w in json.loads(kept[-1][0])["prev"]] == [w[0] for w in words[20:30]]


def test_occasions_of_a_bucket_share_their_calls():
    """One call takes the observations of several occasions, one timer runs all checks that are due, a stopped occasion stays stopped."""
    class Value(list):
        def get(self):
            return self[-1] if self else None

        def update(self, value):
            self.append(value)

    class Rows(list):
        exists = lambda self: bool(self)
        get = lambda self: iter(list(self))
        appendValue = lambda self, value: self.append(value)

        def put(self, values):
            self[:] = values

    timers = set()
    handle = type("Handle", (), {"getValueState": lambda *_: Value(), "getListState": lambda *_: Rows(), "listTimers": lambda _: iter(timers),
                                 "deleteTimer": lambda _, t: timers.discard(t), "registerTimer": lambda _, t: timers.add(t)})()
    watch = capture._Watch(capture.CaptureLimits(min_capture_s=60, quiet_s=100, max_capture_s=10_000))
    watch.init(handle)
    at = lambda s: type("Timer", (), {"getCurrentWatermarkInMs": lambda _: s * 1000})()
    feed = lambda rows: list(watch.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["occasion", "ts", "ticker", "mid"])]), None))
    feed([("1", 130, None, None), ("2", 400, None, None), (None, 10, None, None), ("1", 100, None, None)])
    assert timers == {121_000}
    assert [d.values.tolist() for d in watch.handleExpiredTimer((0,), at(241), None)] == [[[1, 241, "speech_ended"]]]
    assert timers == {421_000}
    feed([("1", 300, None, None), ("2", 430, None, None)])
    assert timers == {421_000}
    assert [d.values.tolist() for d in watch.handleExpiredTimer((0,), at(1000), None)] == [[[2, 541, "speech_ended"]]]
    assert not timers and not watch.pending

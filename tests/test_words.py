"""Transcript, phrase, reprice and alignment operators against plain Python."""

from __future__ import annotations

import bisect
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.functions import text
from tapeline.operators import align, phrases, reprice, transcripts

WORDS = "occasion_id bigint, word_idx bigint, word string, t_start_utc bigint, t_end_utc bigint"


def tape(spark, ws, occasion=1, step=1, start=1000):
    return spark.createDataFrame([(occasion, i, w, start + step * i, start + step * i + 1) for i, w in enumerate(ws)], WORDS)


def loops_by_hand(ws):
    norm = [re.sub(r"^[^A-Za-z0-9']+|[^A-Za-z0-9']+$", "", w).lower() for w in ws]
    out, i = [], 0
    while i < len(norm) - 9:
        gram, reps = norm[i:i + 3], 1
        while all(gram) and norm[i + 3 * reps:i + 3 * reps + 3] == gram:
            reps += 1
        if reps >= 3:
            out.append((i, reps))
            i += 3 * reps
        else:
            i += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_loops_match(spark, seed):
    rng = np.random.default_rng(seed)
    ws = []
    while len(ws) < 400:
        gram = [str(x) for x in rng.choice(["a", "b", "-", "c"] if seed % 2 else ["a", "b"], 3)]
        ws += gram * int(rng.integers(1, 6)) + [str(x) for x in rng.choice(["a", "b", "c"], int(rng.integers(0, 4)))]
    got = sorted((r.word_idx, r.reps) for r in transcripts.loop_flags(tape(spark, ws)).collect())
    assert got == loops_by_hand(ws) and got


@pytest.mark.parametrize("label,need", [("iran", 1), ("new york / york new", 1), ("a b / b a", 1), ("a", 2), ("C+ plan", 1), ("", 1)])
def test_occurrence_times_match(spark, label, need):
    rng = np.random.default_rng(len(label))
    vocabulary = ["Iran,", "iran's", "anti-Iran", "miran", "new", "New", "york", "Yorks.", "a", "b", "b-a", "a.", "c+", "plans", "x"]
    ws = [str(w) for w in rng.choice(vocabulary, 500)]
    parts = [p.split() for p in label.split("/") if p.strip()]
    body = "|".join(r"(?<![A-Za-z])" + r"\s+".join(map(re.escape, p)) + r"(?:'s|’s|es|s)?(?![A-Za-z])" for p in parts)
    starts, pos = [], 0
    for w in ws:
        starts.append(pos)
        pos += len(w) + 1
    want = sorted(1001 + bisect.bisect_right(starts, m.end() - 1) - 1 for m in re.finditer(body, " ".join(ws), re.I)) if parts else []
    anchors = spark.createDataFrame([(1, "K", label if need == 1 else f"{label} ({need}+ times)")], "occasion_id bigint, series_key string, label string")
    words = tape(spark, ws)
    times = phrases.occurrence_times(words, anchors)
    assert sorted(r.t_end_utc for r in times.collect()) == want
    said = [r.said for r in phrases.said_time(times, anchors).collect()]
    assert said == (want[need - 1:need] if want else [])


def test_said_time_by_function(spark):
    anchors = spark.createDataFrame([(1, "K"), (1, "L")], "occasion_id bigint, series_key string")
    words = tape(spark, ["x", "y", "z"])
    out = phrases.said_time_by(words, anchors, lambda w: int(w.t_end_utc.iloc[1]))
    assert sorted((r.series_key, r.said) for r in out.collect()) == [("K", 1002), ("L", 1002)]
    assert phrases.said_time_by(words, anchors, lambda w: None).count() == 0


def test_matches_of_stemmed_words(spark):
    words = tape(spark, "They scored the goals coming back come Back to the-the".split())
    vocab = spark.createDataFrame([("M1", "Comeback / Come Back"), ("M2", "goal"), ("M3", "goals"), ("M4", "com back / back")], "market_ticker string, phrase string")
    got = sorted((r.market_ticker, r.word_idx) for r in phrases.reprice_matches(words, vocab).collect())
    assert got == [("M1", 6), ("M2", 3), ("M4", 4), ("M4", 5), ("M4", 7)]
    # inflected aliases only match once they are stemmed too
    assert [r.word_idx for r in phrases.reprice_matches(words, vocab, True).filter("market_ticker = 'M3'").collect()] == [3]


@pytest.mark.parametrize("t,window", [(1005, 2), (1005, 4), (1003, 1), (500, 10), (5000, 10)])
def test_matches_around_a_move(spark, t, window):
    """Matches end inside the slice; a move before the first or after the last word has one too."""
    words = tape(spark, "cat x x dog x cat x x big dog x".split())
    vocab = spark.createDataFrame([("M", "cat / dog / big dog")], "market_ticker string, phrase string")
    vocab_pair = spark.createDataFrame([("M", "cat / big dog"), ("N", "x dog x")], "market_ticker string, phrase string")
    moves = spark.createDataFrame([("T", t)], "ticker string, t_event bigint")

    def by_hand(v):
        tokens, times = [r.word for r in words.orderBy("word_idx").collect()], [r.t_start_utc for r in words.orderBy("word_idx").collect()]
        lo, hi = max(0, sum(x < t - window for x in times) - 3), sum(x < t + window for x in times) + 3
        out = set()
        for r in v.collect():
            for alias in r.phrase.split(" / "):
                a = alias.split()
                out |= {(r.market_ticker, i) for i in range(lo, min(hi, len(tokens)) - len(a) + 1) if tokens[i:i + len(a)] == a}
        return sorted(out)

    for v in (vocab, vocab_pair):
        got = reprice.mentions_near(moves, words, phrases.measured_matches(words, v), window)
        assert sorted((r.market_ticker, r.word_idx) for r in got.collect()) == by_hand(v)


def test_event_and_cluster_gaps_differ_at_the_boundary(spark):
    rows = [(1, i, "goal", t, t + 1) for i, t in enumerate([0, 20, 40, 61, 100])]
    words = spark.createDataFrame(rows, WORDS)
    hits = words.withColumn("market_ticker", F.lit("M")).withColumn("phrase", F.lit("goal"))
    assert sorted(r.t_word for r in phrases.mention_events(hits, 20).collect()) == [0, 20, 40, 61, 100]
    assert sorted(r.t_word for r in phrases.mention_events(hits, 21).collect()) == [0, 61, 100]
    clusters = phrases.vocabulary_clusters(phrases.vocabulary_hits(words)).collect()
    assert [(r.t_call, r.t_call_last, r.n_hits) for r in clusters] == [(0, 40, 3)]


def test_hit_rate_keeps_zeros(spark):
    vocab = spark.createDataFrame([(1, "A", "Goal"), (1, "B", "nutmeg")], "occasion_id bigint, market_ticker string, phrase string")
    out = {r.market_ticker: r for r in phrases.hit_rate(tape(spark, ["GOAL!", "x", "goals."]), vocab).collect()}
    assert (out["A"].n_matches, out["A"].t_first_utc, out["A"].t_last_utc) == (2, 1000, 1002)
    assert out["B"].n_matches == 0 and out["B"].variants_searched == "nutmeg; nutmegged; nutmegs"


def test_trim_and_sample(spark):
    words = tape(spark, [f"w{i}" for i in range(40)])
    kept = transcripts.trim_tape(words, 1010).orderBy("word_idx").collect()
    assert [r.word_idx for r in kept] == list(range(30)) and kept[0].word == "w10"
    sample = transcripts.sample_windows(words, 4, 5).collect()
    assert len({r.start_idx for r in sample}) == 4
    assert all(r.text == " ".join(f"w{r.start_idx + k}" for k in range(5)) for r in sample)
    assert [r.text for r in transcripts.sample_windows(tape(spark, ["a", "b"]), 4, 5).collect()] == ["a b"]


def measure_by_hand(ticks, t, th=0.03):
    mid = [(b + a) / 2 if b is not None and a is not None else (b if a is None else a) for _, _, b, a, _, _ in ticks]
    rows = [(*r, m) for r, m in zip(ticks, mid)]
    base = [r for r in rows if t - 600 <= r[0] <= t - 120]
    out = dict(t_reprice=None, t_pull=None, move_60s=None, move_300s=None, book_valid_at_word=None,
               tick_coverage=bool(base) and rows[-1][0] >= t + 290)
    known = [r[6] for r in base if r[6] is not None]
    if not known:
        return out
    b0 = float(np.median(known))
    for r in rows:
        if t - 300 <= r[0] <= t + 300:
            if out["t_reprice"] is None and r[6] is not None and abs(r[6] - b0) >= th:
                out["t_reprice"] = r[0]
            pulled = (r[5] is not None and r[5] < 1e-6) or r[3] is None or (r[2] is not None and r[2] >= r[3])
            if out["t_pull"] is None and pulled:
                out["t_pull"] = r[0]
    for name, at in (("move_60s", t + 60), ("move_300s", t + 300)):
        m = [r for r in rows if r[0] <= at][-1][6]
        out[name] = None if m is None else m - b0
    before = [r for r in rows if r[0] <= t - 1]
    if before:
        r = before[-1]
        out["book_valid_at_word"] = None not in r[2:6] and r[2] < r[3] and r[4] >= 1 and r[5] >= 1
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_reprice_matches(spark, seed):
    rng = np.random.default_rng(seed)
    ticks = {}
    for tk in ("A", "B"):
        ts = sorted(int(x) for x in rng.integers(100_000, 104_000, 150))
        maybe = lambda v: None if rng.random() < 0.1 else v
        ticks[tk] = [(t, i, maybe(round(float(rng.choice([0.4, 0.41, 0.44])), 2)), maybe(round(float(rng.choice([0.43, 0.45])), 2)),
                      maybe(float(rng.integers(0, 3))), maybe(float(rng.integers(0, 3)))) for i, t in enumerate(ts)]
    flat = [(tk, *r) for tk, rows in ticks.items() for r in rows]
    df = spark.createDataFrame(flat + flat[:20], "ticker string, recv_utc bigint, seq bigint, yes_bid double, yes_ask double, depth_bid double, depth_ask double")
    events = [(1, m, t) for m in ("A", "B", "C") for t in (99_000, 100_400, 102_000, 103_000, 103_900, 105_000)]
    ev = spark.createDataFrame(events, "occasion_id bigint, market_ticker string, t_word bigint")
    out = {(r.market_ticker, r.t_word): r.asDict() for r in reprice.measure(ev, reprice.prepare(df)).collect()}
    assert len(out) == len(events)
    for _, m, t in events:
        got = out[m, t]
        if m == "C":
            assert got["t_reprice"] is None and got["book_valid_at_word"] is None and not got["tick_coverage"]
            continue
        for k, w in measure_by_hand(ticks[m], t).items():
            assert got[k] == pytest.approx(w) if isinstance(w, float) else got[k] == w, (m, t, k)


def _offsets(spark, *vs):
    return spark.createDataFrame([(1, f"K{i}", float(v)) for i, v in enumerate(vs)], "occasion_id bigint, series_key string, offset double")


@pytest.mark.parametrize("offsets,release,start,method,aligned,n_ok", [
    ([100, 110, 130], None, 110, "price_only", True, 3),
    ([100, 110], None, 105, "price_only", False, 2),
    ([100, 110, 130, 9000], None, 110, "price_only", True, 3),
    ([100], 90, 90, "release+price_qa", True, 1),
    ([1000, 1010, 1020], 90, 1010, "price_over_release", True, 3),
    ([], 77, 77, "release_only", True, 0),
    ([], None, None, "", False, 0),
])
def test_alignment(spark, offsets, release, start, method, aligned, n_ok):
    occ = spark.createDataFrame([(1, release)], "occasion_id bigint, release_start_utc bigint")
    off = _offsets(spark, *offsets) if offsets else _offsets(spark, 0).filter("false")
    r = align.estimate_alignment(occ, off).first()
    assert (r.video_start_utc, r.method, r.aligned, r.n_ok) == (start, method, aligned, n_ok)


def test_first_cross_prefers_the_print(spark):
    rows = [("A", 60, 0.9, 0.98, 0.5), ("A", 120, 0.9, 0.98, float("nan")), ("A", 180, 0.1, 0.1, 0.95)]
    b = spark.createDataFrame(rows, "ticker string, ts bigint, yes_bid_close double, yes_ask_close double, price_close double")
    assert align.first_cross(b).first().cross_ts == 120
    assert align.first_cross(b, window=(130, 400)).first().cross_ts == 180


def test_occurrence_index_uses_the_first_spec(spark):
    corpus = spark.createDataFrame([("d1", "Chair Powell", "speech", 5, "rates, rates"), ("d2", "Li", "speech", 6, "rates")],
                                   "doc_id string, speaker string, format string, date_ts bigint, text string")
    specs = spark.createDataFrame([("chair powell", "speech", "x", 9), ("jerome powell", "speech", "rates", 0), ("jerome powell", "speech", "Rates ", 1),
                                   ("jerome powell", "speech", "rates (3+ times)", 2), ("jerome powell", "speech", "", 3)],
                                  "speaker_key string, format string, label string, ord bigint")
    got = sorted((r.doc_id, r.phrase_key, r.occurred, r["count"]) for r in phrases.occurrence_index(corpus, specs, ["ord"]).collect())
    assert got == [("d1", "rates", True, 2), ("d1", "rates|>=3", False, 2)]
    assert spark.range(1).select(text.speaker_key(F.lit("Chair Powell"))).first()[0] == "jerome powell"


def _plans(monkeypatch, module):
    """The plans of what a module stores, by name."""
    seen, real = {}, module.materialize

    def spy(df, name):
        seen[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(module, "materialize", spy)
    return seen


def test_a_vocabulary_of_occasions_is_not_copied(spark):
    """It grows with the occasions: no copies per salt, no broadcast."""
    vocab = spark.createDataFrame([(1, "M", "goal")], "occasion_id bigint, market_ticker string, phrase string")
    plan = phrases.qa_matches(tape(spark, ["goal", "x"]), vocab)._jdf.queryExecution().toString()
    assert "_salt" not in plan and "SortMergeJoin [occasion_id" in plan


def test_words_without_a_key_leave_before_the_shuffle(spark, monkeypatch):
    plans = _plans(monkeypatch, phrases)
    words = spark.createDataFrame([(1, i, w, i) for i, w in enumerate("the other of-of thes the's and The".split())],
                                  "occasion_id bigint, word_idx bigint, word string, t_end_utc bigint")
    anchors = spark.createDataFrame([(1, "A", "the"), (1, "B", "of / and"), (2, "A", "the")], "occasion_id bigint, series_key string, label string")
    got = sorted(map(tuple, phrases.occurrence_times(words, anchors).collect()))
    assert got == [(1, "A", 0), (1, "A", 3), (1, "A", 4), (1, "A", 6), (1, "B", 2), (1, "B", 2), (1, "B", 5)]
    assert "LeftSemi" in plans["near"] and "strategy=merge" in plans["near"]


def test_a_function_per_key_sees_each_occasion_whole(spark):
    words = spark.createDataFrame([(o, i, f"w{i}", o * 100 + i) for o in range(100) for i in (2, 0, 1)], "occasion_id bigint, word_idx bigint, word string, t_end_utc bigint")
    anchors = spark.createDataFrame([(o, k) for o in range(101) for k in "ab"], "occasion_id bigint, series_key string")
    out = phrases.said_time_by(words, anchors, {"a": lambda w: int(w.t_end_utc.iloc[0]), "b": lambda w: None if len(w) != 3 else int(w.t_end_utc.iloc[2])})
    assert {(r.occasion_id, r.series_key): r.said for r in out.collect()} == {(o, k): o * 100 + 2 * (k == "b") for o in range(100) for k in "ab"}


def test_thanks_reads_the_words_once(spark, monkeypatch):
    plans = _plans(monkeypatch, transcripts)
    got = transcripts.thanks_clusters(tape(spark, ["Thank", "you,", "x", "thank", "YOU!"])).collect()
    assert [(r.word_idx, r.n) for r in got] == [(0, 2)]
    assert "thanks" in plans and "ontains" in plans["thanks"]


def test_positions_of_moves_need_no_order(spark):
    words = tape(spark, ["goal", "x", "goal"])
    moves = spark.createDataFrame([("T", 1001)], "ticker string, t_event bigint")
    vocab = spark.createDataFrame([("M", "goal")], "market_ticker string, phrase string")
    near = reprice.mentions_near(moves, words, phrases.measured_matches(words, vocab))
    assert "Window" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.word_idx for r in near.collect()) == [0, 2]


def test_occasions_share_the_reaction_of_a_second(spark, monkeypatch):
    stored, real = {}, reprice.materialize
    monkeypatch.setattr(reprice, "materialize", lambda df, name: stored.setdefault(name, real(df, name)))
    events = spark.createDataFrame([(o, "M", 1000) for o in range(5)], "occasion_id bigint, market_ticker string, t_word bigint")
    ticks = spark.createDataFrame([("M", 700, 1, 0.2, 0.22, 5.0, 5.0)], "ticker string, recv_utc bigint, seq bigint, yes_bid double, yes_ask double, depth_bid double, depth_ask double")
    assert reprice.measure(events, reprice.prepare(ticks)).count() == 5
    assert stored["moments"].count() == 1


def test_clocks_meet_documents(spark):
    """The clocks of word_frame are joined to documents; their words, many more bytes, meet no join."""
    from tapeline.plans import word_queries

    plan = word_queries.word_frame(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("Generate posexplode") < plan.index("Join Inner")
    words = spark.createDataFrame([(1, 0, "a", 400, 750), (1, 1, "b", 1500, 2500), (2, 0, "c", 0, 350)], "occasion_id long, word_idx long, word string, t_start_ms long, t_end_ms long")
    clocks = spark.createDataFrame([(1, 100), (2, None)], "occasion_id long, video_start_utc long")
    assert [tuple(r) for r in align.to_utc_transcript(words, clocks, "s").orderBy("word_idx").collect()] == [
        (1, 0, "a", 100, 101, "s", None), (1, 1, "b", 102, 102, "s", None)]

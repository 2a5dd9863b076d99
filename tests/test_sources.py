"""Contracts, tables, records, payload shapes and pages."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from __spark_entry__ import queries
from tapeline import schemas
from tapeline.operators import occasions, universe
from tapeline.sources import captions, pages, payloads, records, tables
from tapeline.streaming.book import levels


def candle_rows(spark, rows):
    n = len(schemas.CANDLES.columns)
    return spark.createDataFrame([r + (None,) * (n - len(r)) for r in rows], schemas.CANDLES.schema)


def test_contract_counts_every_broken_rule(spark):
    good = candle_rows(spark, [("A", 60, 1, 0.4), ("A", 120, 1, float("nan"))])
    assert schemas.CANDLES.validate(good).filter("yes_bid_open is null").count() == 1
    bad = candle_rows(spark, [("A", 60, 1, 0.4), ("A", 60, 1, 1.4), (None, -1, 7, 0.1)])
    assert schemas.CANDLES.violations(schemas.CANDLES.conform(bad)) == {
        "ticker": 1, "ts": 1, "period_minutes": 1, "yes_bid_open": 1, "repeated ticker, ts, period_minutes": 1}
    with pytest.raises(schemas.ContractError):
        schemas.CANDLES.validate(bad)
    with pytest.raises(schemas.ContractError, match="missing"):
        schemas.CANDLES.validate(good.drop("ts"))


def test_forced_words_fit_the_live_contract_only(spark):
    row = spark.createDataFrame([("o", 0, "w", 1, 2, "live", -1.0)], schemas.TRANSCRIPT.schema)
    assert schemas.LIVE_TRANSCRIPT.validate(row).count() == 1
    with pytest.raises(schemas.ContractError):
        schemas.TRANSCRIPT.validate(row)


def test_order_and_one_to_one_guards(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    schemas.require_columns(df, ["a", "b"])
    with pytest.raises(schemas.ContractError):
        schemas.require_columns(df, ["b", "a"])
    schemas.require_one_to_one(df, df, "a")
    with pytest.raises(schemas.ContractError, match="right"):
        schemas.require_one_to_one(df, df.union(df), "a")


def test_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "candles")
    assert tables.load_table(spark, path, schemas.CANDLES).count() == 0
    tables.save_table(candle_rows(spark, [("A", 60, 1, 0.4)]), path, schemas.CANDLES)
    assert tables.load_table(spark, path, schemas.CANDLES).first().yes_bid_open == 0.4
    with pytest.raises(Exception):
        tables.load_table(spark, str(tmp_path / "none"), schemas.CANDLES, must_exist=True)
    tables.save_bars(candle_rows(spark, [("A", 60, 1, 0.4)]), str(tmp_path / "bars"), schemas.CANDLES)
    assert (tmp_path / "bars" / "period_minutes=1" / "day=1970-01-01").exists()


def test_a_bad_table_does_not_replace_a_good_one(spark, tmp_path):
    path = str(tmp_path / "bars")
    for bad, rule in (([("A", 60, 1, 1.4), ("B", 60, 1, None)], "yes_bid_open"), ([("A", 60, 1, 0.4)] * 2 + [("B", 60, 1, 0.4)], "repeated")):
        tables.save_table(candle_rows(spark, [("A", 60, 1, 0.5)]), path, schemas.CANDLES)
        with pytest.raises(schemas.ContractError, match=rule):
            tables.save_table(candle_rows(spark, bad), path, schemas.CANDLES)
        assert [r.yes_bid_open for r in tables.load_table(spark, path, schemas.CANDLES).collect()] == [0.5]
        with pytest.raises(schemas.ContractError):
            tables.save_bars(candle_rows(spark, bad), str(tmp_path / "days"), schemas.CANDLES)
    assert [x.name for x in tmp_path.iterdir()] == ["bars"]  # nothing is left beside it
    tables.save_table(candle_rows(spark, []), path, schemas.CANDLES)
    assert tables.load_table(spark, path, schemas.CANDLES).count() == 0


def test_a_checked_save_computes_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = candle_rows(spark, [("A", 60 * i, 1, 0.4) for i in range(20)])
    tables.save_table(rows.mapInArrow(touch, rows.schema), str(tmp_path / "bars"), schemas.CANDLES)
    assert seen.value == 20


def test_tape_appends_and_transcripts_replace_one_occasion(spark, tmp_path):
    ticks, words = str(tmp_path / "ticks"), str(tmp_path / "words")
    row = lambda o, s: spark.createDataFrame([(o, "A", 1, s, *[0.5] * 8)], "occasion_id string, " + ", ".join(
        f"{f.name} {f.type}" for f in schemas.TICKS.fields))
    tables.append_ticks(row("x", 1), ticks)
    tables.append_ticks(row("x", 2), ticks)
    assert spark.read.parquet(ticks).count() == 2
    stream = spark.readStream.schema(row("x", 1).schema).parquet(ticks + "/occasion_id=x").withColumn("occasion_id", F.lit("y"))
    names = ["occasion_id", *schemas.TICKS.columns]
    tables.stream_ticks(stream.select(*names), str(tmp_path / "tape"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "tape")).filter("occasion_id = 'y'").count() == 2
    with pytest.raises(schemas.ContractError):
        tables.append_ticks(row("x", 1).drop("depth_ask2"), ticks)
    w = lambda o, t: spark.createDataFrame([(o, 0, t, 1, 2, "s", None)], schemas.TRANSCRIPT.schema)
    tables.write_transcript(w("x", "old").union(w("y", "keep")), words, schemas.TRANSCRIPT)
    tables.write_transcript(w("x", "new"), words, schemas.TRANSCRIPT)
    assert sorted(r.word for r in tables.load_transcript(spark, words, schemas.TRANSCRIPT).collect()) == ["keep", "new"]
    assert tables.load_transcript(spark, words, schemas.TRANSCRIPT, "x").first().word == "new"


RAW = {
    "market": {"ticker": "KXQ-26JUL04-A", "yes_sub_title": "Oil / Gas", "rules_primary": "If Ann Li says Oil\n as part of the Speech, then the market resolves to Yes.",
               "rules_secondary": "Video is primarily used; a plural or possessive form counts", "close_time": "2026-07-05T00:00:00Z", "volume_fp": "x"},
    "event": {"event_ticker": "KXQ-26JUL04", "series_title": "Li Mention", "settlement_sources": [{"name": " Post "}, {"name": ""}]},
}


def test_registry_columns_carry_no_records(spark, tmp_path):
    """A few columns of the registry are those of the whole one; no rule text goes through an aggregate for them."""
    def record(sighting, ticker, rules, **more):
        return {"sighting": sighting, "market": {**RAW["market"], "ticker": ticker, "rules_primary": rules, **more}, "event": RAW["event"]}

    rules = RAW["market"]["rules_primary"]
    rows = [record(1, "A", "later"), record(0, "A", rules, result="yes"), record(0, "B", "other"), record(0, "C", rules, mve_collection_ticker="M"),
            record(1, "C", rules), record(0, "", rules), record(0, None, rules), record(2, "D", rules, result="no")]
    raw = spark.createDataFrame([(json.dumps(r),) for r in rows], "body string").select(
        F.from_json("body", T.StructType([T.StructField("sighting", T.LongType()), *universe.RAW_SCHEMA.fields])).alias("r")).select("r.*")
    kept = universe.without_parlays(raw, ["sighting"])
    whole = universe.build_registry(universe.catalog(kept), universe.resolutions(kept))
    for columns in (["market_ticker"], ["format", "eligible", "result", "speaker"], ["market_ticker", "governing_sources", "n_candles"], universe.REVIEW_COLUMNS):
        got = universe.registry_columns(raw, ["sighting"], columns)
        assert got.columns == columns
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*columns).collect())), columns
    for name in ("market_filters", "profile_counts"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        aggregates = [line for line in plan.splitlines() if "Aggregate [" in line]
        assert aggregates and not [line for line in aggregates if "rules_primary" in line or "market#" in line], name


def test_records_to_registry_and_review(spark, tmp_path):
    raw_path = tmp_path / "raw.jsonl"
    nqe = {"market": {"ticker": "KXQ-B", "yes_sub_title": "Event does not qualify", "rules_primary": "x"}, "event": {"event_ticker": "E"}}
    raw_path.write_text("\n" + json.dumps(RAW) + "\n\n" + json.dumps(nqe) + "\n")
    raw = records.read_raw_records(spark, str(raw_path)).filter("market is not null")
    cat, res = universe.catalog(raw), universe.resolutions(raw)
    records.write_jsonl(res, str(tmp_path / "res"))
    res = records.read_resolutions(spark, str(tmp_path / "res"))
    reg = universe.build_registry(cat, res).select(*schemas.REGISTRY.columns)
    rows = {r.market_ticker: r for r in schemas.REGISTRY.validate(reg).collect()}
    a, b = rows["KXQ-26JUL04-A"], rows["KXQ-B"]
    assert (a.template, a.speaker, a.occasion, a.confidence, a.resolution_risk, a.eligible) == ("speech", "Ann Li", "the Speech", 0.9, "low", True)
    assert a.settlement_sources == "Post" and a.volume is None and a.series_ticker == "KXQ"
    assert a.notes == "template=speech; video/transcript-primary resolution → low approved-outlet-miss risk; plural/possessive accepted"
    assert b.is_nqe and not b.eligible and b.confidence == 0.95
    records.write_review_csv(reg, str(tmp_path / "review"))
    review = records.read_review_csv(spark, str(tmp_path / "review"))
    assert [r.market_ticker for r in review.collect()] == ["KXQ-26JUL04-A", "KXQ-B"]
    edited = review.select("market_ticker", F.when(F.col("market_ticker") == "KXQ-26JUL04-A", "high").alias("resolution_risk"), "notes")
    out = {r.market_ticker: r for r in universe.apply_review(reg, edited).collect()}
    assert not out["KXQ-26JUL04-A"].eligible and out["KXQ-B"].resolution_risk == "medium"


@pytest.mark.parametrize("rule,template,speaker,occasion,confidence", [
    ("If Ann or Bo says x at the Rally., then the market resolves to Yes.", "speech", "Ann or Bo", "the Rally", 0.8),
    ("If x is said by any Acme representative (op) during the next Acme earnings call (Q+A), then the market resolves to Yes", "earnings", "any Acme representative", "Acme earnings call", 0.9),
    ("If x, or a plural or possessive form of x, is stated by Bo before Jan 1., then the market resolves to Yes.", "duration", "Bo", "public statements before Jan 1", 0.85),
    ("If Bo speaks for 9 minutes at it, then the market resolves to Yes.", "length", "", "", 0.85),
    ("If Bo mentions the topic of x most as part of it, then the market resolves to Yes.", "superlative", "Bo", "it", 0.85),
    ("Whatever", "other", "", "", 0.4)])
def test_rule_templates(spark, rule, template, speaker, occasion, confidence):
    raw = spark.createDataFrame([(json.dumps({"market": {"ticker": "T", "yes_sub_title": "x", "rules_primary": rule}, "event": {}}),)], "b string")
    r = universe.resolutions(raw.select(F.from_json("b", universe.RAW_SCHEMA).alias("r")).select("r.*")).first()
    assert (r.template, r.speaker, r.occasion, r.confidence) == (template, speaker, occasion, confidence)


def test_captions(spark):
    body = {"events": [{"tStartMs": 1000, "segs": [{"utf8": ">> Hello "}, {"utf8": "world", "tOffsetMs": 500}, {"utf8": "[Applause]"}, {"utf8": "\n"}]},
                       {"segs": [{"utf8": "untimed"}]}, {"tStartMs": 500, "segs": [{"utf8": "First"}]}, {"tStartMs": 9000, "segs": [{"utf8": "late"}, {"utf8": "♪♪"}]}, {"tStartMs": 1}]}
    df = spark.createDataFrame([("v", json.dumps(body))], "video_id string, body string")
    got = [(r.word, r.t_start_ms, r.t_end_ms) for r in captions.caption_words(df).orderBy("t_start_ms").collect()]
    assert got == [("First", 500, 1000), ("Hello", 1000, 1500), ("world", 1500, 1800), ("late", 9000, 9300)]


def test_token_ids_in_either_form(spark):
    bodies = [json.dumps([{"id": "1", "clobTokenIds": '["y","n"]'}]), json.dumps({"markets": [{"id": "2", "clobTokenIds": ["a", "b"]}, {"id": "3"}]})]
    out = {r.id: r.yes_token_id for r in payloads.token_markets(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()}
    assert out == {"1": "y", "2": "a", "3": None}


def test_series_listing(spark):
    body = json.dumps({"series": [{"ticker": "KX", "title": "T", "category": "Mentions", "fee_type": "quadratic"}]})
    assert payloads.series_rows(spark.createDataFrame([(body,)], "body string")).first().fee_type == "quadratic"


def test_levels_skip_malformed_pairs(spark):
    raw = [["0.08", "5"], ["8", "3"], ["0.5", "0"], ["x", "1"], ["0.2"], ["0.08", "9"]]
    df = spark.createDataFrame([(raw,)], "r array<array<string>>")
    assert [tuple(x) for x in df.select(levels(F.col("r"))).first()[0]] == [(0.08, 9.0)]


PAGE = """<html><head><title>t</title><script>no()</script></head><body><nav>menu</nav><h1>A <b>Title</b></h1>
<p class="speaker">Gov. Li</p><p class='article__time'>February 17, 2026</p>
<main><p>short</p></main><div id="article"><p>One &amp; two<br>three<form>skip</form></p><li>four<li>five</div><footer>end</footer></body></html>"""


def test_main_text_takes_the_longest_container(spark):
    df = spark.createDataFrame([(1, "u/speech/li20260218a.htm", PAGE), (2, "u", "<p>plain <b>body</b></p>"), (3, "u", "")], "page_id bigint, url string, html string")
    out = {r.page_id: r for r in pages.main_text(df).collect()}
    assert (out[1].title, out[1].body, out[1].speaker, out[1].time_text) == ("ATitle", "One & two three four five", "Gov. Li", "February 17, 2026")
    assert out[2].body == "plain body" and out[3].body == ""
    rows = pages.transcript_rows(pages.main_text(df), "src", "nobody", F.regexp_extract("url", r"(\d{8})", 1), min_words=3).collect()
    assert [(r.speaker, r.date_ts, r.n_words) for r in rows] == [("Gov. Li", 1771286400, 6)]
    assert pages.corpus_of(spark, [type("S", (), {"load": staticmethod(lambda s: pages.transcript_rows(pages.main_text(df), "src", "nobody", F.lit("20260101"), 2))})()]).count() == 2


def test_statement_rows(spark):
    df = spark.createDataFrame([("h/newsevents/pressreleases/monetary20260128a.htm", "", " ".join(["w"] * 60))], "url string, title string, body string")
    r = pages.statement_rows(df, "src", "the Chair").first()
    assert (r.occasion, r.date_ts, r.n_words) == ("FOMC statement — January 2026", 1769558400, 60)


def test_pinned_video_falls_back_to_now(spark):
    df = spark.createDataFrame([("a", True, None), ("b", False, None), ("c", False, 50)], "video_id string, is_live boolean, release_ts bigint")
    assert sorted((r.video_id, r.start_ts) for r in occasions.resolve_pinned(df, 900).collect()) == [("a", 900), ("c", 50)]
    assert [r.video_id for r in occasions.resolve_pinned(df, 900, 100).collect()] == ["a"]


def test_transcripts_share_folders(spark, tmp_path):
    """The folders of a table don't grow with its occasions; those left out of a later write stay."""
    path = str(tmp_path / "many")
    rows = lambda ids, word: spark.createDataFrame([(str(i), 0, word, 1, 2, "s", None) for i in ids], schemas.TRANSCRIPT.schema)
    tables.write_transcript(rows(range(300), "old"), path, schemas.TRANSCRIPT)
    tables.write_transcript(rows(range(0, 300, 3), "new"), path, schemas.TRANSCRIPT)
    assert len([p for p in (tmp_path / "many").iterdir() if p.is_dir()]) <= tables.BUCKETS
    got = {r.occasion_id: r.word for r in tables.load_transcript(spark, path, schemas.TRANSCRIPT).collect()}
    assert got == {str(i): "new" if i % 3 == 0 else "old" for i in range(300)}
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("many")] == ["many"]


def test_transcripts_take_no_shuffle_of_words(spark, tmp_path):
    """Of words made of dealt-out documents none is shuffled, nor any that a later write keeps; a folder can be new."""
    from tapeline.plans import views

    docs = spark.createDataFrame([(i, "en", "some words of one occasion " * 200) for i in range(40)], "doc_id bigint, lang string, text string")
    w = views.words_of(tables.dealt_by_occasion(docs, F.col("doc_id"))).select(*schemas.TRANSCRIPT.columns)
    path, tracker = str(tmp_path / "dealt"), spark.sparkContext._jsc.sc().statusStore()
    rows = lambda: sum(s.shuffleWriteRecords() for s in (lambda l: [l.apply(i) for i in range(l.size())])(tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    before = rows()
    tables.write_transcript(w.where("occasion_id < 30"), path, schemas.TRANSCRIPT, dealt=True)
    tables.write_transcript(w.where("occasion_id >= 20").withColumn("word", F.lit("new")), path, schemas.TRANSCRIPT, dealt=True)
    assert rows() - before < 2000
    got = tables.load_transcript(spark, path, schemas.TRANSCRIPT).groupBy("occasion_id").agg(F.count("*").alias("n"), F.max("word").alias("w")).collect()
    assert {(r.occasion_id, r.n, r.w) for r in got} == {(str(i), 1000, "new" if i >= 20 else "words") for i in range(40)}


def test_tasks_grow_with_the_rows(spark):
    rows = spark.range(0, 100_000, numPartitions=1)
    assert tables.spread(rows, 1000).rdd.getNumPartitions() == 100


def test_captions_are_numbered_in_order_of_time(spark):
    body = {"events": [{"tStartMs": 900, "segs": [{"utf8": " >> two "}, {"utf8": " (aside) "}]}, {"tStartMs": 100, "segs": [{"utf8": ">>> one"}, {"utf8": "　[x]\n"}]}]}
    df = spark.createDataFrame([("v", json.dumps(body))], "video_id string, body string")
    got = [(r.word_idx, r.word) for r in captions.caption_words(df).orderBy("word_idx").collect()]
    assert got == [(0, "one"), (1, ">> two")]

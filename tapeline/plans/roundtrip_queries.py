"""Tables, tapes and records written to the shared folder and read back; contracts counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline import schemas
from tapeline.operators import calibrate, phrases, universe
from tapeline.plans import market_queries, replay_queries, views
from tapeline.plans.catalog import query
from tapeline.plans.sqlviews import sql
from tapeline.session import materialize, shared_dir
from tapeline.sources import pages, records, tables


def _bars(spark, sf_dir):
    """The bar view with every column of its contract."""
    bars = views.candles(spark, sf_dir)
    return bars.select(*[F.col(c) if c in bars.columns else F.lit(None).cast("double").alias(c) for c in schemas.CANDLES.columns])


@query("bars_table", sql("SELECT ticker, ts, period_minutes, yes_bid_close, yes_ask_close, price_low, price_high, price_close, volume FROM candles", "candles"))
def bars_table(spark, sf_dir):
    path = tables.save_table(_bars(spark, sf_dir), shared_dir(spark, "bars"), schemas.CANDLES)
    return tables.load_table(spark, path, schemas.CANDLES, must_exist=True).select(
        "ticker", "ts", "period_minutes", "yes_bid_close", "yes_ask_close", "price_low", "price_high", "price_close", "volume")


@query("bars_by_day", sql("SELECT ticker, ts, yes_bid_close, volume FROM candles", "candles"))
def bars_by_day(spark, sf_dir):
    path = tables.save_bars(_bars(spark, sf_dir), shared_dir(spark, "days"), schemas.CANDLES)
    return spark.read.parquet(path).where("period_minutes = 1440").select("ticker", "ts", "yes_bid_close", "volume")


@query("replay_table", sql("SELECT * FROM replayed", "predictions", "candles", "registry", **replay_queries._replay_ctes("test")))
def replay_table(spark, sf_dir):
    """The replay's rows, checked by their contract while they are written."""
    path = tables.save_table(replay_queries.replay_test(spark, sf_dir), shared_dir(spark, "replay"), schemas.REPLAY)
    return tables.load_table(spark, path, schemas.REPLAY, must_exist=True, check=False)


@query("registry_table", sql("SELECT * EXCLUDE (rules_primary) FROM registry_", "registry_"))
def registry_table(spark, sf_dir):
    path = tables.save_table(market_queries._registry(spark, sf_dir), shared_dir(spark, "registry"), schemas.REGISTRY)
    return tables.load_table(spark, path, schemas.REGISTRY, must_exist=True, check=False).drop("rules_primary")


@query("missing_table", sql("SELECT ticker, ts, period_minutes, yes_bid_close, yes_ask_close, volume, false AS late FROM candles", "candles"))
def missing_table(spark, sf_dir):
    """The bars beside those of a table that nobody has written yet: it adds its columns and no rows."""
    path = tables.save_table(_bars(spark, sf_dir), shared_dir(spark, "bars"), schemas.CANDLES)
    found = tables.load_table(spark, path, schemas.CANDLES, must_exist=True).withColumn("late", F.lit(False))
    none = tables.load_table(spark, shared_dir(spark, "none"), schemas.CANDLES).withColumn("late", F.lit(True))
    return found.unionByName(none).select("ticker", "ts", "period_minutes", "yes_bid_close", "yes_ask_close", "volume", "late")


@query("tape_append", sql("SELECT CASE WHEN seq % 5 = 0 THEN 'late' ELSE 'main' END AS occasion_id, * FROM ticks", "ticks"))
def tape_append(spark, sf_dir):
    ticks = views.ticks(spark, sf_dir)
    rows = ticks.select(F.when(F.col("seq") % 5 == 0, "late").otherwise("main").alias("occasion_id"), *[
        F.col(c) if c in ticks.columns else F.lit(None).cast("double").alias(c) for c in schemas.TICKS.columns])
    path = shared_dir(spark, "tape")
    for part in (0, 1, 2):
        tables.append_ticks(rows.where(F.col("seq") % 3 == part), path)
    return spark.read.parquet(path).select("occasion_id", *ticks.columns)


@query("transcript_replace", sql("""
    SELECT occasion_id, word_idx, CASE WHEN occasion_id % 3 = 0 THEN word || '!' ELSE word END AS word, t_start_utc FROM words""", "words"))
def transcript_replace(spark, sf_dir):
    """All words of all occasions, then a third of the occasions again, whole and changed."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # a document's words go to one folder, so the texts are dealt out instead of the words
    w = views.words_of(tables.dealt_by_occasion(docs, F.col("doc_id"))).select(*[F.col(c) for c in schemas.TRANSCRIPT.columns])
    path = shared_dir(spark, "transcripts")
    tables.write_transcript(w, path, schemas.TRANSCRIPT, dealt=True)
    tables.write_transcript(w.where(F.col("occasion_id") % 3 == 0).withColumn("word", F.concat("word", F.lit("!"))), path, schemas.TRANSCRIPT, dealt=True)
    rows = tables.load_transcript(spark, path, schemas.LIVE_TRANSCRIPT)
    return rows.select(F.col("occasion_id").cast("bigint").alias("occasion_id"), "word_idx", "word", "t_start_utc")


@query("raw_jsonl", sql("SELECT market_ticker, event_ticker, status, volume FROM catalog_", "catalog_"))
def raw_jsonl(spark, sf_dir):
    path = records.write_jsonl(market_queries._kept(spark, sf_dir).drop("sighting"), shared_dir(spark, "raw"))
    return universe.catalog(records.read_raw_records(spark, path)).select("market_ticker", "event_ticker", "status", "volume")


@query("resolutions_jsonl", sql("SELECT market_ticker, template, phrase, resolution_risk, confidence, is_nqe FROM registry_", "registry_"))
def resolutions_jsonl(spark, sf_dir):
    path = records.write_jsonl(market_queries._registry(spark, sf_dir).withColumn("governing_sources", F.split("governing_sources", r"\|")).withColumn(
        "series", F.col("series_ticker")), shared_dir(spark, "resolutions"))
    return records.read_resolutions(spark, path).select("market_ticker", "template", "phrase", "resolution_risk", "confidence", "is_nqe")


@query("review_csv", sql("SELECT market_ticker, confidence, resolution_risk, nullif(left(rules_primary, 60), '') AS rules_primary FROM registry_", "registry_"))
def review_csv(spark, sf_dir):
    path = records.write_review_csv(market_queries._registry(spark, sf_dir), shared_dir(spark, "review"), rule_chars=60)
    return records.read_review_csv(spark, path).select("market_ticker", "confidence", "resolution_risk", "rules_primary")


@query("contract_counts", sql("""
    SELECT 'price_low' AS rule, count(*) FILTER (price_low - 0.2 < 0) AS n FROM candles UNION ALL
    SELECT 'period_minutes', count(*) FILTER (volume > 2) FROM candles UNION ALL
    SELECT 'repeated ticker, ts, period_minutes', count(*) FROM (SELECT 1 FROM candles GROUP BY ticker, ts // 604800 HAVING count(*) > 1)""", "candles"))
def contract_counts(spark, sf_dir):
    """Broken prices, periods and keys, as the contract counts them in a table made to break it."""
    week = _bars(spark, sf_dir).withColumn("ts", F.floor(F.col("ts") / 604_800) * 604_800)
    broken = _bars(spark, sf_dir).withColumn("price_low", F.col("price_low") - 0.2).withColumn("period_minutes", F.when(F.col("volume") > 2, 7).otherwise(1440))
    found = schemas.CANDLES.violations(schemas.CANDLES.conform(broken)) | schemas.CANDLES.violations(schemas.CANDLES.conform(week))
    return spark.createDataFrame([(r, found.get(r, 0)) for r in ("price_low", "period_minutes", "repeated ticker, ts, period_minutes")], "rule string, n bigint")


@query("said_by_hook", sql("""
    SELECT occasion_id, series_key, min(t_end_utc) AS said FROM words, (SELECT unnest(['the', 'of']) AS series_key)
    WHERE word = series_key GROUP BY ALL""", "words"))
def said_by_hook(spark, sf_dir):
    """A caller's own anchor function: the first whole word equal to the anchor."""
    w = views.words(spark, sf_dir).select("occasion_id", "word_idx", "word", "t_end_utc")
    keys = ("the", "of")
    anchors = materialize(w.select("occasion_id").distinct().withColumn("series_key", F.explode(F.array(*[F.lit(k) for k in keys]))), "anchors")

    def first(key):
        def said(pdf):
            hit = pdf.loc[pdf["word"] == key, "t_end_utc"]
            return int(hit.min()) if len(hit) else None

        return said

    return phrases.said_time_by(w, anchors, {k: first(k) for k in keys})


class _Documents:
    """Documents of one language as a corpus source."""

    def __init__(self, sf_dir: str, lang: str | None):
        self.sf_dir, self.lang = sf_dir, lang

    def load(self, spark):
        d = views.table(spark, self.sf_dir, "documents").where(F.col("lang").eqNullSafe(self.lang))
        return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("speaker"), F.lit("speech").alias("format"), F.lit(None).cast("string").alias("occasion"),
                        F.col("doc_id").alias("date_ts"), F.lit(self.lang).alias("source"), F.lit(None).cast("string").alias("url"), F.col("n_chars").alias("n_words"), "text")


@query("corpus_sources", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS speaker, lang AS source, text FROM documents")
def corpus_sources(spark, sf_dir):
    """One source for each language there is."""
    langs = [r.lang for r in views.table(spark, sf_dir, "documents").select("lang").distinct().orderBy("lang").collect()]
    return pages.corpus_of(spark, [_Documents(sf_dir, lang) for lang in langs]).select("doc_id", "speaker", "source", "text")


@query("time_split_rank", sql("""
    SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY t, doc_id) <= round(count(*) OVER () * 0.6) THEN 'train' ELSE 'test' END AS split
    FROM (SELECT doc_id, CASE WHEN doc_id % 10 < 3 THEN ts ELSE 4000000000 END AS t FROM scores)""", "scores"))
def time_split_rank(spark, sf_dir):
    """Most rows share the last time, so the split is by rank."""
    rows = views.scores(spark, sf_dir).withColumn("ts", F.when(F.col("doc_id") % 10 < 3, F.col("ts")).otherwise(F.lit(4_000_000_000)))
    return calibrate.time_split(rows, "ts", ["doc_id"]).select("doc_id", "split")

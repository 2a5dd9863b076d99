"""Queries over landed payloads, built as text from the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import align, occasions, transcripts, universe
from tapeline.plans import views
from tapeline.plans.catalog import query
from tapeline.plans.sqlviews import sql
from tapeline.sources import captions, pages, payloads, records


def _money(c):
    return F.format_string("%.2f", c)


def _ohlc(name, suffix, low, high, close):
    return F.struct(*[_money(c).alias(f"{p}{suffix}") for p, c in (("open", low), ("high", high), ("low", low), ("close", close))]).alias(name)


def _candle_payloads(spark, sf_dir, suffix, volume_key):
    c = views.candles(spark, sf_dir)
    bar = F.struct(
        F.col("ts").alias("end_period_ts"),
        _ohlc("yes_bid", suffix, F.col("yes_bid_close"), F.col("yes_bid_close"), F.col("yes_bid_close")),
        F.struct(F.when(F.col("volume") > 3, _money(F.col("yes_ask_close"))).otherwise("n/a").alias(f"close{suffix}")).alias("yes_ask"),
        _ohlc("price", suffix, F.col("price_low"), F.col("price_high"), F.col("price_close")),
        F.col("volume").cast("string").alias(volume_key))
    return c, bar


_BAR_SQL = """SELECT ticker, ts, yes_bid_close AS yes_bid_open, yes_bid_close AS yes_bid_high, yes_bid_close AS yes_bid_low, yes_bid_close,
    CAST(NULL AS DOUBLE) AS yes_ask_open, CAST(NULL AS DOUBLE) AS yes_ask_high, CAST(NULL AS DOUBLE) AS yes_ask_low,
    CASE WHEN volume > 3 THEN yes_ask_close END AS yes_ask_close, price_low AS price_open, price_high, price_low, price_close, CAST(NULL AS DOUBLE) AS price_mean,
    volume, CAST(NULL AS DOUBLE) AS open_interest, 1440 AS period_minutes FROM candles"""


@query("candle_json", sql(_BAR_SQL, "candles"))
def candle_json(spark, sf_dir):
    c, bar = _candle_payloads(spark, sf_dir, "_dollars", "volume_fp")
    body = F.to_json(F.struct(F.array(F.struct(F.col("ticker").alias("market_ticker"), F.array(bar).alias("candlesticks"))).alias("markets")))
    return payloads.candle_rows(c.select(body.alias("body")), 1440)


@query("candle_json_plain", sql(_BAR_SQL, "candles"))
def candle_json_plain(spark, sf_dir):
    c, bar = _candle_payloads(spark, sf_dir, "", "volume")
    return payloads.market_candle_rows(c.select("ticker", F.to_json(F.struct(F.array(bar).alias("candlesticks"))).alias("body")), 1440)


@query("event_markets", sql("""
    SELECT ticker AS market_ticker, event_ticker, 'listed' AS series_ticker, series_title || '!' AS series_title, len(list_filter(sources, lambda x: true)) AS n_sources, sighting
    FROM raw WHERE NOT parlay UNION ALL
    SELECT NULL, event_ticker, 'listed', series_title || '!', len(sources), sighting FROM raw WHERE parlay""", "raw"))
def event_markets(spark, sf_dir):
    raw = views.raw_records(spark, sf_dir).select("p_partkey", "sighting", F.from_json("body", universe.RAW_SCHEMA).alias("r"))
    # events of parlay legs are listed without markets
    ms = F.when(F.col("r.market.mve_collection_ticker").isNull(), F.array("r.market"))
    event = F.col("r.event").dropFields("series_ticker", "series_title").withField("markets", ms)
    pages_ = raw.select("sighting", F.lit("listed").alias("series_ticker"), F.concat("r.event.series_title", F.lit("!")).alias("series_title"),
                        F.to_json(F.struct(F.array(event).alias("events"))).alias("body"))
    return payloads.event_markets(pages_).select(
        F.col("market.ticker").alias("market_ticker"), "event.event_ticker", "event.series_ticker", "event.series_title",
        F.size(F.filter(F.col("event.settlement_sources"), lambda s: F.trim(s["name"]) != "")).cast("bigint").alias("n_sources"), "sighting")


@query("venue_prices", sql("""
    SELECT ticker AS token_id, ts, price_close AS p, price_close / 2.0 AS mid, ticker || '-yes' AS yes_token_id FROM candles""", "candles"))
def venue_prices(spark, sf_dir):
    c = views.candles(spark, sf_dir)
    point = F.struct(F.col("ts").alias("t"), F.col("price_close").alias("p"))
    history = payloads.price_history(c.select(F.col("ticker").alias("token_id"), F.to_json(F.struct(F.array(point).alias("history"))).alias("body")))
    key = F.concat_ws("@", "ticker", "ts")
    mids = payloads.midpoints(c.select(key.alias("token_id"), F.to_json(F.struct((F.col("price_close") / 2.0).cast("string").alias("mid"))).alias("body")))
    ids = F.to_json(F.array(F.concat("ticker", F.lit("-yes")), F.concat("ticker", F.lit("-no"))))
    item = F.array(F.struct(key.alias("id"), F.lit("q").alias("question"), ids.alias("clobTokenIds")))
    page = F.when(F.col("volume") > 3, F.to_json(item)).otherwise(F.to_json(F.struct(item.alias("markets"))))
    markets = payloads.token_markets(c.select(page.alias("body"))).select("id", "yes_token_id")
    return (
        history.withColumn("id", F.concat_ws("@", "token_id", "ts"))
        .join(mids.withColumnRenamed("token_id", "id"), "id").join(markets, "id").drop("id"))


@query("news_rows", sql("""
    SELECT left(sha1(ts || '|' || source || '|' || title), 16) AS headline_id, ts, source, title AS text
    FROM (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, CASE WHEN event_id % 4 = 0 THEN 'gdelt' ELSE event_type || '.example' END AS source,
                 CASE WHEN event_id % 9 <> 0 THEN 'News ' || event_id END AS title FROM events WHERE event_id % 7 <> 0)
    WHERE title IS NOT NULL"""))
def news_rows(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    eid = F.col("event_id")
    seen = F.when(eid % 7 == 0, "yesterday").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'"))
    article = F.struct(seen.alias("seendate"), F.when(eid % 9 == 0, "  ").otherwise(F.concat(F.lit(" News "), eid)).alias("title"),
                       F.when(eid % 4 != 0, F.concat("event_type", F.lit(".example"))).alias("domain"))
    return payloads.headline_rows(e.select(F.to_json(F.struct(F.array(article).alias("articles"))).alias("body")))


def quote_payloads(spark, sf_dir):
    t = views.ticks(spark, sf_dir)
    m = F.struct(F.col("ticker"), _money(F.col("yes_bid")).alias("yes_bid_dollars"), F.coalesce(_money(F.col("yes_ask")), F.lit("")).alias("yes_ask_dollars"),
                 F.col("depth_bid").cast("string").alias("yes_bid_size_fp"), F.col("depth_ask").cast("string").alias("yes_ask_size_fp"))
    return t.select(F.col("recv_utc").alias("poll_utc"), F.to_json(F.struct(F.array(m).alias("markets"))).alias("body"))


@query("quote_poll", sql("SELECT ticker, recv_utc, recv_utc AS seq, yes_bid, yes_ask, depth_bid, depth_ask FROM ticks", "ticks"))
def quote_poll(spark, sf_dir):
    # a missing ask prints as "null", which is no number
    return payloads.quote_ticks(quote_payloads(spark, sf_dir))


_CAPTIONS = """
    SELECT doc_id AS video_id, i * 400 + i // 50 * 5000 AS t_start_ms, w AS word
    FROM (SELECT doc_id, unnest(ws) AS w, CAST(unnest(range(len(ws))) AS BIGINT) AS i
          FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda t: t <> '') AS ws FROM documents))
    WHERE i % 7 = 0 OR NOT regexp_matches(w, '^(\\[[^\\]]*\\]|>>+|\\(.*\\))$')"""


@query("captions_json", sql("""
    SELECT video_id, word, t_start_ms, CASE WHEN nxt - t_start_ms BETWEEN 1 AND 4000 THEN nxt ELSE t_start_ms + 300 END AS t_end_ms
    FROM (SELECT *, lead(t_start_ms) OVER (PARTITION BY video_id ORDER BY t_start_ms) AS nxt
          FROM (SELECT video_id, t_start_ms, regexp_replace(word, '^>>+', '') AS word FROM caps) WHERE word <> '')""", caps=_CAPTIONS))
def captions_json(spark, sf_dir):
    return _caption_words(spark, sf_dir).drop("word_idx")


def _caption_words(spark, sf_dir):
    words = F.filter(F.split("text", views.WORD_SPLIT), lambda t: t != "")
    # two segments per event: a word after a speaker caret, and a cue that is no word
    events = F.transform(words, lambda w, i: F.struct(
        (i * 400 + F.floor(i / 50) * 5000 - 10).cast("bigint").alias("tStartMs"),
        F.array(F.struct(F.concat(F.when(i % 7 == 0, ">> ").otherwise(""), w, F.lit(" ")).alias("utf8"), F.lit(10).alias("tOffsetMs")),
                F.struct(F.lit("[Music]").alias("utf8"), F.lit(30).alias("tOffsetMs"))).alias("segs")))
    docs = views.documents(spark, sf_dir).select(F.col("doc_id").alias("video_id"), F.to_json(F.struct(events.alias("events"))).alias("body"))
    return captions.caption_words(docs).drop("ev", "seg")


@query("asr_words", sql("""
    SELECT occasion_id, count(*) AS n, CAST(sum(t_start_ms) AS BIGINT) AS starts, CAST(sum(t_end_ms) AS BIGINT) AS ends
    FROM (SELECT occasion_id, word_idx * 400 + 25 AS t_start_ms, word_idx * 400 + 375 AS t_end_ms FROM words WHERE word_idx % 11 <> 0) GROUP BY occasion_id""", "words"))
def asr_words(spark, sf_dir):
    i = F.col("word_idx")
    rows = views.words(spark, sf_dir).select("occasion_id", F.when(i % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "word")).alias("word"),
                                             ((i * 400 + 25) / 1000.0 + 0.0001).alias("t_start"), ((i * 400 + 375) / 1000.0 + 0.0001).alias("t_end"))
    return captions.recognized_words(rows).groupBy("occasion_id").agg(
        F.count("*").alias("n"), F.sum("t_start_ms").alias("starts"), F.sum("t_end_ms").alias("ends"))


@query("vocab_rows", sql("SELECT s_suppkey AS occasion_id, 'M' || s_suppkey AS market_ticker, s_name AS phrase FROM supplier WHERE s_nationkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'N' || s_suppkey, 'also ' || s_name FROM supplier"))
def vocab_rows(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier")
    first = F.struct(F.col("s_name").alias("phrase"), (F.col("s_nationkey") % 3 != 0).alias("eligible"))
    second = F.struct(F.concat(F.lit("also "), "s_name").alias("phrase"), F.lit(None).cast("boolean").alias("eligible"))
    body = F.to_json(F.create_map(F.concat(F.lit("M"), "s_suppkey"), first, F.concat(F.lit("N"), "s_suppkey"), second))
    return records.vocabulary_rows(s.select(F.col("s_suppkey").alias("occasion_id"), body.alias("body")))


@query("series_list", """
    SELECT 'KX' || s_suppkey AS ticker, s_name AS title, 'Mentions' AS category, CASE WHEN s_suppkey % 3 = 0 THEN 'quadratic' ELSE 'quadratic_with_maker_fees' END AS fee_type FROM supplier
    UNION ALL SELECT 'KY' || s_suppkey, s_name, NULL, CASE WHEN s_acctbal < 0 THEN 'flat' END FROM supplier""")
def series_list(spark, sf_dir):
    """Two series a payload; missing fields stay NULL."""
    s = views.table(spark, sf_dir, "supplier")

    def series(ticker, title, category, fee):
        return F.struct(F.concat(F.lit(ticker), "s_suppkey").alias("ticker"), F.col(title).alias("title"), category.alias("category"), fee.alias("fee_type"))

    fee = F.when(F.col("s_suppkey") % 3 == 0, "quadratic").otherwise("quadratic_with_maker_fees")
    both = F.array(series("KX", "s_name", F.lit("Mentions"), fee), series("KY", "s_name", F.lit(None).cast("string"), F.when(F.col("s_acctbal") < 0, "flat")))
    return payloads.series_rows(s.select(F.to_json(F.struct(both.alias("series"))).alias("body")))


@query("pinned_videos", """
    SELECT video_id, coalesce(release_ts, CASE WHEN is_live THEN 900000000 END) AS start_ts
    FROM (SELECT o_orderkey AS video_id, o_orderstatus = 'O' AS is_live, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) END AS release_ts FROM orders)
    WHERE coalesce(release_ts, CASE WHEN is_live THEN 900000000 END) >= 800000000""")
def pinned_videos(spark, sf_dir):
    """Every order as a pinned video; a third has no start of its own."""
    o = views.table(spark, sf_dir, "orders")
    release = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    pinned = o.select(F.col("o_orderkey").alias("video_id"), (F.col("o_orderstatus") == "O").alias("is_live"), F.when(F.col("o_orderkey") % 3 != 0, release).alias("release_ts"))
    return occasions.resolve_pinned(pinned, 900_000_000, 800_000_000).select("video_id", "start_ts")


# --- pages ----------------------------------------------------------------------------------------

@query("html_text")
def html_text(spark, sf_dir):
    return pages.main_text(views.spread(views.table(spark, sf_dir, "pages"))).select("page_id", "title", "body")


@query("page_rows")
def page_rows(spark, sf_dir):
    p = views.spread(views.table(spark, sf_dir, "pages"))
    dated = pages.main_text(p).withColumn("time_text", F.concat(F.lit("Posted May "), (F.col("page_id") % 31 + 1).cast("string"), F.lit(", 2023")))
    return pages.transcript_rows(dated, "pages", "unnamed official", F.regexp_extract("url", r"(\d{8})", 1))


@query("links", sql("""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="(/[A-Za-z]+)"', 1)) AS link FROM pages"""))
def links(spark, sf_dir):
    return pages.links(views.table(spark, sf_dir, "pages"), r'href="(/[A-Za-z]+)"')


def _index_pages(spark, sf_dir):
    """Index pages listing one statement and one speech per customer, some repeated."""
    c = views.table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") % 400)
    digits = F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), F.col("k").cast("int")), "yyyyMMdd")
    return c.select(F.concat(F.lit('<ul><li><a href="/newsevents/pressreleases/monetary'), digits, F.lit('a.htm">Statement</a> <a href="/newsevents/speech/powell'),
                             digits, F.lit('a.htm">Speech</a></ul>')).alias("html"))


_DIGITS = "strftime(DATE '2022-01-01' + CAST(c_custkey % 400 AS INTEGER), '%Y%m%d')"


@query("statement_links", f"SELECT DISTINCT '/newsevents/pressreleases/monetary' || {_DIGITS} || 'a.htm' AS path FROM customer")
def statement_links(spark, sf_dir):
    return pages.statement_links(_index_pages(spark, sf_dir))


@query("speech_links", f"SELECT DISTINCT '/newsevents/speech/powell' || {_DIGITS} || 'a.htm' AS path, 'powell' AS slug, {_DIGITS} AS digits FROM customer")
def speech_links(spark, sf_dir):
    return pages.speech_links(_index_pages(spark, sf_dir))


# --- streams and videos ---------------------------------------------------------------------------

def _video(k):
    return F.concat(F.lit("vid"), F.lpad(k.cast("string"), 8, "0"))


def _live_lines(spark, sf_dir):
    p = views.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    flag = F.when(k % 3 == 0, "True").otherwise("False")
    rel = F.when(k % 5 == 0, "NA").otherwise((F.lit(views.TAPE_T0) + k * 977 % 40_000).cast("string"))
    line = F.when(k % 17 == 0, "short\tline").otherwise(F.concat_ws("\t", F.when(k % 13 == 0, "NA").otherwise(_video(k)), flag, F.when(k % 4 == 0, "True").otherwise("False"),
                                                                      rel, F.lit("ch"), F.lit("a title"), F.lit("with tab")))
    return p.select(F.concat(F.lit("E"), k % 20).alias("event_ticker"), line.alias("line"))


_LIVE = """SELECT 'E' || (page_id % 20) AS event_ticker, 'vid' || lpad(CAST(page_id AS VARCHAR), 8, '0') AS video_id, 'a title' || chr(9) || 'with tab' AS title, 'ch' AS channel,
                  page_id % 3 = 0 AS is_live, page_id % 4 = 0 AS was_live, CASE WHEN page_id % 5 <> 0 THEN 1700000000 + page_id * 977 % 40000 END AS release_ts
           FROM pages WHERE page_id % 17 <> 0 AND page_id % 13 <> 0"""


@query("live_candidates", sql(_LIVE))
def live_candidates(spark, sf_dir):
    return captions.live_candidates(_live_lines(spark, sf_dir))


_PICK = f"""SELECT event_ticker, video_id, is_live, release_ts, 1700020000 AS occurrence_ts, known AS time_known
            FROM (SELECT *, CAST(substr(event_ticker, 2) AS INT) % 2 = 0 AS known FROM ({_LIVE}))
            WHERE NOT was_live AND release_ts IS NOT NULL AND abs(release_ts - 1700020000) <= CASE WHEN known THEN 21600 ELSE 57600 END
            QUALIFY row_number() OVER (PARTITION BY event_ticker ORDER BY is_live DESC, abs(release_ts - 1700020000), video_id) = 1"""


def _picked(spark, sf_dir):
    events = views.table(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("i")).distinct().select(
        F.concat(F.lit("E"), "i").alias("event_ticker"), F.lit(1_700_020_000).cast("bigint").alias("occurrence_ts"), (F.col("i") % 2 == 0).alias("time_known"))
    return occasions.pick_streams(captions.live_candidates(_live_lines(spark, sf_dir)), events)


@query("candidate_pick", sql(_PICK))
def candidate_pick(spark, sf_dir):
    return _picked(spark, sf_dir)


@query("resolved_times", sql(f"""
    SELECT event_ticker, video_id, is_live, release_ts, CASE WHEN time_known THEN occurrence_ts ELSE release_ts END AS occurrence_ts, true AS time_known
    FROM ({_PICK}) WHERE time_known OR (release_ts >= 1700015000 AND CASE WHEN is_live THEN 1700021000 - release_ts <= 2700 ELSE release_ts >= 1700021000 - 300 END)"""))
def resolved_times(spark, sf_dir):
    return occasions.resolve_times(_picked(spark, sf_dir), 1_700_021_000, 1_700_015_000)


@query("video_ranks", sql("""
    SELECT event_ticker, video_id, duration_s, release_ts, was_live,
           row_number() OVER (PARTITION BY event_ticker ORDER BY CASE WHEN was_live AND release_ts IS NOT NULL THEN 0 ELSE 1 END, abs(duration_s - 4500), video_id) AS rank
    FROM (SELECT 'E' || (page_id % 20) AS event_ticker, 'vid' || lpad(CAST(page_id AS VARCHAR), 8, '0') AS video_id, page_id * 131 % 20000 AS duration_s,
                 CASE WHEN page_id % 5 <> 0 THEN 1700000000 + page_id END AS release_ts, page_id % 4 = 0 AS was_live FROM pages WHERE page_id % 19 <> 0)
    WHERE duration_s >= 900 AND duration_s <= CASE WHEN was_live THEN 43200 ELSE 10800 END"""))
def video_ranks(spark, sf_dir):
    k = F.col("page_id")
    line = F.concat_ws("\t", _video(k), F.when(k % 19 == 0, "NA").otherwise((k * 131 % 20_000).cast("string")),
                       F.when(k % 5 == 0, "NA").otherwise((F.lit(views.TAPE_T0) + k).cast("string")), F.when(k % 4 == 0, "True").otherwise("False"), F.lit("ch"), F.lit("t"))
    lines = views.table(spark, sf_dir, "pages").select(F.concat(F.lit("E"), k % 20).alias("event_ticker"), line.alias("line"))
    return occasions.rank_videos(captions.video_candidates(lines), ["event_ticker"]).drop("title", "channel")


@query("linked_streams", sql("""
    SELECT 'E' || page_id AS event_ticker, CASE WHEN page_id % 2 = 0 THEN 'abcde' || lpad(CAST(page_id AS VARCHAR), 6, '0') END AS video_id,
           CASE WHEN page_id % 4 < 3 THEN 'Title ' || page_id END AS title FROM pages"""))
def linked_streams(spark, sf_dir):
    k = F.col("page_id")
    event = F.concat(F.lit("E"), k)
    link = F.concat(F.lit("https://youtu.be/abcde"), F.lpad(k.cast("string"), 6, "0"), F.lit("?t=3"))
    none = F.array().cast("array<string>")

    def milestone(title, related, url):
        return F.struct(title.alias("title"), related.alias("related_event_tickers"), none.alias("primary_event_tickers"), F.struct(url.alias("youtube_link")).alias("product_details"))

    # the first milestone is another event's; the second is linked by card or by its own list
    ms = F.create_map(F.lit("m0"), milestone(F.lit("other"), F.array(F.lit("X")), F.lit("https://youtu.be/xxxxxxxxxxx")),
                      F.lit("m1"), milestone(F.when(k % 4 < 3, F.concat(F.lit("Title "), k)).otherwise(" "), F.when(k % 3 == 0, F.array(event)).otherwise(none),
                                             F.when(k % 2 == 0, link).otherwise("none")))
    cards = F.array(F.struct(event.alias("event_ticker"), F.when(k % 3 == 0, "zz").otherwise("m1").alias("milestone_id")))
    body = F.to_json(F.struct(cards.alias("cards"), F.struct(ms.alias("milestones")).alias("hydrated_data")))
    return payloads.linked_streams(views.table(spark, sf_dir, "pages").select(event.alias("event_ticker"), body.alias("body")))


@query("caption_clock", sql("""
    SELECT video_id, CAST(sum(1700000000 + CAST(round_even(t_start_ms / 1000.0, 0) AS BIGINT)) AS BIGINT) AS starts, count(*) AS n
    FROM (SELECT video_id, t_start_ms, regexp_replace(word, '^>>+', '') AS word FROM caps) WHERE word <> '' GROUP BY video_id""", caps=_CAPTIONS))
def caption_clock(spark, sf_dir):
    w = _caption_words(spark, sf_dir)
    return w.groupBy("video_id").agg(F.sum(align.utc_seconds(F.lit(views.TAPE_T0), F.col("t_start_ms"))).alias("starts"), F.count("*").alias("n"))


@query("video_word_frame", sql("""
    SELECT video_id, word, t_start_ms, row_number() OVER (PARTITION BY video_id ORDER BY t_start_ms) - 1 AS word_idx
    FROM (SELECT video_id, t_start_ms, regexp_replace(word, '^>>+', '') AS word FROM caps) WHERE word <> ''""", caps=_CAPTIONS))
def video_word_frame(spark, sf_dir):
    return _caption_words(spark, sf_dir).select("video_id", "word", "t_start_ms", "word_idx")

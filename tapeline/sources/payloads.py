"""Landed venue and news payloads to rows.

Each function takes rows with the payload text in ``body`` and parses it with a declared schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import prices, text, times
from tapeline.operators.universe import EVENT_TYPE, MARKET_TYPE

PARTS = ("open", "high", "low", "close")
_SIDE = "struct<" + ",".join(f"{p}_dollars:string,{p}:string" for p in (*PARTS, "mean")) + ">"
_CANDLE = (f"struct<end_period_ts:bigint,price:{_SIDE},yes_bid:{_SIDE},yes_ask:{_SIDE},"
           "volume_fp:string,volume:string,open_interest_fp:string,open_interest:string>")


def _first(obj: Column, *keys: str) -> Column:
    return F.coalesce(*[prices.number(obj[k]) for k in keys])


def _candle_row(ticker: Column, c: Column) -> list[Column]:
    cells = [ticker.alias("ticker"), c["end_period_ts"].alias("ts")]
    for side in ("yes_bid", "yes_ask", "price"):
        cells += [_first(c[side], f"{p}_dollars", p).alias(f"{side}_{p}") for p in PARTS]
    return cells + [_first(c["price"], "mean_dollars", "mean").alias("price_mean"),
                    _first(c, "volume_fp", "volume").alias("volume"),
                    _first(c, "open_interest_fp", "open_interest").alias("open_interest")]


def candle_rows(payloads: DataFrame, period_minutes: int) -> DataFrame:
    """Batched candle payloads to bars, in either venue shape."""
    parsed = F.from_json("body", f"struct<markets:array<struct<market_ticker:string,candlesticks:array<{_CANDLE}>>>>")
    markets = payloads.select(F.explode(parsed["markets"]).alias("m"))
    bars = markets.select(F.col("m.market_ticker").alias("t"), F.explode("m.candlesticks").alias("c"))
    return bars.select(*_candle_row(F.col("t"), F.col("c"))).withColumn("period_minutes", F.lit(period_minutes).cast("bigint"))


def market_candle_rows(payloads: DataFrame, period_minutes: int) -> DataFrame:
    """Single-market candle payloads (``ticker``, ``body``) to bars."""
    parsed = F.from_json("body", f"struct<candlesticks:array<{_CANDLE}>>")
    bars = payloads.select("ticker", F.explode(parsed["candlesticks"]).alias("c"))
    return bars.select(*_candle_row(F.col("ticker"), F.col("c"))).withColumn("period_minutes", F.lit(period_minutes).cast("bigint"))


_EVENT_WITH_MARKETS = EVENT_TYPE.simpleString()[:-1] + f",markets:array<{MARKET_TYPE.simpleString()}>>"


def event_markets(payloads: DataFrame) -> DataFrame:
    """Event pages with nested markets to ``market, event`` records.

    Events without markets stay, with a NULL market. ``series_ticker`` and ``series_title`` come
    from the listing where the page has them as columns.
    """
    parsed = F.from_json("body", f"struct<events:array<{_EVENT_WITH_MARKETS}>>")
    keep = [c for c in payloads.columns if c not in ("body",)]
    rows = payloads.select(*keep, F.explode(parsed["events"]).alias("e")).select(
        *keep, "e", F.explode_outer("e.markets").alias("market"))
    event = F.col("e").dropFields("markets")
    if "series_ticker" in keep:
        event = event.withField("series_ticker", F.coalesce(F.col("e.series_ticker"), F.col("series_ticker")))
    if "series_title" in keep:
        event = event.withField("series_title", F.col("series_title"))
    return rows.select(*[c for c in keep if c not in ("series_ticker", "series_title")], "market", event.alias("event"))


def series_rows(payloads: DataFrame) -> DataFrame:
    """Series listings to rows."""
    parsed = F.from_json("body", "struct<series:array<struct<ticker:string,title:string,category:string,fee_type:string>>>")
    return payloads.select(F.inline(parsed["series"]))


def price_history(payloads: DataFrame) -> DataFrame:
    """``{history: [{t, p}]}`` payloads (``token_id``, ``body``) to points."""
    parsed = F.from_json("body", "struct<history:array<struct<t:bigint,p:double>>>")
    return payloads.select("token_id", F.inline(parsed["history"])).withColumnsRenamed({"t": "ts"})


def token_markets(payloads: DataFrame) -> DataFrame:
    """Bare-list or wrapped market pages with their YES token id.

    Token ids come as a list or as a JSON text holding one; the first is YES.
    """
    item = "struct<id:string,question:string,clobTokenIds:string>"
    bare = F.from_json("body", f"array<{item}>")
    wrapped = F.from_json("body", f"struct<markets:array<{item}>>")["markets"]
    markets = F.when(F.trim("body").startswith("["), bare).otherwise(wrapped)
    tokens = F.coalesce(F.from_json("clobTokenIds", "array<string>"), F.array().cast("array<string>"))
    return payloads.select(F.inline(markets)).select(
        "id", "question", tokens.alias("token_ids"), F.try_element_at(tokens, F.lit(1)).alias("yes_token_id"))


def midpoints(payloads: DataFrame) -> DataFrame:
    """``{mid: "0.5"}`` payloads (``token_id``, ``body``) to prices."""
    return payloads.select("token_id", prices.number(F.get_json_object("body", "$.mid")).alias("mid"))


def headline_rows(payloads: DataFrame, default_source: str = "gdelt") -> DataFrame:
    """News payloads to headline rows; undated or untitled articles are dropped."""
    parsed = F.from_json("body", "struct<articles:array<struct<seendate:string,title:string,domain:string>>>")
    rows = payloads.select(F.inline(parsed["articles"])).select(
        times.seendate_to_seconds(F.col("seendate")).alias("ts"),
        F.coalesce("domain", F.lit(default_source)).alias("source"), F.trim("title").alias("text"))
    rows = rows.filter(F.col("ts").isNotNull() & (F.col("text") != ""))
    return rows.select(text.short_hash(F.col("ts"), F.col("source"), F.col("text")).alias("headline_id"), "ts", "source", "text")


def quote_ticks(payloads: DataFrame) -> DataFrame:
    """Polled quote listings (``poll_utc``, ``body``) to one tick per market.

    Works on a stream too. ``seq`` is the poll time: polls have no sequence of their own.
    """
    parsed = F.from_json("body", "struct<markets:array<struct<ticker:string,yes_bid_dollars:string,yes_ask_dollars:string,"
                                 "yes_bid_size_fp:string,yes_ask_size_fp:string>>>")
    m = F.col("m")
    return payloads.select("poll_utc", F.explode(parsed["markets"]).alias("m")).select(
        m["ticker"].alias("ticker"), F.col("poll_utc").alias("recv_utc"), F.col("poll_utc").alias("seq"),
        prices.number(m["yes_bid_dollars"]).alias("yes_bid"), prices.number(m["yes_ask_dollars"]).alias("yes_ask"),
        prices.number(m["yes_bid_size_fp"]).alias("depth_bid"), prices.number(m["yes_ask_size_fp"]).alias("depth_ask"))


def linked_streams(payloads: DataFrame) -> DataFrame:
    """Milestone linked to each event of a card payload: video id and title.

    ``payloads``: event_ticker, body. A milestone counts if the event's card points at it or it
    lists the event; the first one in the payload with a video, and with a title, is used.
    """
    milestone = ("struct<title:string,related_event_tickers:array<string>,primary_event_tickers:array<string>,"
                 "product_details:struct<youtube_link:string>>")
    parsed = F.from_json("body", "struct<cards:array<struct<event_ticker:string,milestone_id:string>>,"
                                 f"hydrated_data:struct<milestones:map<string,{milestone}>>>")
    p = payloads.withColumn("p", parsed).select("event_ticker", F.col("p.cards").alias("cards"),
                                                F.map_entries("p.hydrated_data.milestones").alias("ms"))
    event = F.col("event_ticker")
    pointed = F.transform(F.filter(F.coalesce("cards", F.array()), lambda c: c["event_ticker"] == event), lambda c: c["milestone_id"])

    def lists(ts: Column) -> Column:
        return F.coalesce(F.array_contains(ts, event), F.lit(False))

    linked = F.filter("ms", lambda m: F.coalesce(F.array_contains(pointed, m["key"]), F.lit(False))
                      | lists(m["value"]["related_event_tickers"]) | lists(m["value"]["primary_event_tickers"]))
    ids = F.filter(F.transform(linked, lambda m: text.video_id(m["value"]["product_details"]["youtube_link"])), lambda v: v.isNotNull())
    titles = F.filter(F.transform(linked, lambda m: F.trim(m["value"]["title"])), lambda t: t != "")
    return p.select("event_ticker", F.try_element_at(ids, F.lit(1)).alias("video_id"), F.try_element_at(titles, F.lit(1)).alias("title"))

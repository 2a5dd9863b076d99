"""Views that give every operator an input derived from the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.sources.tables import spread

T0 = 1_704_067_200       # first second of the event table
TAPE_T0 = 1_700_000_000  # tapes squeeze 600 event seconds into one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def event_seconds() -> Column:
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def bid_cents() -> Column:
    return (F.lit(30) + F.col("user_id") % 40 + F.floor("value") % 12).cast("bigint")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(table(spark, sf_dir, "events"))


def ticks_of(events: DataFrame) -> DataFrame:
    e = events.select("event_id", "user_id", bid_cents().alias("c"), event_seconds().alias("s"))
    bid = F.col("c") / 100.0
    eid = F.col("event_id")
    return e.select(
        F.concat(F.lit("U"), F.col("user_id")).alias("ticker"),
        (F.lit(TAPE_T0) + F.floor((F.col("s") - T0) / 600)).cast("bigint").alias("recv_utc"),
        eid.alias("seq"),
        bid.alias("yes_bid"),
        F.when(eid % 23 == 0, F.lit(None).cast("double"))
        .when(eid % 17 == 0, (F.col("c") - 1) / 100.0)
        .otherwise((F.col("c") + 1 + eid % 4) / 100.0).alias("yes_ask"),
        F.when(eid % 19 != 0, (eid * 7 % 130).cast("double")).alias("depth_bid"),
        F.when(eid % 29 != 0, (eid * 11 % 130).cast("double")).alias("depth_ask"),
    )


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", bid_cents().alias("c"), event_seconds().alias("s"),
        (1 + F.col("event_id") % 4).alias("w"))
    day = (F.floor(F.col("s") / 86400) * 86400 + 86400).cast("bigint")
    # event_id follows time, so the last event of a day is the one with the greatest id
    return e.withColumn("day", day).groupBy("user_id", "day").agg(
        F.max_by("c", "event_id").alias("c_last"), F.max_by("w", "event_id").alias("w_last"),
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"),
    ).select(
        F.concat(F.lit("U"), F.col("user_id")).alias("ticker"),
        F.col("day").alias("ts"), F.lit(1440).alias("period_minutes"),
        (F.col("c_last") / 100.0).alias("yes_bid_close"),
        ((F.col("c_last") + F.col("w_last")) / 100.0).alias("yes_ask_close"),
        ((F.col("lo") - 1) / 100.0).alias("price_low"),
        ((F.col("hi") + 3) / 100.0).alias("price_high"),
        ((F.col("c_last") + 1) / 100.0).alias("price_close"),
        F.col("n").cast("double").alias("volume"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col("event_type") == "purchase").alias("n_buys"),
        F.min(event_seconds()).alias("first_s"), F.max(event_seconds()).alias("last_s"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.concat(F.lit("U"), u).alias("market_ticker"),
        F.when(u % 37 != 5, T0 + (u % 25 + 2) * 86400 + 43200).cast("bigint").alias("decision_ts"),
        F.when(u % 2 == 0, "test").otherwise("train").alias("split"),
        F.when(u % 3 == 0, 1).otherwise(0).alias("y"),
        (u * 53 % 100 / 100.0).alias("p_base"),
        (u * 71 % 100 / 100.0).alias("p_topic"),
        (u * 37 % 100 / 100.0).alias("p_cal"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and event type, so markets repeat and the first row must be kept."""
    per = table(spark, sf_dir, "events").groupBy(
        "user_id", "event_type").agg(F.min("event_id").alias("ingest_seq"))
    u = F.col("user_id")
    formats = F.array(*[F.lit(f) for f in ("earnings", "speech", "broadcast", "sports")])
    risks = F.array(*[F.lit(r) for r in ("low", "medium", "high")])
    results = F.array(*[F.lit(r) for r in ("yes", "no", "", "scalar")])
    templates = F.array(*[F.lit(t) for t in ("speech", "earnings", "duration", "other")])
    decision = T0 + (u % 25 + 2) * 86400 + 43200
    return per.select(
        F.concat(F.lit("U"), u).alias("market_ticker"),
        F.concat(F.lit("EV"), u % 30, F.lit("-24JAN"), F.lpad((u % 35).cast("string"), 2, "0")).alias("event_ticker"),
        F.concat(F.lit("S"), u % 7).alias("series_ticker"),
        F.when(u % 5 != 0, F.concat(F.lit("Remarks "), F.col("event_type"), F.lit(" Debate and Dinner"))).otherwise("Weekly press conference").alias("series_title"),
        F.concat(F.lit("occ"), u % 12).alias("occasion"),
        F.concat(F.lit("spk"), u % 11).alias("speaker"),
        F.try_element_at(formats, (u % 5 + 1).cast("int")).alias("format"),
        F.try_element_at(risks, (u % 4 + 1).cast("int")).alias("resolution_risk"),
        F.try_element_at(templates, (u % 4 + 1).cast("int")).alias("template"),
        (u % 9 == 0).alias("is_nqe"),
        ((50 + u % 51) / 100.0).alias("confidence"),
        F.concat(F.lit("label "), u % 17).alias("yes_sub_title"),
        F.try_element_at(results, (u % 4 + 1).cast("int")).alias("result"),
        F.when(u % 8 != 0, decision - 20 * 86400).cast("bigint").alias("open_ts"),
        F.when(u % 6 != 0, decision + 3 * 86400).cast("bigint").alias("close_ts"),
        F.when(u % 7 != 0, decision + 7200).cast("bigint").alias("occurrence_ts"),
        F.when(u % 10 != 0, decision + 5 * 86400).cast("bigint").alias("expiration_ts"),
        "ingest_seq",
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with one row per market."""
    from tapeline.operators.dedup import keep_first
    from tapeline.operators.universe import eligible

    return keep_first(registry(spark, sf_dir), ["market_ticker"], ["ingest_seq"]).withColumn(
        "eligible", eligible())


WORD_SPLIT = "[ \\n\\t\\r]+"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts: one row per token with gaps, ties and backward jumps in time."""
    return words_of(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")))


def words_of(documents: DataFrame, *carried: str) -> DataFrame:
    """The same of (doc_id, lang, text), which may be a stream; ``carried`` columns stay."""
    docs = documents.select(
        "doc_id", "lang", *carried, F.posexplode(F.filter(
            F.split("text", WORD_SPLIT), lambda t: t != "")).alias("word_idx", "word"))
    i, d = F.col("word_idx").cast("bigint"), F.col("doc_id")
    base = TAPE_T0 + (d % 40) * 60 + F.floor(i * 2 / 5) + F.floor(i / 200) * 75
    return docs.select(
        d.alias("occasion_id"), i.alias("word_idx"), "word",
        (base - F.when((i + 1) % 97 == 0, 2).otherwise(0)).cast("bigint").alias("t_start_utc"),
        (base + 1).cast("bigint").alias("t_end_utc"),
        F.concat(F.lit("asr-"), F.col("lang")).alias("source"),
        F.when(i % 50 == 7, -1.0).when(i % 3 == 0, (i % 90 + 10) / 100.0).alias("asr_conf"),
        *carried,
    )


# (market ticker, outcome label)
SPECS = (
    ("U1", "the"), ("U2", "of / and"), ("U3", "with (3+ times)"), ("U4", "that"),
    ("U5", "was / is"), ("U6", "from the"), ("U7", "Zzz"),
)


def specs(spark: SparkSession) -> DataFrame:
    """The tracked phrases: a fixed list, so its size is bounded by construction."""
    rows = [F.struct(F.lit(t).alias("market_ticker"), F.lit(p).alias("phrase")) for t, p in SPECS]
    return spark.range(1).select(F.inline(F.array(*rows)))


SPEAKERS = ("Chair Jerome H. Powell", "Powell", "President Ada B. Stone", "Vice President Ada Stone",
            "the Federal Reserve Chair", "Sen. Li", "Senator Li", "Mr. Chairman Dr. Kay")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    speakers = F.array(*[F.lit(s) for s in SPEAKERS])
    formats = F.array(*[F.lit(f) for f in ("speech", "earnings", "broadcast")])
    return documents(spark, sf_dir).select(
        d.cast("string").alias("doc_id"),
        F.element_at(speakers, (d % 8 + 1).cast("int")).alias("speaker"),
        F.element_at(formats, (d % 3 + 1).cast("int")).alias("format"),
        (TAPE_T0 + d * 86400).cast("bigint").alias("date_ts"), "source", "text",
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", (F.col("n_chars") % 97 / 96.0).alias("p_raw"), F.col("quality").alias("y"),
        F.col("doc_id").alias("ts"))


# --- market records -------------------------------------------------------------------------------

SERIES = ("KXNFLMENTION", "KXEARNINGSMENTION", "KXDWTS", "KXFTN", "KXTALK", "KXSNL")
TITLES = ("Game Mention", "Acme Earnings Call", "Dancing: mention", "Face the Nation - Mention", "Town Hall Mention", "")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market and event records as JSON text, some sighted twice, a few of them parlay legs."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    k, name = F.col("p_partkey"), F.col("p_name")
    # a record is made much longer than its part
    part = spread(table(spark, sf_dir, "part"), 1 << 14).withColumn("s_suppkey", k % n)
    rows = part.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    s = F.col("s_name")
    rules = (
        F.when(k % 7 == 0, F.concat(F.lit("If "), s, F.lit(" says "), name, F.lit(" as part of "), F.col("p_type"), F.lit(" remarks., then the market resolves to Yes.")))
        .when(k % 7 == 1, F.concat(F.lit("If "), name, F.lit(" is said by any "), s, F.lit(" representative (including the operator)\n during the next "), s, F.lit(" earnings call, then the market resolves to Yes.")))
        .when(k % 7 == 2, F.concat(F.lit("If "), name, F.lit(", or a plural or possessive form of the word, is stated by "), s, F.lit(" before  Jan 5., then the market resolves to Yes.")))
        .when(k % 7 == 3, F.concat(F.lit("If "), s, F.lit(" speaks for 30 minutes at "), F.col("p_type"), F.lit(", then the market resolves to Yes.")))
        .when(k % 7 == 4, F.concat(F.lit("If any person or "), s, F.lit(" mentions the topic of "), name, F.lit(" most as part of "), F.col("p_type"), F.lit(", then the market resolves to Yes.")))
        .when(k % 7 == 5, "If a qualifying event does not occur, then the market resolves to Yes.")
        .otherwise(F.concat(F.lit("Resolved by "), s, F.lit("."))))
    label = (F.when(k % 5 == 0, name).when(k % 5 == 1, "Oil / Gas").when(k % 5 == 2, "Afford / Affordable")
             .when(k % 5 == 3, F.concat(name, F.lit(" (3+ times)"))).otherwise(""))
    second = (F.when(k % 3 == 0, "Video of the event is primarily used.").when(k % 3 == 1, "Plural or possessive forms count: a plural or possessive form.")
              .otherwise(F.lit(None).cast("string")))
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    iso = F.concat(F.lit("2024-02-"), day, F.lit("T10:00:00Z"))
    market = F.struct(
        F.concat(_pick(SERIES, k % 6), F.lit("-24FEB"), day, F.lit("-"), k.cast("string")).alias("ticker"), label.alias("yes_sub_title"), rules.alias("rules_primary"),
        second.alias("rules_secondary"), F.when(k % 9 != 0, F.concat(F.lit("2024-01-"), day, F.lit("T00:00:00+00:00"))).alias("open_time"),
        F.when(k % 11 == 0, "soon").otherwise(iso).alias("close_time"), F.when(k % 4 != 0, iso).alias("occurrence_datetime"),
        F.concat(F.lit("2024-03-"), day).alias("expiration_time"), F.concat(F.lit("2024-03-"), day, F.lit("T00:00:00Z")).alias("expected_expiration_time"),
        F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").otherwise("").alias("result"),
        F.when(k % 8 == 0, "n/a").otherwise((k * 3).cast("string")).alias("volume_fp"), (k % 100).cast("string").alias("open_interest_fp"),
        F.when(k % 13 == 0, "MVE1").alias("mve_collection_ticker"), (k % 2 == 0).alias("can_close_early"))
    sources = F.transform(F.slice(F.array(*[F.lit(i) for i in range(6)]), 1, (k % 6).cast("int")),
                          lambda i: F.struct(F.when(i == 2, " ").otherwise(F.concat(F.lit("Outlet "), i.cast("string"))).alias("name")))
    event = F.struct(
        F.concat(_pick(SERIES, k % 6), F.lit("-24FEB"), day).alias("event_ticker"), F.when(k % 10 != 0, _pick(SERIES, k % 6)).alias("series_ticker"),
        _pick(TITLES, k % 6).alias("series_title"), F.lit("State of Play special").alias("title"), sources.alias("settlement_sources"))
    # closed sightings repeat part of the open ones
    seen = F.filter(F.array(F.lit(0), F.lit(1)), lambda i: (i == 0) | (k % 4 == 0))
    return rows.select("p_partkey", F.explode(seen).alias("sighting"), market.alias("m"), event.alias("e")).select(
        "p_partkey", "sighting", F.to_json(F.struct(
            F.col("m").withField("status", F.when(F.col("sighting") == 0, "open").otherwise("closed")).alias("market"), F.col("e").alias("event"))).alias("body"))

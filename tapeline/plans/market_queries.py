"""Universe, registry, occasion and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import times
from tapeline.operators import book, dedup, occasions, profile, universe
from tapeline.plans import views
from tapeline.plans.catalog import query
from tapeline.plans.sqlviews import sql


def _raw(spark, sf_dir):
    """The parsed records with the order they were sighted in."""
    return views.raw_records(spark, sf_dir).select(
        "sighting", F.from_json("body", universe.RAW_SCHEMA).alias("r")).select("sighting", "r.*")


def _kept(spark, sf_dir):
    return universe.without_parlays(_raw(spark, sf_dir), ["sighting"])


def _registry(spark, sf_dir, *columns):
    """The registry, or those of its columns that a query reads."""
    if columns:
        return universe.registry_columns(_raw(spark, sf_dir), ["sighting"], list(columns))
    kept = _kept(spark, sf_dir)
    return universe.build_registry(universe.catalog(kept), universe.resolutions(kept))


@query("catalog", sql("SELECT * REPLACE (CASE WHEN rules_primary LIKE '%the operator)%' THEN replace(rules_primary, '(including the operator) during', '(including the operator)\n during') WHEN rules_primary LIKE '%before Jan 5%' THEN replace(rules_primary, 'before Jan', 'before  Jan') ELSE rules_primary END AS rules_primary) FROM catalog_", "catalog_"))
def catalog(spark, sf_dir):
    return universe.catalog(_kept(spark, sf_dir))


@query("sweep_counts", sql("""
    SELECT count(DISTINCT ticker) AS n_markets_seen, count(DISTINCT CASE WHEN parlay THEN ticker END) AS n_parlay_excluded,
           count(DISTINCT event_ticker) AS n_events, count(DISTINCT series_ticker) AS n_series FROM raw""", "raw"))
def sweep_counts(spark, sf_dir):
    return universe.sweep_counts(_raw(spark, sf_dir))


@query("resolutions", sql("""
    SELECT market_ticker, series, template, speaker, occasion, phrase, variant_rule, cutoff_ts, array_to_string(governing_sources, '|') AS governing_sources,
           early_resolution, cancellation_clause, is_nqe, resolution_risk, confidence, notes FROM res_""", "res_"))
def resolutions(spark, sf_dir):
    return universe.resolutions(_kept(spark, sf_dir)).withColumn("governing_sources", F.array_join("governing_sources", "|"))


@query("registry", sql("SELECT * EXCLUDE (rules_primary) FROM registry_", "registry_"))
def registry(spark, sf_dir):
    return _registry(spark, sf_dir).drop("rules_primary")


@query("unresolved_markets", sql("SELECT market_ticker, template FROM registry_ WHERE template IN ('other', 'nqe')", "registry_"))
def unresolved_markets(spark, sf_dir):
    reg = _registry(spark, sf_dir, "market_ticker", "template")
    parsed = reg.filter(~F.col("template").isin("other", "nqe"))
    return universe.unresolved_markets(reg.select("market_ticker", "template"), parsed)


def _review(spark, sf_dir):
    """Edits for markets with large parts, a few of them unknown to the registry."""
    rows = views.raw_records(spark, sf_dir).filter("sighting = 0").select(F.get_json_object("body", "$.market.ticker").alias("market_ticker"), "p_partkey")
    k = F.col("p_partkey")
    return rows.filter(k % 3 == 0).select(
        F.when(k % 12 == 0, F.concat("market_ticker", F.lit("-X"))).otherwise(F.col("market_ticker")).alias("market_ticker"),
        F.when(k % 2 == 0, "low").alias("resolution_risk"), F.when(k % 5 == 0, 0.99).when(k % 5 == 1, 0.1).alias("confidence"), F.lit("seen").alias("notes"))


_REVIEW = """SELECT CASE WHEN k % 12 = 0 THEN ticker || '-X' ELSE ticker END AS market_ticker, CASE WHEN k % 2 = 0 THEN 'low' END AS risk,
                    CASE k % 5 WHEN 0 THEN 0.99::DOUBLE WHEN 1 THEN 0.1::DOUBLE END AS conf, 'seen' AS note FROM raw WHERE sighting = 0 AND k % 3 = 0"""


@query("review_overlay", sql("""
    SELECT market_ticker, resolution_risk, confidence, notes, template IN ('speech', 'earnings', 'duration') AND NOT is_nqe AND resolution_risk IN ('low', 'medium')
           AND confidence >= 0.8 AS eligible
    FROM (SELECT r.* REPLACE (coalesce(e.risk, resolution_risk) AS resolution_risk, coalesce(e.conf, confidence) AS confidence, coalesce(e.note, notes) AS notes)
          FROM registry_ r LEFT JOIN review e USING (market_ticker))""", "registry_", "raw", review=_REVIEW))
def review_overlay(spark, sf_dir):
    return universe.apply_review(_registry(spark, sf_dir, "market_ticker", "template", "is_nqe", "resolution_risk", "confidence", "notes", "eligible"), _review(spark, sf_dir)).select(
        "market_ticker", "resolution_risk", "confidence", "notes", "eligible")


@query("unknown_edits", sql("SELECT market_ticker FROM review WHERE market_ticker NOT IN (SELECT market_ticker FROM registry_)", "registry_", "raw", review=_REVIEW))
def unknown_edits(spark, sf_dir):
    return universe.unknown_edits(_registry(spark, sf_dir, "market_ticker"), _review(spark, sf_dir)).select("market_ticker")


@query("review_rows", sql("""
    SELECT market_ticker, confidence, resolution_risk, eligible, left(rules_primary, 60) AS rules_primary FROM registry_
    WHERE resolution_risk <> 'low' OR NOT eligible OR variant_rule = 'fuzzy' OR confidence < 0.8""", "registry_"))
def review_rows(spark, sf_dir):
    return universe.review_view(_registry(spark, sf_dir, *universe.REVIEW_COLUMNS), only_flagged=True, rule_chars=60).select(
        "market_ticker", "confidence", "resolution_risk", "eligible", "rules_primary")


@query("triage_topn", sql("""
    (SELECT 'worst' AS list, market_ticker, confidence FROM registry_ ORDER BY confidence, market_ticker LIMIT 15) UNION ALL
    (SELECT 'risk', market_ticker, confidence FROM registry_ WHERE resolution_risk = 'high' ORDER BY market_ticker LIMIT 10)""", "registry_"))
def triage_topn(spark, sf_dir):
    reg = _registry(spark, sf_dir, "market_ticker", "confidence", "resolution_risk")
    parts = [universe.worst_parses(reg, 15).withColumn("list", F.lit("worst")), universe.high_risk(reg, 10).withColumn("list", F.lit("risk"))]
    return dedup.union_all(*parts).drop("resolution_risk")


@query("market_filters", sql("""
    SELECT format, count(*) FILTER (result = '') AS n_unsettled, count(*) FILTER (eligible) AS n_eligible, count(*) FILTER (eligible AND result IN ('yes', 'no')) AS n_target,
           count(*) FILTER (resolution_risk <> 'low' OR NOT eligible OR variant_rule = 'fuzzy' OR confidence < 0.8) AS n_flagged,
           count(*) FILTER (event_ticker NOT LIKE '%9') AS n_kept_suffix FROM registry_ GROUP BY format""", "registry_"))
def market_filters(spark, sf_dir):
    reg = _registry(spark, sf_dir, "format", "result", "eligible", "resolution_risk", "variant_rule", "confidence", "event_ticker")
    target = F.col("eligible") & F.col("result").isin(*universe.BINARY_RESULTS)
    return reg.groupBy("format").agg(
        F.count_if(universe.unsettled(F.col("result"))).alias("n_unsettled"), F.count_if("eligible").alias("n_eligible"), F.count_if(target).alias("n_target"),
        F.count_if(universe.flagged()).alias("n_flagged"), F.count_if(~F.col("event_ticker").endswith("9")).alias("n_kept_suffix"))


@query("suffix_filter", sql("SELECT ticker, count(*) AS n FROM ticks WHERE ticker NOT LIKE '%7' GROUP BY ticker", "ticks"))
def suffix_filter(spark, sf_dir):
    return book.without_suffix(views.ticks(spark, sf_dir), "7").groupBy("ticker").agg(F.count("*").alias("n"))


# --- bars per market ------------------------------------------------------------------------------

@query("targets", sql("SELECT market_ticker, format, result FROM markets WHERE eligible AND result IN ('yes', 'no')", "markets"))
def targets(spark, sf_dir):
    return universe.target_markets(views.markets(spark, sf_dir)).select("market_ticker", "format", "result")


WINDOWS = """SELECT * FROM (SELECT market_ticker AS ticker, coalesce(open_ts, occurrence_ts - 2592000, close_ts - 2592000) AS start,
                    greatest(close_ts, expiration_ts, occurrence_ts) + 172800 AS "end" FROM markets) WHERE "end" > start"""


@query("windows", sql(WINDOWS, "markets"))
def windows(spark, sf_dir):
    return universe.life_windows(views.markets(spark, sf_dir))


@query("first_windows", sql(f'SELECT * FROM ({WINDOWS}) ORDER BY "end", ticker LIMIT 20', "markets"))
def first_windows(spark, sf_dir):
    return universe.first_windows(universe.life_windows(views.markets(spark, sf_dir)), 20)


@query("wanted_bars", sql(f"SELECT ticker, count(*) AS n FROM candles WHERE ticker IN (SELECT ticker FROM ({WINDOWS.replace('FROM markets', 'FROM markets WHERE eligible')})) GROUP BY 1", "markets", "candles"))
def wanted_bars(spark, sf_dir):
    wanted = universe.life_windows(views.markets(spark, sf_dir).filter("eligible"))
    return universe.bars_of_targets(views.candles(spark, sf_dir), wanted).groupBy("ticker").agg(F.count("*").alias("n"))


@query("bar_coverage", sql("""
    SELECT m.market_ticker, coalesce(n, 0) AS n_candles, coalesce(n, 0) > 0 AS has_candles
    FROM markets m LEFT JOIN (SELECT ticker, count(*) AS n FROM candles, (SELECT min(open_ts) - 172800 AS lo, max(close_ts) + 172800 AS hi FROM markets WHERE open_ts IS NOT NULL AND close_ts IS NOT NULL)
                              WHERE ts BETWEEN lo AND hi GROUP BY ticker) c ON c.ticker = m.market_ticker AND m.open_ts IS NOT NULL AND m.close_ts IS NOT NULL""", "markets", "candles"))
def bar_coverage(spark, sf_dir):
    return universe.attach_coverage(views.markets(spark, sf_dir), views.candles(spark, sf_dir)).select("market_ticker", "n_candles", "has_candles")


# Customers as markets: many of them have no bars.
_LISTED = """SELECT 'U' || c_custkey AS market_ticker, c_acctbal > 0 AS eligible, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'yes' WHEN c_mktsegment = 'FURNITURE' THEN 'no' ELSE '' END AS result
             FROM customer"""


def _listed(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    return c.select(F.concat(F.lit("U"), "c_custkey").alias("market_ticker"), (F.col("c_acctbal") > 0).alias("eligible"),
                    F.when(segment.isin("BUILDING", "MACHINERY"), "yes").when(segment == "FURNITURE", "no").otherwise("").alias("result"))


# The markets of the registry, and the listed ones that it lacks.
_TARGETS = """SELECT market_ticker, eligible, result FROM markets UNION ALL
              SELECT * FROM listed WHERE market_ticker NOT IN (SELECT market_ticker FROM markets)"""


@query("coverage", sql("""
    SELECT count(*) AS n_target, count(*) FILTER (b) AS n_covered, count(*) FILTER (NOT b) AS n_missing, (SELECT count(*) FROM candles) AS n_bars
    FROM (SELECT market_ticker IN (SELECT ticker FROM candles) AS b FROM targets WHERE eligible AND result IN ('yes', 'no'))""", "markets", "candles", listed=_LISTED, targets=_TARGETS))
def coverage(spark, sf_dir):
    markets = views.markets(spark, sf_dir).select("market_ticker", "eligible", "result")
    targets = markets.unionByName(_listed(spark, sf_dir).join(markets.select("market_ticker"), "market_ticker", "left_anti"))
    return universe.coverage_stats(views.candles(spark, sf_dir), targets)


@query("missing_keys", sql("SELECT DISTINCT market_ticker FROM listed WHERE market_ticker NOT IN (SELECT ticker FROM candles)", "candles", listed=_LISTED))
def missing_keys(spark, sf_dir):
    have = views.candles(spark, sf_dir).select(F.col("ticker").alias("market_ticker"))
    return dedup.missing_keys(_listed(spark, sf_dir), have, "market_ticker")


# --- occasions ------------------------------------------------------------------------------------

NOW = views.T0 + 15 * 86_400
OCC_CTES = {
    "dated": """SELECT *, CASE WHEN dd BETWEEN 1 AND 31 THEN 1704067200 + (dd - 1) * 86400 + 5 * 3600 END AS day_start
                FROM (SELECT *, coalesce(occurrence_ts, close_ts) AS w, CAST(right(event_ticker, 2) AS BIGINT) AS dd FROM markets)""",
    "timed": """SELECT *, CASE WHEN day_only THEN day_start + 43200 ELSE w END AS when_ts, day_start + 86400 AS day_end
                FROM (SELECT *, coalesce(day_start IS NOT NULL AND (w IS NULL OR abs(w - day_start - 43200) > 172800), false) AS day_only FROM dated)""",
    "picked": f"""SELECT event_ticker, arg_min(speaker, market_ticker) AS speaker,
                         CASE WHEN lower(arg_min(series_title, market_ticker)) LIKE '%press conference%' THEN 'presser' ELSE 'debate' END AS event_type,
                         coalesce(min(when_ts) FILTER (NOT day_only), min(when_ts)) AS occurrence_ts, count(*) AS n_markets,
                         bool_or(NOT day_only) AS time_known
                  FROM upcoming GROUP BY event_ticker""",
}
OCC_CTES = {"dated": OCC_CTES["dated"], "timed": OCC_CTES["timed"], "upcoming": f"""
                  SELECT * FROM timed WHERE format = 'speech' AND template = 'speech' AND eligible AND trim(result) = ''
                    AND ((NOT day_only AND when_ts > {NOW} AND when_ts <= {NOW} + 1728000) OR (day_only AND day_end > {NOW} AND day_start <= {NOW} + 1728000))""",
    "picked": OCC_CTES["picked"]}


def _open_markets(spark, sf_dir):
    """The market view as speech markets still open, so occasions are found among them."""
    return views.markets(spark, sf_dir).withColumns({
        "format": F.lit("speech"), "template": F.lit("speech"), "eligible": F.col("confidence") >= 0.6,
        "result": F.when(F.col("result") == "yes", "yes").otherwise(" ")})


_OPEN = """SELECT * REPLACE ('speech' AS format, 'speech' AS template, confidence >= 0.6 AS eligible, CASE WHEN result = 'yes' THEN 'yes' ELSE ' ' END AS result) FROM {m}"""


def _occ_sql(body: str) -> str:
    ctes = dict(OCC_CTES)
    ctes["dated"] = ctes["dated"].replace("FROM markets)", f"FROM ({_OPEN.format(m='markets')}))")
    return sql(body, "markets", **ctes)


@query("occasions", _occ_sql("SELECT * FROM picked"))
def upcoming(spark, sf_dir):
    return occasions.select_occasions(_open_markets(spark, sf_dir), NOW, 20 * 86_400)


@query("upcoming_markets", _occ_sql("SELECT event_ticker, market_ticker, yes_sub_title, when_ts, day_only FROM upcoming"))
def upcoming_markets(spark, sf_dir):
    return occasions.upcoming_markets(_open_markets(spark, sf_dir), NOW, 20 * 86_400).select(
        "event_ticker", "market_ticker", "yes_sub_title", "when_ts", "day_only")


@query("next_occasion", _occ_sql("SELECT event_ticker, occurrence_ts, occurrence_ts - 1800 AS arm_ts FROM picked ORDER BY occurrence_ts, event_ticker LIMIT 3"))
def next_occasion(spark, sf_dir):
    occ = occasions.select_occasions(_open_markets(spark, sf_dir), NOW, 20 * 86_400)
    return occasions.next_occasion(occ, 3).select("event_ticker", "occurrence_ts", times.arm_at(F.col("occurrence_ts")).alias("arm_ts"))


@query("one_event", sql(f"""
    SELECT event_ticker, arg_min(speaker, market_ticker) AS speaker, 'sports' AS event_type, coalesce(min(coalesce(occurrence_ts, close_ts)), 0) AS occurrence_ts,
           count(*) AS n_markets, false AS time_known
    FROM ({_OPEN.format(m='markets')}) WHERE event_ticker = 'EV13-24JAN13' AND eligible AND trim(result) = '' GROUP BY event_ticker""", "markets"))
def one_event(spark, sf_dir):
    return occasions.select_event(_open_markets(spark, sf_dir), "EV13-24JAN13")


@query("ticker_dates", sql("""
    SELECT market_ticker, CASE WHEN dd BETWEEN 1 AND 31 THEN 1704067200 + (dd - 1) * 86400 + 5 * 3600 END AS day_start,
           CASE WHEN dd BETWEEN 1 AND 31 THEN 1704067200 + dd * 86400 + 5 * 3600 END AS day_end,
           CASE WHEN dd BETWEEN 1 AND 31 THEN 1704067200 + (dd - 1) * 86400 + 17 * 3600 END AS noon
    FROM (SELECT *, CAST(right(event_ticker, 2) AS BIGINT) AS dd FROM markets)""", "markets"))
def ticker_dates(spark, sf_dir):
    day = times.ticker_date(F.col("event_ticker"))
    return views.markets(spark, sf_dir).select("market_ticker", times.day_start(day).alias("day_start"), times.day_end(day).alias("day_end"), times.day_noon(day).alias("noon"))


@query("month_spine", sql("""
    SELECT year(m) AS year, month(m) AS month, strftime(m, '%Y%m%d000000') AS start_digits, strftime(m + INTERVAL 1 MONTH, '%Y%m%d000000') AS end_digits
    FROM (SELECT unnest(range(date_trunc('month', make_timestamp(lo * 1000000)), date_trunc('month', make_timestamp(hi * 1000000)) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS m
          FROM (SELECT min(date_ts) AS lo, max(date_ts) AS hi FROM corpus))""", "corpus"))
def month_spine(spark, sf_dir):
    bounds = views.corpus(spark, sf_dir).agg(
        F.date_format(F.timestamp_seconds(F.min("date_ts")), "yyyy-MM").alias("start_month"),
        F.date_format(F.timestamp_seconds(F.max("date_ts")), "yyyy-MM").alias("end_month"))
    return times.month_spine(bounds)


# --- summaries ------------------------------------------------------------------------------------

_COLUMNS = ["format", "status", "template", "resolution_risk", "speaker"]


@query("profile_counts", sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM registry_ GROUP BY {c}" for c in _COLUMNS), "registry_"))
def profile_counts(spark, sf_dir):
    return profile.value_counts(_registry(spark, sf_dir, *_COLUMNS), _COLUMNS)


@query("corpus_summary", sql("""
    SELECT source, count(*) AS n_docs, count(DISTINCT speaker) AS n_speakers,
           sum(len(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda t: t <> '')))::BIGINT AS n_words, min(date_ts) AS first_ts, max(date_ts) AS last_ts
    FROM corpus GROUP BY source""", "corpus"))
def corpus_summary(spark, sf_dir):
    from tapeline.functions.text import word_count

    return profile.corpus_summary(views.corpus(spark, sf_dir).withColumn("n_words", word_count(F.col("text"))))


@query("busiest_ticker", sql("SELECT ticker, count(*) AS n FROM ticks GROUP BY 1 ORDER BY n DESC, ticker LIMIT 1", "ticks"))
def busiest_ticker(spark, sf_dir):
    return profile.top_values(views.ticks(spark, sf_dir), "ticker", 1)


@query("top_speakers", sql("SELECT speaker, count(*) AS n FROM corpus GROUP BY 1 ORDER BY n DESC, speaker LIMIT 8", "corpus"))
def top_speakers(spark, sf_dir):
    return profile.top_values(views.corpus(spark, sf_dir), "speaker", 8)


@query("run_summary", sql("""
    SELECT w.occasion_id, coalesce(n_ticks, 0) AS n_ticks, coalesce(n_markets, 0) AS n_markets, n_words, least(t0, w0) AS capture_start_utc, greatest(t1, w1) AS capture_end_utc,
           w0 AS speech_start_utc, w1 AS speech_end_utc
    FROM (SELECT occasion_id, count(*) AS n_words, min(t_start_utc) AS w0, max(t_end_utc) AS w1 FROM words GROUP BY 1) w
    LEFT JOIN (SELECT CAST(substr(ticker, 2) AS BIGINT) AS occasion_id, count(*) AS n_ticks, count(DISTINCT ticker) AS n_markets, min(recv_utc) AS t0, max(recv_utc) AS t1
               FROM ticks GROUP BY 1) t USING (occasion_id)""", "words", "ticks"))
def run_summary(spark, sf_dir):
    w = views.words(spark, sf_dir)
    t = views.ticks(spark, sf_dir).withColumn("occasion_id", F.substring("ticker", 2, 20).cast("bigint"))
    return profile.run_summary(w.select("occasion_id").distinct(), t, w)

"""Market universe: catalog, rule parsing, registry, review and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.functions import prices, text, times
from tapeline.operators.dedup import keep_first
from tapeline.schemas import unique_rows

BINARY_RESULTS = ("yes", "no")
REVIEW_EDITABLE = ("resolution_risk", "confidence", "variant_rule", "phrase", "occasion", "notes")
REVIEW_COLUMNS = [
    "market_ticker", "series_ticker", "speaker", "format", "template", "phrase", "yes_sub_title",
    "variant_rule", "occasion", "resolution_risk", "confidence", "is_nqe", "eligible",
    "n_settlement_sources", "has_candles", "result", "notes", "rules_primary",
]

MARKET_FIELDS = ("ticker", "yes_sub_title", "rules_primary", "rules_secondary", "open_time", "close_time",
                 "occurrence_datetime", "expiration_time", "expected_expiration_time", "result",
                 "volume_fp", "open_interest_fp", "status", "mve_collection_ticker")
MARKET_TYPE = T.StructType([T.StructField(f, T.StringType()) for f in MARKET_FIELDS]
                           + [T.StructField("can_close_early", T.BooleanType())])
SOURCES_TYPE = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("url", T.StringType())]))
EVENT_TYPE = T.StructType([T.StructField(f, T.StringType()) for f in ("event_ticker", "series_ticker", "series_title", "title")]
                          + [T.StructField("settlement_sources", SOURCES_TYPE)])
RAW_SCHEMA = T.StructType([T.StructField("market", MARKET_TYPE), T.StructField("event", EVENT_TYPE)])


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _filled(c: Column) -> Column:
    """A text column with blank as NULL."""
    return F.when(c != "", c)


def without_parlays(raw: DataFrame, order: list[str]) -> DataFrame:
    """First sighting of every market, parlay legs left out."""
    first = keep_first(raw.filter(_filled(F.col("market.ticker")).isNotNull()).withColumn(
        "_k", F.col("market.ticker")), ["_k"], order).drop("_k")
    return first.filter(_filled(F.col("market.mve_collection_ticker")).isNull())


def sweep_counts(raw: DataFrame) -> DataFrame:
    """Markets, events and series seen, and parlay legs excluded."""
    return raw.groupBy(F.col("market.ticker").alias("k")).agg(
        F.max(_filled(F.col("market.mve_collection_ticker")).isNotNull()).alias("parlay"),
        F.any_value("event.event_ticker").alias("e"), F.any_value("event.series_ticker").alias("s"),
    ).agg(F.count("*").alias("n_markets_seen"), F.count_if("parlay").alias("n_parlay_excluded"),
          F.count_distinct("e").alias("n_events"), F.count_distinct("s").alias("n_series"))


def catalog(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Market and event records to catalog rows (X1-X5); columns in ``keep`` go along."""
    m, e = F.col("market"), F.col("event")
    series = F.coalesce(_filled(e["series_ticker"]), F.split(m["ticker"], "-")[0])
    title = F.coalesce(_filled(e["series_title"]), e["title"])
    sources = text.source_names(e["settlement_sources"])
    return raw.select(
        *keep, m["ticker"].alias("market_ticker"), _text(e["event_ticker"]).alias("event_ticker"),
        series.alias("series_ticker"), _text(e["series_title"]).alias("series_title"),
        text.series_speaker(series, title).alias("speaker"), text.market_format(series, title).alias("format"),
        _text(m["yes_sub_title"]).alias("yes_sub_title"), _text(m["rules_primary"]).alias("rules_primary"),
        _text(m["rules_secondary"]).alias("rules_secondary"),
        times.iso_to_seconds(m["open_time"]).alias("open_ts"), times.iso_to_seconds(m["close_time"]).alias("close_ts"),
        times.iso_to_seconds(m["occurrence_datetime"]).alias("occurrence_ts"),
        times.iso_to_seconds(m["expiration_time"]).alias("expiration_ts"),
        _text(m["result"]).alias("result"), prices.number(m["volume_fp"]).alias("volume"),
        prices.number(m["open_interest_fp"]).alias("open_interest"), _text(m["status"]).alias("status"),
        F.array_join(sources, "|").alias("settlement_sources"),
        F.size(sources).cast("bigint").alias("n_settlement_sources"),
        F.lit(False).alias("has_candles"), F.lit(0).cast("bigint").alias("n_candles"),
    )


def resolutions(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rule text to template, speaker, occasion, risk and confidence (X6, X7, X9, X10); columns in ``keep`` go along."""
    m, e = F.col("market"), F.col("event")
    label, rules = _text(m["yes_sub_title"]), text.squeeze(m["rules_primary"])
    second = F.lower(_text(m["rules_secondary"]))
    base = raw.select(
        *keep, m["ticker"].alias("market_ticker"),
        F.coalesce(_filled(e["series_ticker"]), F.split(m["ticker"], "-")[0]).alias("series"),
        text.rule_template(m["rules_primary"], label).alias("template"), rules.alias("_rules"),
        F.trim(label).alias("phrase"), text.phrase_variant(label).alias("_variant"),
        F.coalesce(times.iso_to_seconds(m["close_time"]), times.iso_to_seconds(m["expected_expiration_time"])).alias("cutoff_ts"),
        text.source_names(e["settlement_sources"]).alias("governing_sources"),
        F.coalesce(m["can_close_early"], F.lit(False)).alias("early_resolution"),
        (second.contains("video") & second.contains("primarily used")).alias("_video"),
        second.contains("plural or possessive").alias("_plural"),
    )
    t, n = F.col("template"), F.size("governing_sources")
    nqe = t == "nqe"

    def part(pattern: str, group: int) -> Column:
        return F.trim(F.regexp_extract("_rules", pattern, group))

    company = part(text.EARNINGS_RULE, 2)
    speaker = (
        F.when(t == "earnings", F.concat(F.lit("any "), company, F.lit(" representative")))
        .when(t == "speech", part(text.SPEECH_RULE, 1)).when(t == "duration", part(text.DURATION_RULE, 2))
        .when(t == "superlative", part(text.SUPERLATIVE_RULE, 1)).otherwise(""))

    def undotted(c: Column) -> Column:
        return F.rtrim(c, F.lit("."))

    occasion = (
        F.when(t == "earnings", F.concat(company, F.lit(" earnings call")))
        .when(t == "speech", undotted(part(text.SPEECH_RULE, 3)))
        .when(t == "duration", F.concat(F.lit("public statements "), undotted(part(text.DURATION_RULE, 3))))
        .when(t == "superlative", undotted(part(text.SUPERLATIVE_RULE, 3))).otherwise(""))
    loose = (F.lower("speaker") == "any person") | F.col("speaker").contains(" or ")
    confidence = (
        F.when(nqe, 0.95).when(t == "earnings", 0.9).when((t == "speech") & loose, 0.8).when(t == "speech", 0.9)
        .when(t.isin("duration", "superlative", "length"), 0.85).otherwise(0.4))
    risk = (
        F.when((t == "duration") & (n >= 3), "medium").when(t == "duration", "high")
        .when((t == "earnings") | F.col("_video"), "low").when(n >= 5, "low").when(n >= 1, "medium").otherwise("high"))
    why = (
        F.when((t == "duration") & (n >= 3), text.NOTE_WINDOW_VIDEO)
        .when(t == "duration", text.NOTE_WINDOW_SPARSE)
        .when((t == "earnings") | F.col("_video"), text.NOTE_VIDEO)
        .when(n >= 5, F.concat(n.cast("string"), F.lit(text.NOTE_OUTLETS)))
        .when(n >= 1, F.concat(F.lit(text.NOTE_FEW_OUTLETS[0]), n.cast("string"), F.lit(text.NOTE_FEW_OUTLETS[1])))
        .otherwise(text.NOTE_NO_SOURCE))
    vague = F.col("_variant").isin("count_threshold", "fuzzy")
    bumped = F.when(~vague, F.col("_risk")).when(F.col("_risk") == "low", "medium").otherwise("high")
    note = F.concat_ws(
        "; ", F.concat(F.lit("template="), t),
        F.concat(F.when(t == "other", text.NOTE_UNKNOWN).otherwise(""), why,
                 F.when(vague, F.concat(F.lit(text.NOTE_VAGUE[0]), F.col("_variant"), F.lit(text.NOTE_VAGUE[1]))).otherwise("")),
        F.when(F.col("_plural"), text.NOTE_PLURAL))
    return (
        base.withColumns({"speaker": speaker, "occasion": occasion, "_risk": risk})
        .select(
            *keep, "market_ticker", "series", "template", "speaker", "occasion", "phrase",
            F.when(nqe, "exact").otherwise(F.col("_variant")).alias("variant_rule"), "cutoff_ts", "governing_sources",
            "early_resolution", nqe.alias("cancellation_clause"), nqe.alias("is_nqe"),
            F.when(nqe, "medium").otherwise(bumped).alias("resolution_risk"), confidence.alias("confidence"),
            F.when(nqe, text.NOTE_NQE)
            .otherwise(note).alias("notes"))
    )


def eligible() -> Column:
    """Model-set gate over registry columns."""
    return F.coalesce(
        F.col("template").isin(*text.BINARY_TEMPLATES) & ~F.col("is_nqe")
        & F.col("resolution_risk").isin("low", "medium") & (F.col("confidence") >= 0.8), F.lit(False))


def preferred_speaker(parsed: Column, fallback: Column) -> Column:
    """The parsed speaker unless it is blank or starts with "any " (X8)."""
    p = F.trim(_text(parsed))
    return F.when((p != "") & ~F.lower(p).startswith("any "), p).otherwise(fallback)


def build_registry(cat: DataFrame, res: DataFrame) -> DataFrame:
    """Catalog joined one to one with its resolutions (J1). See ``unresolved_markets`` for the rest.

    A market that either side lists twice fails the query.
    """
    for name, default in (("has_candles", F.lit(False)), ("n_candles", F.lit(0).cast("bigint"))):
        if name not in cat.columns:
            cat = cat.withColumn(name, default)
    return _matched(cat, res)


def _matched(cat: DataFrame, res: DataFrame) -> DataFrame:
    r = res.withColumnRenamed("speaker", "_parsed").drop("series")
    if "governing_sources" in r.columns:
        r = r.withColumn("governing_sources", F.array_join("governing_sources", "|"))
    both = unique_rows(cat, ["market_ticker"], "catalog").join(unique_rows(r, ["market_ticker"], "resolution"), "market_ticker")
    if "_parsed" in r.columns:
        both = both.withColumn("speaker", preferred_speaker(F.col("_parsed"), F.col("speaker"))).drop("_parsed")
    return both.withColumn("eligible", eligible())


def registry_columns(raw: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """``columns`` of the registry of raw records, the first sighting of each market, parlay legs left out.

    The rows of ``build_registry`` over ``without_parlays``, but records become rows before the first of
    each market is picked, so aggregates, shuffle and join hold the wanted columns and never a whole record.
    """
    wanted = {*columns, "template", "is_nqe", "resolution_risk", "confidence"}
    marks = (*order, "_parlay")

    def row(df: DataFrame, name: str, keep: tuple[str, ...]) -> DataFrame:
        return df.select(*keep, F.struct(*[c for c in df.columns if c in wanted and c not in ("market_ticker", *keep)]).alias(name))

    marked = raw.filter(_filled(F.col("market.ticker")).isNotNull()).withColumn("_parlay", _filled(F.col("market.mve_collection_ticker")).isNotNull())
    res = row(resolutions(marked, (*marks, "market", "event")), "_res", (*marks, "market", "event"))
    cat = row(catalog(res, (*marks, "_res")), "_cat", (*marks, "_res", "market_ticker"))
    first = keep_first(cat, ["market_ticker"], order).filter(~F.col("_parlay"))
    return _matched(first.select("market_ticker", "_cat.*"), first.select("market_ticker", "_res.*")).select(*columns)


def unresolved_markets(cat: DataFrame, res: DataFrame) -> DataFrame:
    """Catalog markets without a resolution."""
    return cat.join(res.select("market_ticker"), "market_ticker", "left_anti")


def apply_review(registry: DataFrame, review: DataFrame) -> DataFrame:
    """Overlay the edited columns where an edit is present and recompute eligibility."""
    names = [c for c in REVIEW_EDITABLE if c in review.columns]
    edits = review.select("market_ticker", *[F.col(c).alias(f"_edit_{c}") for c in names])
    out = registry.join(edits, "market_ticker", "left").withColumns(
        {c: F.coalesce(f"_edit_{c}", c) for c in names})
    return out.withColumn("eligible", eligible()).select(*registry.columns)


def unknown_edits(registry: DataFrame, review: DataFrame) -> DataFrame:
    """Edits for markets the registry does not have."""
    return review.join(registry.select("market_ticker"), "market_ticker", "left_anti")


def flagged() -> Column:
    """Rows that warrant a human look."""
    return ((F.col("resolution_risk") != "low") | ~F.col("eligible") | (F.col("variant_rule") == "fuzzy")
            | (F.col("confidence") < 0.8))


def _risk_rank() -> Column:
    return F.when(F.col("resolution_risk") == "high", 0).when(F.col("resolution_risk") == "low", 2).otherwise(1)


def review_view(registry: DataFrame, only_flagged: bool = False, rule_chars: int = 200) -> DataFrame:
    """Review rows, worst parses first, rule text on one line and cut (O3)."""
    rows = registry.filter(flagged()) if only_flagged else registry
    return (
        rows.orderBy("confidence", _risk_rank(), "market_ticker")
        .withColumn("rules_primary", F.substring(text.squeeze(F.col("rules_primary")), 1, rule_chars))
        .select(*REVIEW_COLUMNS)
    )


def worst_parses(registry: DataFrame, n: int) -> DataFrame:
    """The n lowest-confidence markets (O1)."""
    return registry.orderBy("confidence", "market_ticker").limit(n)


def high_risk(registry: DataFrame, n: int) -> DataFrame:
    """n high-risk markets, by ticker (O1)."""
    return registry.filter(F.col("resolution_risk") == "high").orderBy("market_ticker").limit(n)


# --- bars per market ------------------------------------------------------------------------------

def target_markets(registry: DataFrame) -> DataFrame:
    """Eligible markets with a scorable result."""
    return registry.filter(F.col("eligible") & F.col("result").isin(*BINARY_RESULTS))


def unsettled(result: Column) -> Column:
    """NULL or blank result."""
    return result.isNull() | (F.trim(result) == "")


def life_windows(registry: DataFrame, pre_days: int = 30, post_days: int = 2) -> DataFrame:
    """Time window of each market's bars; unknown or empty windows are dropped."""
    before, after = pre_days * times.DAY_S, post_days * times.DAY_S
    start = F.coalesce(F.col("open_ts"), F.col("occurrence_ts") - before, F.col("close_ts") - before)
    end = F.greatest("close_ts", "expiration_ts", "occurrence_ts") + after
    return registry.select(F.col("market_ticker").alias("ticker"), start.alias("start"), end.alias("end")).filter(
        F.col("end") > F.col("start"))


def first_windows(windows: DataFrame, n: int) -> DataFrame:
    """The first n windows by end and ticker (O2)."""
    return windows.orderBy("end", "ticker").limit(n)


def bars_of_targets(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Bars of wanted markets only."""
    return bars.join(windows.select("ticker").distinct(), "ticker", "left_semi")


def attach_coverage(cat: DataFrame, bars: DataFrame, pad_days: int = 2) -> DataFrame:
    """Bar count and flag per market, over the catalog-wide time window.

    Bars are counted per ticker before the join.
    """
    pad = pad_days * times.DAY_S
    both = F.col("open_ts").isNotNull() & F.col("close_ts").isNotNull()
    lo, hi = cat.filter(both).agg(F.min("open_ts") - pad).scalar(), cat.filter(both).agg(F.max("close_ts") + pad).scalar()
    counts = (
        bars.filter((F.col("ts") >= lo) & (F.col("ts") <= hi))
        .groupBy(F.col("ticker").alias("market_ticker")).agg(F.count("*").alias("_n"))
        .join(cat.filter(both).select("market_ticker"), "market_ticker", "left_semi")
    )
    out = cat.drop("n_candles", "has_candles").join(counts, "market_ticker", "left")
    return out.withColumn("n_candles", F.coalesce("_n", F.lit(0))).withColumn(
        "has_candles", F.col("n_candles") > 0).drop("_n")


def coverage_stats(bars: DataFrame, registry: DataFrame) -> DataFrame:
    """Targets, those with bars, those without, and all bars."""
    have = bars.groupBy(F.col("ticker").alias("market_ticker")).agg(F.count("*").alias("n"))
    targets = target_markets(registry).select("market_ticker").withColumn("_target", F.lit(True))
    return targets.join(have, "market_ticker", "full_outer").agg(
        F.count("_target").alias("n_target"),
        F.count_if(F.col("_target") & F.col("n").isNotNull()).alias("n_covered"),
        F.count_if(F.col("_target") & F.col("n").isNull()).alias("n_missing"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_bars"))

"""The input views of ``views.py`` as SQL common table expressions."""

from __future__ import annotations

from tapeline.plans.views import SPEAKERS, SPECS

_SPEC_ROWS = ", ".join(f"('{t}', '{p}')" for t, p in SPECS)
_SPEAKER_LIST = ", ".join(f"'{s}'" for s in SPEAKERS)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """
        SELECT event_id, user_id, event_type,
               CAST(30 + user_id % 40 + CAST(floor(value) AS BIGINT) % 12 AS BIGINT) AS c,
               CAST(floor(epoch(ts)) AS BIGINT) AS s
        FROM events"""),
    "ticks": (("ev",), """
        SELECT 'U' || user_id AS ticker, 1700000000 + (s - 1704067200) // 600 AS recv_utc,
               event_id AS seq, c / 100.0 AS yes_bid,
               CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 17 = 0 THEN (c - 1) / 100.0
                    ELSE (c + 1 + event_id % 4) / 100.0 END AS yes_ask,
               CASE WHEN event_id % 19 <> 0 THEN CAST(event_id * 7 % 130 AS DOUBLE) END AS depth_bid,
               CASE WHEN event_id % 29 <> 0 THEN CAST(event_id * 11 % 130 AS DOUBLE) END AS depth_ask
        FROM ev"""),
    "candles": (("ev",), """
        SELECT 'U' || user_id AS ticker, s // 86400 * 86400 + 86400 AS ts, 1440 AS period_minutes,
               arg_max(c, event_id) / 100.0 AS yes_bid_close,
               (arg_max(c, event_id) + arg_max(1 + event_id % 4, event_id)) / 100.0 AS yes_ask_close,
               (min(c) - 1) / 100.0 AS price_low, (max(c) + 3) / 100.0 AS price_high,
               (arg_max(c, event_id) + 1) / 100.0 AS price_close, CAST(count(*) AS DOUBLE) AS volume
        FROM ev GROUP BY user_id, s // 86400"""),
    "predictions": (("ev",), """
        SELECT DISTINCT 'U' || user_id AS market_ticker,
               CASE WHEN user_id % 37 <> 5 THEN 1704067200 + (user_id % 25 + 2) * 86400 + 43200 END AS decision_ts,
               CASE WHEN user_id % 2 = 0 THEN 'test' ELSE 'train' END AS split,
               CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS y,
               user_id * 53 % 100 / 100.0 AS p_base, user_id * 71 % 100 / 100.0 AS p_topic,
               user_id * 37 % 100 / 100.0 AS p_cal
        FROM ev"""),
    "registry": (("ev",), """
        SELECT 'U' || user_id AS market_ticker,
               'EV' || (user_id % 30) || '-24JAN' || lpad(CAST(user_id % 35 AS VARCHAR), 2, '0') AS event_ticker,
               'S' || (user_id % 7) AS series_ticker,
               CASE WHEN user_id % 5 <> 0 THEN 'Remarks ' || event_type || ' Debate and Dinner'
                    ELSE 'Weekly press conference' END AS series_title,
               'occ' || (user_id % 12) AS occasion, 'spk' || (user_id % 11) AS speaker,
               (['earnings','speech','broadcast','sports'])[user_id % 5 + 1] AS format,
               (['low','medium','high'])[user_id % 4 + 1] AS resolution_risk,
               (['speech','earnings','duration','other'])[user_id % 4 + 1] AS template,
               user_id % 9 = 0 AS is_nqe, (50 + user_id % 51) / 100.0 AS confidence,
               'label ' || (user_id % 17) AS yes_sub_title,
               (['yes','no','','scalar'])[user_id % 4 + 1] AS result,
               d - CASE WHEN user_id % 8 <> 0 THEN 20 * 86400 END AS open_ts,
               d + CASE WHEN user_id % 6 <> 0 THEN 3 * 86400 END AS close_ts,
               d + CASE WHEN user_id % 7 <> 0 THEN 7200 END AS occurrence_ts,
               d + CASE WHEN user_id % 10 <> 0 THEN 5 * 86400 END AS expiration_ts,
               ingest_seq
        FROM (SELECT user_id, event_type, min(event_id) AS ingest_seq,
                     1704067200 + (user_id % 25 + 2) * 86400 + 43200 AS d
              FROM ev GROUP BY ALL)"""),
    "markets": (("registry",), """
        SELECT *, coalesce(template IN ('speech','earnings','duration') AND NOT is_nqe
                           AND resolution_risk IN ('low','medium') AND confidence >= 0.8, false) AS eligible
        FROM registry QUALIFY row_number() OVER (PARTITION BY market_ticker ORDER BY ingest_seq) = 1"""),
    "words": ((), """
        SELECT doc_id AS occasion_id, i AS word_idx, word,
               base - CASE WHEN (i + 1) % 97 = 0 THEN 2 ELSE 0 END AS t_start_utc,
               base + 1 AS t_end_utc, 'asr-' || lang AS source,
               CASE WHEN i % 50 = 7 THEN -1.0 WHEN i % 3 = 0 THEN (i % 90 + 10) / 100.0 END AS asr_conf
        FROM (SELECT doc_id, lang, word, i, 1700000000 + (doc_id % 40) * 60 + i * 2 // 5 + i // 200 * 75 AS base
              FROM (SELECT doc_id, lang, unnest(ws) AS word, CAST(unnest(range(len(ws))) AS BIGINT) AS i
                    FROM (SELECT doc_id, lang,
                                 list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda t: t <> '') AS ws
                          FROM documents)))"""),
    "specs": ((), f"SELECT * FROM (VALUES {_SPEC_ROWS}) AS v(market_ticker, phrase)"),
    "corpus": ((), f"""
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, ([{_SPEAKER_LIST}])[doc_id % 8 + 1] AS speaker,
               (['speech','earnings','broadcast'])[doc_id % 3 + 1] AS format,
               1700000000 + doc_id * 86400 AS date_ts, source, text
        FROM documents"""),
    "raw": ((), """
        SELECT p_partkey AS k, sighting, CASE WHEN sighting = 0 THEN 'open' ELSE 'closed' END AS status,
               series || '-24FEB' || day || '-' || p_partkey AS ticker, series || '-24FEB' || day AS event_ticker,
               CASE WHEN p_partkey % 10 <> 0 THEN series END AS series_ticker, series, title AS series_title,
               CASE p_partkey % 7
                 WHEN 0 THEN 'If ' || s_name || ' says ' || p_name || ' as part of ' || p_type || ' remarks., then the market resolves to Yes.'
                 WHEN 1 THEN 'If ' || p_name || ' is said by any ' || s_name || ' representative (including the operator) during the next ' || s_name || ' earnings call, then the market resolves to Yes.'
                 WHEN 2 THEN 'If ' || p_name || ', or a plural or possessive form of the word, is stated by ' || s_name || ' before Jan 5., then the market resolves to Yes.'
                 WHEN 3 THEN 'If ' || s_name || ' speaks for 30 minutes at ' || p_type || ', then the market resolves to Yes.'
                 WHEN 4 THEN 'If any person or ' || s_name || ' mentions the topic of ' || p_name || ' most as part of ' || p_type || ', then the market resolves to Yes.'
                 WHEN 5 THEN 'If a qualifying event does not occur, then the market resolves to Yes.'
                 ELSE 'Resolved by ' || s_name || '.' END AS rules,
               CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'Oil / Gas' WHEN 2 THEN 'Afford / Affordable' WHEN 3 THEN p_name || ' (3+ times)' ELSE '' END AS label,
               CASE p_partkey % 3 WHEN 0 THEN 'Video of the event is primarily used.' WHEN 1 THEN 'Plural or possessive forms count: a plural or possessive form.' ELSE '' END AS second,
               CASE WHEN p_partkey % 9 <> 0 THEN CAST(epoch(CAST('2024-01-' || day AS TIMESTAMP)) AS BIGINT) END AS open_ts,
               CASE WHEN p_partkey % 11 <> 0 THEN CAST(epoch(CAST('2024-02-' || day || ' 10:00:00' AS TIMESTAMP)) AS BIGINT) END AS close_ts,
               CASE WHEN p_partkey % 4 <> 0 THEN CAST(epoch(CAST('2024-02-' || day || ' 10:00:00' AS TIMESTAMP)) AS BIGINT) END AS occurrence_ts,
               CAST(epoch(CAST('2024-03-' || day AS TIMESTAMP)) AS BIGINT) AS expiration_ts,
               CASE p_partkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END AS result,
               CASE WHEN p_partkey % 8 <> 0 THEN CAST(p_partkey * 3 AS DOUBLE) END AS volume, CAST(p_partkey % 100 AS DOUBLE) AS open_interest,
               p_partkey % 13 = 0 AS parlay, p_partkey % 2 = 0 AS early,
               list_filter(['Outlet 0', 'Outlet 1', '', 'Outlet 3', 'Outlet 4', 'Outlet 5'][1:p_partkey % 6], lambda x: x <> '') AS sources,
               s_name, p_name, p_type
        FROM (SELECT p.*, s.s_name, lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS day,
                     (['KXNFLMENTION', 'KXEARNINGSMENTION', 'KXDWTS', 'KXFTN', 'KXTALK', 'KXSNL'])[p_partkey % 6 + 1] AS series,
                     (['Game Mention', 'Acme Earnings Call', 'Dancing: mention', 'Face the Nation - Mention', 'Town Hall Mention', ''])[p_partkey % 6 + 1] AS title
              FROM part p JOIN supplier s ON p_partkey % (SELECT count(*) FROM supplier) = s_suppkey),
             (SELECT unnest([0, 1]) AS sighting)
        WHERE sighting = 0 OR p_partkey % 4 = 0"""),
    "kept": (("raw",), "SELECT * FROM raw WHERE sighting = 0 AND NOT parlay"),
    "catalog_": (("kept",), """
        SELECT ticker AS market_ticker, event_ticker, coalesce(series_ticker, series) AS series_ticker, series_title,
               CASE k % 6 WHEN 0 THEN 'Game' WHEN 1 THEN 'Acme' WHEN 2 THEN 'Dancing' WHEN 3 THEN 'Face the Nation' WHEN 4 THEN 'Town Hall' ELSE 'State of Play special' END AS speaker,
               CASE k % 6 WHEN 0 THEN 'sports' WHEN 1 THEN 'earnings' WHEN 2 THEN 'entertainment' WHEN 3 THEN 'broadcast' WHEN 4 THEN 'speech' ELSE 'entertainment' END AS format,
               label AS yes_sub_title, rules AS rules_primary, second AS rules_secondary, open_ts, close_ts, occurrence_ts, expiration_ts, result,
               volume, open_interest, status, array_to_string(sources, '|') AS settlement_sources, CAST(len(sources) AS BIGINT) AS n_settlement_sources,
               false AS has_candles, CAST(0 AS BIGINT) AS n_candles
        FROM kept"""),
    "parsed_": (("kept",), """
        SELECT *, CASE WHEN template = 'nqe' THEN 'medium' WHEN vague AND base = 'low' THEN 'medium' WHEN vague THEN 'high' ELSE base END AS resolution_risk,
               CASE WHEN template = 'nqe' THEN 'qualifying-event-does-not-occur leg (cancellation clause); not a phrase pred'
                    ELSE 'template=' || template || '; ' || CASE WHEN template = 'other' THEN 'unrecognized rule template — needs manual parse; ' ELSE '' END || why ||
                         CASE WHEN vague THEN '; +' || variant || ' ambiguity' ELSE '' END ||
                         CASE WHEN second LIKE '%a plural or possessive%' THEN '; plural/possessive accepted' ELSE '' END END AS notes
        FROM (SELECT *, variant IN ('count_threshold', 'fuzzy') AS vague,
                     CASE WHEN template = 'duration' THEN CASE WHEN n >= 3 THEN 'medium' ELSE 'high' END WHEN template = 'earnings' OR video THEN 'low'
                          WHEN n >= 5 THEN 'low' WHEN n >= 1 THEN 'medium' ELSE 'high' END AS base,
                     CASE WHEN template = 'duration' THEN CASE WHEN n >= 3 THEN 'windowed statement, no canonical video → outlet-miss risk'
                                                               ELSE 'windowed statement, sparse approved sources → high miss risk' END
                          WHEN template = 'earnings' OR video THEN 'video/transcript-primary resolution → low approved-outlet-miss risk'
                          WHEN n >= 5 THEN n || ' approved outlets → low miss risk'
                          WHEN n >= 1 THEN 'only ' || n || ' approved source(s) → outlet-dependency risk' ELSE 'no governing source declared' END AS why
              FROM (SELECT ticker AS market_ticker, coalesce(series_ticker, series) AS series, second, event_ticker, coalesce(series_ticker, series) AS series_ticker, series_title,
                           CASE k % 6 WHEN 0 THEN 'Game' WHEN 1 THEN 'Acme' WHEN 2 THEN 'Dancing' WHEN 3 THEN 'Face the Nation' WHEN 4 THEN 'Town Hall' ELSE 'State of Play special' END AS listed_speaker,
                           CASE k % 6 WHEN 0 THEN 'sports' WHEN 1 THEN 'earnings' WHEN 2 THEN 'entertainment' WHEN 3 THEN 'broadcast' WHEN 4 THEN 'speech' ELSE 'entertainment' END AS format,
                           rules, open_ts, close_ts, occurrence_ts, expiration_ts, result, volume, open_interest, status, len(sources) AS n, second LIKE 'Video%' AS video,
                           (['speech', 'earnings', 'duration', 'length', 'superlative', 'nqe', 'other'])[k % 7 + 1] AS template,
                           CASE k % 7 WHEN 0 THEN s_name WHEN 1 THEN 'any ' || s_name || ' representative' WHEN 2 THEN s_name WHEN 4 THEN 'any person or ' || s_name ELSE '' END AS speaker,
                           CASE k % 7 WHEN 0 THEN p_type || ' remarks' WHEN 1 THEN s_name || ' earnings call' WHEN 2 THEN 'public statements before Jan 5' WHEN 4 THEN p_type ELSE '' END AS occasion,
                           label AS phrase, CASE k % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'aliases_listed' WHEN 2 THEN 'plural_possessive' WHEN 3 THEN 'count_threshold' ELSE 'fuzzy' END AS variant,
                           CASE WHEN k % 7 = 5 THEN 'exact' ELSE CASE k % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'aliases_listed' WHEN 2 THEN 'plural_possessive' WHEN 3 THEN 'count_threshold' ELSE 'fuzzy' END END AS variant_rule,
                           coalesce(close_ts, expiration_ts) AS cutoff_ts, sources AS governing_sources, early AS early_resolution,
                           k % 7 = 5 AS cancellation_clause, k % 7 = 5 AS is_nqe,
                           CAST((['0.9', '0.9', '0.85', '0.85', '0.85', '0.95', '0.4'])[k % 7 + 1] AS DOUBLE) AS confidence
                    FROM kept))"""),
    "res_": (("parsed_",), """
        SELECT market_ticker, series, second, n, video, template, speaker, occasion, phrase, variant, variant_rule, cutoff_ts, governing_sources, early_resolution, cancellation_clause, is_nqe,
               confidence, vague, base, why, resolution_risk, notes FROM parsed_"""),
    "registry_": (("parsed_",), """
        SELECT market_ticker, event_ticker, series_ticker, series_title, format, phrase AS yes_sub_title, rules AS rules_primary, second AS rules_secondary, open_ts, close_ts, occurrence_ts,
               expiration_ts, result, volume, open_interest, status, array_to_string(governing_sources, '|') AS settlement_sources, CAST(n AS BIGINT) AS n_settlement_sources,
               false AS has_candles, CAST(0 AS BIGINT) AS n_candles,
               CASE WHEN speaker <> '' AND speaker NOT LIKE 'any %' THEN speaker ELSE listed_speaker END AS speaker,
               template, phrase, variant_rule, occasion, cutoff_ts, array_to_string(governing_sources, '|') AS governing_sources, early_resolution,
               cancellation_clause, is_nqe, resolution_risk, confidence, notes,
               template IN ('speech', 'earnings', 'duration') AND NOT is_nqe AND resolution_risk IN ('low', 'medium') AND confidence >= 0.8 AS eligible
        FROM parsed_"""),
    "scores": ((), """
        SELECT l.doc_id, n_chars % 97 / 96.0 AS p_raw, quality AS y, l.doc_id AS ts
        FROM labels l JOIN documents d USING (doc_id)"""),
}


def sql(body: str, *views: str, **ctes: str) -> str:
    """``body`` preceded by the views it needs, then by its own CTEs."""
    parts: dict[str, str] = {}

    def add(name: str) -> None:
        needs, text = VIEWS[name]
        for n in needs:
            add(n)
        parts.setdefault(name, text)

    for v in views:
        add(v)
    parts.update(ctes)
    if not parts:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in parts.items()) + "\n" + body

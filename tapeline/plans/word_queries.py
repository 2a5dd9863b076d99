"""Transcript, phrase, reprice and alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.functions import text, times
from tapeline.operators import align, bars, phrases, reprice, transcripts
from tapeline.plans import views
from tapeline.plans.catalog import query
from tapeline.plans.sqlviews import sql
from tapeline.session import materialize

QA = "lower(regexp_replace(word, '^[^A-Za-z0-9'']+|[^A-Za-z0-9'']+$', '', 'g'))"
CLEAN = ("regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(word), '[^\\x00-\\x7F]', '', 'g')), "
         "'''s\\b', '', 'g'), '[^a-z0-9]', '', 'g')")


def _stem(t: str) -> str:
    return (f"CASE WHEN {t} LIKE '%ing' AND len({t}) >= 6 THEN left({t}, len({t}) - 3) "
            f"WHEN {t} LIKE '%ed' AND len({t}) >= 5 THEN left({t}, len({t}) - 2) "
            f"WHEN {t} LIKE '%es' AND len({t}) >= 5 THEN left({t}, len({t}) - 2) "
            f"WHEN {t} LIKE '%s' AND len({t}) >= 4 THEN left({t}, len({t}) - 1) ELSE {t} END")


# --- transcript QA -------------------------------------------------------------------------------

GAPS = """SELECT occasion_id, pe AS gap_start_utc, t_start_utc AS gap_end_utc, t_start_utc - pe AS duration_s
          FROM (SELECT *, lag(t_end_utc) OVER (PARTITION BY occasion_id ORDER BY t_start_utc, word_idx) AS pe FROM words)
          WHERE t_start_utc - pe > 60"""


@query("gap_scan", sql(GAPS, "words"))
def gap_scan(spark, sf_dir):
    return transcripts.gap_scan(views.words(spark, sf_dir))


@query("throughput", sql("""
    SELECT occasion_id, count(*) AS n_minutes, count(*) FILTER (wpm < 3) AS n_sparse, round(avg(wpm), 9) AS mean_wpm,
           quantile_cont(wpm, 0.5) AS median_wpm, max(wpm) AS max_wpm
    FROM (SELECT occasion_id, t_start_utc // 60 AS m, count(*) AS wpm FROM words GROUP BY ALL) GROUP BY occasion_id""", "words"))
def throughput(spark, sf_dir):
    return transcripts.throughput_summary(transcripts.throughput(views.words(spark, sf_dir))).withColumn(
        "mean_wpm", F.round("mean_wpm", 9))


@query("backward_jumps", sql("""
    SELECT occasion_id, len(m) AS n_backward, m[len(m) // 2 + 1] AS median_s, m[len(m)] AS max_s, n_words, len(m) / n_words AS share
    FROM (SELECT occasion_id, list_sort(list(p - t_start_utc) FILTER (t_start_utc < p)) AS m, count(*) AS n_words
          FROM (SELECT *, lag(t_start_utc) OVER (PARTITION BY occasion_id ORDER BY word_idx) AS p FROM words) GROUP BY occasion_id)
    WHERE len(m) > 0""", "words"))
def backward_jumps(spark, sf_dir):
    return transcripts.backward_jumps(views.words(spark, sf_dir))


@query("same_start_runs", sql("""
    SELECT occasion_id, min(word_idx) AS word_idx, min(t_start_utc) AS t_start_utc, count(*) AS n_words
    FROM (SELECT *, sum(c) OVER (PARTITION BY occasion_id ORDER BY word_idx) AS run
          FROM (SELECT *, CASE WHEN t_start_utc IS DISTINCT FROM lag(t_start_utc) OVER (PARTITION BY occasion_id ORDER BY word_idx)
                          THEN 1 ELSE 0 END AS c FROM words))
    GROUP BY occasion_id, run HAVING count(*) >= 3""", "words"))
def same_start_runs(spark, sf_dir):
    return transcripts.same_start_runs(views.words(spark, sf_dir), 3)


@query("non_ascii", sql("""
    SELECT occasion_id, count(*) AS n_non_ascii, array_to_string(list(word ORDER BY word_idx)[1:10], ' ') AS sample
    FROM words WHERE regexp_matches(word, '[^\\x00-\\x7F]') GROUP BY occasion_id""", "words"))
def non_ascii(spark, sf_dir):
    return transcripts.non_ascii(views.words(spark, sf_dir)).withColumn("sample", F.array_join("sample", " "))


def _thanking(words):
    """The word view with two frequent neighbours renamed, so the filler phrase occurs in it."""
    t = text.qa_token(F.col("word"))
    return words.withColumn("word", F.when(t == "of", "Thank").when(t == "the", "you,").otherwise(F.col("word")))


@query("thanks_clusters", sql(f"""
    SELECT occasion_id, min(word_idx) AS word_idx, count(*) AS n, arg_min(t_start_utc, word_idx) AS t_first, arg_max(t_start_utc, word_idx) AS t_last
    FROM (SELECT *, sum(c) OVER (PARTITION BY occasion_id ORDER BY word_idx) AS g
          FROM (SELECT *, CASE WHEN word_idx - lag(word_idx) OVER (PARTITION BY occasion_id ORDER BY word_idx) <= 50 THEN 0 ELSE 1 END AS c
                FROM (SELECT *, {QA} AS tok, lead({QA}) OVER (PARTITION BY occasion_id ORDER BY word_idx) AS nxt FROM words)
                WHERE tok = 'of' AND nxt = 'the'))
    GROUP BY occasion_id, g""", "words"))
def thanks_clusters(spark, sf_dir):
    return transcripts.thanks_clusters(_thanking(views.words(spark, sf_dir)))


@query("loop_flags", sql(f"""
    SELECT * FROM (WITH RECURSIVE t AS (SELECT occasion_id, word_idx AS i, {QA} AS tok
        FROM (SELECT * REPLACE (CASE WHEN word_idx // 25 % 4 = 1 THEN 'Loop' || (word_idx % 3) || ',' ELSE word END AS word) FROM words)),
    e AS (SELECT occasion_id, i, tok <> '' AND tok IS NOT DISTINCT FROM lead(tok, 3) OVER (PARTITION BY occasion_id ORDER BY i) AS eq,
                 max(i) OVER (PARTITION BY occasion_id) + 1 AS n FROM t),
    r AS (SELECT occasion_id, i, n, coalesce(min(CASE WHEN NOT eq THEN i END) OVER (PARTITION BY occasion_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n) - i AS run FROM e),
    c AS (SELECT occasion_id, i, 1 + run // 3 AS reps FROM r WHERE run >= 6 AND i < n - 9),
    s AS (SELECT occasion_id, min(i) AS i FROM c GROUP BY 1
          UNION ALL
          SELECT s.occasion_id, (SELECT min(d.i) FROM c d WHERE d.occasion_id = s.occasion_id AND d.i >= s.i + 3 * c.reps)
          FROM s JOIN c ON c.occasion_id = s.occasion_id AND c.i = s.i)
    SELECT s.occasion_id, s.i AS word_idx, reps FROM s JOIN c ON c.occasion_id = s.occasion_id AND c.i = s.i)""", "words"))
def loop_flags(spark, sf_dir):
    return transcripts.loop_flags(_looping(views.words(spark, sf_dir)))


def _looping(words):
    """The word view, whole, with a three-word phrase said over and over in every fourth stretch."""
    i = F.col("word_idx")
    return words.withColumn("word", F.when(F.floor(i / 25) % 4 == 1, F.concat(F.lit("Loop"), i % 3, F.lit(","))).otherwise(F.col("word")))


@query("tape_facts", sql(f"""
    SELECT w.occasion_id, n_words, t_first, t_last, n_forced, n_no_conf, CAST(coalesce(b, 0) AS BIGINT) AS blind_s,
           CASE WHEN t_last > t_first THEN coalesce(b, 0) / (t_last - t_first) END AS blind_share
    FROM (SELECT occasion_id, count(*) AS n_words, min(t_start_utc) AS t_first, max(t_end_utc) AS t_last,
                 count(*) FILTER (asr_conf = -1.0) AS n_forced, count(*) FILTER (asr_conf IS NULL) AS n_no_conf
          FROM words GROUP BY occasion_id) w
    LEFT JOIN (SELECT occasion_id, sum(duration_s) AS b FROM ({GAPS}) GROUP BY 1) g USING (occasion_id)""", "words"))
def tape_facts(spark, sf_dir):
    w = views.words(spark, sf_dir)
    return transcripts.tape_facts(w, transcripts.gap_scan(w))


@query("previews", sql("""
    SELECT occasion_id, string_agg(word, ' ' ORDER BY word_idx) AS preview FROM words WHERE word_idx < 40 GROUP BY occasion_id""", "words"))
def previews(spark, sf_dir):
    return transcripts.preview(views.words(spark, sf_dir))


@query("sample_windows", sql("""
    SELECT s.occasion_id, start_idx, arg_min(w.t_start_utc, w.word_idx) AS t_start_utc, string_agg(w.word, ' ' ORDER BY w.word_idx) AS text
    FROM (SELECT occasion_id, word_idx AS start_idx FROM (SELECT *, max(word_idx) OVER (PARTITION BY occasion_id) + 1 AS n FROM words)
          WHERE word_idx < n - 15 OR (n <= 15 AND word_idx = 0)
          QUALIFY row_number() OVER (PARTITION BY occasion_id ORDER BY md5('42:' || occasion_id || ':' || word_idx), word_idx) <= 3) s
    JOIN words w ON w.occasion_id = s.occasion_id AND w.word_idx BETWEEN start_idx AND start_idx + 14 GROUP BY s.occasion_id, start_idx""", "words"))
def sample_windows(spark, sf_dir):
    return transcripts.sample_windows(views.words(spark, sf_dir), 3, 15)


@query("trimmed_tape", sql("""
    SELECT occasion_id, count(*) AS n, max(word_idx) AS last_idx, sum(word_idx * t_start_utc)::BIGINT AS chk
    FROM (SELECT occasion_id, t_start_utc, row_number() OVER (PARTITION BY occasion_id ORDER BY word_idx) - 1 AS word_idx
          FROM words WHERE t_start_utc >= 1700000120) GROUP BY occasion_id""", "words"))
def trimmed_tape(spark, sf_dir):
    return transcripts.trim_tape(views.words(spark, sf_dir), 1_700_000_120).groupBy("occasion_id").agg(
        F.count("*").alias("n"), F.max("word_idx").alias("last_idx"),
        F.sum(F.col("word_idx") * F.col("t_start_utc")).alias("chk"))


@query("token_forms", sql(f"""
    SELECT clean, {_stem('clean')} AS stemmed, qa, count(*) AS n
    FROM (SELECT {CLEAN} AS clean, {QA} AS qa FROM words) GROUP BY ALL""", "words"))
def token_forms(spark, sf_dir):
    clean = text.reprice_token(F.col("word"))
    return views.words(spark, sf_dir).select(
        clean.alias("clean"), text.stem(clean).alias("stemmed"), text.qa_token(F.col("word")).alias("qa")).groupBy(
        "clean", "stemmed", "qa").agg(F.count("*").alias("n"))


@query("local_clock", sql("""
    SELECT occasion_id, strftime(make_timestamp((min(t_start_utc) - 14400) * 1000000), '%H:%M:%S') AS first_clock,
           strftime(make_timestamp((max(t_start_utc) - 14400) * 1000000), '%H:%M:%S') AS last_clock
    FROM words GROUP BY occasion_id""", "words"))
def local_clock(spark, sf_dir):
    return views.words(spark, sf_dir).groupBy("occasion_id").agg(
        times.local_clock(F.min("t_start_utc"), -4.0).alias("first_clock"),
        times.local_clock(F.max("t_start_utc"), -4.0).alias("last_clock"))


# --- phrases -------------------------------------------------------------------------------------

def _vocab(words):
    """The tracked phrases of every occasion."""
    rows = F.array(*[F.struct(F.lit(t).alias("market_ticker"), F.lit(p).alias("phrase")) for t, p in views.SPECS])
    return words.select("occasion_id").distinct().select("occasion_id", F.inline(rows))


REPRICE_HITS = f"""
    SELECT DISTINCT occasion_id, market_ticker, phrase, word_idx, t_start_utc
    FROM (SELECT *, {_stem('c')} AS a, lead({_stem('c')}) OVER (PARTITION BY occasion_id ORDER BY word_idx) AS b
          FROM (SELECT *, {CLEAN} AS c FROM words)) w
    JOIN (SELECT *, list_filter(list_transform(string_split(trim(alias), ' '),
                   lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), lambda x: x <> '') AS ts
          FROM (SELECT *, unnest(string_split(phrase, '/')) AS alias FROM specs)) v
      ON a = ts[1] AND (len(ts) = 1 OR (len(ts) = 2 AND b = ts[2]))"""
EVENTS = """SELECT occasion_id, market_ticker, phrase, t_start_utc AS t_word,
                   count(*) OVER (PARTITION BY occasion_id, market_ticker) AS total_matches_in_tape,
                   lag(t_start_utc) OVER (PARTITION BY occasion_id, market_ticker ORDER BY t_start_utc, word_idx) AS p FROM hits
            QUALIFY p IS NULL OR t_start_utc - p >= 60"""


@query("phrase_matches", sql("SELECT * FROM hits", "words", "specs", hits=REPRICE_HITS))
def phrase_matches(spark, sf_dir):
    return phrases.reprice_matches(views.words(spark, sf_dir), views.specs(spark))


@query("mention_events", sql("SELECT * EXCLUDE (p) FROM events_", "words", "specs", hits=REPRICE_HITS, events_=EVENTS))
def mention_events(spark, sf_dir):
    return _events(views.words(spark, sf_dir), spark)


def _events(words, spark):
    return phrases.mention_events(phrases.reprice_matches(words, views.specs(spark)), 60)


VOCAB_RE = r"\bthe\b|that|from"
CLUSTERS = f"""
    SELECT occasion_id, g, min(t_start_utc) AS t_call, max(t_start_utc) AS t_call_last, count(*) AS n_hits,
           array_to_string(list(word ORDER BY t_start_utc, word_idx), ' ') AS words
    FROM (SELECT *, sum(c) OVER (PARTITION BY occasion_id ORDER BY t_start_utc, word_idx) AS g
          FROM (SELECT *, CASE WHEN t_start_utc - lag(t_start_utc) OVER (PARTITION BY occasion_id ORDER BY t_start_utc, word_idx) <= 20
                          THEN 0 ELSE 1 END AS c
                FROM words WHERE regexp_matches(word, '(?i){VOCAB_RE}')))
    GROUP BY occasion_id, g HAVING count(*) >= 2"""


@query("vocab_clusters", sql("SELECT * EXCLUDE (g) FROM clusters", "words", clusters=CLUSTERS))
def vocab_clusters(spark, sf_dir):
    return _clusters(views.words(spark, sf_dir)).withColumn("words", F.array_join("words", " "))


def _clusters(words):
    return phrases.vocabulary_clusters(phrases.vocabulary_hits(words, VOCAB_RE, 20))


FORMS = {"the": "the|thes", "of / and": "and|ands|of|ofs", "with (3+ times)": "with (3+ times)", "that": "that|thats",
         "was / is": "is|was", "from the": "from the", "Zzz": "zzz|zzzs"}
_FORM_ROWS = ", ".join(f"('{p}', '{f}')" for p, f in FORMS.items())
@query("phrase_hits", sql(f"""
    SELECT k.*, coalesce(n_matches, 0) AS n_matches, t_first_utc, t_last_utc, replace(forms, '|', '; ') AS variants_searched
    FROM (SELECT * FROM (SELECT DISTINCT occasion_id FROM words), specs) k
    JOIN (VALUES {_FORM_ROWS}) f(phrase, forms) USING (phrase)
    LEFT JOIN (SELECT occasion_id, market_ticker, count(DISTINCT word_idx) AS n_matches, arg_min(t_start_utc, word_idx) AS t_first_utc,
                      arg_max(t_start_utc, word_idx) AS t_last_utc
               FROM (SELECT occasion_id, word_idx, t_start_utc, {QA} AS a,
                            lead({QA}) OVER (PARTITION BY occasion_id ORDER BY word_idx) AS b FROM words) w
               JOIN (SELECT market_ticker, unnest(string_split(forms, '|')) AS form FROM specs JOIN (VALUES {_FORM_ROWS}) f(phrase, forms) USING (phrase)) v
                 ON form = a OR form = a || ' ' || b
               GROUP BY ALL) h USING (occasion_id, market_ticker)""", "words", "specs"))
def phrase_hits(spark, sf_dir):
    w = views.words(spark, sf_dir)
    return phrases.hit_rate(w, _vocab(w))


@query("phrase_forms", """
    SELECT phrase, string_agg(form, '; ' ORDER BY form) AS forms FROM (
        SELECT DISTINCT phrase, unnest(CASE WHEN w LIKE '%s' THEN [w] ELSE [w, w || 's'] END) AS form
        FROM (SELECT split_part(p_name, ' ', 1) || ' / ' || split_part(p_name, ' ', 2) AS phrase, lower(unnest(string_split(p_name, ' ')[1:2])) AS w FROM part))
    GROUP BY phrase""")
def phrase_forms(spark, sf_dir):
    """Surface forms of the part names' words as alternates."""
    w = F.split("p_name", " ")
    phrases_ = views.table(spark, sf_dir, "part").select(F.concat_ws(" / ", F.get(w, F.lit(0)), F.get(w, F.lit(1))).alias("phrase")).distinct()
    return phrases_.select("phrase", F.array_join(F.array_sort(text.surface_forms(F.col("phrase"))), "; ").alias("forms"))


SPEC_LABELS = ("the", "of / and", "With (3+ times)", "that", "was / is", "From the", "the / and (12+ times)", "")
# label, terms after the plural rule as one token pattern, key, least count
_SPEC_SQL = """(VALUES ('the', '(the)', 1), ('and|of', '(of|and)', 1), ('with|>=3', '(with)', 3), ('that', '(that)', 1),
    ('is|was', '(was|is)', 1), ('from the', '(from\\s+the)', 1), ('and|the|>=12', '(the|and)', 12)) AS s(phrase_key, pat, need)"""
_KEYS_SQL = """CASE doc_id::BIGINT % 8 WHEN 0 THEN 'jerome powell' WHEN 1 THEN 'jerome powell' WHEN 2 THEN 'ada stone' WHEN 3 THEN 'ada stone'
    WHEN 4 THEN 'jerome powell' WHEN 5 THEN 'sen. li' WHEN 6 THEN 'li' ELSE 'kay' END"""


def _spec_groups(spark, sf_dir):
    keys = views.corpus(spark, sf_dir).select(text.speaker_key(F.col("speaker")).alias("speaker_key"), "format").distinct()
    # every label twice, so that the first one per phrase key has to be picked
    labels = F.array(*[F.lit(x) for x in SPEC_LABELS * 2])
    return keys.select("speaker_key", "format", F.posexplode(labels).alias("ord", "label"))


@query("occurrence_index", sql(f"""
    SELECT doc_id, {_KEYS_SQL} AS speaker_key, format, phrase_key, date_ts, n >= need AS occurred, n AS "count"
    FROM (SELECT *, len(regexp_extract_all(regexp_replace(text, '([^A-Za-z])', '\\1\\1', 'g'),
                        '(?i)(^|[^A-Za-z])' || replace(pat, '\\s+', '\\s+') || '(''s''?s?|’’s|es|s)?([^A-Za-z]|$)')) AS n
          FROM corpus, {_SPEC_SQL})""", "corpus"))
def occurrence_index(spark, sf_dir):
    return phrases.occurrence_index(views.corpus(spark, sf_dir), _spec_groups(spark, sf_dir), ["ord"])


@query("speaker_keys", sql(f"SELECT speaker, {_KEYS_SQL} AS speaker_key, count(*) AS n FROM corpus GROUP BY ALL", "corpus"))
def speaker_keys(spark, sf_dir):
    return views.corpus(spark, sf_dir).groupBy("speaker", text.speaker_key(F.col("speaker")).alias("speaker_key")).agg(
        F.count("*").alias("n"))


@query("word_counts", sql("""
    SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda t: t <> '')) AS n_words,
           left(sha1(source || '|' || doc_id || '|'), 16) AS hid FROM documents"""))
def word_counts(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.word_count(F.col("text")).alias("n_words"),
                    text.short_hash(F.col("source"), F.col("doc_id"), F.lit("")).alias("hid"))


# --- reprice -------------------------------------------------------------------------------------

PREP = "SELECT DISTINCT ticker, recv_utc, seq, yes_bid, yes_ask, depth_bid, depth_ask, coalesce((yes_bid + yes_ask) / 2.0, yes_bid, yes_ask) AS mid FROM ticks"
MEASURE = {
    "hits": REPRICE_HITS, "evts": EVENTS, "prep": PREP,
    "uniq": "SELECT DISTINCT market_ticker, t_word FROM evts",
    "base": """SELECT market_ticker, t_word, (m[(len(m) + 1) // 2] + m[len(m) // 2 + 1]) / 2.0 AS baseline
               FROM (SELECT market_ticker, t_word, list_sort(list(mid) FILTER (mid IS NOT NULL)) AS m FROM uniq
                     JOIN prep ON ticker = market_ticker AND recv_utc BETWEEN t_word - 600 AND t_word - 120 GROUP BY ALL)""",
    "win": """SELECT b.*, p.*, mid - baseline AS dev,
                     coalesce(depth_ask < 1e-6, false) OR yes_ask IS NULL OR coalesce(yes_bid >= yes_ask, false) AS pulled
              FROM base b JOIN prep p ON ticker = market_ticker AND recv_utc BETWEEN t_word - 300 AND t_word + 300
              WHERE baseline IS NOT NULL""",
    "moved": """SELECT market_ticker, t_word, arg_min(recv_utc, (recv_utc, seq)) FILTER (abs(dev) >= 0.03) AS t_reprice,
                       arg_min(dev, (recv_utc, seq)) FILTER (abs(dev) >= 0.03) AS reprice_move,
                       min(recv_utc) FILTER (pulled) AS t_pull FROM win GROUP BY ALL""",
    "look": """SELECT market_ticker, t_word, off, p.mid - b.baseline AS mv, p.recv_utc IS NOT NULL AS found,
                      coalesce(p.yes_bid < p.yes_ask AND p.depth_bid >= 1 AND p.depth_ask >= 1, false) AS ok
               FROM (SELECT *, unnest([60, 300, -1]) AS off FROM base WHERE baseline IS NOT NULL) b
               LEFT JOIN LATERAL (SELECT * FROM prep p WHERE p.ticker = b.market_ticker AND p.recv_utc <= b.t_word + b.off
                                  ORDER BY recv_utc DESC, seq DESC LIMIT 1) p ON true""",
    "seen": """SELECT market_ticker, t_word, max(mv) FILTER (off = 60) AS move_60s, max(mv) FILTER (off = 300) AS move_300s,
                      bool_or(ok) FILTER (off = -1 AND found) AS book_valid_at_word FROM look GROUP BY ALL""",
    "measured": """SELECT e.occasion_id, e.market_ticker, e.phrase, e.t_word, e.total_matches_in_tape, t_reprice, t_pull,
                          t_reprice - e.t_word AS lag_s, move_60s, move_300s, reprice_move, book_valid_at_word,
                          coalesce(b.market_ticker IS NOT NULL AND l.last >= e.t_word + 290, false) AS tick_coverage
                   FROM evts e LEFT JOIN base b USING (market_ticker, t_word) LEFT JOIN moved USING (market_ticker, t_word)
                   LEFT JOIN seen USING (market_ticker, t_word)
                   LEFT JOIN (SELECT ticker AS market_ticker, max(recv_utc) AS last FROM prep GROUP BY 1) l USING (market_ticker)""",
}


@query("reprice", sql("SELECT * FROM measured", "words", "specs", "ticks", **MEASURE))
def reprice_measured(spark, sf_dir):
    return reprice.measure(_events(views.words(spark, sf_dir), spark), reprice.prepare(views.ticks(spark, sf_dir)))


@query("lag_stats", sql("""
    SELECT market_ticker, count(*) AS n, quantile_cont(lag_s, 0.25) AS p25, quantile_cont(lag_s, 0.5) AS median,
           quantile_cont(lag_s, 0.75) AS p75, min(lag_s) AS min_s, max(lag_s) AS max_s,
           round(avg(CASE WHEN lag_s < 0 THEN 100.0 ELSE 0.0 END), 9) AS pct_negative
    FROM measured WHERE tick_coverage AND lag_s IS NOT NULL GROUP BY market_ticker""", "words", "specs", "ticks", **MEASURE))
def lag_stats(spark, sf_dir):
    m = reprice.measure(_events(views.words(spark, sf_dir), spark), reprice.prepare(views.ticks(spark, sf_dir)))
    return reprice.lag_stats(m, ["market_ticker"]).withColumn("pct_negative", F.round("pct_negative", 9))


def _moves_ctes(n: int) -> dict[str, str]:
    return {
        "prep": PREP,
        "sec": "SELECT ticker, recv_utc, min(seq) AS seq0 FROM prep GROUP BY ALL",
        "opened": f"""SELECT ticker, recv_utc, first_value({{'r': recv_utc, 's': seq0}}) OVER (PARTITION BY ticker ORDER BY recv_utc
                      RANGE BETWEEN {n} PRECEDING AND CURRENT ROW) AS o FROM sec""",
        "moves": """SELECT p.ticker, p.recv_utc, p.seq, b.mid AS mid_before, p.mid AS mid_after, abs(p.mid - b.mid) AS move_abs
                    FROM prep p JOIN opened o ON o.ticker = p.ticker AND o.recv_utc = p.recv_utc
                    JOIN prep b ON b.ticker = p.ticker AND b.recv_utc = o.o.r AND b.seq = o.o.s
                    WHERE b.seq <> p.seq AND p.mid IS NOT NULL AND b.mid IS NOT NULL
                      AND p.ticker IN (SELECT ticker FROM prep GROUP BY ticker HAVING count(*) >= 3)""",
    }


TOP_CTES = {
    **_moves_ctes(30),
    "ranked": "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY move_abs DESC, recv_utc, seq) AS n FROM moves QUALIFY n <= 30",
    "greedy": """SELECT ticker, list_reduce(list([{'t': recv_utc, 'm': move_abs, 'b': mid_before, 'a': mid_after}] ORDER BY n),
                   lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: abs(k.t - x[1].t) < 300)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept
                 FROM ranked GROUP BY ticker""",
    "top": """SELECT ticker, k.t AS t_event, k.m AS move_abs, k.b AS mid_before, k.a AS mid_after
              FROM (SELECT ticker, unnest(kept) AS k FROM greedy) ORDER BY move_abs DESC, ticker, t_event LIMIT 10""",
}


def _top(spark, sf_dir):
    return reprice.fastest_moves(reprice.step_moves(reprice.prepare(views.ticks(spark, sf_dir)), 30))


@query("step_moves", sql("SELECT * FROM moves", "ticks", **_moves_ctes(20)))
def step_moves(spark, sf_dir):
    return reprice.step_moves(reprice.prepare(views.ticks(spark, sf_dir)), 20)


@query("fast_moves", sql("SELECT * FROM top", "ticks", **TOP_CTES))
def fast_moves(spark, sf_dir):
    return _top(spark, sf_dir)


@query("cross_reaction", sql("""
    SELECT c.occasion_id, c.t_call, c.call_id, m.ticker, m.recv_utc AS t_react, m.mv AS move, m.recv_utc - t_call AS lag_s
    FROM (SELECT occasion_id, t_call, occasion_id || ':' || t_call AS call_id FROM clusters
          WHERE t_call - 90 >= (SELECT min(recv_utc) FROM prep) AND t_call + 180 <= (SELECT max(recv_utc) FROM prep)) c
    LEFT JOIN LATERAL (SELECT ticker, recv_utc, mid_after - mid_before AS mv FROM moves m
               WHERE m.recv_utc BETWEEN t_call - 90 AND t_call + 180 AND move_abs >= 0.04
               ORDER BY recv_utc, ticker, seq LIMIT 1) m ON true""", "words", "ticks", **_moves_ctes(20), clusters=CLUSTERS))
def cross_reaction(spark, sf_dir):
    ticks = reprice.prepare(views.ticks(spark, sf_dir))
    calls = _clusters(views.words(spark, sf_dir)).select(
        "occasion_id", "t_call", F.concat_ws(":", "occasion_id", "t_call").alias("call_id"))
    return reprice.earliest_reaction(reprice.covered_calls(calls, ticks), reprice.step_moves(ticks, 20))


@query("calibration_lags", sql("""
    SELECT count(*) AS n, quantile_cont(lag, 0.25) AS p25, quantile_cont(lag, 0.5) AS median, quantile_cont(lag, 0.75) AS p75, min(lag) AS min_s, max(lag) AS max_s,
           round(avg(CASE WHEN lag < 0 THEN 100.0 ELSE 0.0 END), 9) AS pct_negative
    FROM (SELECT min(m.recv_utc) - any_value(t_call) AS lag FROM clusters c
          JOIN moves m ON m.recv_utc BETWEEN t_call - 90 AND t_call + 180 AND move_abs >= 0.04
          WHERE t_call - 90 >= (SELECT min(recv_utc) FROM prep) AND t_call + 180 <= (SELECT max(recv_utc) FROM prep) GROUP BY occasion_id, t_call)""",
    "words", "ticks", **_moves_ctes(20), clusters=CLUSTERS))
def calibration_lags(spark, sf_dir):
    found = cross_reaction(spark, sf_dir).withColumn("tick_coverage", F.lit(True))
    return reprice.lag_stats(found).withColumn("pct_negative", F.round("pct_negative", 9))


_MEASURED = REPRICE_HITS.replace("SELECT DISTINCT occasion_id, market_ticker, phrase, word_idx, t_start_utc", "SELECT occasion_id, market_ticker, phrase, word_idx, t_start_utc, min(len(ts)) AS n") + " GROUP BY ALL"


@query("moves_near_mentions", sql("""
    SELECT s.ticker, s.t_event, s.occasion_id, h.market_ticker, h.phrase, h.word_idx, h.t_start_utc, h.t_start_utc - s.t_event AS dt_s
    FROM (SELECT ticker, t_event, occasion_id, count(*) FILTER (t_start_utc < t_event - 120) AS lo, count(*) FILTER (t_start_utc < t_event + 120) AS hi
          FROM (SELECT DISTINCT ticker, t_event FROM top), words GROUP BY ALL) s
    JOIN hits h ON h.occasion_id = s.occasion_id AND h.word_idx >= lo - 3 AND h.word_idx + n <= hi + 3""", "words", "specs", "ticks",
    **{**TOP_CTES, "hits": _MEASURED}))
def moves_near_mentions(spark, sf_dir):
    w = views.words(spark, sf_dir)
    return reprice.mentions_near(_top(spark, sf_dir), w, phrases.measured_matches(w, views.specs(spark)))


@query("bar_jumps_vs_hits", sql("""
    SELECT j.ticker, j.ts, round(delta, 9) AS delta, h.n_matches, h.t_first, h.t_last
    FROM (SELECT ticker, ts, price_close - lag(price_close) OVER (PARTITION BY ticker ORDER BY ts) AS delta FROM candles) j
    LEFT JOIN (SELECT market_ticker AS ticker, count(*) AS n_matches, min(t_start_utc) AS t_first, max(t_start_utc) AS t_last
               FROM hits GROUP BY 1) h USING (ticker)
    WHERE abs(delta) > 0.045""", "words", "specs", "candles", hits=REPRICE_HITS))
def bar_jumps_vs_hits(spark, sf_dir):
    hits = phrases.reprice_matches(views.words(spark, sf_dir), views.specs(spark)).groupBy(
        F.col("market_ticker").alias("ticker")).agg(
        F.count("*").alias("n_matches"), F.min("t_start_utc").alias("t_first"), F.max("t_start_utc").alias("t_last"))
    jumps = bars.bar_jumps(views.candles(spark, sf_dir), "price_close", 0.045)
    return jumps.join(hits, "ticker", "left").select("ticker", "ts", F.round("delta", 9).alias("delta"), "n_matches", "t_first", "t_last")


# --- alignment -----------------------------------------------------------------------------------

@query("first_cross", sql("SELECT ticker, min(ts) AS cross_ts FROM candles WHERE coalesce(price_close, (yes_bid_close + yes_ask_close) / 2.0) >= 0.5 GROUP BY ticker", "candles"))
def first_cross(spark, sf_dir):
    return align.first_cross(views.candles(spark, sf_dir), 0.5)


_ANCHOR_LABELS = (("U1", "the"), ("U2", "of / and"), ("U3", "with (3+ times)"), ("U4", "from the / of the"), ("U5", "was"))


def _anchors(words):
    rows = F.array(*[F.struct(F.lit(t).alias("series_key"), F.lit(p).alias("label")) for t, p in _ANCHOR_LABELS])
    return materialize(words.select("occasion_id").distinct().select("occasion_id", F.inline(rows)), "asked")


def _video_words(spark, sf_dir):
    """The word view on video-relative milliseconds."""
    return _on_video(views.words(spark, sf_dir))


def _on_video(words, *carried):
    return words.select(
        "occasion_id", "word_idx", "word",
        (F.col("word_idx") * 400).alias("t_start_ms"), (F.col("word_idx") * 400 + 350).alias("t_end_ms"), *carried)


# Matches on the view's words: an alternate with letters on neither side, plural or possessive.
# Single words are counted inside a word; the pairs also over the next word.
_SAID = """
    SELECT occasion_id, series_key, word_idx * 400 + 350 + CASE WHEN pair THEN 400 ELSE 0 END AS t_end
    FROM (SELECT occasion_id, word_idx, word, lead(word) OVER (PARTITION BY occasion_id ORDER BY word_idx) AS nxt FROM words) w
    JOIN (VALUES ('U1', '(the)', false), ('U2', '(of|and)', false), ('U3', '(with)', false), ('U4', '(from|of)', true),
                 ('U5', '(was)', false)) v(series_key, pat, pair)
      ON CASE WHEN pair THEN regexp_matches(word, '(?i)(^|[^A-Za-z])' || pat || '$') AND regexp_matches(nxt, '(?i)^the(''s|’s|es|s)?([^A-Za-z]|$)')
         ELSE regexp_matches(word, '(?i)(^|[^A-Za-z])' || pat || '(''s|’s|es|s)?([^A-Za-z]|$)') END"""


@query("phrase_times", sql("SELECT occasion_id, series_key, t_end AS t_end_utc, count(*) AS n FROM said GROUP BY ALL", "words", said=_SAID))
def phrase_times(spark, sf_dir):
    w = _video_words(spark, sf_dir).withColumn("t_end_utc", F.col("t_end_ms"))
    return phrases.occurrence_times(w, _anchors(w)).groupBy("occasion_id", "series_key", "t_end_utc").agg(F.count("*").alias("n"))


_ALIGN = {
    "said": _SAID,
    "saidn": """SELECT occasion_id, series_key, t_end FROM said
                QUALIFY row_number() OVER (PARTITION BY occasion_id, series_key ORDER BY t_end) = CASE WHEN series_key = 'U3' THEN 3 ELSE 1 END""",
    "crosses": "SELECT ticker, min(ts) AS cross_ts FROM candles WHERE price_close >= 0.4 AND ts >= 1705000000 GROUP BY ticker",
    "offs": "SELECT occasion_id, series_key, cross_ts - t_end / 1000.0 AS off FROM saidn JOIN crosses ON ticker = series_key",
    "occ": "SELECT DISTINCT occasion_id, CASE WHEN occasion_id % 3 <> 0 THEN 1705017600 + occasion_id % 200 END AS release_start_utc FROM words",
    "mid0": "SELECT occasion_id, (m[(len(m) + 1) // 2] + m[len(m) // 2 + 1]) / 2.0 AS m0 FROM (SELECT occasion_id, list_sort(list(off)) AS m FROM offs GROUP BY 1)",
    "mid1": """SELECT occasion_id, (m[(len(m) + 1) // 2] + m[len(m) // 2 + 1]) / 2.0 AS m1
               FROM (SELECT occasion_id, list_sort(list(off)) AS m FROM offs JOIN mid0 USING (occasion_id) WHERE abs(off - m0) <= 120 GROUP BY 1)""",
    "clock": """SELECT *, CASE WHEN price IS NULL AND release_start_utc IS NULL THEN '' WHEN price IS NULL THEN 'release_only'
                        WHEN release_start_utc IS NULL THEN 'price_only' WHEN abs(release_start_utc - price) <= 120 THEN 'release+price_qa'
                        ELSE 'price_over_release' END AS method
                FROM (SELECT *, coalesce(m1, m0) AS price FROM occ LEFT JOIN mid0 USING (occasion_id) LEFT JOIN mid1 USING (occasion_id))""",
    "started": "SELECT *, CASE WHEN method IN ('release_only', 'release+price_qa') THEN CAST(release_start_utc AS DOUBLE) ELSE price END AS start FROM clock",
    "qa": """SELECT occasion_id, count(*) AS n_anchors, count(*) FILTER (abs(off - start) <= 120) AS n_ok, max(abs(off - start)) AS worst
             FROM offs JOIN started USING (occasion_id) GROUP BY 1""",
    "aligned_": """SELECT occasion_id, CAST(round_even(start, 0) AS BIGINT) AS video_start_utc, coalesce(n_anchors, 0) AS n_anchors, coalesce(n_ok, 0) AS n_ok,
                          round(worst, 6) AS max_abs_residual_s,
                          CASE method WHEN '' THEN false WHEN 'release_only' THEN true WHEN 'release+price_qa' THEN n_ok >= 1
                               ELSE n_ok >= 3 AND n_ok / n_anchors >= 0.5 END AS aligned, method, release_start_utc
                   FROM started LEFT JOIN qa USING (occasion_id)""",
}


def _alignment(spark, sf_dir):
    w = _video_words(spark, sf_dir)
    anchors = _anchors(w)
    said = phrases.said_time(phrases.occurrence_times(w.withColumn("t_end_utc", F.col("t_end_ms")), anchors), anchors)
    crosses = align.first_cross(views.candles(spark, sf_dir), 0.4, (1_705_000_000, 1 << 40))
    offsets = materialize(align.anchor_offsets(said, crosses), "anchors")
    d = F.col("occasion_id")
    occasions = anchors.select("occasion_id").distinct().withColumn(
        "release_start_utc", F.when(d % 3 != 0, 1_705_017_600 + d % 200))
    return w, offsets, align.estimate_alignment(occasions, offsets)


@query("align_anchors", sql("SELECT * FROM aligned_", "words", "candles", **_ALIGN))
def align_anchors(spark, sf_dir):
    return _alignment(spark, sf_dir)[2].withColumn("max_abs_residual_s", F.round("max_abs_residual_s", 6))


@query("anchor_residuals", sql("""
    SELECT o.occasion_id, series_key, round(off - video_start_utc, 6) AS residual_s, round(off - min(off) OVER (PARTITION BY o.occasion_id), 6) AS reaction_lag_s
    FROM offs o JOIN aligned_ a USING (occasion_id)""", "words", "candles", **_ALIGN))
def anchor_residuals(spark, sf_dir):
    _, offsets, alignment = _alignment(spark, sf_dir)
    return align.anchor_residuals(offsets, alignment).withColumns(
        {c: F.round(c, 6) for c in ("residual_s", "reaction_lag_s")})


@query("word_frame", sql("""
    SELECT occasion_id, word_idx, word, video_start_utc + CAST(round_even(word_idx * 400 / 1000.0, 0) AS BIGINT) AS t_start_utc,
           video_start_utc + CAST(round_even((word_idx * 400 + 350) / 1000.0, 0) AS BIGINT) AS t_end_utc, 'captions' AS source,
           CAST(NULL AS DOUBLE) AS asr_conf
    FROM words JOIN aligned_ USING (occasion_id) WHERE video_start_utc IS NOT NULL""", "words", "candles", **_ALIGN))
def word_frame(spark, sf_dir):
    _, _, alignment = _alignment(spark, sf_dir)
    # the documents meet their clocks, as their words are many more bytes
    docs = align.clocked(views.documents(spark, sf_dir).select("doc_id", "lang", "text"), alignment, "doc_id")
    return align.on_clock(_on_video(views.words_of(docs, "video_start_utc"), "video_start_utc"), "captions")

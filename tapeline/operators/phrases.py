"""Phrases in transcripts and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import text
from tapeline.operators.joins import join_small
from tapeline.operators.ordered import by_position, by_seconds, islands, previous
from tapeline.session import materialize

OCCASIONS = 32  # of a caller's function that Python is handed at a time, about


def occurrence_index(corpus: DataFrame, specs: DataFrame, order: list[str]) -> DataFrame:
    """Every document against the phrases asked about its own speaker and format.

    ``corpus``: doc_id, speaker, format, date_ts, text. ``specs``: speaker_key, format, label and
    the ``order`` columns; the first label of a (speaker, format, phrase key) is used. A busy
    speaker's documents are spread over salts.
    """
    s = specs.withColumn("spec", text.phrase_spec(F.col("label"))).select(
        "speaker_key", "format", F.col("spec.phrase_key").alias("phrase_key"),
        F.col("spec.pattern").alias("pattern"), F.col("spec.min_count").alias("min_count"), *order)
    first = s.filter(F.col("pattern").isNotNull()).groupBy("speaker_key", "format", "phrase_key").agg(
        F.min_by(F.struct("pattern", "min_count"), F.struct(*order)).alias("spec"))
    docs = corpus.select("doc_id", text.speaker_key(F.col("speaker")).alias("speaker_key"), "format",
                         "date_ts", F.coalesce("text", F.lit("")).alias("text"))
    hits = join_small(docs, first, ["speaker_key", "format"], ["doc_id"])
    return hits.withColumn("count", text.count_matches(F.col("text"), F.col("spec.pattern"))).select(
        "doc_id", "speaker_key", "format", "phrase_key", "date_ts",
        (F.col("count") >= F.col("spec.min_count")).alias("occurred"), "count")


def token_lists(vocab: DataFrame, lists: Column) -> DataFrame:
    """Vocabulary rows to one row per token of each of their token lists."""
    keys = [c for c in vocab.columns if c in ("occasion_id", "market_ticker", "phrase")]
    rows = vocab.select(*keys, F.posexplode(F.array_distinct(lists)).alias("alias", "tokens"))
    return rows.select(*keys, "alias", F.size("tokens").alias("n"),
                       F.posexplode("tokens").alias("pos", "token"))


def ngram_matches(words: DataFrame, token: Column, vocab_tokens: DataFrame) -> DataFrame:
    """Start positions where a phrase's token list occurs, distinct per phrase.

    A word equal to a phrase's token at place ``p`` votes for the start ``p`` words before it; a
    start with votes from all places of one list is a match. Only voting words are shuffled, by
    their start, so neither long transcripts nor common words gather in one task. ``word_idx``
    must be gap-free (see ``trim_tape``). A vocabulary with ``occasion_id`` applies to that
    occasion only. ``n_tokens`` is the length of the shortest list that matches there.
    """
    own = ["occasion_id"] if "occasion_id" in vocab_tokens.columns else []
    w = words.select("occasion_id", "word_idx", "t_start_utc", token.alias("token"))
    if own:
        # words that no phrase has leave first; the vocabulary grows with the occasions, so it is neither
        # copied per salt nor broadcast
        tokens = materialize(vocab_tokens.select("token").distinct(), "tokens")
        met = w.join(tokens, "token", "left_semi").join(vocab_tokens.hint("merge"), ["occasion_id", "token"])
    else:
        met = join_small(w, vocab_tokens, ["token"], ["word_idx"])
    votes = met.withColumn("start", F.col("word_idx") - F.col("pos"))
    starts = votes.groupBy("occasion_id", "market_ticker", "phrase", "start").agg(
        # at most one entry per token of the phrase
        F.collect_list(F.struct("alias", "n")).alias("votes"),
        F.min(F.when(F.col("pos") == 0, F.col("t_start_utc"))).alias("t_start_utc"))
    whole = F.filter("votes", lambda v: F.size(F.filter("votes", lambda o: o["alias"] == v["alias"])) == v["n"])
    n = F.array_min(F.transform(whole, lambda v: v["n"]))
    return starts.withColumn("n_tokens", n).filter("n_tokens IS NOT NULL").select(
        "occasion_id", "market_ticker", "phrase", F.col("start").alias("word_idx"), "t_start_utc", "n_tokens")


def measured_matches(words: DataFrame, vocab: DataFrame, stem_aliases: bool = False) -> DataFrame:
    """Matches under the reprice token rules, with their lengths: words are stemmed, aliases by option only."""
    lists = text.alias_tokens(F.col("phrase"), stem_aliases)
    return ngram_matches(words, text.stem(text.reprice_token(F.col("word"))), token_lists(vocab, lists))


def reprice_matches(words: DataFrame, vocab: DataFrame, stem_aliases: bool = False) -> DataFrame:
    """Matches under the reprice token rules."""
    return measured_matches(words, vocab, stem_aliases).drop("n_tokens")


def qa_matches(words: DataFrame, vocab: DataFrame, forms: Column | None = None) -> DataFrame:
    """Matches of the surface forms (``forms``, where they are at hand) under the QA token rules."""
    forms = text.surface_forms(F.col("phrase")) if forms is None else forms
    lists = F.transform(forms, lambda f: F.split(f, " "))
    return ngram_matches(words, text.qa_token(F.col("word")), token_lists(vocab, lists)).drop("n_tokens")


def mention_events(matches: DataFrame, gap_s: float) -> DataFrame:
    """Mentions after at least ``gap_s`` without a match, with the total matches."""
    matches = materialize(matches, "matches")  # few rows from a long scan, read three times
    rows, order = by_seconds(matches, ("occasion_id", "market_ticker"), "t_start_utc", "word_idx")
    marked = previous(rows, order, _before=F.col("t_start_utc"))
    totals = matches.groupBy("occasion_id", "market_ticker").agg(F.count("*").alias("total_matches_in_tape"))
    return (
        marked.filter(F.col("_before").isNull() | (F.col("t_start_utc") - F.col("_before") >= gap_s))
        .join(totals, ["occasion_id", "market_ticker"])
        .select("occasion_id", "market_ticker", "phrase", F.col("t_start_utc").alias("t_word"),
                "total_matches_in_tape")
    )


def vocabulary_hits(words: DataFrame, pattern: str = text.EVENT_VOCABULARY, gap_s: int = 20) -> DataFrame:
    """Words matching an event vocabulary, numbered by cluster; a pause over ``gap_s`` splits (T5)."""
    hits = words.filter(F.col("word").rlike(f"(?i){pattern}")).select(
        "occasion_id", "word_idx", "word", "t_start_utc")
    rows, order = by_seconds(materialize(hits, "hits"), ("occasion_id",), "t_start_utc", "word_idx")
    marked = previous(rows, order, _before=F.col("t_start_utc"))
    new = F.col("_before").isNull() | (F.col("t_start_utc") - F.col("_before") > gap_s)
    return islands(marked, order, new, "cluster").select(*hits.columns, "cluster")


def vocabulary_clusters(hits: DataFrame, min_hits: int = 2) -> DataFrame:
    """Clusters of at least ``min_hits`` hits with all their words in order (T5).

    A pause ends a cluster, so its list is bounded by the hits of one unbroken stretch of one
    occasion.
    """
    return hits.groupBy("occasion_id", "cluster").agg(
        F.min("t_start_utc").alias("t_call"), F.max("t_start_utc").alias("t_call_last"), F.count("*").alias("n_hits"),
        F.transform(F.array_sort(F.collect_list(F.struct("t_start_utc", "word_idx", "word"))), lambda w: w["word"]).alias("words"),
    ).filter(F.col("n_hits") >= min_hits).drop("cluster")


def hit_rate(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Matches, first and last time per occasion and vocabulary row, zeros kept (A10).

    ``vocab``: occasion_id, market_ticker, phrase.
    """
    # the forms of a phrase are made once, however many occasions track it
    vocab = materialize(vocab, "vocab")
    forms = materialize(vocab.select("phrase").distinct().withColumn("_forms", text.surface_forms(F.col("phrase"))), "forms")
    known = vocab.join(forms, "phrase", "left").select(*vocab.columns, "_forms")
    hits = qa_matches(words, known, F.col("_forms")).groupBy("occasion_id", "market_ticker").agg(
        F.count("*").alias("n_matches"),
        F.min_by("t_start_utc", "word_idx").alias("t_first_utc"),
        F.max_by("t_start_utc", "word_idx").alias("t_last_utc"))
    return (
        known.join(hits, ["occasion_id", "market_ticker"], "left")
        .withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
        .withColumn("variants_searched", F.array_join("_forms", "; ")).drop("_forms")
    )


def _letters(c: Column) -> Column:
    """Lower case, with the four letters that match a plain one when case is ignored."""
    return F.lower(F.translate(c, "ſ\u212aİı", "skii"))


def occurrence_times(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """End time of the word that closes each match of an anchor's label.

    The label's pattern runs over the space-joined words, but never over a whole transcript: two
    neighbouring words are joined only where a match could span them, and what remains between
    such joints is a text of a few words. ``words``: occasion_id, word_idx, word, t_end_utc.
    ``anchors``: occasion_id, series_key, label; they are read twice, so store them if they are costly.
    """
    spec = text.phrase_spec(F.col("label"))
    a = anchors.select("label").distinct().withColumn("_s", spec).filter(F.col("_s.pattern").isNotNull())
    terms = F.transform("_s.alternates", lambda t: F.transform(
        F.split(text.squeeze(t), " "), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))))
    pairs = F.flatten(F.transform(terms, lambda t: F.when(F.size(t) > 1, F.zip_with(
        F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1),
        lambda x, y: F.concat(x, F.lit("\\s+"), y))).otherwise(F.array().cast("array<string>"))))
    # folded both ways, so that letters with several lower cases stay together
    words_of = F.flatten(F.transform("_s.alternates", lambda t: F.split(F.lower(F.upper(text.squeeze(t))), " ")))
    plain = F.flatten(F.transform("_s.alternates", lambda t: F.split(text.squeeze(t), " ")))
    # a label is parsed once, however many occasions ask for it
    a = materialize(a.select("label", F.col("_s.pattern").alias("pattern"), F.array_distinct(words_of).alias("needles"),
                             F.when(F.size(pairs) > 0, F.concat(F.lit("(?iu)"), F.array_join(pairs, "|"))).alias("joint"),
                             F.array_distinct(F.transform(plain, lambda n: F.regexp_extract(_letters(n), "[a-z]+", 0))).alias("_akeys")), "labels")
    tight, free = a.filter(~F.array_contains("_akeys", "")), a.filter(F.array_contains("_akeys", ""))
    # a match holds the first run of letters of a label's word whole, but for a plural; so words and
    # anchors meet on those runs, and only then come substring tests and patterns. Words with no run
    # of any label leave before the shuffle.
    keys = materialize(tight.select("label", F.explode("_akeys").alias("_key")), "keys")
    words = words.select("occasion_id", "word_idx", "word", "t_end_utc")
    anchors = anchors.select("occasion_id", "series_key", "label")
    letters = F.when(F.octet_length("word") == F.length("word"), F.lower("word")).otherwise(_letters(F.col("word")))
    runs = F.regexp_extract_all(letters, F.lit("[a-z]+"), F.lit(0))
    run = F.col("_run")
    ends = F.when(run.endswith("es"), F.array(run, F.expr("left(_run, length(_run) - 1)"), F.expr("left(_run, length(_run) - 2)"))).when(
        run.endswith("s"), F.array(run, F.expr("left(_run, length(_run) - 1)"))).otherwise(F.array(run))
    keyed = words.withColumn("_run", F.explode(runs)).withColumn("_key", F.explode(ends)).drop("_run")
    keyed = keyed.join(keys.select("_key").distinct(), "_key", "left_semi")
    # the anchors grow with the occasions, so they are never broadcast
    met = keyed.join(anchors.join(keys, "label").hint("merge"), ["occasion_id", "_key"]).drop("_key").join(tight, "label")
    if not free.isEmpty():  # labels with a word of no letters have no such run
        met = met.unionByName(join_small(words, anchors.join(free, "label"), ["occasion_id"], ["word_idx"]))
    near = met.filter(F.exists("needles", lambda n: F.contains(F.lower(F.upper("word")), n))).drop("needles", "_akeys", "label")
    # a word may meet an anchor by several runs; the few rows that pass the tests are made distinct
    near = materialize(near.dropDuplicates(["occasion_id", "series_key", "word_idx"]), "near")
    # no match of a label of single words spans two words
    within = near.filter("joint IS NULL").withColumn("n", F.expr("size(regexp_extract_all(word, pattern, 0))")).filter("n > 0").select(
        "occasion_id", "series_key", F.explode(F.array_repeat("t_end_utc", F.col("n"))).alias("t_end_utc"))
    rows, order = by_position(near.filter("joint IS NOT NULL"), ("occasion_id", "series_key"), "word_idx")
    rows = previous(rows, order, _pi=F.col("word_idx"), _pw=F.col("word"))
    joined = (F.col("_pi") == F.col("word_idx") - 1) & F.expr("concat(_pw, ' ', word) rlike joint")
    pieces = islands(rows, order, ~F.coalesce(joined, F.lit(False)), "piece").groupBy(
        "occasion_id", "series_key", "piece").agg(
        F.any_value("pattern").alias("pattern"),
        F.array_sort(F.collect_list(F.struct("word_idx", "word", "t_end_utc"))).alias("ws"))
    pieces = pieces.withColumn("body", F.array_join(F.transform("ws", lambda w: w["word"]), " "))
    found = pieces.withColumn("hits", F.expr("regexp_extract_all(body, pattern, 0)")).filter(
        F.size("hits") > 0).withColumn("gaps", F.expr("split(body, pattern, -1)"))
    ends = F.expr("""transform(sequence(1, size(hits)), k ->
        aggregate(arrays_zip(slice(gaps, 1, k), slice(hits, 1, k)), 0, (n, x) -> n + length(x['0']) + length(x['1'])))""")
    starts = F.expr("""transform(sequence(1, size(ws)), k ->
        aggregate(slice(ws, 1, k - 1), 0, (n, w) -> n + length(w.word) + 1))""")
    across = (
        found.withColumns({"ends": ends, "starts": starts})
        .select("occasion_id", "series_key", "ws", "starts", F.explode("ends").alias("end"))
        .select("occasion_id", "series_key",
                F.expr("ws[size(filter(starts, s -> s <= end - 1)) - 1].t_end_utc").alias("t_end_utc"))
    )
    return within.unionByName(across)


def said_time(times: DataFrame, anchors: DataFrame) -> DataFrame:
    """Time of an anchor's ``min_count``-th occurrence, where there is one.

    Occurrences are counted per second first, so the window holds one row per second.
    """
    need = anchors.select("occasion_id", "series_key", text.phrase_spec(F.col("label"))["min_count"].alias("need"))
    keys = ["occasion_id", "series_key"]
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("t_end_utc"))
    seconds = times.groupBy(*keys, "t_end_utc").agg(F.count("*").alias("n")).withColumn("upto", upto)
    return seconds.join(need, keys).filter(F.col("upto") >= F.col("need")).groupBy(*keys).agg(
        F.min("t_end_utc").alias("said"))


def said_time_by(words: DataFrame, anchors: DataFrame, fn, schema: str = "occasion_id bigint, series_key string, said bigint") -> DataFrame:
    """Anchor times from a caller's function of a word frame (F1).

    ``fn(pandas.DataFrame) -> int | None`` sees the words of one occasion in order, once per
    anchor of it; this is the extension point, ``said_time`` needs no Python. ``fn`` may also be
    one function per series key. Python is handed some tens of occasions at a time, and the words
    of each once, however many anchors it has. ``anchors`` are read twice.
    """
    import pandas as pd

    def some(w, a):
        frames = dict(tuple(w.drop(columns="_group").sort_values(["occasion_id", "word_idx"]).groupby("occasion_id", sort=False)))
        out = []
        for o, k in dict.fromkeys(zip(a["occasion_id"], a["series_key"])):
            value = (fn[k] if isinstance(fn, dict) else fn)(frames[o].copy()) if o in frames else None
            if not pd.isna(value):
                out.append((o, k, value))
        return pd.DataFrame(out, columns=["occasion_id", "series_key", "said"])

    groups = -(-anchors.select("occasion_id").distinct().count() // OCCASIONS)
    group = F.pmod(F.xxhash64("occasion_id"), F.lit(max(groups, 1)))
    return words.withColumn("_group", group).groupBy("_group").cogroup(
        anchors.select("occasion_id", "series_key").withColumn("_group", group).groupBy("_group")).applyInPandas(some, schema)

"""Transcript quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.text import qa_token
from tapeline.operators.ordered import (WORDS_PER_CHUNK, Ordering, by_position, by_seconds, following,
                                          islands, previous, running_sum)
from tapeline.session import materialize


def trim_tape(words: DataFrame, floor_ts: int) -> DataFrame:
    """Drop words before a time and number the rest without gaps in word order."""
    rows, order = by_position(words.filter(F.col("t_start_utc") >= floor_ts), ("occasion_id",), "word_idx")
    return (running_sum(rows, order, _n=F.lit(1)).withColumn("word_idx", F.col("_n") - 1)
            .select(*words.columns))


def gap_scan(words: DataFrame, threshold_s: float = 60.0) -> DataFrame:
    """Silences longer than a threshold, in start order."""
    rows, order = by_seconds(words.select("occasion_id", "word_idx", "t_start_utc", "t_end_utc"),
                             ("occasion_id",), "t_start_utc", "word_idx", seconds=3600)
    gap = F.col("t_start_utc") - F.col("gap_start_utc")
    return previous(rows, order, gap_start_utc=F.col("t_end_utc")).filter(gap > threshold_s).select(
        "occasion_id", "gap_start_utc", F.col("t_start_utc").alias("gap_end_utc"), gap.alias("duration_s"))


def throughput(words: DataFrame) -> DataFrame:
    """Words per occasion and minute (A2)."""
    return words.groupBy("occasion_id", (F.floor(F.col("t_start_utc") / 60) * 60).alias("minute_ts")).agg(
        F.count("*").alias("wpm"))


def throughput_summary(per_minute: DataFrame, sparse_below: int = 3) -> DataFrame:
    """Mean, median and largest words per minute, and sparse minutes, per occasion (A2)."""
    return per_minute.groupBy("occasion_id").agg(
        F.count("*").alias("n_minutes"), F.count_if(F.col("wpm") < sparse_below).alias("n_sparse"),
        F.avg("wpm").alias("mean_wpm"), F.percentile("wpm", F.lit(0.5)).alias("median_wpm"),
        F.max("wpm").alias("max_wpm"))


def backward_jumps(words: DataFrame) -> DataFrame:
    """Starts earlier than the word before: count, share, upper median and largest."""
    rows, order = by_position(words.select("occasion_id", "word_idx", "t_start_utc"), ("occasion_id",), "word_idx")
    size = F.col("_before") - F.col("t_start_utc")
    jumps = previous(rows, order, _before=F.col("t_start_utc")).filter(size > 0).groupBy(
        "occasion_id", size.alias("size")).agg(F.count("*").alias("n"))
    # one row per distinct size from here on
    upto = F.sum("n").over(Window.partitionBy("occasion_id").orderBy("size"))
    all_n = F.sum("n").over(Window.partitionBy("occasion_id"))
    totals = words.groupBy("occasion_id").agg(F.count("*").alias("n_words"))
    return (
        jumps.withColumns({"upto": upto, "all_n": all_n}).groupBy("occasion_id").agg(
            F.max("all_n").alias("n_backward"),
            F.min(F.when(F.col("upto") > F.floor(F.col("all_n") / 2), F.col("size"))).alias("median_s"),
            F.max("size").alias("max_s"))
        .join(totals, "occasion_id")
        .withColumn("share", F.col("n_backward") / F.col("n_words"))
    )


def same_start_runs(words: DataFrame, min_run: int = 5) -> DataFrame:
    """Runs of consecutive words with one start time."""
    rows, order = by_position(words.select("occasion_id", "word_idx", "t_start_utc"), ("occasion_id",), "word_idx")
    marked = previous(rows, order, _before=F.col("t_start_utc"))
    new = F.col("_before").isNull() | (F.col("_before") != F.col("t_start_utc"))
    return islands(marked, order, new, "run").groupBy("occasion_id", "run").agg(
        F.min("word_idx").alias("word_idx"), F.min("t_start_utc").alias("t_start_utc"),
        F.count("*").alias("n_words")).filter(F.col("n_words") >= min_run).drop("run")


def thanks_clusters(words: DataFrame, max_gap: int = 50) -> DataFrame:
    """Clusters of "thank you" at most ``max_gap`` words apart."""
    token, low = qa_token(F.col("word")), F.lower("word")
    # a plain search first, and the few rows that are left are stored, as they are read twice
    near = words.filter(low.contains("thank") | low.contains("you")).select(
        "occasion_id", "word_idx", "t_start_utc", token.alias("token")).filter(F.col("token").isin("thank", "you"))
    rows, order = by_position(materialize(near, "thanks"), ("occasion_id",), "word_idx")
    pairs = following(rows, order, _ni=F.col("word_idx"), _nt=F.col("token")).filter(
        (F.col("token") == "thank") & (F.col("_nt") == "you") & (F.col("_ni") == F.col("word_idx") + 1))
    marked = previous(materialize(pairs, "pairs"), order, _before=F.col("word_idx"))
    new = F.col("_before").isNull() | (F.col("word_idx") - F.col("_before") > max_gap)
    return islands(marked, order, new, "cluster").groupBy("occasion_id", "cluster").agg(
        F.min("word_idx").alias("word_idx"), F.count("*").alias("n"),
        F.min_by("t_start_utc", "word_idx").alias("t_first"),
        F.max_by("t_start_utc", "word_idx").alias("t_last")).drop("cluster")


def non_ascii(words: DataFrame, shown: int = 10) -> DataFrame:
    """Non-ASCII words: number and the first few."""
    odd = words.filter(F.col("word").rlike(r"[^\x00-\x7F]")).select("occasion_id", "word_idx", "word")
    place = F.row_number().over(Window.partitionBy("occasion_id").orderBy("word_idx"))
    first = odd.withColumn("_n", place).filter(F.col("_n") <= shown).groupBy("occasion_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "word"))), lambda w: w["word"]).alias("sample"))
    return odd.groupBy("occasion_id").agg(F.count("*").alias("n_non_ascii")).join(first, "occasion_id")


def loop_flags(words: DataFrame, min_reps: int = 3) -> DataFrame:
    """Three-word grams repeated back to back, found left to right without overlap.

    A gram at ``i`` repeats as long as each word equals the one three places on, so loops are runs
    of that equality: a run of ``r`` starting at ``i`` gives ``1 + r // 3`` repeats and the scan
    goes on after them. A run's own repeats always pass its end, so only a run beginning within
    that overshoot (two places at most) depends on the one before; such chains of runs are folded
    in order, all others stand alone. Loops that reach the very end of the tape are not counted.
    """
    token = qa_token(F.col("word"))
    rows, order = by_position(words.select("occasion_id", "word_idx", token.alias("token")),
                              ("occasion_id",), "word_idx")
    # the token three places on, inside chunks that carry the first three words of the next
    halo = rows.withColumn("_home", F.col("_chunk")).withColumn("_chunk", F.explode(F.array_distinct(F.array(
        "_chunk", F.floor((F.col("word_idx") - 3) / F.lit(WORDS_PER_CHUNK))))))
    ahead = Window.partitionBy("occasion_id", "_chunk").orderBy("word_idx")
    equal = halo.withColumn("_t3", F.lead("token", 3).over(ahead)).withColumn("_i3", F.lead("word_idx", 3).over(ahead)).filter(
        (F.col("_home") == F.col("_chunk")) & (F.col("_i3") == F.col("word_idx") + 3) & (F.col("token") == F.col("_t3"))).drop("_home", "_t3", "_i3")
    marked = previous(materialize(equal, "repeats"), order, _before=F.col("word_idx"))
    new = F.col("_before").isNull() | (F.col("_before") != F.col("word_idx") - 1)
    runs = islands(marked, order, new, "run").groupBy("occasion_id", "run").agg(
        F.min("word_idx").alias("s"), F.count("*").alias("r"), F.count_if(F.col("token") == "").alias("blank"))
    # a run always covers all three words of its gram, so one blank spoils all of it
    runs = runs.filter((F.col("r") >= 3 * (min_reps - 1)) & (F.col("blank") == 0)).withColumn(
        "_chunk", F.floor(F.col("s") / F.lit(1 << 14)))
    near = Ordering(("occasion_id",), ("s",), "_chunk")
    linked = previous(materialize(runs, "runs"), near, _pe=F.col("s") + F.col("r"))
    chains = islands(linked, near, F.col("_pe").isNull() | (F.col("s") > F.col("_pe") + 3), "chain").groupBy(
        "occasion_id", "chain").agg(F.array_sort(F.collect_list(F.struct("s", "r"))).alias("runs"))
    found = F.expr(f"""aggregate(runs, named_struct('at', 0L, 'out', cast(array() as array<struct<i:bigint,reps:bigint>>)),
        (acc, x) -> if(x.s + x.r - greatest(x.s, acc.at) >= {3 * (min_reps - 1)},
          named_struct('at', greatest(x.s, acc.at) + 3 * (1 + (x.s + x.r - greatest(x.s, acc.at)) div 3),
                       'out', array_append(acc.out, named_struct('i', greatest(x.s, acc.at),
                              'reps', 1 + (x.s + x.r - greatest(x.s, acc.at)) div 3))),
          acc), acc -> acc.out)""")
    ends = words.groupBy("occasion_id").agg((F.max("word_idx") + 1).alias("_n"))
    return (
        chains.select("occasion_id", F.inline(found))
        .join(ends, "occasion_id").filter(F.col("i") < F.col("_n") - 9)
        .select("occasion_id", F.col("i").alias("word_idx"), "reps")
    )


def tape_facts(words: DataFrame, gaps: DataFrame) -> DataFrame:
    """Counts, span, forced and unscored shares and blind share per occasion."""
    facts = words.groupBy("occasion_id").agg(
        F.count("*").alias("n_words"), F.min("t_start_utc").alias("t_first"), F.max("t_end_utc").alias("t_last"),
        F.count_if(F.col("asr_conf") == -1.0).alias("n_forced"),
        F.count_if(F.col("asr_conf").isNull()).alias("n_no_conf"))
    blind = gaps.groupBy("occasion_id").agg(F.sum("duration_s").alias("blind_s"))
    return facts.join(blind, "occasion_id", "left").withColumns({
        "blind_s": F.coalesce("blind_s", F.lit(0)),
        "blind_share": F.try_divide(F.coalesce("blind_s", F.lit(0)), F.col("t_last") - F.col("t_first"))})


def preview(words: DataFrame, n: int = 40) -> DataFrame:
    """First ``n`` words of each occasion as text."""
    return words.filter(F.col("word_idx") < n).groupBy("occasion_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda w: w["word"]), " ").alias("preview"))


def sample_windows(words: DataFrame, n_windows: int = 15, length: int = 15, seed: int = 42) -> DataFrame:
    """Seeded random word windows of each occasion.

    Starts are ranked by the MD5 of seed, occasion and position, so other engines can draw the same
    windows; a tape not longer than a window gives itself.
    """
    sizes = words.groupBy("occasion_id").agg((F.max("word_idx") + 1).alias("_n"))
    starts = words.select("occasion_id", "word_idx").join(sizes, "occasion_id").filter(
        (F.col("word_idx") < F.col("_n") - length) | ((F.col("_n") <= length) & (F.col("word_idx") == 0)))
    place = F.row_number().over(Window.partitionBy("occasion_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "occasion_id", "word_idx")), "word_idx"))
    picks = starts.withColumn("_p", place).filter(F.col("_p") <= n_windows).select(
        "occasion_id", F.col("word_idx").alias("start_idx"),
        F.explode(F.sequence("word_idx", F.col("word_idx") + length - 1)).alias("word_idx"))
    return picks.join(words.select("occasion_id", "word_idx", "word", "t_start_utc"), ["occasion_id", "word_idx"]).groupBy(
        "occasion_id", "start_idx").agg(
        F.min_by("t_start_utc", "word_idx").alias("t_start_utc"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda w: w["word"]), " ").alias("text"))


def word_frame(words: DataFrame, video: str, order: list[str]) -> DataFrame:
    """Timed words with a running index per video (X40); captions are numbered as they are parsed."""
    rows, o = by_seconds(words, (video,), order[0], *order[1:], seconds=3_600_000)
    return running_sum(rows, o, _n=F.lit(1)).withColumn("word_idx", F.col("_n") - 1).drop("_n", "_chunk")

"""Counts and summaries over any table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of each value of several columns in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """The n most frequent values."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def corpus_summary(corpus: DataFrame) -> DataFrame:
    """Transcripts, speakers, words and time span per source."""
    return corpus.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_distinct("speaker").alias("n_speakers"),
        F.sum("n_words").alias("n_words"), F.min("date_ts").alias("first_ts"), F.max("date_ts").alias("last_ts"))


def run_summary(occasions: DataFrame, ticks: DataFrame, words: DataFrame) -> DataFrame:
    """Tick and word counts and the covered span per occasion.

    ``ticks`` and ``words`` carry ``occasion_id``; each is reduced before the joins.
    """
    t = ticks.groupBy("occasion_id").agg(
        F.count("*").alias("n_ticks"), F.count_distinct("ticker").alias("n_markets"),
        F.min("recv_utc").alias("_t0"), F.max("recv_utc").alias("_t1"))
    w = words.groupBy("occasion_id").agg(
        F.count("*").alias("n_words"), F.min("t_start_utc").alias("speech_start_utc"),
        F.max("t_end_utc").alias("speech_end_utc"))
    return occasions.join(t, "occasion_id", "left").join(w, "occasion_id", "left").select(
        *occasions.columns, F.coalesce("n_ticks", F.lit(0)).alias("n_ticks"),
        F.coalesce("n_markets", F.lit(0)).alias("n_markets"), F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.least("_t0", "speech_start_utc").alias("capture_start_utc"),
        F.greatest("_t1", "speech_end_utc").alias("capture_end_utc"), "speech_start_utc", "speech_end_utc")

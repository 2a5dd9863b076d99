"""Parquet tables under contracts, and the tape of an occasion."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeline.schemas import TICKS, Contract, ContractError, require_columns
from tapeline.session import delete, replace


#: Folders of a transcript table, files in each at least, neighbouring words that stay in one file.
BUCKETS, FILES, RUN = 64, 8, 1 << 14


def load_table(spark: SparkSession, path: str, contract: Contract, must_exist: bool = False,
               check: bool = True, where: Column | None = None, aside: tuple[str, ...] = ()) -> DataFrame:
    """Read and validate a table; one that does not exist is empty.

    ``aside``: columns of the layout that the contract does not know. ``where`` may name them.
    """
    try:
        df = spark.read.parquet(path)
    except AnalysisException as exc:
        if must_exist or exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return contract.empty(spark)
    df = (df if where is None else df.filter(where)).drop(*aside)
    return contract.validate(df) if check else contract.conform(df)


def spread(df: DataFrame, rows: int = 4096) -> DataFrame:
    """Rows over all cores, at most about ``rows`` in a task.

    Long rows in few files (documents, pages) would otherwise keep most of a cluster idle, and what
    a task holds would grow with the input. An input of many splits is left alone.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def _stored(df: DataFrame, path: str, contract: Contract, partition_by: list[str], extra: dict[str, Column]) -> str:
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    rows, broken = contract.observed(df)
    try:
        rows.withColumns(extra).write.partitionBy(*partition_by).parquet(staging)
        found = broken() | contract.repeated_keys(spark.read.parquet(staging))
        if found:
            raise ContractError(f"{contract.name}: {found}")
    except BaseException:
        delete(spark, staging)
        raise
    replace(spark, staging, path)
    return path


def save_table(df: DataFrame, path: str, contract: Contract, partition_by: list[str] = ()) -> str:
    """Overwrite a table that keeps its contract.

    The rows are computed once: they go to a folder beside the table while the broken rules are
    counted as observed metrics; then the keys are counted in what was written. Only a table
    without violations takes the place of the old one, else ``ContractError`` tells the counts and
    the old one stays.
    """
    return _stored(df, path, contract, list(partition_by), {})


def save_bars(df: DataFrame, path: str, contract: Contract) -> str:
    """Bars laid out by granularity and day, so time windows prune files; checked like any table."""
    return _stored(df, path, contract, ["period_minutes", "day"], {"day": F.to_date(F.timestamp_seconds("ts"))})


def append_ticks(ticks: DataFrame, path: str) -> str:
    """Append ticks to a tape as new files (S3). ``ticks`` leads with ``occasion_id``."""
    require_columns(ticks, ["occasion_id", *TICKS.columns])
    ticks.write.mode("append").partitionBy("occasion_id").parquet(path)
    return path


def stream_ticks(ticks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a tick stream to a tape exactly once (S3)."""
    require_columns(ticks, ["occasion_id", *TICKS.columns])
    return (ticks.writeStream.format("parquet").partitionBy("occasion_id")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _bucket(occasion: Column) -> Column:
    return F.pmod(F.xxhash64(occasion.cast("string")), F.lit(BUCKETS)).cast("int")


def dealt_by_occasion(df: DataFrame, occasion: Column, rows: int = 4096) -> DataFrame:
    """Rows that words will be made of, a task's share in few folders of a transcript table.

    At most about ``rows`` come to a task; one row or a few are an occasion, as documents are.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    files = max(FILES, -(-2 * tasks // BUCKETS))
    return df.repartition(tasks, _bucket(occasion), F.pmod(F.xxhash64(occasion), F.lit(files)))


def _write_buckets(words: DataFrame, path: str, dealt: bool) -> None:
    """Append words to the folders of their occasions' buckets, a few files in each.

    Neighbouring words stay together, as they are stored in less space so.
    """
    words = words.withColumn("bucket", _bucket(F.col("occasion_id")))
    if not dealt:
        words = words.repartition("bucket", F.pmod(F.xxhash64("occasion_id", F.floor(F.col("word_idx") / RUN)), F.lit(FILES)))
    words.write.mode("append").partitionBy("bucket").parquet(path)


def write_transcript(words: DataFrame, path: str, contract: Contract, dealt: bool = False) -> str:
    """Replace the transcripts of the occasions in ``words``, keep the others.

    Occasions share a fixed number of folders by a hash, as one for each would be millions of small
    files. The folders that ``words`` touches are written anew beside the table, with what other
    occasions have in them, and then take the place of the old ones. Only ``words`` are shuffled,
    and not even they if ``dealt`` says that they come from ``dealt_by_occasion``.
    """
    require_columns(words, contract.columns)
    spark = words.sparkSession
    staging, ids = (f"{path.rstrip('/')}-{uuid.uuid4().hex}" for _ in range(2))
    try:
        _write_buckets(words, staging, dealt)
        try:
            spark.read.parquet(path)
        except AnalysisException as exc:
            if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            replace(spark, staging, path)
            return path
        try:
            new = spark.read.parquet(staging).select("bucket", F.col("occasion_id").alias("_o")).distinct()
        except AnalysisException as exc:  # no words
            if exc.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return path
        # in a folder the occasions that came anew are few, so the words it keeps need no shuffle
        new.repartition("bucket").write.partitionBy("bucket").parquet(ids)
        touched = [r["bucket"] for r in spark.read.parquet(ids).select("bucket").distinct().collect()]

        def keep(bucket: int) -> None:
            try:
                old = spark.read.parquet(f"{path}/bucket={bucket}")
            except AnalysisException as exc:  # a folder that the table doesn't have yet
                if exc.getCondition() != "PATH_NOT_FOUND":
                    raise
                return
            kept = old.join(spark.read.parquet(f"{ids}/bucket={bucket}"), F.col("occasion_id").eqNullSafe(F.col("_o")), "left_anti")
            kept.select(*words.columns).write.mode("append").parquet(f"{staging}/bucket={bucket}")

        with ThreadPoolExecutor(8) as pool:
            list(pool.map(keep, touched))
        for b in touched:
            replace(spark, f"{staging}/bucket={b}", f"{path}/bucket={b}")
    finally:
        delete(spark, staging, ids)
    return path


def load_transcript(spark: SparkSession, path: str, contract: Contract, occasion_id: str | None = None) -> DataFrame:
    """Transcripts of a tape, or of one occasion from its bucket."""
    one = None if occasion_id is None else (F.col("bucket") == _bucket(F.lit(occasion_id))) & (F.col("occasion_id") == occasion_id)
    return load_table(spark, path, contract, check=False, where=one, aside=("bucket",))

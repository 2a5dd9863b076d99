"""Text records: JSON lines and the review CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.operators.universe import RAW_SCHEMA, REVIEW_COLUMNS, review_view

RESOLUTION_SCHEMA = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("market_ticker", "series", "template", "speaker", "occasion", "phrase", "variant_rule")],
    T.StructField("cutoff_ts", T.LongType()), T.StructField("governing_sources", T.ArrayType(T.StringType())),
    *[T.StructField(n, T.BooleanType()) for n in ("early_resolution", "cancellation_clause", "is_nqe")],
    T.StructField("resolution_risk", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("notes", T.StringType()),
])
_REVIEW_TYPES = {"confidence": T.DoubleType(), "is_nqe": T.BooleanType(), "eligible": T.BooleanType(),
                 "n_settlement_sources": T.LongType(), "has_candles": T.BooleanType()}
REVIEW_SCHEMA = T.StructType([T.StructField(c, _REVIEW_TYPES.get(c, T.StringType())) for c in REVIEW_COLUMNS])


def write_jsonl(df: DataFrame, path: str) -> str:
    """One JSON object per line (S5, S6). NULL fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def read_raw_records(spark: SparkSession, path: str) -> DataFrame:
    """``{market, event}`` records; blank lines are skipped."""
    return spark.read.schema(RAW_SCHEMA).json(path)


def read_resolutions(spark: SparkSession, path: str) -> DataFrame:
    """Parsed resolutions."""
    return spark.read.schema(RESOLUTION_SCHEMA).json(path)


def write_review_csv(registry: DataFrame, path: str, only_flagged: bool = False, rule_chars: int = 200) -> str:
    """Review rows as CSV, worst parses first.

    A global sort writes one ordered file per range, so a large review is not one task.
    """
    review_view(registry, only_flagged, rule_chars).write.mode("overwrite").option("header", True).option(
        "escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """Edited review rows; an empty cell is no edit."""
    return spark.read.schema(REVIEW_SCHEMA).option("header", True).option("escape", '"').csv(path)


def vocabulary_rows(files: DataFrame, eligible_only: bool = True) -> DataFrame:
    """``{ticker: {phrase, eligible}}`` documents to phrase rows.

    ``files``: occasion_id, body. A row without ``eligible`` is eligible.
    """
    parsed = F.from_json("body", "map<string,struct<phrase:string,eligible:boolean>>")
    rows = files.select("occasion_id", F.explode(parsed).alias("market_ticker", "v")).select(
        "occasion_id", "market_ticker", F.col("v.phrase").alias("phrase"),
        F.coalesce("v.eligible", F.lit(True)).alias("eligible"))
    return rows.filter("eligible").drop("eligible") if eligible_only else rows

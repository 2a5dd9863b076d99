"""Table contracts: declared columns with their rules, checked in one aggregate pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Allowed codes.
FORMATS = ("earnings", "speech", "broadcast", "sports", "entertainment", "other")
TEMPLATES = ("speech", "earnings", "duration", "length", "superlative", "nqe", "other")
VARIANTS = ("exact", "plural_possessive", "aliases_listed", "count_threshold", "fuzzy")
RISKS = ("low", "medium", "high")
SPLITS = ("train", "test")
SIDES = ("yes", "no")
PERIODS = (1, 60, 1440)

TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


class ContractError(ValueError):
    """A table broke its contract."""


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    null: bool = True
    lo: float | None = None
    hi: float | None = None
    one_of: tuple = ()

    def violation(self) -> Column | None:
        """Whether a row breaks this field's rules."""
        c = F.col(self.name)
        tests = []
        if not self.null:
            tests.append(c.isNull())
        if self.lo is not None:
            tests.append(c < self.lo)
        if self.hi is not None:
            tests.append(c > self.hi)
        if self.one_of:
            tests.append(~c.isin(*self.one_of))
        out = None
        for t in tests:
            t = F.coalesce(t, F.lit(False))
            out = t if out is None else out | t
        return out


def text(name: str, null: bool = True, one_of: tuple = ()) -> Field:
    return Field(name, "string", null, one_of=one_of)


def count(name: str, null: bool = False, lo: float | None = 0) -> Field:
    return Field(name, "bigint", null, lo=lo)


def price(name: str) -> Field:
    return Field(name, "double", True, 0.0, 1.0)


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]
    key: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, TYPES[f.type], True) for f in self.fields])

    def empty(self, spark: SparkSession) -> DataFrame:
        """No rows with the declared columns, for a table that is not there yet."""
        return spark.createDataFrame([], self.schema)

    def conform(self, df: DataFrame) -> DataFrame:
        """Exactly the declared columns in order, cast, NaN as NULL."""
        extra, missing = set(df.columns) - set(self.columns), set(self.columns) - set(df.columns)
        if extra or missing:
            raise ContractError(f"{self.name}: missing {sorted(missing)}, unexpected {sorted(extra)}")
        out = []
        for f in self.fields:
            c = F.col(f.name).cast(TYPES[f.type])
            out.append((F.nanvl(c, F.lit(None).cast("double")) if f.type == "double" else c).alias(f.name))
        return df.select(*out)

    def checks(self) -> dict[str, Column]:
        """Per rule, the number of rows that break it."""
        rules = {f.name: f.violation() for f in self.fields}
        return {n: F.count_if(v) for n, v in rules.items() if v is not None}

    def repeated_keys(self, df: DataFrame) -> dict[str, int]:
        """Keys that repeat; only the key columns are read."""
        if not self.key:
            return {}
        twice = df.groupBy(*self.key).agg(F.count("*").alias("_n")).filter("_n > 1").count()
        return {"repeated " + ", ".join(self.key): twice} if twice else {}

    def violations(self, df: DataFrame) -> dict[str, int]:
        """Rows that break each field's rules, and keys that repeat; one pass each."""
        checks = [c.alias(n) for n, c in self.checks().items()]
        found = {k: v for k, v in df.agg(*checks).first().asDict().items() if v} if checks else {}
        return found | self.repeated_keys(df)

    def observed(self, df: DataFrame) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
        """The conformed table, and a function that tells the violations its rows had.

        They are counted while an action reads the table, and known once that has ended, so a
        costly table is computed once to be stored and checked.
        """
        seen = Observation()
        rows = self.conform(df).observe(seen, F.count("*").alias("rows written"), *[c.alias(n) for n, c in self.checks().items()])
        return rows, lambda: {k: v for k, v in seen.get.items() if v and k != "rows written"}

    def validate(self, df: DataFrame) -> DataFrame:
        """The conformed table, or ``ContractError`` with the counts."""
        out = self.conform(df)
        found = self.violations(out)
        if found:
            raise ContractError(f"{self.name}: {found}")
        return out


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact columns in exact order."""
    if df.columns != columns:
        raise ContractError(f"schema mismatch: {df.columns} != {columns}")
    return df


def require_one_to_one(left: DataFrame, right: DataFrame, key: str) -> None:
    """Unique keys on both sides of a join."""
    for side, df in (("left", left), ("right", right)):
        if not df.groupBy(key).count().filter("count > 1").isEmpty():
            raise ContractError(f"{key} is not unique on the {side} side")


def unique_rows(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """The same rows; the query that reads them fails where a key repeats.

    Unlike ``require_one_to_one`` it runs no job of its own, and a join on the keys can use the
    way its aggregate deals rows out.
    """
    rows = df.groupBy(*keys).agg(F.any_value(F.struct(*df.columns)).alias("_row"), F.count("*").alias("_n"))
    twice = F.raise_error(F.concat(F.lit(f"{', '.join(keys)} repeats on the {side} side: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    return rows.select(F.when(F.col("_n") == 1, F.col("_row")).otherwise(twice).alias("_row")).select("_row.*")


_CATALOG = (
    text("market_ticker", False), text("event_ticker", False), text("series_ticker", False), text("series_title"),
    text("speaker"), text("format", False, FORMATS), text("yes_sub_title"), text("rules_primary"), text("rules_secondary"),
    count("open_ts", True, None), count("close_ts", True, None), count("occurrence_ts", True, None),
    count("expiration_ts", True, None), text("result"), Field("volume", "double", True, 0.0),
    Field("open_interest", "double", True, 0.0), text("status"), text("settlement_sources"),
    count("n_settlement_sources"), Field("has_candles", "boolean", False), count("n_candles"),
)
CATALOG = Contract("catalog", _CATALOG, ("market_ticker",))
REGISTRY = Contract("registry", _CATALOG + (
    text("template", False, TEMPLATES), text("phrase"), text("variant_rule", False, VARIANTS), text("occasion"),
    count("cutoff_ts", True, None), text("governing_sources"), Field("early_resolution", "boolean", False),
    Field("cancellation_clause", "boolean", False), Field("is_nqe", "boolean", False),
    text("resolution_risk", False, RISKS), Field("confidence", "double", False, 0.0, 1.0), text("notes"),
    Field("eligible", "boolean", False)), ("market_ticker",))
CORPUS = Contract("corpus", (
    text("doc_id", False), text("speaker", False), text("format", False, FORMATS), text("occasion"), count("date_ts"),
    text("source", False), text("url"), count("n_words"), text("text")), ("doc_id",))
HEADLINES = Contract("headlines", (
    text("headline_id", False), count("ts"), text("source"), text("text", False)), ("headline_id",))
CANDLES = Contract("candles", (
    text("ticker", False), count("ts"), Field("period_minutes", "bigint", False, one_of=PERIODS),
    *[price(f"{s}_{p}") for s in ("yes_bid", "yes_ask", "price") for p in ("open", "high", "low", "close")],
    price("price_mean"), Field("volume", "double", True, 0.0), Field("open_interest", "double", True, 0.0)),
    ("ticker", "ts", "period_minutes"))
REPLAY = Contract("replay", (
    text("market_ticker", False), text("occasion"), text("speaker"), text("format", False, FORMATS),
    text("resolution_risk", False, RISKS), count("decision_ts", True, None), text("split", False, SPLITS),
    Field("y", "bigint", False, one_of=(0, 1)), price("market_prob"), price("p_base"), price("p_topic"), price("p_cal"),
    Field("traded", "boolean", False), text("side", True, SIDES), price("quote_price"), Field("filled", "boolean", False),
    count("fill_ts", True, None), price("fill_price"), Field("fee", "double", False, 0.0),
    Field("contracts", "double", False, 0.0), Field("stake", "double", False, 0.0), Field("payout", "double", False),
    Field("pnl", "double", False), Field("decided_by_technicality", "boolean", False)), ("market_ticker",))
TRANSCRIPT = Contract("transcript", (
    text("occasion_id", False), count("word_idx"), text("word", False), count("t_start_utc"), count("t_end_utc"),
    text("source", False), Field("asr_conf", "double", True, 0.0, 1.0)), ("occasion_id", "word_idx"))
# A live transcript marks words committed without agreement with a confidence of -1.
LIVE_TRANSCRIPT = Contract("live transcript", TRANSCRIPT.fields[:-1] + (
    Field("asr_conf", "double", True, -1.0, 1.0),), TRANSCRIPT.key)
# New tick columns go at the end only.
TICKS = Contract("ticks", (
    text("ticker", False), count("recv_utc"), count("seq"), *[Field(n, "double") for n in (
        "yes_bid", "yes_ask", "depth_bid", "depth_ask", "yes_bid2", "yes_ask2", "depth_bid2", "depth_ask2")]))
PREDICTIONS = Contract("predictions", (
    text("market_ticker", False), count("decision_ts", True, None), text("split", False, SPLITS),
    Field("y", "bigint", False, one_of=(0, 1)), price("p_base"), price("p_topic"), price("p_cal")), ("market_ticker",))

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tapeline.functions import prices, text, times


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame(rows, ddl).coalesce(1).select(column).collect()]


def test_round_cents_is_exact(spark):
    rng = random.Random(3)
    xs = [rng.random() * 1.02 for _ in range(20_000)] + [c / 1000 for c in range(1021)] + [c / 100 + 0.01 for c in range(101)]
    got = values(spark, [(x,) for x in xs], "x double", prices.round_cents(F.col("x")))
    assert got == [round(x, 2) for x in xs]


@pytest.mark.parametrize("side,bid,ask,want", [
    ("yes", 0.40, 0.45, 0.41), ("no", 0.40, 0.45, 0.44), ("yes", 0.40, 0.41, None), ("no", 0.40, 0.41, None)])
def test_maker_quote(spark, side, bid, ask, want):
    q = prices.maker_quote(F.col("s"), F.col("b"), F.col("a"), 0.01)
    assert values(spark, [(side, bid, ask)], "s string, b double, a double", q) == [want]


def test_number_is_lenient(spark):
    rows = [("0.5",), ("x",), ("",), (None,), ("NaN",)]
    assert values(spark, rows, "s string", prices.number(F.col("s"))) == [0.5, None, None, None, None]


@pytest.mark.parametrize("label,body,count,occurs", [
    ("Inflation", "Inflation is here. inflation's cost; inflations", 3, True),
    ("Afford / Affordable", "affordable homes we can afford", 2, True),
    ("Inflation (3+ times)", "inflation inflation", 2, False),
    ("Inflation (3+ times)", "inflation inflation INFLATION", 3, True),
    ("World Cup", "the world  cups and World Cup.", 2, True),
    ("ICE", "nice rice ice", 1, True),
    ("Billionaire", "billionaires' tax", 1, True),
    ("Iran’s", "iran’s", 1, True),
    ("C++", "we use C++ and c+++", 2, True),
    ("", "anything", 0, False),
])
def test_phrase_spec(spark, label, body, count, occurs):
    spec = text.phrase_spec(F.col("l"))
    df = spark.createDataFrame([(label, body)], "l string, b string").withColumn("s", spec).select(
        text.count_matches(F.col("b"), F.col("s.pattern")).alias("n"), "s.min_count", "s.pattern")
    r = df.first()
    assert r["n"] == count
    assert (r["pattern"] is not None and r["n"] >= r["min_count"]) == occurs


def test_phrase_keys_and_variants(spark):
    rows = [("Oil / Gas",), ("gas/OIL ",), ("Inflation (3+ times)",), ("Afford / Affordable",), (None,)]
    spec = text.phrase_spec(F.col("l"))
    assert values(spark, rows, "l string", spec["phrase_key"]) == ["gas|oil", "gas|oil", "inflation|>=3", "afford|affordable", ""]
    assert values(spark, rows, "l string", spec["variant"]) == [
        "aliases_listed", "aliases_listed", "count_threshold", "plural_possessive", "fuzzy"]


def test_speaker_key(spark):
    rows = [("Chair Jerome H. Powell",), ("Vice Chair for Supervision Michael S. Barr",), ("the Federal Reserve Chair",),
            ("Mr. President Joe Biden",), ("  ",), (None,), ("Fed",)]
    assert values(spark, rows, "s string", text.speaker_key(F.col("s"))) == [
        "jerome powell", "michael barr", "jerome powell", "joe biden", "", "", "jerome powell"]


def test_tokens_fold_as_compatibility_decomposition(spark):
    ws = ["Café", "naïve’s", "Iran's", "ﬁne", "x²", "½", "Ångström", "ＡＢＣ", "日本", "It’s", "goal!", "١", "㎏", "ĳ"]

    def by_hand(w):
        s = unicodedata.normalize("NFKD", w).encode("ascii", "ignore").decode().lower()
        s = s.replace("'s", "") if s.endswith("'s") else s
        return "".join(c for c in s if c.isascii() and c.isalnum())

    assert values(spark, [(w,) for w in ws], "w string", text.reprice_token(F.col("w"))) == [by_hand(w) for w in ws]


def test_stem_and_forms(spark):
    assert values(spark, [(w,) for w in ("scoring", "goed", "goals", "goes", "is", "bus", "passes")], "w string", text.stem(F.col("w"))) == [
        "scor", "goed", "goal", "goe", "is", "bus", "pass"]
    assert values(spark, [("Red Card / goal",), ("Comeback / Come Back",)], "p string", text.surface_forms(F.col("p"))) == [
        ["goal", "goals", "red card", "red cards"], ["come back", "come backs", "comeback", "comebacks"]]


def test_formats_and_speakers(spark):
    rows = [("KXNFLMENTION", "x"), ("KXEARNINGSMENTIONAAPL", "Apple"), ("KXDWTS", ""), ("KXQ", "Face the Nation"), ("KXTRUMP", "Trump"), ("KXQ", "Acme earnings")]
    assert values(spark, rows, "t string, n string", text.market_format(F.col("t"), F.col("n"))) == [
        "sports", "earnings", "entertainment", "broadcast", "speech", "earnings"]
    assert values(spark, [("T", "Apple earnings call mention"), ("T", " - mention"), ("T", None)], "t string, n string",
                  text.series_speaker(F.col("t"), F.col("n"))) == ["Apple", "T", "T"]


def test_times(spark):
    assert values(spark, [("2026-07-03T15:00:00Z",), ("2026-07-03T15:00:00.5+02:00",), ("soon",), ("",), ("2026",), (None,)], "s string",
                  times.iso_to_seconds(F.col("s"))) == [1783090800, 1783083600, None, None, None, None]
    assert values(spark, [("20240612T191500Z",), ("2024",), ("20241312T191500Z",)], "s string", times.seendate_to_seconds(F.col("s"))) == [1718219700, None, None]
    assert values(spark, [("on February 17, 2026 at",), ("February 31, 2026",), ("nothing",)], "s string",
                  times.long_date_to_seconds(F.col("s"))) == [1771286400, None, None]
    assert [str(d) for d in values(spark, [("KX-26JUL04",), ("KX-26APR29C",), ("KX-26FEB30",), ("KX-26XXX01",), ("A-26JUN14CARVGK-B",)], "s string",
                                   times.ticker_date(F.col("s")))] == ["2026-07-04", "2026-04-29", "None", "None", "2026-06-14"]
    day = F.to_date("s")
    assert values(spark, [("2026-07-04",)], "s string", times.day_start(day)) == [1783137600]
    # the day the clocks go back has 25 hours
    assert values(spark, [("2026-11-01",)], "s string", times.day_end(day) - times.day_start(day)) == [25 * 3600]
    assert values(spark, [(60,), (61,), (0,), (-1,), (-60,)], "t bigint", times.bucket_end(F.col("t"), 60)) == [60, 120, 0, 0, -60]
    assert values(spark, [(60,), (61,)], "t bigint", times.next_boundary(F.col("t"), 60)) == [120, 120]


def test_book_state_of_missing_depth(spark):
    rows = [(0.4, 0.5, 1.0, 1.0), (0.5, 0.5, 1.0, 1.0), (0.4, 0.5, 1.0, None), (0.4, 0.5, 1e-9, 1.0), (None, None, None, None), (None, 0.5, 1.0, 1.0)]
    cols = [F.col("b"), F.col("a"), prices.touch_depth(F.col("db")), prices.touch_depth(F.col("da"))]
    assert values(spark, rows, "b double, a double, db double, da double", prices.book_state(*cols)) == [
        "VALID", "CROSSED", "EMPTY_ASK", "EMPTY_BID", "EMPTY_BOTH", "VALID"]

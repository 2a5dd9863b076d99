"""Time functions. Stored times are whole unix seconds (``bigint``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"
DAY_S = 86_400

# Month names in dates and month codes in tickers.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December")
MONTH_CODES = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN",
               "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def bucket_end(ts: Column, period_s: int) -> Column:
    """End of the bucket ``(S - period, S]`` holding ``ts``."""
    return ts + F.pmod(-ts, F.lit(period_s).cast("bigint"))


def next_boundary(ts: Column, period_s: int) -> Column:
    """First boundary strictly after ``ts``."""
    return ts - F.pmod(ts, F.lit(period_s).cast("bigint")) + F.lit(period_s)


def iso_to_seconds(value: Column) -> Column:
    """ISO date-time text to unix seconds; anything else is NULL."""
    full = value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$")
    return F.when(full, F.unix_seconds(F.try_to_timestamp(value)))


def seendate_to_seconds(value: Column) -> Column:
    """``yyyyMMddTHHmmssZ`` to unix seconds."""
    shaped = F.when(value.rlike(r"^\d{8}T\d{6}Z$"), value)
    return F.unix_seconds(F.try_to_timestamp(shaped, F.lit("yyyyMMdd'T'HHmmss'Z'")))


def digits_to_seconds(value: Column) -> Column:
    """``yyyymmdd`` to unix seconds at midnight UTC."""
    shaped = F.when(value.rlike(r"^\d{8}$"), value)
    return F.unix_seconds(F.try_to_timestamp(shaped, F.lit("yyyyMMdd")))


def long_date_to_seconds(text: Column) -> Column:
    """First "Month d, yyyy" in ``text`` to unix seconds."""
    pattern = "(" + "|".join(MONTH_NAMES) + r")\s+(\d{1,2}),\s+(\d{4})"
    month = F.regexp_extract(text, pattern, 1)
    number = F.array_position(F.array(*[F.lit(m) for m in MONTH_NAMES]), month)
    day = F.regexp_extract(text, pattern, 2)
    year = F.regexp_extract(text, pattern, 3)
    stamp = F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(month != "", F.unix_seconds(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd"))))


def month_spine(bounds: DataFrame) -> DataFrame:
    """Months ``start_month..end_month`` (``yyyy-mm``, inclusive) of each row, with their bounds as
    digits (X20)."""
    first = F.to_date(F.concat("start_month", F.lit("-01")))
    last = F.to_date(F.concat("end_month", F.lit("-01")))
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))
    return bounds.select(F.explode(months).alias("m")).select(
        F.year("m").cast("bigint").alias("year"),
        F.month("m").cast("bigint").alias("month"),
        F.date_format("m", "yyyyMMddHHmmss").alias("start_digits"),
        F.date_format(F.add_months("m", 1), "yyyyMMddHHmmss").alias("end_digits"),
    )


def ticker_date(ticker: Column) -> Column:
    """Date held by the rightmost ``yyMONdd`` segment of a ticker.

    A segment of that shape with a real month decides the answer even when its day is impossible,
    in which case the date is NULL.
    """
    months = "|".join(MONTH_CODES)
    shape = rf"^(\d{{2}})({months})(\d{{2}})[A-Z]*$"
    segments = F.filter(
        F.transform(F.split(F.upper(ticker), "-"), lambda s: F.trim(s)), lambda s: s.rlike(shape)
    )
    segment = F.try_element_at(segments, F.lit(-1))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTH_CODES]),
                              F.regexp_extract(segment, shape, 2))
    digits = F.concat(F.lit("20"), F.regexp_extract(segment, shape, 1),
                      F.lpad(number.cast("string"), 2, "0"), F.regexp_extract(segment, shape, 3))
    return F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))


def _zoned_seconds(day: Column, hour: int) -> Column:
    local = F.concat(day.cast("string"), F.lit(f" {hour:02d}:00:00"))
    return F.unix_seconds(F.to_utc_timestamp(F.try_to_timestamp(local), MARKET_ZONE))


def day_start(day: Column) -> Column:
    """Start of the market's civil day."""
    return _zoned_seconds(day, 0)


def day_end(day: Column) -> Column:
    """End (exclusive) of the market's civil day."""
    return _zoned_seconds(F.date_add(day, 1), 0)


def day_noon(day: Column) -> Column:
    """Noon of the market's civil day."""
    return _zoned_seconds(day, 12)


def local_clock(ts: Column, offset_hours: float) -> Column:
    """``HH:mm:ss`` at a fixed offset from UTC."""
    shifted = F.floor(ts) + F.lit(int(offset_hours * 3600))
    second = F.pmod(shifted, F.lit(DAY_S))
    parts = [F.floor(second / 3600), F.floor(F.pmod(second, F.lit(3600)) / 60),
             F.pmod(second, F.lit(60))]
    return F.concat_ws(":", *[F.lpad(p.cast("string"), 2, "0") for p in parts])


def arm_at(occurrence_ts: Column, lead_s: int = 1800) -> Column:
    """Arm time of an occasion."""
    return occurrence_ts - F.lit(lead_s)

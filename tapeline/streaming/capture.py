"""Capture health over ticks and words: blind watch and auto-stop."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tapeline.functions.times import next_boundary
from tapeline.operators.joins import asof_backward
from tapeline.operators.ordered import by_seconds, following

ALERT_SCHEMA = "occasion_id bigint, at bigint, kind string"
#: Occasions reach Python by buckets, as each call costs more than the checks of an occasion.
BUCKETS = 2048


@dataclass(frozen=True)
class CaptureLimits:
    min_capture_s: int = 600
    max_capture_s: int = 3 * 3600
    quiet_s: int = 300
    move_threshold: float = 0.08
    move_window_s: int = 300
    blind_s: int = 180
    period_s: int = 60


BROADCAST_LIMITS = CaptureLimits(min_capture_s=900, max_capture_s=int(3.5 * 3600), quiet_s=600)


def stop_times(words: DataFrame, occasions: DataFrame, limits: CaptureLimits = CaptureLimits()) -> DataFrame:
    """When and why each capture stops.

    Checks happen one second after each period boundary. A capture ends at the first check past
    its cap, or at the first one where it is long enough and no word has come for the quiet time.
    ``occasions``: occasion_id, capture_start_utc, occurrence_ts. Each word starts one silence, so
    the rule is one pass over word ends.
    """
    p = limits.period_s

    def check_at(ts):
        """First check at or after a time."""
        return next_boundary(ts - 2, p) + 1

    ends = words.groupBy("occasion_id", F.col("t_end_utc").alias("t")).agg(F.lit(1).alias("n"))
    rows, order = by_seconds(ends, ("occasion_id",), "t")
    silences = following(rows, order, _next=F.col("t")).join(occasions, "occasion_id")
    due = check_at(F.greatest(F.col("t") + limits.quiet_s, F.col("capture_start_utc") + limits.min_capture_s))
    quiet = silences.filter(F.col("_next").isNull() | (due < F.col("_next"))).groupBy("occasion_id").agg(
        F.min(due).alias("_quiet_at"))
    cap = check_at(F.greatest(F.col("occurrence_ts") + limits.max_capture_s, F.col("capture_start_utc") + 1))
    out = occasions.join(quiet, "occasion_id", "left").withColumn("_cap_at", cap)
    ended = F.col("_quiet_at") < F.col("_cap_at")
    return out.select("occasion_id", F.when(ended, F.col("_quiet_at")).otherwise(F.col("_cap_at")).alias("stop_utc"),
                      F.when(ended, "speech_ended").otherwise("max_duration").alias("stop_reason"))


def blind_minutes(quotes: DataFrame, words: DataFrame, occasions: DataFrame,
                  limits: CaptureLimits = CaptureLimits()) -> DataFrame:
    """Checks at which a book has moved while the transcript stood still.

    ``quotes``: occasion_id, ticker, at, mid - the standing mid at each check, one row per ticker
    and check. A missing mid is no observation.
    """
    back = Window.partitionBy("occasion_id", "ticker").orderBy("at").rangeBetween(-limits.move_window_s, 0)
    span = F.max("mid").over(back) - F.min("mid").over(back)
    moved = quotes.filter(F.col("mid").isNotNull()).withColumn("_span", span).groupBy("occasion_id", "at").agg(
        F.max("_span").alias("span")).filter(F.col("span") >= limits.move_threshold)
    spoken = words.groupBy("occasion_id", "t_end_utc").agg(F.lit(1).alias("_n"))
    seen = asof_backward(moved, spoken, "occasion_id", F.col("at"), F.col("t_end_utc"), "_n", ["t_end_utc"], "w")
    since = F.coalesce("w.t_end_utc", "capture_start_utc")
    return seen.join(occasions.select("occasion_id", "capture_start_utc"), "occasion_id").filter(
        F.col("at") - since >= limits.blind_s).select("occasion_id", "at", "span", (F.col("at") - since).alias("silent_s"))


def _thinned(observations: DataFrame, period_s: int) -> DataFrame:
    """The observations that a check can see, of those that Python gets together.

    Of a ticker (or the words) only the last one before a check counts; the first of each period
    stays too, as it may start the capture.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts = b.column("ts")
            at = pc.fill_null(ts, 0).to_numpy()
            rows = pd.DataFrame({c: pc.dictionary_encode(b.column(c), null_encoding="encode").indices.to_numpy() for c in ("occasion_id", "ticker")})
            rows["period"] = -((1 - at) // period_s)  # checks come one second after each boundary
            rows = rows.iloc[np.argsort(at, kind="stable")]
            needed = ~rows.duplicated(keep="last") | ~rows.duplicated(["occasion_id", "period"], keep="first")
            yield b.filter(pc.or_(pc.is_null(ts), pa.array(needed.sort_index().to_numpy())))

    return observations.mapInArrow(run, observations.schema)


class _Watch(StatefulProcessor):
    """Standing mids and the last word of each occasion of a bucket, checked after every period boundary."""

    def __init__(self, limits: CaptureLimits) -> None:
        self.limits = limits

    def init(self, handle) -> None:
        self.handle = handle
        # small: five minutes of one mid per ticker and check, and when the next check is due
        self.running = handle.getValueState("watch", "body string")
        self.stopped = handle.getValueState("stopped", "body string")
        # observations that the watermark has not passed, those of a micro-batch together
        self.pending = handle.getListState("pending", "body string")

    def _first(self, start: int) -> int:
        return (start // self.limits.period_s + 1) * self.limits.period_s + 1

    def _timer(self, running: dict) -> None:
        """One timer a bucket, at the first check that is due."""
        due = [min(s["check"] for s in running.values()) * 1000] if running else []
        if (before := list(self.handle.listTimers())) != due:
            for old in before:
                self.handle.deleteTimer(old)
            for new in due:
                self.handle.registerTimer(new)

    def _check(self, s: dict, at: int) -> list[tuple[int, str]]:
        lim, out = self.limits, []
        for ticker, mid in s["mids"].items():
            hist = s["hist"].setdefault(ticker, [])
            hist.append([at, mid])
            s["hist"][ticker] = [h for h in hist if at - h[0] <= lim.move_window_s]
        moved = any(max(m for _, m in h) - min(m for _, m in h) >= lim.move_threshold for h in s["hist"].values() if h)
        if moved and at - (s["word"] or s["start"]) >= lim.blind_s:
            out.append((at, "blind"))
        if at >= s["occurrence"] + lim.max_capture_s:
            out.append((at, "max_duration"))
        elif at - s["start"] >= lim.min_capture_s and s["word"] and at - s["word"] >= lim.quiet_s:
            out.append((at, "speech_ended"))
        s["stopped"] = bool(out) and out[-1][1] != "blind"
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gone = self.stopped.get()
        gone = set(json.loads(gone[0])) if gone else set()
        batch = [(o, int(ts), None if pd.isna(t) else t, None if pd.isna(m) else float(m))
                 for part in rows for o, ts, t, m in zip(part["occasion"], part["ts"], part["ticker"], part["mid"]) if not pd.isna(o) and o not in gone]
        if batch:
            running = self.running.get()
            running = json.loads(running[0]) if running else {}
            first: dict[str, int] = {}
            for o, ts, *_ in batch:
                first[o] = min(ts, first.get(o, ts))
            for o, ts in first.items():
                s = running.setdefault(o, {"check": self._first(ts)})
                if "start" not in s:  # until the first check the earliest observation tells when it is due
                    s["check"] = min(s["check"], self._first(ts))
            self.pending.appendValue((json.dumps(batch),))
            self.running.update((json.dumps(running),))
            self._timer(running)
        yield from ()

    def _run(self, s: dict, rows: list[list], upto: int) -> tuple[dict, list[list], list[tuple[int, str]]]:
        """All checks of one occasion that are due: its state, the rows that are left, the alerts."""
        out, i = [], 0
        if "start" not in s:
            start = rows[0][0]
            s = {"start": start, "occurrence": start, "word": 0, "mids": {}, "hist": {}, "stopped": False, "check": self._first(start)}
        while not s["stopped"] and s["check"] <= upto:
            while i < len(rows) and rows[i][0] <= s["check"]:
                ts, ticker, mid = rows[i]
                if ticker is None:
                    s["word"] = max(s["word"], ts)
                elif mid is not None:
                    s["mids"][ticker] = mid
                else:
                    s["mids"].pop(ticker, None)
                i += 1
            out += self._check(s, s["check"])
            s["check"] += self.limits.period_s
        return s, rows[i:], out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, waiting = timerValues.getCurrentWatermarkInMs() // 1000, {}
        for (body,) in self.pending.get() if self.pending.exists() else []:
            for o, *r in json.loads(body):
                waiting.setdefault(o, []).append(r)
        running, ended, left, out = json.loads(self.running.get()[0]), [], [], []
        for o, s in list(running.items()):
            rows = sorted(waiting.get(o, []), key=lambda r: r[0])
            if s["check"] <= upto:
                s, rows, found = self._run(s, rows, upto)
                out += [(int(o), at, kind) for at, kind in found]
            if s.get("stopped"):
                ended.append(o)
                del running[o]
            else:
                running[o] = s
                left += [(o, *r) for r in rows]
        self.running.update((json.dumps(running),))
        if ended:
            gone = self.stopped.get()
            self.stopped.update((json.dumps((json.loads(gone[0]) if gone else []) + ended),))
        if left:
            self.pending.put([(json.dumps(left),)])
        else:
            self.pending.clear()
        self._timer(running)
        if out:
            yield pd.DataFrame(out, columns=["occasion_id", "at", "kind"])

    def close(self) -> None:
        pass


def watch(observations: DataFrame, limits: CaptureLimits = CaptureLimits(), delay_s: int = 1) -> DataFrame:
    """Alerts of a running capture from one stream of observations.

    ``observations``: occasion_id, ts, ticker, mid. A row without a ticker is a word that ended at
    ``ts``; one with a ticker is its standing mid. The first observation starts the capture.
    A check runs when the watermark, ``delay_s`` behind the latest observation of any occasion,
    has passed it, so an occasion that falls silent is stopped too; later rows are dropped. A row
    without an occasion only moves the watermark. Observations that no check can see leave before
    the shuffle; so if the watermark already stands inside the period of an occasion's first rows,
    the capture may start with a later row of that same period.
    """
    seen = _thinned(observations.select("occasion_id", "ts", "ticker", "mid"), limits.period_s)
    # as text, for a column of numbers with a null would come to Python as floats
    timed = seen.select(F.pmod(F.xxhash64("occasion_id"), F.lit(BUCKETS)).alias("bucket"), F.col("occasion_id").cast("string").alias("occasion"),
                        "ts", "ticker", "mid", F.timestamp_seconds("ts").alias("_at"))
    return timed.withWatermark("_at", f"{delay_s} seconds").groupBy("bucket").transformWithStateInPandas(
        _Watch(limits), ALERT_SCHEMA, "Append", "EventTime")

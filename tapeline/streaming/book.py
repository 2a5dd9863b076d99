"""Order book rebuilt from snapshot and delta frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tapeline.functions import prices

TICK_SCHEMA = ("ticker string, recv_utc bigint, seq bigint, yes_bid double, yes_ask double, depth_bid double, "
               "depth_ask double, yes_bid2 double, yes_ask2 double, depth_bid2 double, depth_ask2 double")
_COLUMNS = [c.split()[0] for c in TICK_SCHEMA.split(", ")]
#: Tickers that share a bucket are handed to Python together: what it costs to call it is paid per bucket and micro-batch.
BUCKETS = 2048
_FRAME = ["snapshot", "yes_price", "yes_count", "no_price", "no_count", "side", "price", "delta"]


def _dollars(price: Column) -> Column:
    p = prices.number(price)
    return F.round(F.when(p > 1.0, p / 100.0).otherwise(p), 4)


def levels(raw: Column) -> Column:
    """``[[price, count], ...]`` to an array of levels, last count of a price.

    Cents become dollars, malformed pairs and empty levels are skipped.
    """
    pairs = F.filter(F.coalesce(raw, F.array().cast("array<array<string>>")), lambda p: F.size(p) >= 2)
    parsed = F.filter(F.transform(pairs, lambda p: F.struct(_dollars(p[0]).alias("price"), prices.number(p[1]).alias("count"))),
                      lambda x: x["price"].isNotNull() & (x["count"] > 0))
    return F.transform(F.array_distinct(F.transform(parsed, lambda x: x["price"])), lambda k: F.struct(
        k.alias("price"), F.element_at(F.filter(parsed, lambda x: x["price"] == k), -1)["count"].alias("count")))


def frames(payloads: DataFrame) -> DataFrame:
    """Frame text (``recv_utc``, ``body``) to parsed book frames; other frame types are dropped.

    The receive time is the one stamped when the frame was read.
    """
    arr = "array<array<string>>"
    parsed = F.from_json("body", "struct<type:string,seq:bigint,msg:struct<market_ticker:string,"
                         f"yes_dollars_fp:{arr},yes:{arr},no_dollars_fp:{arr},no:{arr},"
                         "side:string,price_dollars:string,price:string,delta_fp:string,delta:string>>")
    p = payloads.select("recv_utc", parsed.alias("p")).filter(
        F.col("p.type").isin("orderbook_snapshot", "orderbook_delta") & (F.col("p.msg.market_ticker") != ""))
    m = F.col("p.msg")
    return p.select(
        m["market_ticker"].alias("ticker"), "recv_utc", F.coalesce("p.seq", F.lit(0)).alias("seq"),
        (F.col("p.type") == "orderbook_snapshot").alias("snapshot"),
        levels(F.coalesce(m["yes_dollars_fp"], m["yes"])).alias("yes"), levels(F.coalesce(m["no_dollars_fp"], m["no"])).alias("no"),
        F.lower(m["side"]).alias("side"), _dollars(F.coalesce(m["price_dollars"], m["price"])).alias("price"),
        prices.number(F.coalesce(m["delta_fp"], m["delta"])).alias("delta"))


def _top(book: dict[float, float]) -> list[tuple[float | None, float | None]]:
    best = sorted(book, reverse=True)[:2]
    return [(p, book[p]) for p in best] + [(None, None)] * (2 - len(best))


def _ask(price: float | None) -> float | None:
    return None if price is None else round(1.0 - price, 4)


class _Rebuild(StatefulProcessor):
    """The books of a bucket of tickers, one state entry each; one top-of-book row per frame."""

    def init(self, handle) -> None:
        self.books = handle.getMapState("books", "ticker string", "yes_price array<double>, yes_count array<double>, no_price array<double>, no_count array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        batch = frames[0] if len(frames) == 1 else pd.concat(frames)
        codes, tickers = pd.factorize(batch["ticker"])
        order = np.lexsort((batch["recv_utc"].to_numpy(), batch["seq"].to_numpy(), codes))
        batch, out = batch.iloc[order], []
        ends = np.cumsum(np.bincount(codes)).tolist()
        values = list(zip(*(batch[c].tolist() for c in _FRAME)))
        for ticker, lo, hi in zip(tickers, [0, *ends], ends):
            out += self._tops(ticker, values[lo:hi])
        yield pd.DataFrame({**{c: batch[c].to_numpy() for c in _COLUMNS[:3]}, **dict(zip(_COLUMNS[3:], zip(*out)))}, columns=_COLUMNS)

    def _tops(self, ticker: str, frames: list[tuple]) -> list[tuple]:
        """Apply a ticker's frames, in order, to its book."""
        kept = self.books.getValue((ticker,)) or ((),) * 4
        kept = {"yes": dict(zip(kept[0], kept[1])), "no": dict(zip(kept[2], kept[3]))}
        books = {s: dict(b) for s, b in kept.items()}
        tops, out = {s: _top(b) for s, b in books.items()}, []
        for snapshot, yp, yn, np_, nn, side, price, delta in frames:
            if snapshot:
                books = {"yes": dict(zip(yp, yn)), "no": dict(zip(np_, nn))}
                tops = {s: _top(b) for s, b in books.items()}
            elif side in books and price == price and delta == delta:  # neither is missing
                book = books[side]
                count = book.get(price, 0.0) + delta
                if count > 0:
                    book[price] = count
                else:
                    book.pop(price, None)
                tops[side] = _top(book)
            ((b1, db1), (b2, db2)), ((n1, dn1), (n2, dn2)) = tops["yes"], tops["no"]
            out.append((b1, _ask(n1), db1, dn1, b2, _ask(n2), db2, dn2))
        if books != kept:
            self.books.updateValue((ticker,), tuple(list(v) for b in (books["yes"], books["no"]) for v in (b.keys(), b.values())))
        return out

    def close(self) -> None:
        pass


def rebuild(book_frames: DataFrame) -> DataFrame:
    """Top of book and the level behind it after every frame.

    A snapshot replaces both sides, a delta changes one level, and a level at or below zero is
    gone. Frames of a ticker are applied in ``seq`` order inside a micro-batch, whose size the
    source's rate limit bounds; across batches the state carries the book.
    Tickers are handed to Python by buckets; a checkpoint of the earlier layout, keyed by ticker, can't be continued.
    """
    # plain arrays reach Python much faster than arrays of rows
    plain = [F.col(s)[f].alias(f"{s}_{f}") for s in ("yes", "no") for f in ("price", "count")]
    flat = book_frames.select(F.pmod(F.xxhash64("ticker"), F.lit(BUCKETS)).alias("_bucket"), "ticker", "recv_utc", "seq", "snapshot", *plain, "side", "price", "delta")
    return flat.groupBy("_bucket").transformWithStateInPandas(_Rebuild(), TICK_SCHEMA, "Append", "None")

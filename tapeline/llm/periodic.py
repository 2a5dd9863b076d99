"""Periodic runs of words: branching tandem repeats in an enhanced suffix array.

A text is a sequence of words. Its suffixes are sorted, and the lengths of the prefixes that
neighbours share cut the order into LCP intervals: all suffixes that share a prefix of that depth.
Inside an interval of depth D a square of period D stands at i where the suffix i + D lies in the
same interval, which the inverse suffix array tells; it is branching where the word after it ends
the repetition. Either half of such a square lies outside the interval's largest child, so only the
suffixes of the smaller children are tried, each as the first and as the second half: n log n tries
in all, and no tree nodes. A branching square rotated to the left until the words differ is a run;
squares that give the same stretch are merged and the least period stays.

Many texts are sorted in one go: words are numbered apart for every text, so no suffix shares a
prefix with one of another text, and no match runs over a text's end.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.common import query, slices, table, utf8, words

LEAST_WORDS = 6
LEAST_EXPONENT = 4
BATCH_WORDS = 1 << 17  # texts sorted together hold about so many words; a longer one is sorted alone

Prepare = Callable[[object, list[bytes]], list[bytes]]


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """The words of all texts as numbers; equal only for equal words of one text."""
    out, base = np.empty(sum(map(len, texts)), np.int64), 0
    at = 0
    for w in texts:
        seen: dict[bytes, int] = {}
        out[at:at + len(w)] = [base + seen.setdefault(x, len(seen)) for x in w]
        base, at = base + len(seen), at + len(w)
    return out


def suffix_order(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, inverse, ranks by prefixes of 1, 2, 4, … words) by prefix doubling.

    A rank is the first place of its group in the order. Only groups of more than one suffix are
    sorted again. Past the end ranks are -1, so a shorter suffix comes first.
    """
    n = len(t)
    sa = np.argsort(t, kind="stable")
    first = np.concatenate([[True], t[sa[1:]] != t[sa[:-1]]])
    rank = np.full(n + 1, -1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, width = [rank.copy()], 1
    while True:
        alone = first & np.concatenate([first[1:], [True]])
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        s = sa[at]
        key = rank[s] * (n + 1) + rank[np.minimum(s + width, n)] + 1
        order = np.argsort(key, kind="stable")
        s, key = s[order], key[order]
        sa[at] = s
        first[at] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[s] = np.maximum.accumulate(np.where(first, np.arange(n), 0))[at]
        levels.append(rank.copy())
        width *= 2
    inverse = np.empty(n, np.int64)
    inverse[sa] = np.arange(n)
    return sa, inverse, levels


def shared_prefixes(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix of the order shares with the one before it; -1 at both ends."""
    n = len(sa)
    a, b = sa[:-1].copy(), sa[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)]
        same &= (a < n) & (b < n)
        a += same << k
        b += same << k
    return np.concatenate([[-1], a - sa[:-1], [-1]])


def _lower_neighbours(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest place with a smaller value before and after each place of ``at``."""
    least, k = [lcp], 1  # least[k][i]: the least of 2 ** k values from i on
    while 2 * k <= len(lcp):
        least.append(np.minimum(least[-1][:-k], least[-1][k:]))
        k *= 2
    value, after, before = lcp[at], at + 1, at - 1
    for k in range(len(least) - 1, -1, -1):
        size, m = 1 << k, least[k]
        ok = after + size <= len(lcp)
        ok &= m[np.minimum(after, len(m) - 1)] >= value
        after = np.where(ok, after + size, after)
        ok = before - size + 1 >= 0
        ok &= m[np.clip(before - size + 1, 0, len(m) - 1)] >= value
        before = np.where(ok, before - size, before)
    return before, after


def _tried(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place in the order, depth, left, right): all places in the smaller children of intervals."""
    at = np.flatnonzero(lcp > 0)
    left, end = _lower_neighbours(lcp, at)
    right = end - 1
    # the interval's inner edges in order: the children lie between them
    order = np.lexsort((at, right, left))
    at, left, right = at[order], left[order], right[order]
    new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]) if len(at) else np.empty(0, bool)
    last = np.concatenate([new[1:], [True]]) if len(at) else new
    start = np.concatenate([np.where(new, left, np.concatenate([[0], at[:-1]])), at[last]])
    stop = np.concatenate([at, right[last] + 1])
    depth = np.concatenate([lcp[at], lcp[at[last]]])
    lo, hi = np.concatenate([left, left[last]]), np.concatenate([right, right[last]])
    group = np.concatenate([np.cumsum(new), np.cumsum(new)[last]]) - 1
    # all children but the largest (of equal ones, the first)
    by = np.lexsort((start, start - stop, group))
    largest = by[np.concatenate([[True], group[by][1:] != group[by][:-1]])] if len(by) else by
    small = np.ones(len(start), bool)
    small[largest] = False
    start, stop, depth, lo, hi = (x[small] for x in (start, stop, depth, lo, hi))
    size = stop - start
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    return place, np.repeat(depth, size), np.repeat(lo, size), np.repeat(hi, size)


def branching_squares(t: np.ndarray, sa: np.ndarray, inverse: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square whose next word ends the repetition."""
    n = len(t)
    place, depth, lo, hi = _tried(lcp)
    i = sa[place]
    other = np.stack([i, i - depth])  # the square starts at the suffix, or one period before it
    met = np.stack([i + depth, i - depth])  # where its other half starts
    ok = (met >= 0) & (met < n)
    q = inverse[np.clip(met, 0, n - 1)]
    ok &= (q >= lo) & (q <= hi)
    after = other + 2 * depth
    ok &= (after >= n) | (t[np.clip(after, 0, n - 1)] != t[np.clip(after - depth, 0, n - 1)])
    start, period = other[ok], np.broadcast_to(depth, other.shape)[ok]
    keep = np.unique(start * (n + 1) + period)
    return keep // (n + 1), keep % (n + 1)


def rotated(start: np.ndarray, period: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The start of each square's run: as far to the left as words one period apart agree."""
    a, b = start.copy(), start + period
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        same = (a >= size) & (levels[k][np.maximum(a - size, 0)] == levels[k][np.maximum(b - size, 0)])
        a -= same << k
        b -= same << k
    return a


def runs_of(t: np.ndarray, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, ...]:
    """(start, length, period) of every run, by start, then period."""
    if len(t) < 2:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    sa, inverse, levels = suffix_order(t)
    start, period = branching_squares(t, sa, inverse, shared_prefixes(sa, levels))
    end, start = start + 2 * period, rotated(start, period, levels)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])]) if len(start) else np.empty(0, bool)
    start, end, period = start[first], end[first], period[first]
    long = end - start >= np.maximum(least, exponent * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def kept(w: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return w
    gone = np.zeros(len(w) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def _grouped(texts: list[list[bytes]]) -> Iterator[slice]:
    lo, held = 0, 0
    for i, w in enumerate(texts):
        if held and held + len(w) > BATCH_WORDS:
            yield slice(lo, i)
            lo, held = i, 0
        held += len(w)
    yield slice(lo, len(texts))


def runs_of_texts(texts: list[list[bytes]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    out: list[list[tuple[int, int, int]]] = []
    for part in _grouped(texts):
        some = texts[part]
        edges = np.cumsum([0, *map(len, some)])
        start, length, period = runs_of(numbered(some), least, exponent)
        own = np.searchsorted(edges, start, side="right") - 1
        found: list[list[tuple[int, int, int]]] = [[] for _ in some]
        for k, s, n, p in zip(own.tolist(), (start - edges[own]).tolist(), length.tolist(), period.tolist()):
            found[k].append((s, n, p))
        out += found
    return out


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def collapse_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT,
                  prepare: Prepare | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (array of start, length, period), collapsed.

    A run is a stretch of at least ``least`` words and ``exponent`` periods in which words one
    period apart are equal, for the least such period, and which no neighbouring word prolongs.
    ``collapsed`` is the text, its words joined by one space, without the words of a run after its
    first period. Words are cut at ASCII white space and unchanged; null, empty and blank texts
    have none, no runs and an empty collapsed text. ``prepare(id, words)`` may change the words
    first. Whole texts are searched, however long; a text is never split. Repeated rows and ids
    stay, null ids too; an empty table gives no rows; other columns aren't read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [words(x) for x in utf8(b, "text")]
            if prepare:
                texts = [prepare(i, w) for i, w in zip(b.column(b.schema.get_field_index("id")).to_pylist(), texts)]
            runs = runs_of_texts(texts, least, exponent)
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("id")), pa.array(map(len, texts), pa.int64()), pa.array([[dict(zip(RUN.names, r)) for r in rs] for rs in runs],
                 pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names]))), pa.array([b" ".join(kept(w, r)) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string())],
                names=[id, "n_words", "runs", "collapsed"])

    made = T.StructType([T.StructField(id, docs.schema[id].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, made)


def planted(doc_id: int | None, w: list[bytes]) -> list[bytes]:
    """The words with the registered query's periodic tail; unchanged for a null id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = w[a:a + p]
    return w[:a] + (tail * (-(-(n - a) // p)))[:n - a]


#: A run of six words and four periods agrees with itself, one period on, over five words at least:
#: runs are stretches of equal five-word pieces, and of those over one stretch the least period counts.
_SQL = rf"""
WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_prepend(4294967295, [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')]) AS digits FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, xor(4294967295, list_reduce(digits, lambda x, b: xor(tab[(xor(x, b) & 255) + 1], x >> 8))) AS h FROM d, crc),
a AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 AND h % 10 = 0 THEN (h // 10) % n ELSE n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, [w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] for i in range(n)] AS w FROM p),
u AS (SELECT doc_id, w, unnest(range(0, n - 4)) AS i FROM t),
k AS (SELECT doc_id, i, list_aggregate(w[i + 1:i + 5], 'string_agg', ' ') AS piece FROM u),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.piece = y.piece AND x.i < y.i),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM m GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS q FROM s WHERE length >= greatest({LEAST_WORDS}, {LEAST_EXPONENT} * q) GROUP BY doc_id, start, length),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, q) AS k FROM r),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
z AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM t),
c AS (SELECT z.doc_id, string_agg(word, ' ' ORDER BY z.i) AS collapsed FROM z LEFT JOIN gone ON gone.doc_id = z.doc_id AND gone.i = z.i WHERE gone.i IS NULL GROUP BY z.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, (1000 * length // q)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN o ON o.doc_id = t.doc_id AND o.k = 1 LEFT JOIN l ON l.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id"""


@query("op13_periodic_runs", _SQL)
def _op13(spark, sf_dir):
    found = collapse_runs(table(spark, sf_dir, "documents"), prepare=planted)
    # greatest length, then smallest start, then period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

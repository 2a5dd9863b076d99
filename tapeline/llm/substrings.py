"""Substring dedup: seed and extend over winnowed anchors.

A window is ``length`` consecutive words. Its anchor is the leftmost least hash among the shorter
word grams in it, so equal windows have equal anchors at equal places, and the windows with one
anchor are a run of starts. Anchors are the seeds: documents meet only where they share one. A
run reaches both ways from its anchor; runs whose hashes are equal are repeated as a whole. Only
where the runs of a seed differ, at the edges of a repeat, are their windows grouped one by one, by
a 64-bit hash. The union of all repeated windows is every maximal repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import add_column, free_name, query, slices, table, utf8, words
from tapeline.session import materialize, settled

LENGTH = 35
SEED_WORDS = 8
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_HALF, _NEAR = np.uint64(32), np.uint64(29)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + (b ^ (b >> _HALF)) * _B
    x ^= x >> _NEAR
    x *= _C
    return x ^ (x >> _HALF)


def word_hashes(text: bytes | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words(text)], np.uint64)


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, by doubling."""
    n, have, g = len(h) - size + 1, 1, h
    if n <= 0:
        return np.empty(0, np.uint64)
    while have * 2 <= size:
        g, have = _mix(g[:-have], g[have:]), have * 2
    return g if have == size else _mix(g[:n], g[size - have:])


def anchor_of(seeds: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least value in every ``width`` neighbours."""
    at, have = np.arange(len(seeds)), 1

    def pick(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(seeds[b] < seeds[a], b, a)

    while have * 2 <= width:
        at, have = pick(at[:-have], at[have:]), have * 2
    return at if have == width else pick(at[:len(seeds) - width + 1], at[width - have:])


def anchors(text: bytes | None, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(anchor, first start, last start, hash of the run) of every run of windows."""
    h = word_hashes(text)
    whole = grams(h, length)
    if not len(whole):
        return tuple(np.empty(0, t) for t in (np.uint64, np.int32, np.int32, np.uint64))
    seeds = grams(h, seed)
    at = anchor_of(seeds, length - seed + 1)
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    hi = np.concatenate([lo[1:], [len(at)]]) - 1
    place = at[lo]
    # first and last window overlap or touch, so with their places they fix the run's words
    run = _mix(_mix(whole[lo], whole[hi]), ((place - lo) * 65536 + (hi - place + 32768)).astype(np.uint64))
    return seeds[place], lo.astype(np.int32), hi.astype(np.int32), run


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def all_anchors(texts: DataFrame, length: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [anchors(t, length, seed) for t in utf8(b, "text")]
            keys = b.column(b.schema.get_field_index("key")).take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
            a, lo, hi, span = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([_signed(a), keys, pa.array(lo), pa.array(hi), _signed(span)], names=["anchor", "key", "lo", "hi", "span"])

    return texts.mapInArrow(run, "anchor long, key binary, lo int, hi int, span long")


def windows_of(runs: DataFrame, length: int) -> DataFrame:
    """(window, key, start) for every start in the runs of (key, text, runs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys, hashes, starts = [], [], []
            for i, (t, spans) in enumerate(zip(utf8(b, "text"), b.column(b.schema.get_field_index("runs")).to_pylist())):
                at = np.unique(np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans]))
                keys.append(np.full(len(at), i))
                hashes.append(grams(word_hashes(t), length)[at])
                starts.append(at)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(hashes)), b.column(b.schema.get_field_index("key")).take(pa.array(np.concatenate(keys))),
                     pa.array(np.concatenate(starts).astype(np.int32))], names=["window", "key", "start"])

    return runs.mapInArrow(run, "window long, key binary, start int")


def text_key(text: Column) -> Column:
    """Equal texts are one document to the search: 128 bits of the text."""
    return F.unhex(F.md5(text))


def repeats(texts: DataFrame, length: int = LENGTH, seed: int = SEED_WORDS) -> DataFrame:
    """(key, runs): per text key the word intervals [lo, hi) that windows found elsewhere cover.

    ``texts`` has one (key, text) row for each document, copies included.
    """
    return settled(lambda: _repeats(texts.where("text is not null"), length, seed), "repeats")


def _repeats(texts: DataFrame, length: int, seed: int) -> DataFrame:
    seeds = materialize(all_anchors(texts, length, seed), "anchors")
    # what a join meets is stored first: both sides are then dealt out for it, and a hot key can be split
    shared = materialize(seeds.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "shared")
    met = materialize(seeds.join(shared, "anchor"), "seeds")

    spans = met.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(F.struct("key", "lo", "hi")).alias("one"))
    spans = materialize(spans, "spans")
    whole = met.join(spans.where("n > 1").select("anchor", "span"), ["anchor", "span"]).select("key", "lo", (F.col("hi") + length).alias("hi"))

    mixed = materialize(spans.groupBy("anchor").agg(F.count("*").alias("spans"), F.min("n").alias("least")).where("spans > 1 and least = 1").select("anchor"), "mixed")
    edges = materialize(spans.join(mixed, "anchor").groupBy("one.key").agg(F.collect_set(F.struct("one.lo", "one.hi")).alias("runs")), "runs")
    windows = materialize(windows_of(texts.join(edges, "key").select("key", "text", "runs"), length), "windows")
    place = F.struct("key", "start")
    again = materialize(windows.groupBy("window").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("window"), "again")
    single = windows.join(again, "window").select("key", F.col("start").alias("lo"), (F.col("start") + length).alias("hi"))
    return whole.unionByName(single).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))


def kept_words(text: bytes | None, runs: list[dict] | None) -> tuple[int, list[bytes]]:
    """(all words, the words outside the runs)"""
    w = words(text)
    if not runs:
        return len(w), w
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, [r["lo"] for r in runs], 1)
    np.add.at(cover, [r["hi"] for r in runs], -1)
    return len(w), [w[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]


def _with_runs(docs: DataFrame, text: str, length: int, seed: int) -> tuple[DataFrame, str, str]:
    key, runs = free_name(docs, "text_key"), free_name(docs, "runs")
    found = repeats(docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text")), length, seed).select(F.col("key").alias(key), F.col("runs").alias(runs))
    return docs.withColumn(key, text_key(F.col(text))).join(found, key, "left"), key, runs


def substring_report(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256.

    Words are cut at ASCII white space and unchanged; a null text has none. Every window that
    also starts elsewhere, in the same text included, takes its words away, the first occurrence
    too. Repeated rows are documents of their own and so repeat each other. Texts shorter than a
    window lose nothing. Empty tables give no rows; other columns aren't read.
    """
    rows, _, runs = _with_runs(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", length, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_words, n_removed, digests = [], [], []
            for t, r in zip(utf8(b, "text"), b.column(b.schema.get_field_index(runs)).to_pylist()):
                n, kept = kept_words(t, r)
                n_words.append(n), n_removed.append(n - len(kept)), digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
                                             names=[id, "n_words", "n_removed", "kept_sha256"])

    kind = dict(docs.dtypes)[id]
    return rows.select("id", "text", runs).mapInArrow(run, f"`{id}` {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", length: int = LENGTH, seed: int = SEED_WORDS) -> DataFrame:
    """``docs`` with the repeated words cut from the texts, what stays joined by one space.

    Texts without a repeat stay as they are, white space included. ``n_chars`` follows the text.
    Null texts stay null, texts of nothing but repeats become empty; no row goes. Rows that repeat
    are repeats of each other. An empty table gives no rows.
    """
    rows, _, runs = _with_runs(docs, text, length, seed)
    cut = free_name(rows, "cut")

    def kept(b: pa.RecordBatch) -> pa.Array:
        return pa.array([b" ".join(kept_words(t, r)[1]).decode() if r else None for t, r in zip(utf8(b, text), b.column(b.schema.get_field_index(runs)).to_pylist())], pa.string())

    new = F.coalesce(F.col(cut), F.col(text))
    changed = {text: new} | ({n_chars: F.length(new).cast(dict(docs.dtypes)[n_chars])} if n_chars in docs.columns else {})
    return add_column(rows, cut, docs.schema[text].dataType, kept).select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


@query("op2_substrings", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH} + 2)) AS i FROM d),
x AS (SELECT doc_id, i, list_aggregate(w[i:i + {LENGTH} - 1], 'string_agg', ' ') AS k FROM s),
r AS (SELECT doc_id, i FROM x WHERE k IN (SELECT k FROM x GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + {LENGTH})) AS j FROM r) GROUP BY doc_id),
p AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g ON g.doc_id = d.doc_id),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM p),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.j) AS kept FROM u LEFT JOIN (SELECT doc_id, unnest(gone) AS j FROM p) q ON q.doc_id = u.doc_id AND q.j = u.j WHERE q.j IS NULL GROUP BY u.doc_id)
SELECT p.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM p LEFT JOIN k ON k.doc_id = p.doc_id""")
def _op2(spark, sf_dir):
    return substring_report(table(spark, sf_dir, "documents"))

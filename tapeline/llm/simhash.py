"""Near-duplicates by SimHash: deletion-variant signatures.

A fingerprint of 64 bits is cut into ``limit // 2 + 1`` segments, so two fingerprints that differ
in at most ``limit`` bits have a segment that differs in at most one. Every segment is indexed
once per bit with that bit left out (64 rows a fingerprint); two segments at most one bit apart
share such a key. An equality join on the keys finds the candidates and its condition compares
the whole fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.common import add_column, free_name, query, table, utf8, words
from tapeline.llm.graph import components
from tapeline.session import materialize

BITS = 64
SEED = 42
_BLOCK = 1 << 16  # shingles whose bits are unpacked at a time


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The fingerprint as a signed 64-bit integer; a text without words has 0."""
    w = words(text.lower()) if text else []
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    joined, ends, starts, at = b" ".join(w), [], [], 0
    for x in w:
        starts.append(at)
        at += len(x)
        ends.append(at)
        at += 1
    last = ends[min(shingle, len(w)) - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, n, _BLOCK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[lo:min(n, lo + _BLOCK)], last[lo:lo + _BLOCK])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str, name: str, shingle: int = 4) -> DataFrame:
    return add_column(docs, name, T.LongType(), lambda b: pa.array([fingerprint(t, shingle) for t in utf8(b, text)], pa.int64()))


def _segments(limit: int) -> list[tuple[int, int]]:
    n = limit // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def _mask(start: int, end: int) -> int:
    m = ((1 << end) - 1) ^ ((1 << start) - 1)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def variants(fps: DataFrame, limit: int) -> DataFrame:
    """(bit, key, fp): every fingerprint once per bit, keyed by that bit's segment without it."""
    made = [F.struct(F.lit(bit).alias("bit"), F.lit(_mask(s, e) & ~_mask(bit, bit + 1)).alias("mask"))
            for s, e in _segments(limit) for bit in range(s, e)]
    return fps.select("fp", F.explode(F.array(*made)).alias("x")).select(
        F.col("x.bit").alias("bit"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"), "fp")


def _first_meeting(bit: Column, differs: Column, limit: int) -> Column:
    """Holds for one of the keys that two fingerprints share: in their first near segment, the
    differing bit, or the segment's first bit if they agree in it."""
    near = [F.bit_count(differs.bitwiseAND(F.lit(_mask(s, e)))) <= 1 for s, e in _segments(limit)]
    out = F.lit(False)
    for i, (s, e) in enumerate(_segments(limit)):
        here = bit.between(s, e - 1) & ((differs.bitwiseAND(F.lit(_mask(s, e))) != 0) | (bit == s))
        for earlier in near[:i]:
            here = here & ~earlier
        out = out | here
    return out


def links(fps: DataFrame, limit: int) -> DataFrame:
    """(a, b) with a < b: each pair of different fingerprints at most ``limit`` bits apart, once."""
    keyed = variants(fps, limit)
    left, right = (keyed.select("bit", "key", F.col("fp").alias(n)) for n in "ab")
    differs = F.col("a").bitwiseXOR(F.col("b"))
    # Spark sizes the keyed rows as if each fingerprint had one, so left alone it broadcasts some millions of them
    return left.hint("merge").join(right, ["bit", "key"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(differs) <= limit) & _first_meeting(F.col("bit"), differs, limit)).select("a", "b")


def roots(fps: DataFrame, limit: int) -> DataFrame:
    """(fp, root): the fingerprints that have a link, and one fingerprint for each component."""
    return components(links(fps, limit), "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("root"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, limit: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id, component_root.

    Texts are lower-cased in A-Z only and cut into word shingles, repeats included; a text of
    fewer words is one shingle, one without words (or null) has fingerprint zero and links like
    any other. component_id is the smallest id of the component (nulls are passed over; null if
    it has none), component_root a fingerprint that names the component. Repeated rows and ids
    stay as they are; an empty table gives no rows. Equal fingerprints are one node of the graph,
    so copies make no pairs. Other columns of ``docs`` aren't read.
    """
    prints = materialize(with_fingerprint(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "fp", shingle).drop("text"), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    rooted = nodes.join(roots(nodes.select("fp"), limit), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    known = rooted.join(named, "root").select("fp", "root", "component_id")
    return prints.join(known, "fp", "left").select(
        F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("root").alias("component_root"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, limit: int = 4) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Ids that are null come last; of repeated rows with that id one stays. Null and blank texts have
    fingerprint zero and link like any other. An empty table gives no rows. Columns are kept.
    """
    fp, key, least = free_name(docs, "fp"), free_name(docs, "row_key"), free_name(docs, "least")
    prints = materialize(with_fingerprint(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "fp", shingle).drop("text"), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    rooted = nodes.join(roots(nodes.select("fp"), limit), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min_by("fp", F.struct(F.col("least").isNull(), "least", "fp")).alias(fp),
                                      F.min("least").alias(least)).drop("root")
    # copies share a fingerprint but not an id, so joined on both they spread over all tasks
    best = best.withColumn(key, F.xxhash64(fp, least))
    rows = with_fingerprint(docs, text, fp, shingle).withColumn(key, F.xxhash64(fp, id))
    kept = rows.join(best, [fp, key]).where(F.col(id).eqNullSafe(F.col(least)))
    return kept.dropDuplicates([fp, key]).select(*docs.columns)


@query("op1_simhash")
def _op1(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))

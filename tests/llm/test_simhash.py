from __future__ import annotations

import random
import re

import pytest
import xxhash
from conftest_llm import DATA, by_hand_components
from pyspark.sql import functions as F

from tapeline.llm import simhash
from tapeline.llm.graph import components


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def by_hand(rows, limit=4):
    """[(id, hex fingerprint, component)] of (id, text) rows, by all pairs."""
    prints = [fingerprint(t) for _, t in rows]
    roots = by_hand_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= limit])
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots)]


def result(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert result(simhash._op1(spark, DATA)) == sorted(by_hand(rows), key=str)


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert result(simhash.near_duplicates(odd_docs)) == sorted(by_hand(rows), key=str)
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    prints = [fingerprint(t) for _, t in rows]
    roots = by_hand_components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    ids = {r: [i for (i, _), q in zip(rows, roots) if q == r and i is not None] for r in roots}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((min(x, default=None) for x in ids.values()), key=str)


def test_empty(odd_docs):
    none = odd_docs.limit(0)
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).collect() == []


def test_each_link_once(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:40]:
        fps.append(f ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 6))}))
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for limit in (2, 4, 6):
        got = sorted((r.a, r.b) for r in simhash.links(df, limit).collect())
        assert got == sorted((a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= limit)


def test_keyed_rows_are_not_broadcast(spark, tmp_path):
    """A stored table of fingerprints is small enough for a broadcast, its 64 keyed rows each are not."""
    spark.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fps")
    plan = simhash.links(spark.read.parquet(f"{tmp_path}/fps"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4), (7, 7)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(29, 100)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    place = {n: i for i, n in enumerate(nodes)}
    roots = by_hand_components(len(nodes), [(place[a], place[b]) for a, b in edges if a != b])
    assert sorted((r.node, r.component) for r in components(df, "a", "b").collect()) == [(n, nodes[roots[i]]) for i, n in enumerate(nodes)]

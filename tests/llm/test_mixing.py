from __future__ import annotations

import random
import re
from collections import defaultdict

from conftest_llm import DATA

from tapeline.llm import mixing


def targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > most * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: rest * weight[s] / w for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def check(df, docs):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = [tuple(r) for r in df.collect()]
    assert df.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(((i, s) for i, s, *_ in rows), key=str) == sorted(((d.doc_id, words(d.text)) for d in docs), key=str)
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += words(d.text)
    want = targets(dict(sizes))
    assert sorted({(s, round(t, 4)) for _, _, s, t, _ in rows}) == sorted({(sizes[s], round(want[s], 4)) for s in sizes})
    assert all(0 <= k <= 2 * s and (k % s == 0 if s else k == 0) for _, s, _, _, k in rows)
    return rows, sizes, want


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    rows, sizes, want = check(mixing._op3(spark, DATA), docs)
    source, longest, taken = {d.doc_id: d.source for d in docs}, defaultdict(int), defaultdict(int)
    for i, s, _, _, k in rows:
        longest[source[i]] = max(longest[source[i]], s)
        taken[source[i]] += k
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6 for s in sizes)
    assert sorted(rows) == sorted(tuple(r) for r in mixing._op3(spark, DATA).collect())


def test_large_source_meets_its_target(frame):
    rng = random.Random(5)
    docs = [(i, "w " * rng.randint(1, 60), "hot" if i % 3 else "cold") for i in range(6000)]
    df = frame(docs, "doc_id long, text string, source string")
    rows, sizes, want = check(mixing.mixture(df), df.collect())
    for s in sizes:
        taken = sum(k for i, _, _, _, k in rows if docs[i][2] == s)
        assert abs(taken - want[s]) <= 30
    # the chance of a copy is the same for short and long documents
    hot = [(z, k) for i, z, _, _, k in rows if docs[i][2] == "cold"]
    rate = lambda part: sum(k for _, k in part) / sum(z for z, _ in part)
    assert abs(rate([x for x in hot if x[0] <= 30]) - rate([x for x in hot if x[0] > 30])) < 0.12


def test_odd_rows(odd_docs):
    docs = odd_docs.collect()
    rows, *_ = check(mixing.mixture(odd_docs), docs)
    out = mixing.mixed(odd_docs)
    assert out.columns == odd_docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))] += 1
    want = defaultdict(int)
    for i, s, _, _, k in rows:
        if k:
            want[i, s] += k // s
    assert got == want


def test_repeated_rows(frame):
    docs = [(1, "a b c d", "x")] * 700 + [(i, "a b " * (i % 9), None) for i in range(300)]
    df = frame(docs, "doc_id long, text string, source string")
    rows, sizes, want = check(mixing.mixture(df), df.collect())
    same = [k for i, s, _, _, k in rows if s == 4 and i == 1]
    assert max(same) - min(same) <= 4


def test_empty(odd_docs):
    assert mixing.mixture(odd_docs.limit(0)).collect() == []
    assert mixing.mixed(odd_docs.limit(0)).collect() == []
    assert [r.taken for r in mixing.mixture(odd_docs.where("text is null")).collect()] == [0, 0]


def test_plan_is_native(spark):
    plan = mixing._op3(spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from conftest_llm import DATA

from tapeline.llm import quality


def by_hand(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), n < 10 or 100 * len(again) > 20 * n


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = quality._op5(spark, DATA).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == {i: by_hand(t) for i, t in docs.items()}
    assert not any(r.kept and r.base_failed for r in rows)
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k == (y == 1) for k, y in judged]) > 0.9


def test_repeated_words():
    for text in ("a b c d e a b c d e", "a a a a a a", "a b c d e f a b c d e x b c d e f", "a b c d", "", "x y " * 9 + "q"):
        assert quality.repeated_words(text.encode().split()) == by_hand(text)[4]


def test_rules_are_found_and_pruned():
    rng = np.random.default_rng(0)
    n = 6000
    x = {"a": rng.random(n), "b": rng.random(n), "noise": rng.random(n)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.3)) | (x["b"] > 0.95)
    flipped = rng.random(n) < 0.01
    rules = quality.learn(x, bad ^ flipped)
    hit = np.zeros(n, bool)
    for r in rules:
        hit |= quality._covers(r, x, n)
    assert np.mean(hit == bad) > 0.98
    assert len(rules) <= 6 and quality.learn(x, np.zeros(n, bool)) == [] and quality.learn({k: v[:0] for k, v in x.items()}, bad[:0]) == []


def test_order_of_the_conditional(spark):
    rules = [(quality.Condition("words", True, 5.0),), (quality.Condition("words", True, 2.0), quality.Condition("symbols_per_word", False, 1.0))]
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c"), (3, "#### #### ####"), (4, "a")], "doc_id long, text string")
    assert [(r.doc_id, r.rule) for r in quality.judged(docs, rules).orderBy("doc_id").collect()] == [(1, 0), (2, 1), (3, None), (4, None)]


def test_odd_rows(odd_docs):
    labels = odd_docs.selectExpr("doc_id", "cast(pmod(coalesce(doc_id, 0), 2) as int) as quality")
    rules = quality.fit(odd_docs, labels)
    rows = quality.judged(odd_docs, rules)
    got = sorted((tuple(r)[:7] for r in rows.collect()), key=str)
    assert got == sorted(((r.doc_id, *by_hand(r.text)) for r in odd_docs.collect()), key=str)
    kept = quality.keep_good(odd_docs, rules)
    assert kept.columns == odd_docs.columns and kept.count() == rows.where("kept").count()
    assert quality.judged(odd_docs.limit(0), rules).collect() == []
    assert quality.fit(odd_docs, labels.limit(0)) == []


def test_held_out_labels(spark):
    """Rules learned on two thirds of the labels, judged on the rest."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = "crc32(cast(doc_id as string)) % 3 = 0"
    rules = quality.fit(docs, labels.where(f"not {held}"))
    rows = quality.judged(docs, rules).where("not base_failed").join(labels.where(held), "doc_id").groupBy("quality").agg(
        {"*": "count", "rule": "count"}).collect()
    found = {r["quality"]: (r["count(1)"], r["count(rule)"]) for r in rows}
    print(found)
    assert found[0][1] > 0.9 * found[0][0] and found[1][1] < 0.01 * found[1][0]

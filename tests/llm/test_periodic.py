from __future__ import annotations

import random
import re

import numpy as np
import pytest
from compare import duck, run
from conftest_llm import DATA

from tapeline.llm import periodic
from tapeline.llm.common import ORACLES


def by_hand(w, least=6, exponent=4):
    """(start, length, period) of every run, by trying every period."""
    number = {x: k for k, x in enumerate(dict.fromkeys(w))}
    t, found = np.array([number[x] for x in w]), {}
    for q in range(1, len(w) // exponent + 1):
        same = np.concatenate([[False], t[:-q] == t[q:], [False]])
        starts, ends = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
        for i, j in zip(starts.tolist(), ends.tolist()):
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def test_query(spark):
    ok, message, n = run(spark, duck(DATA), "op13", periodic._op13, ORACLES["op13_periodic_runs"], DATA)
    assert ok and n, message


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (2, 3)])
def test_random_words(least, exponent):
    """Batches of short texts over few words, half of them with a periodic stretch."""
    rng = random.Random(exponent)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(0, 6)):
            w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 60))]
            if w and rng.random() < 0.5:
                a = rng.randrange(len(w))
                w = (w[:a] + w[a:a + 1 + (len(w) - a) // rng.randint(2, 9)] * len(w))[:len(w)]
            texts.append(w)
        got = periodic.runs_of_texts(texts, least, exponent)
        assert got == [by_hand(w, least, exponent) for w in texts]
        assert [periodic.kept(w, r) for w, r in zip(texts, got)] == [collapsed(w, r) for w, r in zip(texts, got)]


def test_long_text(monkeypatch):
    """A text longer than a batch, with one run over half of it and one of a single word."""
    monkeypatch.setattr(periodic, "BATCH_WORDS", 1000)
    rng = random.Random(1)
    w = [b"%d" % rng.randrange(10**6) for _ in range(5000)]
    w = w + w[-1000:] * 5 + [b"x"] + [b"same"] * 3000 + [b"y"]
    assert periodic.runs_of_texts([w[:10], w, [], w[-20:]], 6, 4) == [[], [(4000, 6000, 1000), (10001, 3000, 1)], [], [(0, 19, 1)]]


def test_odd_rows(spark, odd_docs):
    docs = odd_docs.unionByName(odd_docs.limit(1).selectExpr("20L as doc_id", "repeat('a b ', 9) as text", *[c for c in odd_docs.columns if c not in ("doc_id", "text")]))
    got = periodic.collapse_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]

    def row(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = by_hand(w)
        return str((i, len(w), runs, " ".join(collapsed(w, runs))))

    rows = got.collect()
    assert sorted(str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in rows) == sorted(row(r.doc_id, r.text) for r in docs.collect())
    assert any(r.runs == [(0, 300, 1)] and r.collapsed == "same" for r in rows) and any(r.runs == [(0, 18, 2)] for r in rows)
    assert periodic.collapse_runs(odd_docs.limit(0)).collect() == []

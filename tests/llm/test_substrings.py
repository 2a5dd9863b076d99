from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from compare import duck, run
from conftest_llm import DATA

from tapeline.llm import substrings
from tapeline.llm.common import ORACLES


def by_hand(rows, length):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + length]) for w in texts for i in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = {j for k in range(len(w) - length + 1) if seen[tuple(w[k:k + length])] > 1 for j in range(k, k + length)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def test_query(spark):
    ok, message, n = run(spark, duck(DATA), "op2", substrings._op2, ORACLES["op2_substrings"], DATA)
    assert ok and n, message


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = by_hand(rows, 35)
    got = sorted((tuple(r) for r in substrings.substring_report(odd_docs).collect()), key=str)
    assert got == sorted((x[:4] for x in want), key=str)
    cut = substrings.without_repeats(odd_docs)
    assert cut.columns == odd_docs.columns
    kept = sorted(((r.doc_id, " ".join((r.text or "").split(" ")) if r.text else r.text, r.n_chars) for r in cut.collect()), key=str)
    assert kept == sorted(((i, w[4] if w[2] else t, None if t is None else len(w[4] if w[2] else t)) for (i, t), w in zip(rows, want)), key=str)


@pytest.mark.parametrize("length,seed", [(6, 3), (7, 4), (9, 8), (5, 5)])
def test_small_windows(frame, length, seed):
    rng = random.Random(length)
    shared = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(4, 14))) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 12))) for _ in range(3)]
        rows.append((i, " ".join(parts)))
    rows += [(100, "x " * 40), (101, "y " * length), (102, "ab ba " * 30)]
    got = sorted(tuple(r) for r in substrings.substring_report(frame(rows, "doc_id long, text string"), length=length, seed=seed).collect())
    assert got == sorted(x[:4] for x in by_hand(rows, length))


def test_empty(odd_docs):
    assert substrings.substring_report(odd_docs.limit(0)).collect() == []
    assert substrings.without_repeats(odd_docs.limit(0)).collect() == []

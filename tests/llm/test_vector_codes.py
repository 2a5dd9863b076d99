from __future__ import annotations

import hashlib
import random
from math import floor, isfinite

import numpy as np
from compare import duck, run
from conftest_llm import DATA

from tapeline.llm import vector_codes
from tapeline.llm.common import ORACLES


def by_hand(rows, parts=16, entries=64, rounds=2):
    """(sorted (id, label, codes, error), digest) of (id, vector, label) rows, comparing everything."""
    rows = [(i, [floor(256 * x) for x in v], y) for i, v, y in rows if v and all(x is not None and isfinite(x) and abs(256 * x) <= 2**26 for x in v)]
    if not rows:
        return [], None
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    n = len(rows[0][1])
    rows = [r for r in rows if len(r[1]) == n]
    cuts = [n * p // parts for p in range(parts + 1)]
    pieces = [[v[lo:hi] for lo, hi in zip(cuts, cuts[1:])] for _, v, _ in rows]
    books = [[list(x[p]) for x in pieces[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            code = [nearest(x[p], books[p])[1] for x in pieces]
            for k in set(code):
                own = [x[p] for x, c in zip(pieces, code) if c == k]
                books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for (i, _, y), x in zip(rows, pieces):
        best = [nearest(x[p], books[p]) for p in range(parts)]
        out.append((i, y, bytes(k for _, k in best), sum(d for d, _ in best)))
    return sorted(out, key=str), hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def result(df, **how):
    rows, books = vector_codes.compress(df, **how)
    return sorted(((r.vec_id, r.label, bytes(r.codes), r.error) for r in rows.collect()), key=str), books.digest() if books else None


def test_query(spark):
    ok, message, n = run(spark, duck(DATA), "op11", vector_codes._op11, ORACLES["op11_vector_codes"], DATA)
    assert ok and n, message


def test_odd_vectors(frame):
    """Null, empty, short, non-finite and far vectors; ties, copies, null ids and labels; clashing columns."""
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(20)], i % 3 or None) for i in range(150)]
    rows += [(3, rows[9][1], 1), (3, rows[3][1], 1), (3, rows[3][1], 1), (None, rows[4][1], 2), (None, None, None), (200, None, 1), (201, [], 1), (202, [1.0] * 19, 1),
             (203, [1.0] * 19 + [None], 1), (204, [float("nan")] * 20, 1), (205, [float("inf")] + [0.0] * 19, 1), (206, [1e30] * 20, 1), (207, [2e5] * 20, 7), (208, [-2e5] * 20, 7)]
    df = frame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, x int, codes int")
    for how in ({}, {"parts": 4, "entries": 7, "rounds": 5}, {"parts": 20, "entries": 3, "rounds": 0}, {"parts": 32, "entries": 200}):
        assert result(df.repartition(5), **how) == by_hand(rows, **how)


def test_empty(frame):
    for rows in ([], [(1, None, 2), (2, [], 2)]):
        assert result(frame(rows, "vec_id long, embedding array<float>, label int")) == ([], None)


def test_active_entries():
    """Assignment by moved entries equals that by all of them, also with many ties."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        x, old = rng.integers(-3, 4, (40, 2)), rng.integers(-3, 4, (9, 2))
        new = np.where(rng.random((9, 1)) < 0.4, rng.integers(-3, 4, (9, 2)), old)
        moved = np.flatnonzero((old != new).any(axis=1))
        got = vector_codes.nearest_active(x, new, moved, *vector_codes.nearest(x, old))
        assert all((a == b).all() for a, b in zip(got, vector_codes.nearest(x, new)))


def test_far_components_are_exact():
    x = np.array([[2**26, -2**26], [2**26 - 1, 5]])
    assert vector_codes.distances(x, np.array([[-2**26, 2**26], [2**26, 4]])).tolist() == [[2**55, (2**26 + 4) ** 2], [(2**27 - 1) ** 2 + (2**26 - 5) ** 2, 2]]


def test_decode(frame):
    rows = [(i, [i / 4.0] * 16, 0) for i in range(8)]
    got, books = vector_codes.compress(frame(rows, "vec_id long, embedding array<float>, label int"))
    assert {r.vec_id: books.decode(bytes(r.codes)).tolist() for r in got.collect()} == {i: [64 * i] * 16 for i in range(8)}

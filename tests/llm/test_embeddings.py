from __future__ import annotations

import math

import numpy as np
from compare import duck, run
from conftest_llm import DATA, by_hand_components

from tapeline.llm import embeddings
from tapeline.llm.common import ORACLES


def by_hand(rows, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    def linked(i, j):
        if i == j or not (ok[i] and ok[j]) or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = (np.array(rows[k][1], float) / np.abs(np.array(rows[k][1], float)).max() for k in (i, j))
        return a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= least

    edges = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if linked(i, j)]
    roots, names = by_hand_components(len(rows), edges), {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            names[r] = min(i, names.get(r, i))
    return sorted(((i, sum(e[0] == k for e in edges), names.get(r), i == names.get(r)) for k, ((i, _), r) in enumerate(zip(rows, roots))), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark):
    ok, message, n = run(spark, duck(DATA), "op10", embeddings._op10, ORACLES["op10_embeddings"], DATA)
    assert ok and n, message


def test_odd_vectors(frame):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((12, 16))
    vectors = [(base[i % 12] + 0.05 * rng.standard_normal(16)).tolist() for i in range(90)] + [base[0].tolist()] * 6 + [(base[1] * 1e200).tolist(), (base[1] * 1e-200).tolist(), (-base[2]).tolist()]
    vectors += [None, [], [0.0] * 16, [None, *base[3, 1:].tolist()], [math.nan, *base[3, 1:].tolist()], [math.inf, *base[3, 1:].tolist()], [1.0, 2.0], [2.0, 4.0], base[4, :8].tolist()]
    rows = [*enumerate(vectors), (3, vectors[3]), (None, vectors[5]), (None, [5.0, -1.0]), (None, None)]
    df = frame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, code string")
    # every vector without an id that links with nothing has no name
    assert result(embeddings.near_duplicates(df)) == sorted(((i, n, c, i == c) for i, n, c, _ in by_hand(rows)), key=str)


def test_empty(frame):
    assert embeddings.near_duplicates(frame([], "vec_id long, embedding array<float>")).collect() == []
    got = embeddings.near_duplicates(frame([(2, None), (1, [0.0, 0.0])], "vec_id long, embedding array<float>"))
    assert result(got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_near_the_bound(frame, monkeypatch):
    """Pairs drawn right at the threshold, where codes differ most, and large groups of one code."""
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows, pairs = [], 400
    for k in range(pairs):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.951, 0.99)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    center = rng.standard_normal(64)
    rows += [(10_000 + i, (center + 0.01 * rng.standard_normal(64)).tolist()) for i in range(120)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame(rows, "vec_id long, embedding array<double>")).collect()}
    found = sum(got[2 * k].n_links == 1 and got[2 * k + 1].component_id == 2 * k for k in range(pairs))
    assert found >= 0.95 * pairs
    assert all(got[10_000 + i].n_links == 119 and got[10_000 + i].component_id == 10_000 for i in range(120))


def test_rotation_is_orthogonal_and_balanced():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64)) + 1
    mean, turn = embeddings.learn_rotation(x)
    assert np.allclose(turn.T @ turn, np.eye(64), atol=1e-8)
    assert (np.abs(((x - mean) @ turn >= 0).mean(axis=0) - 0.5) < 0.05).all()

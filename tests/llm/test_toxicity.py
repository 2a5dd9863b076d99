from __future__ import annotations

import random
import zlib

import numpy as np

from tapeline.llm import toxicity

STEMS = ("vilno", "grashk", "ubber")


def documents(seed, n, endings):
    """(id, text, label): toxic ones hold one to three words of a toxic stem among plain prose."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["na", "to", "re", "li", "sen", "mo", "da", "ver"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        w, toxic = [word() for _ in range(rng.randint(5, 300))], int(rng.random() < 0.3)
        for _ in range(rng.randint(1, 3) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(STEMS) + rng.choice(endings) + rng.choice(["", ",", "!"]))
        rows.append((seed * 10_000 + i, " ".join(w), toxic))
    return rows


def right(model, rows):
    out = []
    for _, t, y in rows:
        w = toxicity.tokens(t.encode())
        known = dict(zip(w, model.word_margins(w).tolist())) if w else {}
        out.append((model.score(model.margin(w, known)) >= 0.5) == (y == 1))
    return np.mean(out)


def fitted(rows):
    passages, document = [], []
    for k, (_, t, _) in enumerate(rows):
        w = toxicity.tokens(t.encode())
        for i in range(0, len(w), toxicity.PASSAGE_WORDS):
            passages.append(w[i:i + toxicity.PASSAGE_WORDS])
            document.append(k)
    return toxicity.train(passages, np.array(document), np.array([y for *_, y in rows]))


def test_unseen_endings_share_vectors():
    model = fitted(documents(1, 2_200, ["a", "ish", "est", "o", "ing"]))
    assert right(model, documents(2, 300, ["a", "ish", "est", "o", "ing"])) > 0.97
    assert right(model, documents(3, 300, ["ez", "ilo", "ung"])) > 0.85  # 0.7 without shared vectors
    small = documents(6, 150, ["a"])
    assert (fitted(small).margins == fitted(small).margins).all() and fitted(small).scale == fitted(small).scale


def test_held_out_accuracy_and_no_other_input(spark):
    rows = documents(4, 900, ["a", "ish", "o"])
    docs = spark.createDataFrame([(i, t, "x", y) for i, t, y in rows], "doc_id long, text string, source string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    assert {i: r.held_out for i, r in got.items()} == fold
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert np.mean([got[i].predicted == y for i, _, y in rows if fold[i]]) > 0.95
    # labels of the held-out fold change nothing
    wrong = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert (toxicity.fit(docs, wrong).margins == model.margins).all()


def test_odd_rows(spark, odd_docs):
    docs = documents(5, 60, ["a"])
    model = fitted(docs)
    rows = toxicity.scored(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if r.doc_id in (4, 5, 6)}
    assert len(blank) == 1
    assert toxicity.scored(odd_docs.limit(0), model).collect() == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(odd_docs, toxicity.fit(odd_docs, labels)).collect()} == {toxicity.train([], np.zeros(0, int), np.zeros(0, int)).score(0.0)}
    one_kind = spark.createDataFrame([(1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity.scored(odd_docs, toxicity.fit(odd_docs, one_kind)).collect())

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from conftest_llm import DATA
from test_packing import check
from test_near_copies import by_hand as near_copies_by_hand
from test_substrings import by_hand as substrings_by_hand
from tokenizers import Tokenizer

import public_tokenizers
from tapeline.llm import mixing, quality
from tapeline.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage(spark):
    """Each stage against the plain version of its operator, on what its predecessor kept."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = materialize(stages["quality_rules"](spark, docs, DATA), "t1")
    judged = quality.judged(docs, quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged if r.kept} and kept.columns == COLUMNS

    one = materialize(stages["near_duplicates"](spark, kept, DATA), "t2")
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted((r.doc_id for r in one.collect()), key=str) == near_copies_by_hand(rows) and one.columns == COLUMNS

    cut = materialize(stages["substring_dedup"](spark, one, DATA), "t3")
    rows = {r.doc_id: r for r in one.collect()}
    want = {w[0]: w for w in substrings_by_hand([(i, r.text) for i, r in rows.items()], 35)}
    assert {(r.doc_id, r.text, r.n_chars) for r in cut.collect()} == {
        (i, w[4] if w[2] else rows[i].text, len(w[4] if w[2] else rows[i].text)) for i, w in want.items()} and cut.columns == COLUMNS

    mix = materialize(stages["source_mixture"](spark, cut, DATA), "t4")
    times = {r.doc_id: r.taken // r.size for r in mixing.mixture(cut).collect() if r.taken}
    assert Counter(r.doc_id for r in mix.collect()) == times and mix.columns == COLUMNS

    packed = stages["packed_sequences"](spark, mix, DATA).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n, total = check(packed, [(r.doc_id, r.text) for r in mix.collect()], tokenizer, 2048)
    assert n <= -(-total // 2048) + 1
    assert sorted((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, DATA).collect()) == sorted((r.doc_id, r.piece, r.length) for r in packed)


def test_odd_rows(spark, odd_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (12, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rng = random.Random(6)
    more = spark.createDataFrame([(100 + i, " ".join(rng.choice("abcdefghij") + str(rng.randrange(999)) for _ in range(80)), "en", "s0", 1) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd_docs.select(*COLUMNS).unionByName(more), odd_docs.select(*COLUMNS).limit(0)):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert bool(rows) == bool(docs.count())

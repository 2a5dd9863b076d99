from __future__ import annotations

import random

import public_tokenizers
import pytest
from conftest_llm import DATA
from tokenizers import Tokenizer, models, pre_tokenizers

from tapeline.llm import token_counts


def library(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)])
    return t


@pytest.fixture(scope="module")
def public():
    return library(token_counts.load_pieces(public_tokenizers.path(token_counts.VOCABULARY)))


def test_query(spark, public):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {r.doc_id: len(e.ids) for r, e in zip(docs, public.encode_batch([r.text for r in docs], add_special_tokens=False))}
    assert {r.doc_id: r.n_tokens for r in token_counts._op8(spark, DATA).collect()} == want


def test_odd_texts(public):
    texts = ["", "a", "日本語 テキスト 😀😀 x😀y", "<s> </s> <0x0A> <unk>", "▁▁ a▁b ▁", "é  n　b sp", "\x1c\x1d a\x1fb", "ñ" * 50, "x" * 500, "😀a😀", "a😀b c😀 😀", "ß ẞ", "﻿a ​"]
    count = token_counts.counter(token_counts.VOCABULARY)
    for t, e in zip(texts, public.encode_batch(texts, add_special_tokens=False)):
        units = token_counts.units(t)
        count.learn(set(units))
        assert sum(count.known[u] for u in units) == len(e.ids), t


def test_ties():
    """Equal scores: the path whose last piece starts first, as the library takes it."""
    rng = random.Random(8)
    for trial in range(40):
        pieces = [("<unk>", 0.0), *[(f"<0x{b:02X}>", -50.0) for b in range(256)], ("▁", -1.0)]
        made = {"".join(rng.choice("abc▁") if i == 0 else rng.choice("abc") for i in range(rng.randint(1, 4))) for _ in range(14)} - {"▁"}
        pieces += [(p, float(-rng.randint(1, 4))) for p in sorted(made)]
        words = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(60)]
        want = [len(e.ids) for e in library(pieces).encode_batch([w or "▁" for w in words], add_special_tokens=False)]
        assert token_counts.Counter(pieces).count_all(words) == want


def test_odd_rows(odd_docs, public):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.counted(odd_docs).collect()), key=str)
    assert got == sorted(((i, len(public.encode(t or "", add_special_tokens=False).ids)) for i, t in docs), key=str)
    assert token_counts.counted(odd_docs.limit(0)).collect() == []

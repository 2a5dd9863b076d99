from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import DATA
from tokenizers import Tokenizer

from tapeline.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, docs, tokenizer, capacity):
    want = []
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = np.array(ids[at:at + capacity], "<u4")
            want.append((i, k, at, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(w[3] for w in want)


def test_query(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    n, total = check(packing._op6(spark, DATA).collect(), docs, tokenizer, 2048)
    assert n <= -(-total // 2048) + 1


def test_odd_rows(odd_docs, tokenizer):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for block in (packing.BLOCK, 5):
        check(packing.pack(odd_docs, capacity=64, block=block).collect(), docs, tokenizer, 64)
    assert packing.pack(odd_docs.limit(0)).collect() == []


def test_words_tokenize_like_texts(tokenizer):
    rng = random.Random(1)
    w = ("don't it's 'tis we'll x's' a.b. É İstanbul ǅ ß ﬁ 日本 naïve naïve <|endoftext|> <|startoftext|>x a<|endoftext|>b <| |> '' 's 'll 5th x2 ΑΣ Σ 😀 <|ENDOFTEXT|> "
         "... foo</w> </w> \0 a\0b ſ K Å aͅ \x85a a\xa0b ...'s 'S").split(" ")
    letters = "abcdefghijklmnopqrstuvwxyzéèñüßÉ'.,<|>/w0"
    w += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 16))) for _ in range(20_000)]
    words = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(rng.choices(w, k=40)) for _ in range(300)]
    for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        folded = packing.folded_words(t.encode())
        words.learn(set(folded))
        assert words.encode(folded) == np.array(e.ids, "<u4").tobytes()


def first_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        for i, r in enumerate(room):
            if r >= n:
                room[i] -= n
                break
        else:
            room.append(capacity - n)
    return len(room)


def test_best_two_fit():
    rng = random.Random(4)
    for capacity, low, high in ((100, 1, 100), (100, 20, 60), (2048, 30, 900), (10, 3, 7)):
        lengths = [rng.randint(low, high) for _ in range(400)]
        where, offset = packing.best_two_fit(lengths, capacity)
        full = defaultdict(int)
        for s, n in zip(where, lengths):
            full[s] += n
        assert max(full.values()) <= capacity and len(full) <= first_fit_decreasing(lengths, capacity)
    # the smallest of 6 + 3 gives way to 2 + 2
    where, _ = packing.best_two_fit([6, 3, 2, 2], 10)
    assert where[0] == where[2] == where[3] != where[1]
    assert [len(x) for x in packing.best_two_fit([], 10)] == [0, 0]

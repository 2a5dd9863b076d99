from __future__ import annotations

import random

import pytest

#: Columns that carry names the operators use inside.
CLASHING = "fp long, root long, c int, runs int, text_key int, cut int, size int, source_size int, mix_k int, n int, id int, key int, unit int"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, no words, long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(3)
    long = prose(rng, 30_000, 5_000)
    base = prose(rng, 120)
    texts = [(1, base), (2, base + " tail"), (3, base.upper()), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (None, base), (8, long), (8, long), (9, "same " * 300),
             (10, "é ü \u00a0 x\u2003y 日本 \U0001f600"), (11, "one two"), (12, prose(rng, 400)), (12, "other text under the same id"), (None, None)]
    rows = [(i, t, None if k % 5 == 4 else "en", None if k % 4 == 3 else f"s{k % 3}", None if t is None else len(t), *[k % 2 or None] * 13) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")

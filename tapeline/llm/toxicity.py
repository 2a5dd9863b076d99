"""Toxicity: subword bags averaged into a linear softmax.

A word is the bag of its byte n-grams, so a misspelling or an unseen ending shares most of a known
word's vectors. A passage is the mean of its words, and a softmax over that mean is trained
jointly with the vectors, in numpy, on passages of a bounded sample of labelled documents. Labels
are the documents'; after each round only the passages of a toxic document that the model finds
toxic keep its label. A document scores as its most toxic passage, on a scale fitted to training
documents that were kept out of the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import query, table, utf8, words

PASSAGE_WORDS = 24
#: A passage of fewer different words is averaged over this many.
LEAST_WORDS = 12
BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = range(3, 8)  # seven bytes leave the eighth of a 64-bit word for the length
#: Labelled documents of each kind, and passages of them, that the model is fitted on at most.
SAMPLE_DOCUMENTS, SAMPLE_PASSAGES = 2_000, 60_000
FOLDS = 5
SEED = 11
_EDGE = b".,;:!?\"'()[]{}<>#*$%&|-_+=~^/\\"
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CACHED_WORDS = 400_000
_AT_ONCE = 20_000


def held_out(id: Column) -> Column:
    return F.crc32(id.cast("string")) % FOLDS == 0


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased in A-Z, marks cut off the ends; what has nothing else goes."""
    return [s for w in words(text.lower()) if (s := w.strip(_EDGE))] if text else []


def subwords(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of ``<word>`` and of every whole word."""
    data = np.frombuffer(b"".join([b"<" + w + b">" for w in vocabulary]), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(vocabulary)), [len(w) + 2 for w in vocabulary])
    whole = np.array([xxhash.xxh32_intdigest(w) for w in vocabulary], np.uint64)
    numbers, packed = [np.arange(len(vocabulary))], [whole]
    for n in GRAMS:
        k = len(data) - n + 1
        if k <= 0:
            continue
        inside = owner[:k] == owner[n - 1:]
        gram = sum(data[j:k + j] << np.uint64(8 * j) for j in range(n))[inside]
        numbers.append(owner[:k][inside])
        packed.append(gram ^ (np.uint64(n) << np.uint64(56)))
    mixed = np.concatenate(packed) * _K1
    mixed ^= mixed >> np.uint64(31)
    return np.concatenate(numbers), ((mixed * _K2) >> np.uint64(40)).astype(np.int64) % BUCKETS


@dataclass
class Model:
    """Per bucket the margin of its vector for the toxic class, and the scale of documents."""

    margins: np.ndarray
    bias: float
    scale: tuple[float, float]

    def word_margins(self, vocabulary: list[bytes]) -> np.ndarray:
        out = []
        for lo in range(0, len(vocabulary), _AT_ONCE):
            some = vocabulary[lo:lo + _AT_ONCE]
            number, bucket = subwords(some)
            out.append(np.bincount(number, self.margins[bucket], len(some)) / np.bincount(number, minlength=len(some)))
        return np.concatenate(out) if out else np.empty(0)

    def margin(self, w: list[bytes], known: dict[bytes, float]) -> float:
        """Of a document: its most toxic passage's, given the margins of its words."""
        look, most = known.__getitem__, 0.0 if not w else -np.inf
        for k in range(0, len(w), PASSAGE_WORDS):
            bag = set(w[k:k + PASSAGE_WORDS])
            most = max(most, sum(map(look, bag)) / max(len(bag), LEAST_WORDS))
        return most + self.bias

    def score(self, margin: float) -> float:
        a, b = self.scale
        return float(1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30))))


@dataclass
class _Batch:
    """Some passages as segments: tokens by passage and by word, n-grams by word and by bucket."""

    passages: np.ndarray
    token_word: np.ndarray
    token_starts: np.ndarray
    sizes: np.ndarray
    divisors: np.ndarray
    by_word: np.ndarray
    word_starts: np.ndarray
    gram_bucket: np.ndarray
    gram_starts: np.ndarray
    gram_counts: np.ndarray
    by_bucket: np.ndarray
    bucket_starts: np.ndarray
    buckets: np.ndarray


def _batch(passages: np.ndarray, token_lists: list[np.ndarray], gram_lo: np.ndarray, gram_n: np.ndarray, gram_bucket: np.ndarray) -> _Batch:
    sizes = np.array([len(token_lists[p]) for p in passages])
    seen, token_word = np.unique(np.concatenate([token_lists[p] for p in passages]), return_inverse=True)
    by_word = np.argsort(token_word, kind="stable")
    n = gram_n[seen]
    starts = np.cumsum(n) - n
    at = np.repeat(gram_lo[seen] - starts, n) + np.arange(n.sum())
    bucket = gram_bucket[at]
    by_bucket = np.argsort(bucket, kind="stable").astype(np.int32)
    buckets, bucket_starts = np.unique(bucket[by_bucket], return_index=True)
    return _Batch(passages, token_word, np.cumsum(sizes) - sizes, sizes, np.maximum(sizes, LEAST_WORDS).astype(np.float32), by_word, np.searchsorted(token_word[by_word], np.arange(len(seen))), bucket, starts, n,
                  by_bucket, bucket_starts, buckets)


def train(passages: list[list[bytes]], document: np.ndarray, toxic: np.ndarray, share: float | None = None, rounds=(300, 300, 400), batch: int = 300, rate: float = 1.0, seed: int = SEED) -> Model:
    """Fit on passages (word lists) of documents; ``toxic`` has a label per document number.

    ``share`` is how many of all documents are toxic, if the given ones are picked by label.
    Without both labels the model knows nothing and every document scores that share.
    """
    given = float(toxic.mean()) if len(toxic) else 0.0
    share = given if share is None else share
    if not passages or not 0 < given < 1:
        flat = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return Model(np.zeros(BUCKETS, np.float32), 0.0, (0.0, float(flat)))
    vocabulary: dict[bytes, int] = {}
    token_lists = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in dict.fromkeys(p)], np.int64) for p in passages]
    del passages
    known, parts, numbers = list(vocabulary), [], []
    for lo in range(0, len(known), _AT_ONCE):
        number, bucket = subwords(known[lo:lo + _AT_ONCE])
        parts.append(bucket[np.argsort(number, kind="stable")].astype(np.int32))
        numbers.append(np.bincount(number))
    gram_bucket, gram_n = np.concatenate(parts), np.concatenate(numbers)
    gram_lo = np.cumsum(gram_n) - gram_n

    apart = np.arange(len(toxic)) % 4 == 3
    inside = np.flatnonzero(~apart[document])
    rng = np.random.default_rng(seed)
    rng.shuffle(inside)
    batches = [inside[i:i + batch] for i in range(0, len(inside), batch)]
    vectors = (rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.05).astype(np.float32)
    weights = (rng.standard_normal((DIMENSIONS, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_v, seen_w, seen_b = np.full(vectors.shape, 1e-3, np.float32), np.full(weights.shape, 1e-3, np.float32), np.full(2, 1e-3, np.float32)
    label = toxic[document].astype(np.int64)
    weight = np.ones(len(document), np.float32)

    def model(scale=(1.0, 0.0)) -> Model:
        return Model((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]), scale)

    def margins() -> np.ndarray:
        m = model()
        per_word = m.word_margins(known)
        return np.array([per_word[t].sum() / max(len(t), LEAST_WORDS) for t in token_lists]) + m.bias

    for k, steps in enumerate(rounds):
        if k:  # of a toxic document the most toxic passage, and what is as toxic as not, count
            found = margins()
            top = np.full(len(toxic), -np.inf)
            np.maximum.at(top, document, found)
            weight = np.where((label == 0) | (found >= np.minimum(0.5, top[document])), 1, 0).astype(np.float32)
        balance = np.bincount(label[inside], weight[inside], 2)
        each = weight * (len(inside) / 2 / np.maximum(balance, 1))[label].astype(np.float32)
        for i in (j for _ in range(-(-steps // len(batches))) for j in rng.permutation(len(batches))):
            b = _batch(batches[i], token_lists, gram_lo, gram_n, gram_bucket)
            word_vectors = np.add.reduceat(vectors[b.gram_bucket], b.gram_starts) / b.gram_counts[:, None].astype(np.float32)
            mean = np.add.reduceat(word_vectors[b.token_word], b.token_starts) / b.divisors[:, None]
            z = mean @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(p)), label[b.passages]] -= 1
            d = p * (each[b.passages] / max(1e-6, float(each[b.passages].sum())))[:, None]
            d_mean = (d @ weights.T) / b.divisors[:, None]
            d_words = np.add.reduceat(np.repeat(d_mean, b.sizes, axis=0)[b.by_word], b.word_starts) / b.gram_counts[:, None].astype(np.float32)
            d_vectors = np.add.reduceat(np.repeat(d_words, b.gram_counts, axis=0)[b.by_bucket], b.bucket_starts)
            for value, seen, grad, rows in ((vectors, seen_v, d_vectors, b.buckets), (weights, seen_w, mean.T @ d, slice(None)), (bias, seen_b, d.sum(axis=0), slice(None))):
                grad = grad * 100
                seen[rows] += grad * grad
                value[rows] -= rate * grad / np.sqrt(seen[rows])
    found, top = margins(), np.full(len(toxic), -np.inf)
    np.maximum.at(top, document, found)
    fitted = apart & np.isfinite(top)
    return model(_scale(top[fitted], toxic[fitted], share))


def _scale(margin: np.ndarray, toxic: np.ndarray, share: float, steps: int = 50) -> tuple[float, float]:
    """Logistic fit, toxic documents weighing their ``share``, kept from running off by a small prior."""
    if not 0 < toxic.sum() < len(toxic):
        return 1.0, 0.0
    mid, spread = float(np.median(margin)), float(margin.std()) or 1.0
    x = np.stack([(margin - mid) / spread, np.ones(len(margin))], axis=1)
    w = np.where(toxic == 1, share / toxic.sum(), (1 - share) / (len(toxic) - toxic.sum())) * len(toxic)
    theta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (w * (p - toxic)) + 0.05 * theta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        theta -= np.linalg.solve(hess, grad)
    return float(theta[0] / spread), float(theta[1] - theta[0] * mid / spread)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
        documents: int = SAMPLE_DOCUMENTS, passages: int = SAMPLE_PASSAGES) -> Model:
    """Train on labelled documents outside the held-out fold: up to ``documents`` of each label,
    the first by a hash of the id, and ``passages`` passages of them."""
    known = labels.select(F.col(id).alias("_id"), F.col(label).alias("_y")).where("_id is not null and _y is not null").where(~held_out(F.col("_id"))).groupBy(
        "_id").agg(F.max("_y").alias("_y"))
    by_hash = (F.xxhash64("_id", F.lit(SEED)), F.col("_id"))
    picked = known.where("_y = 1").orderBy(*by_hash).limit(documents).unionByName(known.where("_y = 0").orderBy(*by_hash).limit(documents))
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")  # at most 2 * ``documents`` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (y, t) in enumerate(zip(b.column(2).to_pylist(), utf8(b, "_text"))):
                w = tokens(t)
                out += [(i, y, b" ".join(w[k:k + PASSAGE_WORDS])) for k in range(0, len(w), PASSAGE_WORDS)]
            if out:
                i, y, p = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(y, pa.int32()), pa.array(p, pa.binary())], names=["id", "y", "passage"])

    cut = rows.select("_id", "_text", F.col("_y").cast("int").alias("_y")).select("_id", "_text", "_y").mapInArrow(
        run, f"id {dict(docs.dtypes)[id]}, y int, passage binary")
    seen = cut.orderBy(F.xxhash64("id", "passage", F.lit(SEED)), "id", "passage").limit(passages).toPandas()
    ids = sorted(set(seen["id"]))
    place = {x: i for i, x in enumerate(ids)}
    document = seen["id"].map(place).to_numpy(np.int64) if len(seen) else np.zeros(0, np.int64)
    toxic = np.zeros(len(ids), np.int64)
    toxic[document] = seen["y"].to_numpy()
    share = known.agg(F.avg((F.col("_y") == 1).cast("double"))).first()[0]
    return train([bytes(p).split(b" ") for p in seen["passage"]], document, toxic, share)


def scored(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted; only the text makes a score.

    Texts without words (null, empty) score as an empty passage. Repeated rows score alike; an
    empty table gives no rows; other columns aren't read. A null id counts as not held out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [tokens(t) for t in utf8(part, "text")]
                if len(known) > _CACHED_WORDS:
                    known.clear()
                new = list(set().union(*texts) - known.keys())
                if new:
                    known.update(zip(new, model.word_margins(new).tolist()))
                scores = [model.score(model.margin(w, known)) for w in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = dict(docs.dtypes)[id]
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return rows.select(F.col("id").alias(id), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_toxicity")
def _op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))

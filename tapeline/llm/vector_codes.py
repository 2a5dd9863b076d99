"""Vector code compression: one small codebook per part of the vector, trained by active-entry Lloyd.

Vectors become whole numbers and are cut into parts; a part's code is its nearest codebook entry.
A round replaces the entries by the means of their parts and assigns again. Every part keeps its
code and its exact distance, so after the first assignment a part whose own entry stayed where it
was meets only the entries that moved: those that did not cannot have become nearer. A part whose
entry moved is compared with the whole codebook. All arithmetic is in whole numbers, so ties are
exact; the lower index wins them. Codebooks are as large as ``entries`` vectors, whatever the table
holds; they travel with the tasks and come back as sums per entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.common import query, slices, table
from tapeline.session import materialize, settled

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 26  # components must stay within it, so that sums of squares fit 64 bits
_ROWS = 2048


@dataclass
class Codebooks:
    """The entries of every part and which of them moved in the last round."""

    tables: list[np.ndarray]
    moved: list[np.ndarray]

    @property
    def cuts(self) -> list[int]:
        return [0, *np.cumsum([t.shape[1] for t in self.tables]).tolist()]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry, place, joined with commas."""
        return hashlib.sha256(",".join(str(c) for t in self.tables for c in t.ravel().tolist()).encode()).hexdigest()

    def decode(self, codes: bytes) -> np.ndarray:
        """The whole-number vector that the codes stand for."""
        return np.concatenate([t[c] for t, c in zip(self.tables, codes)])


def cut(n: int, parts: int) -> list[int]:
    """The edges of ``parts`` consecutive parts, equal where ``parts`` divides ``n``."""
    return [n * i // parts for i in range(parts + 1)]


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, label, n, x) of (id, vector, label): floor(scale * component) as 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _ROWS):
            v = b.column(1)
            length = pc.fill_null(pc.list_value_length(v), 0)
            whole = b.filter(pc.greater(length, 0))
            sizes = pc.list_value_length(whole.column(1)).to_numpy(zero_copy_only=False)
            flat = whole.column(1).flatten()
            x = np.floor(flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) * scale)
            edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~(np.abs(x) <= LIMIT))])
            good = bad[edges[1:]] == bad[edges[:-1]]
            ints = np.where(np.abs(x) <= LIMIT, x, 0).astype("<i4")
            raw = [ints[lo:hi].tobytes() for lo, hi in zip(edges[:-1][good], edges[1:][good])]
            kept = whole.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), pa.array(sizes[good], pa.int32()), pa.array(raw, pa.binary())], names=["id", "label", "n", "x"])

    made = [vectors.schema["id"], vectors.schema["label"], T.StructField("n", T.IntegerType()), T.StructField("x", T.BinaryType())]
    return vectors.select("id", "vector", "label").mapInArrow(run, T.StructType(made))


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # then floating point is exact too
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries.astype(np.int64)], axis=1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, distance): the whole codebook, lowest index first among ties."""
    d = distances(x, entries)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


def nearest_active(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, distance) after the entries at ``moved`` have moved."""
    code, dist = code.copy(), dist.copy()
    if not len(moved):
        return code, dist
    own = np.isin(code, moved)
    if own.any():
        code[own], dist[own] = nearest(x[own], entries)
    still = np.flatnonzero(~own)
    if len(still):
        c, d = nearest(x[still], entries[moved])
        c = moved[c]
        wins = (d < dist[still]) | ((d == dist[still]) & (c < code[still]))
        code[still[wins]], dist[still[wins]] = c[wins], d[wins]
    return code, dist


def _ints(b: pa.RecordBatch, name: str, dtype: str) -> np.ndarray:
    col = b.column(b.schema.get_field_index(name))
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(b.num_rows, -1).astype(np.int64)


def assign(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, x, codes, dist): codes as one byte a part, distances as 64-bit integers.

    Rows that carry codes and distances already are assigned by the entries that moved.
    """
    known, cuts = "codes" in rows.columns, books.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, _ROWS):
            x = _ints(b, "x", "<i4")
            old = (_ints(b, "codes", "u1"), _ints(b, "dist", "<i8")) if known else None
            codes, dist = np.empty((len(x), len(books.tables)), np.uint8), np.empty((len(x), len(books.tables)), "<i8")
            for p, entries in enumerate(books.tables):
                part = x[:, cuts[p]:cuts[p + 1]]
                codes[:, p], dist[:, p] = nearest_active(part, entries, books.moved[p], old[0][:, p], old[1][:, p]) if old else nearest(part, entries)
            cols = [b.column(b.schema.get_field_index(c)) for c in ("id", "label", "x")]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array([r.tobytes() for r in m], pa.binary()) for m in (codes, dist)]], names=["id", "label", "x", "codes", "dist"])

    made = [*[rows.schema[c] for c in ("id", "label", "x")], *[T.StructField(c, T.BinaryType()) for c in ("codes", "dist")]]
    return rows.mapInArrow(run, T.StructType(made))


def means(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The next codebooks: floor(sum / count) by component; entries without parts stay.

    Every task adds its rows up first and sends one number per entry and component.
    """
    cuts, entries = books.cuts, len(books.tables[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((entries, cuts[-1]), np.int64)
        count = np.zeros((entries, len(books.tables)), np.int64)
        for b in slices(batches, _ROWS):
            x, codes = _ints(b, "x", "<i4"), _ints(b, "codes", "u1")
            for p in range(len(books.tables)):
                np.add.at(total[:, cuts[p]:cuts[p + 1]], codes[:, p], x[:, cuts[p]:cuts[p + 1]])
                count[:, p] += np.bincount(codes[:, p], minlength=entries)
        part = np.repeat(np.arange(len(books.tables)), np.diff(cuts))
        entry, place = np.nonzero(count[:, part])
        yield pa.RecordBatch.from_arrays([pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[entry, place]), pa.array(count[entry, part[place]])],
                                         names=["entry", "place", "total", "count"])

    sums = rows.select("x", "codes").mapInArrow(run, "entry int, place int, total long, count long").groupBy("entry", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("count").alias("count"))
    whole = np.concatenate(books.tables, axis=1)
    new = whole.copy()
    for r in sums.collect():  # entries x components at most
        new[r["entry"], r["place"]] = int(r["total"]) // r["count"]
    tables = [new[:, lo:hi] for lo, hi in zip(cuts, cuts[1:])]
    return Codebooks(tables, [np.flatnonzero((a != b).any(axis=1)) for a, b in zip(tables, books.tables)])


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(rows, codebooks); rows are stored and hold id, label, codes (one byte a part), error.

    Vectors that are null or empty, or that hold a null or non-finite component, are dropped, as
    are those of another length than the kept vector with the smallest id and those with a
    component whose whole number is beyond 2**26. ``entries`` is 256 at most. Codebooks start as
    the parts of the vectors with the smallest ids (nulls last; of equal ids, the smaller vector
    first); where there are fewer vectors they have fewer entries. Parts are equal where the length
    allows it, else they differ by one component. Repeated rows and ids stay. ``error`` sums the
    squared distances of all parts. A table without usable vectors gives no rows and no codebooks.
    Other columns aren't read.
    """
    read = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    books = None

    def make() -> DataFrame:
        nonlocal books
        rows = materialize(integers(read, scale), "integers")
        order = [F.col("id").asc_nulls_last(), F.col("x")]
        first = rows.orderBy(*order).select("n").first()
        if first is None:
            return rows.select("id", "label", F.col("x").alias("codes"), F.lit(0).cast("bigint").alias("error")).limit(0)
        rows = rows.where(F.col("n") == first["n"])
        start = np.array([np.frombuffer(r["x"], "<i4") for r in rows.orderBy(*order).limit(entries).select("x").collect()], np.int64)
        edges = cut(first["n"], parts)
        books = Codebooks([start[:, lo:hi] for lo, hi in zip(edges, edges[1:])], [])
        for k in range(rounds + 1):
            rows = assign(rows, books)
            if k < rounds:
                rows = materialize(rows, "assigned")
                books = means(rows, books)

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, _ROWS):
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(_ints(b, "dist", "<i8").sum(axis=1))], names=["id", "label", "codes", "error"])

        made = T.StructType([*[rows.schema[c] for c in ("id", "label", "codes")], T.StructField("error", T.LongType())])
        return rows.select("id", "label", "codes", "dist").mapInArrow(total, made)

    out = settled(make, "codes")
    return out.select(F.col("id").alias(id), F.col("label").alias(label), "codes", "error"), books



def _sql() -> str:
    steps = [f"""
v AS (SELECT vec_id, label, [floor({SCALE} * x)::BIGINT for x in embedding] AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
x AS (SELECT vec_id, p, e[len(e) * p // {PARTS} + 1:len(e) * (p + 1) // {PARTS}] AS x FROM (SELECT vec_id, e, unnest(range({PARTS})) AS p FROM v)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT {ENTRIES}),
c0 AS (SELECT p, k, x AS c FROM x JOIN f ON f.vec_id = x.vec_id)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
d{r} AS (SELECT vec_id, x.p, k, x, list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, len(x) + 1)])::BIGINT AS d FROM x JOIN c{r} ON c{r}.p = x.p),
a{r} AS (SELECT vec_id, p, arg_min(k, d * {ENTRIES} + k) AS k, min(d) AS d, any_value(x) AS x FROM d{r} GROUP BY vec_id, p)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} AS (SELECT p, k, list(m ORDER BY i) AS m FROM (SELECT p, k, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM (SELECT p, k, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY p, k, i) GROUP BY p, k),
c{r + 1} AS (SELECT c{r}.p, c{r}.k, coalesce(m, c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.p = c{r}.p AND m{r}.k = c{r}.k)""")
    return f"""WITH {",".join(steps)},
t AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(n::VARCHAR, ',' ORDER BY p, k, i)) AS codebooks_sha256 FROM (SELECT p, k, unnest(c) AS n, unnest(range(len(c))) AS i FROM c{ROUNDS}))
SELECT v.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN t ON t.vec_id = v.vec_id, h"""


@query("op11_vector_codes", _sql())
def _op11(spark, sf_dir):
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    # stored, so that a label of many rows can be split in the join
    by_label = materialize(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))

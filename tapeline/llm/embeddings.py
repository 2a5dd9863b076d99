"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation is learned, on a bounded sample, that brings the centred vectors close to the corners
of a cube, so that the signs are balanced binary codes. A code is cut into tables; two codes are
candidates if in some table they differ in at most one bit and in all in at most ``radius``. Each
code is indexed once per table and looks up its own keys and those one bit away. The original
vectors decide. Equal vectors are one node with a multiplicity, so copies make no pairs; vectors
of one code are compared in blocks, and only counts and the edges of a forest leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import query, table
from tapeline.llm.graph import components
from tapeline.session import materialize

BITS, TABLES, RADIUS = 64, 4, 16
LEAST_COSINE = 0.95
SAMPLE = 10_000
ITERATIONS = 50
BLOCK = 256
SEED = 5


def _unit(v: list | None) -> np.ndarray | None:
    """The vector scaled to length one, or None if it has no direction."""
    if not v or any(x is None for x in v):
        return None
    a = np.array(v, np.float64)
    most = np.abs(a).max()
    if not np.isfinite(most) or most == 0:
        return None
    a /= most
    return a / np.sqrt(a @ a)


def nodes_of(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, node, n, unit): node names the vector's content; null where it can't link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [_unit(v) for v in b.column(1).to_pylist()]
            raw = [None if u is None else u.tobytes() for u in units]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if r is None else xxhash.xxh3_128_digest(r) for r in raw], pa.binary()),
                 pa.array([None if u is None else len(u) for u in units], pa.int32()), pa.array(raw, pa.binary())], names=["id", "node", "n", "unit"])

    return vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector")).mapInArrow(run, f"id {dict(vectors.dtypes)[id]}, node binary, n int, unit binary")


def learn_rotation(sample: np.ndarray, bits: int = BITS, iterations: int = ITERATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions turned by iterative quantisation.

    Where there are fewer dimensions than bits, random directions fill the code up.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    x, d = sample - mean, sample.shape[1]
    _, vectors = np.linalg.eigh(x.T @ x)
    k = min(bits, d)
    main = vectors[:, ::-1][:, :k]
    v = x @ main
    turn = np.linalg.qr(rng.standard_normal((k, k)))[0]
    for _ in range(iterations):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, np.hstack([main @ turn, rng.standard_normal((d, bits - k))])


def codes_of(nodes: DataFrame, rotations: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(node, n, unit, code) with a signed 64-bit code."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for n, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                mean, turn = rotations[n]
                bits = np.packbits((np.frombuffer(raw) - mean) @ turn >= 0, bitorder="little")
                found.append(int.from_bytes(bits.tobytes(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=["node", "n", "unit", "m", "least", "code"])

    return nodes.select("node", "n", "unit", "m", "least").mapInArrow(run, f"node binary, n int, unit binary, m long, least {dict(nodes.dtypes)['least']}, code long")


def _mask(t: int) -> int:
    width = BITS // TABLES
    m = ((1 << width) - 1) << (t * width)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def _bit(i: int) -> int:
    return 1 << i if i < BITS - 1 else -(1 << (BITS - 1))


def candidates(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(n, a, b) with a < b: every pair of different codes that the tables bring together, once."""
    own = codes.select("n", F.col("code").alias("b"), F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_mask(t)).alias("mask")) for t in range(TABLES)])).alias("x")).select(
        "n", "b", F.col("x.t").alias("t"), F.col("b").bitwiseAND(F.col("x.mask")).alias("key"))
    width = BITS // TABLES
    near = [(t, i) for t in range(TABLES) for i in [None, *range(t * width, (t + 1) * width)]]
    asked = codes.select("n", F.col("code").alias("a"), F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(_mask(t)).alias("mask"), F.lit(0 if i is None else _bit(i)).cast("bigint").alias("flip")) for t, i in near])).alias("x")).select(
        "n", "a", F.col("x.t").alias("t"), F.col("a").bitwiseAND(F.col("x.mask")).bitwiseXOR(F.col("x.flip")).alias("key"))
    differs = F.col("a").bitwiseXOR(F.col("b"))
    close = [F.bit_count(differs.bitwiseAND(F.lit(_mask(t)))) <= 1 for t in range(TABLES)]
    first = F.lit(False)
    for t in range(TABLES):
        here = F.col("t") == t
        for earlier in close[:t]:
            here = here & ~earlier
        first = first | here
    return asked.join(own, ["n", "t", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(differs) <= radius) & first).select("n", "a", "b")


def _forest(linked: np.ndarray) -> np.ndarray:
    """The least member of each row's component in a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def compare(pairs: DataFrame, least_cosine: float) -> DataFrame:
    """(node, other, links): per node the rows it links to in a pair of blocks, and a forest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, other, links = [], [], []
            for same, n, left, right in zip(*[b.column(k).to_pylist() for k in range(4)]):
                both = left if same else left + right
                x = np.frombuffer(b"".join(e["unit"] for e in both)).reshape(-1, n)
                k = len(left)
                linked = np.zeros((len(both), len(both)), bool)
                if same:
                    linked = x @ x.T >= least_cosine
                    np.fill_diagonal(linked, False)
                else:
                    linked[:k, k:] = x[:k] @ x[k:].T >= least_cosine
                    linked[k:, :k] = linked[:k, k:].T
                if not linked.any():
                    continue
                total, root = linked @ np.array([e["m"] for e in both]), _forest(linked)
                for i in np.flatnonzero(total):
                    node.append(both[i]["node"]), other.append(both[root[i]]["node"]), links.append(int(total[i]))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(other, pa.binary()), pa.array(links, pa.int64())], names=["node", "other", "links"])

    return pairs.mapInArrow(run, "node binary, other binary, links long")


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", least_cosine: float = LEAST_COSINE, radius: int = RADIUS,
                    sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null, NaN or infinite components, link with
    nothing, as do vectors of different lengths. Repeated rows are vectors of their own. A null
    id is passed over as a component's name unless there is no other. An empty table gives no
    rows; other columns aren't read.
    """
    rows = materialize(nodes_of(vectors, id, vector), "vectors")
    nodes = materialize(rows.where("node is not null").groupBy("node").agg(
        F.first("n").alias("n"), F.first("unit").alias("unit"), F.count("*").alias("m"), F.min("id").alias("least")), "nodes")
    rotations = {}
    for (n,) in nodes.select("n").distinct().collect():  # one row per length of vector
        seen = nodes.where(F.col("n") == n).orderBy(F.xxhash64("node"), "node").select("unit").limit(sample).toPandas()["unit"]
        rotations[n] = learn_rotation(np.frombuffer(b"".join(seen)).reshape(-1, n))
    coded = materialize(codes_of(nodes, rotations), "codes")

    sizes = materialize(coded.groupBy("n", "code").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")), "sizes")
    member = F.struct("node", "m", "unit")
    blocks = materialize(coded.join(sizes, ["n", "code"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).groupBy("n", "code", "block").agg(
        F.collect_list(member).alias("members")), "blocks")
    codes = coded.select("n", "code").distinct()
    found = materialize(candidates(codes, radius).unionByName(codes.select("n", F.col("code").alias("a"), F.col("code").alias("b"))), "candidates")
    left = blocks.select("n", F.col("code").alias("a"), F.col("block").alias("i"), F.col("members").alias("left"))
    right = blocks.select("n", F.col("code").alias("b"), F.col("block").alias("j"), F.col("members").alias("right"))
    # a code of one vector needn't meet itself
    pairs = found.join(left, ["n", "a"]).where((F.col("a") != F.col("b")) | (F.size("left") > 1) | (F.col("i") > 0)).join(right, ["n", "b"]).where("a != b or i <= j")
    met = materialize(compare(pairs.select(F.expr("a = b and i = j").alias("same"), "n", "left", "right"), least_cosine), "links")

    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = nodes.select("node", "m", "least").join(components(met, "node", "other"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(rooted.groupBy("component").agg(F.min("least").alias("component_id")), "named")
    known = materialize(rooted.join(named, "component").join(links, "node", "left").select(
        "node", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "components")
    out = rows.select("id", "node").join(known, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op10_embeddings", f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {LEAST_COSINE}),
r AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id""")
def _op10(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))

"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, its source's target over its
source's size. The whole part is taken for certain. The fractional parts are probabilities that
the pivotal method settles: two documents exchange mass, at random but without bias, until one
of them is 0 or 1; the other meets the next. Mass is counted in words, so a source's total is kept
up to the one document left over, which is rounded to the nearer side: a source misses its target
by half of one document at most. Documents are settled in small chunks; each chunk's left-over
document goes up a reduction tree of the same fan-in. Built-in functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.llm.common import WORD, free_name, query, table
from tapeline.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
FAN_IN = 128
SEED = 17


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, items) of a table (source, size, …), one row per source.

    Sources are ranked by code point, null last; the weights repeat along the ranks. The total is
    ``share`` of all sizes; a source stops at ``most`` times its size and what it can't take is
    shared again by weight. Ranks come from range partitions and a running count of them, and
    each round of sharing is one aggregate, so no task sees all sources.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("items"))
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(found.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = ranged.groupBy("part").agg(F.count("*").alias("before")).withColumn(
        "before", F.coalesce(F.sum("before").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialize(ranged.join(before, "part").withColumn("weight", F.get(cycle, (rank % len(weights)).cast("int"))).drop("part", "before"), "weights")

    cap, total, level = F.col("source_size") * F.lit(most), None, 0.0
    while True:  # the level only rises; it is done when no further source is above its cap
        full = cap <= F.col("weight") * F.lit(level)
        size, capped, free = ranked.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        total = share * (size or 0)
        raised = (total - (capped or 0)) / free if free else level
        if not free or raised <= level * (1 + 1e-12):
            break
        level = raised
    return ranked.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(level)).alias("target"), "items")


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the given columns."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _item(h: Column, **fields: Column) -> Column:
    return F.struct(h.alias("h"), *[c.alias(n) for n, c in fields.items()])


def _moved(x: Column, p: Column) -> Column:
    return F.struct(*[x[n].alias(n) for n in ("h", "id", "size", "n", "base")], p.alias("p"))


def _settled(x: Column, extra: int) -> Column:
    return F.struct(x["id"].alias("id"), x["size"].alias("size"), x["n"].alias("n"), (x["base"] + F.lit(extra)).alias("m"))


def _pivot(a: Column, b: Column) -> Column:
    """(held, done) after one exchange between the held document ``a`` and the next one ``b``."""
    up_a, down_a = (1 - a["p"]) * a["size"], a["p"] * a["size"]
    up_b, down_b = (1 - b["p"]) * b["size"], b["p"] * b["size"]
    to_a, to_b = F.least(up_a, down_b), F.least(down_a, up_b)
    rises = (to_a + to_b == 0) | (_unit(F.lit(SEED), a["h"], b["h"]) * (to_a + to_b) < to_b)
    a_is_one, a_is_zero = rises & (up_a <= down_b), ~rises & (down_a <= up_b)
    held = (F.when(a_is_one, _moved(b, b["p"] - to_a / b["size"])).when(rises, _moved(a, a["p"] + to_a / a["size"]))
            .when(a_is_zero, _moved(b, b["p"] + to_b / b["size"])).otherwise(_moved(a, a["p"] - to_b / a["size"])))
    done = F.when(a_is_one, _settled(a, 1)).when(rises, _settled(b, 0)).when(a_is_zero, _settled(a, 0)).otherwise(_settled(b, 1))
    return F.struct(held.alias("held"), done.alias("done"))


def _settle(chunks: DataFrame) -> DataFrame:
    """(source, chunk, held, done): every chunk's documents but one settled."""
    grouped = chunks.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("item")).alias("items"))
    start = F.struct(F.get("items", F.lit(0)).alias("held"), F.slice(F.transform("items", lambda x: _settled(x, 0)), 1, 0).alias("done"))

    def step(s: Column, b: Column) -> Column:
        met = F.transform(F.array(_pivot(s["held"], b)), lambda m: F.struct(m["held"].alias("held"), F.concat(s["done"], F.array(m["done"])).alias("done")))
        return F.get(met, F.lit(0))

    done = grouped.select("source", "chunk", F.aggregate(F.slice("items", F.lit(2), F.size("items")), start, step).alias("s"))
    return done.select("source", "chunk", "s.held", "s.done")


def copies(sizes: DataFrame, targets: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(id, source, size, n, m): equal rows of ``sizes`` (id, source, size) as one, and how many
    copies the ``n`` of them have together."""
    rows = sizes.groupBy("id", "source", "size").agg(F.count("*").alias("n"))
    t = targets.withColumnRenamed("source", "_source")
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("n")
    items = rows.join(t, F.col("source").eqNullSafe(F.col("_source"))).withColumn("per", per).withColumn(
        "base", F.floor("per").cast("bigint")).withColumn("p", F.col("per") - F.col("base"))
    whole = (F.col("size") == 0) | (F.col("p") <= 0)
    h = F.xxhash64(F.lit(SEED), "id", "size")
    chunk = F.pmod(h, F.ceil(F.col("items") / F.lit(fan_in)))
    level = materialize(_settle(items.where(~whole).select("source", chunk.alias("chunk"), _item(
        F.xxhash64(F.lit(SEED + 1), "id", "size"), id=F.col("id"), size=F.col("size"), n=F.col("n"), base=F.col("base"), p=F.col("p")).alias("item"))), "settled")

    out = items.where(whole).select("id", "source", "size", "n", F.when(F.col("size") > 0, F.col("base")).otherwise(0).cast("bigint").alias("m"))
    most = targets.agg(F.max("items")).first()[0] or 1
    for _ in range(max(0, math.ceil(math.log(max(1, math.ceil(most / fan_in)), fan_in) - 1e-9))):
        out = out.unionByName(_rows(level))
        level = materialize(_settle(level.select("source", F.floor(F.col("chunk") / F.lit(fan_in)).alias("chunk"), F.col("held").alias("item"))), "settled")
    last = F.when(F.col("held.p") >= 0.5, _settled(F.col("held"), 1)).otherwise(_settled(F.col("held"), 0))
    return out.unionByName(_rows(level)).unionByName(_rows(level.select("source", F.array(last).alias("done"))))


def _rows(level: DataFrame) -> DataFrame:
    return level.select("source", F.explode("done").alias("x")).select("x.id", "source", "x.size", "x.n", "x.m")


def _sizes(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:
    return materialize(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")), "sizes")


def _part(m: Column, n: Column, k: Column) -> Column:
    """What the k-th of n equal rows gets of m copies."""
    return (F.floor(m / n) + F.when(k < m % n, 1).otherwise(0)).cast("bigint")


def mixture(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target (of its source), taken.

    Sizes are words; a null or empty text has size 0 and nothing taken of it. A null source is one
    source, ranked last. ``taken`` is 0 to ``most`` times the size and a multiple of it; all
    randomness hashes ids and sizes, so reruns agree. Equal rows share their copies evenly. An
    empty table gives no rows; other columns aren't read.
    """
    sizes = _sizes(docs, id, text, source)
    targets = materialize(source_targets(sizes, weights, share, most), "targets")
    each = copies(sizes, targets).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn(
        "taken", _part(F.col("m"), F.col("n"), F.col("k") - 1) * F.col("size"))
    t = targets.withColumnRenamed("source", "_source")
    return each.join(t, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("id").alias(id), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it. Columns are kept.

    Sizes, targets and draws are those of ``mixture``: null and empty texts are taken no times, a
    null source is one source. Rows of one id, source and size share their copies in the order of a
    hash of their simple columns. An empty table gives no rows.
    """
    sizes = _sizes(docs, id, text, source)
    targets = materialize(source_targets(sizes, weights, share, most), "targets")
    decided = copies(sizes, targets).where("m > 0").select(*[F.col(c).alias(f"_mix_{c}") for c in ("id", "source", "size", "n", "m")])
    size, k, times = (free_name(docs, c) for c in ("mix_size", "mix_k", "mix_times"))
    rows = docs.withColumn(size, size_of(F.col(text)))
    rows = rows.join(decided, F.col(id).eqNullSafe(F.col("_mix_id")) & F.col(source).eqNullSafe(F.col("_mix_source")) & (F.col(size) == F.col("_mix_size")))
    simple = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    same = Window.partitionBy(id, source, size).orderBy(F.xxhash64(*simple))
    rows = rows.withColumn(k, F.when(F.col("_mix_n") > 1, F.row_number().over(same)).otherwise(1)).withColumn(
        times, _part(F.col("_mix_m"), F.col("_mix_n"), F.col(k) - 1)).where(F.col(times) > 0)
    return rows.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


@query("op3_mixing")
def _op3(spark, sf_dir):
    return mixture(table(spark, sf_dir, "documents"))

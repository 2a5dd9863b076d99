"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on; all are runtime SQL settings, so they also apply to a session
# somebody else built.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "tapeline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings. On a cluster leave ``master`` unset."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    ``spark.checkpoint.dir`` names that location. Where it is unset a folder of this machine is
    made and recorded in the session, but only for a ``local`` master; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoint")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders that ``materialize`` has made since the innermost open ``settled`` began.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For small results that several branches of one plan read: they are computed once, the plan
    is cut, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The stored result of ``make()``; whatever else it stored on the way is deleted.

    Only the result may be read afterwards. A failure deletes the intermediate tables too.
    """
    mine: list[str] = []
    token, open_ = _MADE.set(mine), True
    spark = None
    try:
        out = make()
        spark = out.sparkSession
        _MADE.reset(token)
        open_ = False
        return materialize(out, name)
    finally:
        if open_:
            _MADE.reset(token)
        delete(spark or SparkSession.active(), *mine)


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove folders through the file system that Spark itself uses for them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Put the folder ``new`` in the place of ``path``, which may exist."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (new, path))
    fs = target.getFileSystem(conf)
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{new} could not take the place of {path}")

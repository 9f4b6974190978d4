"""Session factory, table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidewright", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset, a local one of our own, which only
    a local master can do with: on a cluster each executor would write to its own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("tidewright.local.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        at = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("tidewright.local.dir", at)
    return at.rstrip("/")


#: Open scratches, the innermost last, each a list of the folders of its cuts.
_OPEN: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _OPEN:
        _OPEN[-1].append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a cut that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame] | None = None) -> Iterator[list[DataFrame]]:
    """Remove at the end all cuts made inside but those of the DataFrames in the list it gives.

    Operators close one around rounds whose tables nothing reads any more; around a whole query and the writing of its
    result, it leaves the shared folder as it was.
    """
    kept = [] if keep is None else keep
    _OPEN.append([])
    try:
        yield kept
    finally:
        stay = {getattr(df, "_cut_path", None) for df in kept}
        for path in _OPEN.pop():
            if path not in stay:
                _delete(spark, path)
            elif _OPEN:
                _OPEN[-1].append(path)


def default_sf_dir(sf: str) -> str:
    return os.path.join(os.environ.get("TIDEWRIGHT_DATA", "/root/testdata"), sf)


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, as when it isn't installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread few input splits over all cores before costly work in Python; many splits stay where they are.

    The rows are hashed on `key`, so the spread is the same if a task runs again. Above one split a core nothing is
    shuffled.
    """
    workers_import(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2, key) if df.rdd.getNumPartitions() < cores else df

"""Sinks: written to a staging folder, read back and counted, then moved into place."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut


def _fs(df: DataFrame, path: str):  # noqa: ANN202
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def write_atomic(df: DataFrame, path: str, form: str = "parquet", **options: str) -> int:
    """Replace `path` by df: stage beside it, read back and compare counts, then rename. Gives the number of rows.

    If writing or counting fails, what was at `path` stays as it was.
    """
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    options = {"header": "true"} | options if form == "csv" else options
    sp, fs = _fs(df, stage)
    source = cut(df)  # worked out once, so that both counts are of the same rows
    try:
        source.write.format(form).options(**options).save(stage)
        rows, want = df.sparkSession.read.format(form).options(**options).schema(df.schema).load(stage).count(), source.count()
        if rows != want:
            raise RuntimeError(f"{rows} of {want} rows read back")
    except BaseException:
        fs.delete(sp, True)
        raise
    finally:
        drop_cut(source)
    target, _ = _fs(df, path)
    old, _ = _fs(df, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        fs.delete(sp, True)
        raise RuntimeError(f"{path} can't be moved away")
    if not fs.rename(sp, target):
        if had:
            fs.rename(old, target)
        raise RuntimeError(f"{stage} can't be moved to {path}")
    if had:
        fs.delete(old, True)
    return rows


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Parquet with one folder a value of `by`; rows are ranged by the value and a hash, so that files are few and a
    value of most rows is spread over many tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, F.col(by), F.xxhash64(*df.columns)).write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A small result (at most a report) as one JSON file: written beside it first, then moved into place."""
    doc = [r.asDict(recursive=True) for r in rows.collect()]
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    with open(stage, "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False, indent=2, default=str)
        f.flush()
        os.fsync(f.fileno())
    os.replace(stage, path)


def append_audit(events: DataFrame, path: str) -> None:
    """Append events as JSON lines with the time of writing."""
    events.withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)


def resume(todo: DataFrame, done_path: str, key: str) -> DataFrame:
    """Rows of todo whose key isn't in the parquet table of finished work yet; all if there is none."""
    p, fs = _fs(todo, done_path)
    if not fs.exists(p):
        return todo
    return todo.join(todo.sparkSession.read.parquet(done_path).select(key), key, "left_anti")


def append_done(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)

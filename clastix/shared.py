"""Tables written in the cluster's shared folder, to cut lineage and to survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_OPEN: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, else that of the context's checkpoints.

    Where both are unset, a temporary folder of this machine, removed at the end, if the master is local, as in
    tests; on a cluster, whose executors don't share such a folder, an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        path = tempfile.mkdtemp(prefix="clastix-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN.append("file://" + path)
    return _OWN[0]


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    for made in _OPEN:
        made.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more; a table that is gone already is passed over."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """The tables that written() makes within, for drop() once the results that read them are written."""
    made: list[DataFrame] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN[:] = [m for m in _OPEN if m is not made]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out

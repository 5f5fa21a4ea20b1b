"""Scratch tables of iterative operators: written once, read by what follows, removed when superseded."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; where that is unset (tests), one of our own that goes at exit."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-loomseq-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def new_folder(spark: SparkSession) -> str:
    """A path in the scratch folder that nothing else uses."""
    return f"{scratch_dir(spark)}/loomseq-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` written and read back: its lineage is cut, and a lost executor costs no recomputation of what led to it."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove the files of settled tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_settled", None):
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path as its object."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

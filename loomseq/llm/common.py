"""What the operators of this subpackage share: scratch tables, column hygiene, connected components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

_OWN: dict[str, str] = {}
#: Spark drops a query's shuffle files when it ends; what it computed is in a table by then.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset (tests), a local one of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-loomseq-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def cut(df: DataFrame, tag: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    ``batch`` is the number of rows that a Python worker gets at a time, where whole texts go to it.

    This cuts lineage in a way that survives lost executors: the parts are ordinary files in the folder that
    the cluster shares, not blocks on executors.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/loomseq-{tag}-{uuid.uuid4().hex}"
    now = {_CLEAN: "true"} | ({_BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomseq_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a table made by ``cut`` that nothing reads any more."""
    path = getattr(df, "_loomseq_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more and let Spark drop the shuffle files of finished jobs.

    Spark deletes shuffle files when the driver collects the garbage that refers to them; long chains of jobs
    would otherwise keep all of theirs on the executors' disks.
    """
    for t in tables:
        drop_cut(t)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(key: str, kind: DataType, rest: str) -> StructType:
    """The schema of a key column of any type followed by the columns ``rest``."""
    return StructType([StructField(key, kind), *StructType.fromDDL(rest)])


def map_pandas(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType) -> DataFrame:
    """``mapInPandas`` that keeps integers beside nulls as they are (pandas alone would make them floats)."""
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches):
        for out in fn(b.to_pandas(integer_object_nulls=True) for b in batches):
            yield from pa.Table.from_pandas(out[arrow.names], schema=arrow, preserve_index=False).combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component = smallest node reachable.

    Alternating large-star and small-star rounds: every round is a min per node (combined on the map side)
    and an equi-join, so hubs are never gathered; AQE splits the hub's side of the join.  Rounds go on until one changes nothing.  Nulls and self-loops
    are ignored, repeated edges count once.  An empty edge list gives an empty result.
    """
    x, y = F.col(a), F.col(b)
    pairs = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(
        F.greatest(x, y).alias("u"), F.least(x, y).alias("v")
    ).distinct()
    cur = cut(pairs, "cc")
    mark = _mark(cur)
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        new = cut(small, "cc")
        new_mark = _mark(new)
        drop_cut(cur)
        cur = new
        if new_mark == mark:
            break
        mark = new_mark
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum: equal marks mean that a round changed nothing."""
    r = edges.select(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
    return r["n"], r["h"]

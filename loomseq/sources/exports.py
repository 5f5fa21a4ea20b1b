"""Export of a report's frames side by side, with one manifest."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from loomseq.sources.scratch import filesystem

#: Frames computed and written at the same time: most of their jobs are too small to fill the executors.
TOGETHER = 6

MANIFEST = "name string, path string, rows long, cols int, columns array<string>"


def side_by_side(step: Callable, items: Iterable, most: int = TOGETHER) -> list:
    """``step`` of each item, in the items' order, ``most`` of them at a time from threads of the driver."""
    with ThreadPool(most) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(step), items, chunksize=1)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, the rest as it is: what a CSV file can hold."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def export_report(spark: SparkSession, frames: dict[str, DataFrame], path: str, sample_id: str, centre_id: str = "", report_type: str = "detailed") -> DataFrame:
    """Write each frame as ``path/<sample>_<name>.csv`` with a header, then the manifest; gives the manifest's files.

    Frames are written side by side, and rows are counted by the write itself, so a frame is computed once.  A frame whose columns are nested is written with JSON in
    them; one without rows has a header and 0 in the manifest.  ``path/<sample>_manifest.json`` comes last, so its being
    there says that the export is whole; an export that runs again replaces each file.
    Manifest: sample_id, centre_id, report_type, and per file name, path, rows, cols, columns.
    """

    def write(frame: tuple[str, DataFrame]) -> dict:
        name, df = frame
        target, seen = f"{path}/{sample_id}_{name.replace(' ', '_')}.csv", Observation()
        flat(df).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("header", True).csv(target)
        return {"name": name, "path": target, "rows": int(seen.get["rows"]), "cols": len(df.columns), "columns": df.columns}

    files = side_by_side(write, frames.items())
    text = json.dumps({"sample_id": sample_id, "centre_id": centre_id, "report_type": report_type, "files": files}, indent=2)
    fs, p = filesystem(spark, f"{path}/{sample_id}_manifest.json")
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return read_manifest(spark, path, sample_id)


def read_manifest(spark: SparkSession, path: str, sample_id: str) -> DataFrame:
    """One row per exported file: sample_id, name, path, rows, cols, columns."""
    shape = StructType.fromDDL(f"sample_id string, centre_id string, report_type string, files array<struct<{MANIFEST.replace(' ', ': ').replace(',: ', ', ')}>>")
    whole = spark.read.schema(shape).option("multiLine", True).json(f"{path}/{sample_id}_manifest.json")
    return whole.select("sample_id", F.explode("files").alias("f")).select("sample_id", "f.*")

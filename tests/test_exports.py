"""The export of frames with its manifest."""

import json

from pyspark.sql import functions as F

from loomseq.sources import exports


def test_export_writes_each_frame_and_one_manifest(spark, tmp_path):
    base = f"file://{tmp_path}"
    frames = {
        "cnv arm events": spark.createDataFrame([(1, "a,b", None), (2, 'q"x', 0.5)], "k int, t string, v double"),
        "nested": spark.range(3).select("id", F.array("id", "id").alias("list"), F.struct("id").alias("a.b")),
        "empty": spark.createDataFrame([], "x int, y string"),
    }
    for _ in range(2):  # run again, it replaces itself
        got = exports.export_report(spark, frames, base, "S1", "c9").collect()
    assert [(r.sample_id, r["name"], r.path, r.rows, r.cols, r.columns) for r in got] == [
        ("S1", "cnv arm events", f"{base}/S1_cnv_arm_events.csv", 2, 3, ["k", "t", "v"]), ("S1", "nested", f"{base}/S1_nested.csv", 3, 3, ["id", "list", "a.b"]), ("S1", "empty", f"{base}/S1_empty.csv", 0, 2, ["x", "y"]),
    ]
    back = spark.read.option("header", True).csv(got[0].path)
    assert sorted(map(tuple, back.collect())) == [("1", "a,b", None), ("2", 'q"x', "0.5")] and back.columns == ["k", "t", "v"]
    assert sorted(r["list"] for r in spark.read.option("header", True).option("escape", '"').csv(got[1].path).collect()) == ["[0,0]", "[1,1]", "[2,2]"]
    whole = json.loads((tmp_path / "S1_manifest.json").read_text())
    assert (whole["sample_id"], whole["centre_id"], whole["report_type"], len(whole["files"])) == ("S1", "c9", "detailed", 3)

"""Sinks and frames that are written side by side, from tables that several queries share."""

import threading

from pyspark.sql import functions as F

from loomseq.operators import fusion as fu
from loomseq.plans.registry import Tables
from loomseq.sources import exports

HITS = "sample string, read_id string, gene string, chrom string, start_pos long, end_pos long"
SF = "/root/testdata/sf0.001"


def test_steps_run_at_the_same_time_and_keep_their_order(spark):
    met = threading.Barrier(3, timeout=30)

    def step(k):
        met.wait()  # none passes unless all three are running
        return spark.range(k).count()

    assert exports.side_by_side(step, [3, 1, 2]) == [3, 1, 2]


def test_middles_come_from_one_row_per_read(spark):
    rows = [("S", f"r{i}", g, "c", p, p + 11) for i in range(3) for g, p in (("a", 0), ("b", 0), ("b", 100 + i // 2))]
    rows += [("S", "x", "a", "c", 500, 510), ("S", "x", "c", "c", 600, 610), ("S", "y", "a", "c", 700, 710), ("S", None, "a", "c", 800, 810), ("S", None, "b", "c", 800, 810)]
    got = fu.supported_middles(spark.createDataFrame(rows, HITS))
    assert sorted(map(tuple, got.collect())) == [("c", 5), ("c", 105), ("c", 106)]
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()  # the hits were read once, before


def test_a_table_that_several_queries_read_is_made_once(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(5).select(F.col("id") * 2)

    t = Tables(spark, SF, several=True)
    both = exports.side_by_side(lambda _: t.held("x", make), range(2))
    assert len(made) == 1 and both[0] is both[1] and both[0].count() == 5
    assert Tables(spark, SF).held("x", make)._jdf.queryExecution().logical().toString().count("Range") == 1 and len(made) == 2

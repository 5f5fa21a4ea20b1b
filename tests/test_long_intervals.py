"""Range joins on intervals from a base to a chromosome long, against a nested loop."""

import random

import pytest
from pyspark.sql import functions as F

from loomseq.operators import intervals as iv

SHAPE = "id long, chrom string, start_pos long, end_pos long"


def some(rnd, n):
    rows = []
    for i in range(n):
        length = int(10 ** rnd.uniform(0, 6.3))
        start = rnd.randrange(2_000_000)
        rows.append((i, rnd.choice(["chr1", "chr2"]), start, start + length))
    return rows + [(n, "chr1", 0, 250_000_000), (n + 1, "chr2", 5, 5), (n + 2, "chr1", 0, 1)]


@pytest.mark.parametrize("seed, rows", [(1, iv.SMALL_ROWS), (2, 10)])
def test_joins_equal_nested_loop(spark, seed, rows, monkeypatch):
    monkeypatch.setattr(iv, "SMALL_ROWS", rows)  # 10: not broadcast, all levels
    rnd = random.Random(seed)
    a, b = some(rnd, 150), some(rnd, 150)
    left, right = spark.createDataFrame(a, SHAPE), spark.createDataFrame(b, SHAPE)
    got = sorted((r.id, r.r_id, r.overlap) for r in iv.overlap_join(left, right, 20, width=100).collect())
    want = sorted((x[0], y[0], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[1] == y[1] and min(x[3], y[3]) - max(x[2], y[2]) > 20)
    assert got == want and got
    got = sorted((r.id, r.r_id) for r in iv.contained(left, right, width=100).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and y[2] <= x[2] and x[3] <= y[3])
    points = left.select("id", "chrom", F.col("start_pos").alias("pos"))
    got = sorted((r.id, r.r_id) for r in iv.points_in(points, right, 3, 7, width=100).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and y[2] - 3 <= x[2] <= y[3] + 7)


def test_a_chromosome_long_region_makes_few_rows(spark):
    one = spark.createDataFrame([(1, "chr1", 0, 250_000_000), (2, "chr1", 10, 500)], SHAPE)
    cut, top = iv.region_side(one, F.col("start_pos"), F.col("end_pos") - 1, iv.BIN, iv.LEVELS - 1)
    assert top == 2 and cut.count() <= 2 * (iv.LONG + iv.LEVELS)
    left = one.where("id = 2")
    assert sorted(r.r_id for r in iv.overlap_join(left, one).collect()) == [1, 2]
    assert iv.overlap_join(left, one.limit(0)).count() == 0 and iv.overlap_join(left.limit(0), one).count() == 0

"""Quantiles by selection equal those of all values in order."""

import math
import random

from pyspark.sql import functions as F

from loomseq.operators.quantiles import quantiles

AT = [0.0, 0.25, 0.5, 0.9, 1.0]


def plain(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    i, j = math.floor(at), math.ceil(at)
    return v[i] if i == j or v[i] == v[j] else (j - at) * v[i] + (at - i) * v[j]


def test_equal_to_sorted_values(spark):
    r = random.Random(5)
    groups = {
        ("flat", 1): [7.0] * 50,
        ("one", 1): [3.5],
        ("even", 2): [float(x) for x in range(1000)] + [5.0] * 700,
        ("steep", None): [10.0**k * r.choice((-1, 1)) for k in range(-300, 300, 7) for _ in range(2)],
        (None, 3): [r.gauss(0, 1) for _ in range(997)],
        ("wide", 4): [-1.7e308, 1.7e308, 0.0, -0.0, 5e-324],
        ("ends", 5): [float("-inf")] * 3 + [1.0, 2.0] + [float("inf")] * 2,
        ("end", 6): [float("inf")] * 2,
    }
    rows = [(a, b, v) for (a, b), vs in groups.items() for v in vs]
    rows += [("even", 2, None), ("none", 1, None), ("none", 1, float("nan"))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "a string, `b.c` int, `v.x` double")
    for cells in (64, 1024):
        got = {(x["a"], x["b.c"]): x for x in quantiles(df, ["a", "b.c"], "v.x", AT, cells).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            assert (got[k]["n"], got[k]["min"], got[k]["max"]) == (len(vs), min(vs), max(vs))
            assert got[k]["q"] == [plain(vs, p) for p in AT], k


def test_without_keys_and_without_rows(spark):
    df = spark.range(1001).select((F.col("id") % 10).alias("v"))
    assert [tuple(x) for x in quantiles(df, [], "v", [0.5]).collect()] == [(1001, 0.0, 9.0, [4.0])]
    assert quantiles(df.limit(0), [], "v", [0.5]).count() == 0

"""Exact quantiles per group by selection over histograms: no task holds a group's values.

The rows become a histogram of (group, value) with counts, combined before the shuffle.  Each rank that a quantile needs
has a range of values; a round cuts the ranges into cells of equal width, counts them, and keeps the cell that the rank
lies in, shrunk to the least and greatest value there.  A round sorts at most ``cells`` numbers per rank, and cuts a range by that factor; it
ends when every range is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.sources.scratch import drop, settle


def _magnitude(v: Column) -> Column:
    """Grows with ``v`` by its binary order of magnitude, over -2,124 to 2,124."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1_100))


def _cell(v: Column, lo: Column, hi: Column, cells: int, steep: bool) -> Column:
    """The cell of ``v`` among ``cells`` between ``lo`` and ``hi``: it never falls as ``v`` grows, and both ends get cells of their own.

    With ``steep`` a range over many orders of magnitude is cut by them, so that steep distributions take few rounds too.
    """
    low, high = _magnitude(lo), _magnitude(hi)
    share = F.when((hi - lo) == float("inf"), (v / 2 - lo / 2) / (hi / 2 - lo / 2)).otherwise((v - lo) / (hi - lo))
    if steep:
        share = F.when(high - low > 16, (_magnitude(v) - low) / (high - low)).otherwise(share)
    return F.when((lo == hi) | (v == lo), 0).when(v == hi, cells - 1).otherwise(F.greatest(F.lit(0), F.least(F.floor(share * cells), F.lit(cells - 1)))).cast("int")


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], cells: int = 1024) -> DataFrame:
    """(keys, n, min, max, q): for each group the number of values, their bounds and the quantiles ``at``, interpolated.

    The same numbers as ``percentile``.  Values are taken as doubles; nulls and NaN do not count, and a group without
    values has no row.  Infinite values are the ends of the order.  Null keys form a group.  Without ``keys`` all rows are one group.
    """
    group = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.lit(0)
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(group.alias("_k"), (v + 0.0).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    hist = settle(rows.groupBy("_k", "_v").agg(F.count("*").alias("_c")))
    # infinities count for ranks and bounds; ranges are cut between finite values
    big = 1.7976931348623157e308
    finite = F.greatest(F.lit(-big), F.least(F.lit(big), F.col("_v")))
    stats = settle(hist.groupBy("_k").agg(F.sum("_c").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")))
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in at]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place for f in (F.floor, F.ceil)]))
    zero = F.lit(0).cast("long")
    want = stats.select("_k", F.explode(ranks).alias("_r"), zero.alias("_under"), F.col("_lo"), F.col("_hi"))
    found: list[DataFrame] = []
    while True:
        inside = hist.withColumn("_f", finite).join(want, hist["_k"].eqNullSafe(want["_k"])).where("_f between _lo and _hi")
        cell = _cell(F.col("_f"), F.col("_lo"), F.col("_hi"), cells, steep=len(found) > 0)
        counts = inside.groupBy(want["_k"].alias("_k"), "_r", "_under", cell.alias("_cell")).agg(F.sum("_c").alias("_c"), F.min("_f").alias("_lo"), F.max("_f").alias("_hi"))
        upto = F.col("_under") + F.sum("_c").over(Window.partitionBy("_k", "_r").orderBy("_cell"))
        near = counts.withColumn("_upto", upto).withColumn("_under", F.col("_upto") - F.col("_c")).where("_under <= _r and _r < _upto")
        step = settle(near.select("_k", "_r", "_under", "_lo", "_hi"))
        found.append(step)
        want = step.where("_lo < _hi").select("_k", "_r", "_under", "_lo", "_hi")
        if want.isEmpty():
            break
    done = found[0].where("_lo = _hi")
    for f in found[1:]:
        done = done.unionByName(f.where("_lo = _hi"))
    # a cell of one finite bound can hold that bound and the infinity beside it
    ends = hist.where(F.abs("_v") == float("inf")).select("_k", F.col("_v").alias("_e"), F.col("_c").alias("_n"))
    ends = ends.groupBy("_k").agg(F.sum(F.when(F.col("_e") < 0, F.col("_n")).otherwise(0)).alias("_less"), F.sum(F.when(F.col("_e") > 0, F.col("_n")).otherwise(0)).alias("_more"))
    picked = done.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_lo"))).alias("_at"))
    out = stats.join(picked, stats["_k"].eqNullSafe(picked["_k"])).select(stats["_k"], "n", "min", "max", "_at")
    out = out.join(ends, out["_k"].eqNullSafe(ends["_k"]), "left").select(out["_k"], "n", "min", "max", "_at", F.coalesce("_less", zero).alias("_less"), F.coalesce("_more", zero).alias("_more"))

    def one(rank: Column) -> Column:
        exact = F.col("_at")[rank.cast("long")]
        return F.when(rank < F.col("_less"), float("-inf")).when(rank >= F.col("n") - F.col("_more"), float("inf")).otherwise(exact)

    def between(p: Column) -> Column:
        i, j = F.floor(p), F.ceil(p)
        a, b = one(i), one(j)
        return F.when((i == j) | (a == b), a).otherwise((j - p) * a + (p - i) * b)

    named = [F.col("_k").getField(k).alias(k) for k in keys]
    result = settle(out.select(*named, "n", "min", "max", F.array(*[between(p) for p in place]).alias("q")))
    drop(hist, stats, *found)
    return result

"""Coverage of targets and genomes: depths, tiers, distributions, outliers, cumulative series, snapshot joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.operators.intervals import overlap_join
from loomseq.operators.quantiles import quantiles


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first step that ``value`` reaches, else ``otherwise``."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for least, label in steps[1:]:
        out = out.when(value >= least, label)
    return out.otherwise(otherwise)


def depth_quality(value: Column) -> Column:
    return ladder(value, [(30, "Excellent"), (20, "Good"), (10, "Moderate")], "Insufficient")


def depth_tier(value: Column) -> Column:
    return ladder(value, [(30, "high"), (20, "medium")], "low")


def methylation_tier(value: Column) -> Column:
    return ladder(value, [(10, "high"), (5, "medium")], "low")


TARGET = ["chrom", "start_pos", "end_pos", "gene"]


def per_target(aln: DataFrame, targets: DataFrame, rows: Column, total: Column) -> DataFrame:
    """``total`` over the alignments that touch each target, 0 for none; ``rows`` counts those of one place as ``w``.

    Alignments of one place meet the targets once.  The targets are the join's small side, and only totals meet them again.
    """
    t = targets.select(*TARGET)
    spots = aln.groupBy("chrom", "start_pos", "end_pos").agg(rows.alias("w"))
    hits = overlap_join(spots, t.distinct(), min_overlap=0).groupBy(*[F.col(f"r_{c}").alias(c) for c in TARGET]).agg(total)
    name = next(c for c in hits.columns if c not in TARGET)
    return t.distinct().join(hits, TARGET, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def target_coverage(aln: DataFrame, targets: DataFrame) -> DataFrame:
    """Bases and depth of each target; the length counts both ends, and targets without a read have zeros."""
    out = per_target(aln, targets, F.count("*"), F.sum(F.col("overlap") * F.col("w")).alias("bases"))
    return out.withColumn("length", F.col("end_pos") - F.col("start_pos") + 1).withColumn("coverage", F.col("bases") / F.col("length"))


def reads_per_target(aln: DataFrame, targets: DataFrame) -> DataFrame:
    """Primary alignments that touch each target, zero for none."""
    primary = aln.where(~F.col("is_supplementary")).select("read_id", "chrom", "start_pos", "end_pos")
    return per_target(primary, targets, F.count("read_id"), F.sum("w").alias("reads"))


def add_totals(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], how: str = "outer") -> DataFrame:
    """Two tables of totals added by key: ``outer`` keeps keys of either side, ``inner`` only those of both."""
    both = old.select(*keys, *values, F.lit(1).alias("_o"), F.lit(0).alias("_n")).unionByName(new.select(*keys, *values, F.lit(0).alias("_o"), F.lit(1).alias("_n")))
    out = both.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values], F.max("_o").alias("_o"), F.max("_n").alias("_n"))
    return (out.where("_o = 1 and _n = 1") if how == "inner" else out).drop("_o", "_n")


def latest_snapshot(df: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """Each key's values at its newest time."""
    return df.groupBy(*keys).agg(F.max(F.struct(ts, *values)).alias("_s")).select(*keys, *[F.col(f"_s.{v}").alias(v) for v in values])


def on_off_target(aln: DataFrame, covered: DataFrame, lengths: DataFrame) -> DataFrame:
    """Depth of each chromosome on and off its targets, whose ``target_coverage`` is ``covered``."""
    total = aln.groupBy("chrom").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("all_bases"))
    on = covered.groupBy("chrom").agg(F.sum("bases").alias("on_bases"), F.sum("length").alias("on_length"))
    j = lengths.join(total, "chrom", "left").join(on, "chrom", "left").na.fill(0, ["all_bases", "on_bases", "on_length"])
    return j.select(
        "chrom", F.round(F.when(F.col("on_length") > 0, F.col("on_bases") / F.col("on_length")).otherwise(0.0), 6).alias("on_depth"),
        F.round((F.col("all_bases") - F.col("on_bases")) / (F.col("length") - F.col("on_length")), 6).alias("off_depth"),
    )


def distribution(df: DataFrame, value: str = "coverage") -> DataFrame:
    """Median, mean, bounds and the percentages of rows at depths 30, 20 and 10."""
    c = F.col(value)
    share = lambda n: F.round(100 * F.avg((c >= n).cast("int")), 6).alias(f"pct_{n}")
    mid = quantiles(df, [], value, [0.5]).select(F.col("q")[0].alias("median"))
    rest = df.agg(F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), share(30), share(20), share(10))
    return rest.join(F.broadcast(mid), F.lit(True), "left").select("median", *rest.columns)


def box_statistics(df: DataFrame, keys: list[str], value: str = "coverage") -> DataFrame:
    """Minimum, quartiles (interpolated) and maximum per group, and the number of its values."""
    q = quantiles(df, keys, value, [0.25, 0.5, 0.75])
    return q.select(*keys, "min", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))], "max", "n")


def iqr_outliers(df: DataFrame, keys: list[str], value: str = "coverage", least_rows: int = 4) -> DataFrame:
    """Rows beyond 1.5 interquartile ranges of their group, in groups of ``least_rows`` or more, as Gain or Loss."""
    box = box_statistics(df, keys, value).where(F.col("n") >= least_rows).select(*keys, "q1", "q3")
    width = 1.5 * (F.col("q3") - F.col("q1"))
    high, low = F.col(value) > F.col("q3") + width, F.col(value) < F.col("q1") - width
    return df.join(box, keys).where(high | low).withColumn("label", F.when(high, "Gain").otherwise("Loss")).drop("q1", "q3")


def sd_outliers(df: DataFrame, keys: list[str], value: str, times: float = 2.0, least_rows: int = 3) -> DataFrame:
    """Rows beyond ``times`` sample deviations of their time point's mean; flat or small time points have none."""
    w = Window.partitionBy(*keys)
    stats = df.withColumns({"_m": F.avg(value).over(w), "_s": F.stddev_samp(value).over(w), "_n": F.count("*").over(w)})
    high, low = F.col(value) > F.col("_m") + times * F.col("_s"), F.col(value) < F.col("_m") - times * F.col("_s")
    return stats.where((F.col("_n") >= least_rows) & (F.col("_s") != 0) & (high | low)).withColumn("label", F.when(high, "high").otherwise("low")).drop("_m", "_s", "_n")


def mean_band(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean per time point beside the band of two deviations around the mean of those means."""
    per = df.groupBy(ts).agg(F.avg(value).alias("mean"))
    band = per.agg(F.avg("mean").alias("_m"), F.stddev_samp("mean").alias("_s"))
    return per.crossJoin(F.broadcast(band)).select(ts, F.round("mean", 6).alias("mean"), F.round(F.col("_m") - 2 * F.col("_s"), 6).alias("low"), F.round(F.col("_m") + 2 * F.col("_s"), 6).alias("high"))


def cumulative(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Running total of ``value`` per key in time order."""
    return df.withColumn("total", F.sum(value).over(Window.partitionBy(*keys).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)))

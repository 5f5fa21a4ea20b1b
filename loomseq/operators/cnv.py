"""Copy number from binned counts: normalisation, smoothing, runs, arms, bands, events, change points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.operators.intervals import small
from loomseq.operators.quantiles import quantiles

BIN_WIDTH = 10_000
KEY = ["sample", "chrom"]


def binned_counts(aln: DataFrame, width: int = BIN_WIDTH, least_mapq: int = 60) -> DataFrame:
    """Reads of mapping quality ``least_mapq`` or more per bin of their start."""
    return aln.where(F.col("mapq") >= least_mapq).groupBy(*KEY, F.floor(F.col("start_pos") / width).alias("bin")).agg(F.count("*").alias("n"))


def copy_numbers(bins: DataFrame) -> DataFrame:
    """Value of each bin: twice its count over the sample's median of non-zero autosomal counts."""
    auto = bins.where(F.col("chrom").rlike("^chr[0-9]+$") & (F.col("n") > 0))
    mid = quantiles(auto, ["sample"], "n", [0.5]).select("sample", F.col("q")[0].alias("m"))
    return bins.join(small(mid), "sample").select(*KEY, "bin", F.round(2 * F.col("n") / F.col("m"), 6).alias("value"))


def moving_average(bins: DataFrame) -> DataFrame:
    """Centred mean over three bins; at the ends the edge value is taken again."""
    w = Window.partitionBy(*KEY).orderBy("bin")
    v = F.col("value")
    return bins.withColumn("smooth", F.round((F.coalesce(F.lag("value").over(w), v) + v + F.coalesce(F.lead("value").over(w), v)) / 3, 6))


def normalised(sample: DataFrame, control: DataFrame) -> DataFrame:
    """Smoothed sample minus smoothed control; bins that one side lacks count as 0 there."""
    s = moving_average(sample).select(*KEY, "bin", F.col("smooth").alias("s"))
    c = moving_average(control).select("chrom", "bin", F.col("smooth").alias("c"))
    owners = sample.select(*KEY).distinct()
    grid = owners.join(c.select("chrom", "bin"), "chrom").select(*KEY, "bin").union(s.select(*KEY, "bin")).distinct()
    zero = F.lit(0.0)
    return grid.join(s, [*KEY, "bin"], "left").join(c, ["chrom", "bin"], "left").select(*KEY, "bin", F.round(F.coalesce("s", zero) - F.coalesce("c", zero), 6).alias("value"))


def chromosome_statistics(bins: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return bins.groupBy(*KEY).agg(r(F.avg("value")).alias("mean"), r(F.stddev_pop("value")).alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("bins"))


def runs(bins: DataFrame, over: float = 0.5, width: int = BIN_WIDTH) -> DataFrame:
    """Consecutive bins beyond ``over`` of one sign as half-open regions labelled gain or loss."""
    sign = F.when(F.col("value") > over, 1).when(F.col("value") < -over, -1)
    s = bins.withColumn("sign", sign).where("sign is not null")
    isle = F.col("bin") - F.row_number().over(Window.partitionBy(*KEY, "sign").orderBy("bin"))
    return s.withColumn("_i", isle).groupBy(*KEY, "sign", "_i").agg((F.min("bin") * width).alias("start_pos"), ((F.max("bin") + 1) * width).alias("end_pos")).select(
        *KEY, "start_pos", "end_pos", F.when(F.col("sign") == 1, "gain").otherwise("loss").alias("kind")
    )


def bins_in_bands(bins: DataFrame, bands: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """Each bin beside every band that its index range, ends included, holds; a border bin counts for both bands."""
    b = bands.select("chrom", "band", F.col("start_pos").alias("band_start"), F.col("end_pos").alias("band_end"))
    b = b.withColumn("bin", F.explode(F.sequence(F.floor(F.col("band_start") / width), F.floor(F.col("band_end") / width))))
    return bins.join(small(b), ["chrom", "bin"])


def with_sex(df: DataFrame, sexes: DataFrame | None) -> DataFrame:
    """``df`` with its sample's ``sex`` out of (sample, sex); a sample that is not listed counts as female."""
    if sexes is None:
        return df.withColumn("sex", F.lit("Female"))
    return df.join(small(sexes.select("sample", "sex")), "sample", "left").withColumn("sex", F.coalesce("sex", F.lit("Female")))


def is_male(sex: Column) -> Column:
    return F.upper(sex).isin("XY", "MALE")


def thresholds(chrom: Column, sex: Column) -> tuple[Column, Column]:
    """(gain, loss) by chromosome and sex label; labels other than XY and Male count as female.  Fixed values."""
    male = is_male(sex)
    gain = F.when(chrom == "chrX", F.when(male, 0.3).otherwise(0.75)).when(chrom == "chrY", F.when(male, 0.5).otherwise(0.2)).otherwise(0.4)
    loss = F.when(chrom == "chrX", F.when(male, -0.3).otherwise(-0.75)).when(chrom == "chrY", F.when(male, -0.5).otherwise(-1.0)).otherwise(-0.4)
    return gain, loss


def arm_statistics(bins: DataFrame, bands: DataFrame, sexes: DataFrame | None = None, width: int = BIN_WIDTH) -> DataFrame:
    """Per arm (the band's first letter): mean, shares of bins over gain and under loss, and the larger share."""
    gain, loss = thresholds(F.col("chrom"), F.col("sex"))
    arms = with_sex(bins_in_bands(bins, bands, width), sexes).withColumn("arm", F.substring("band", 1, 1))
    out = arms.groupBy(*KEY, "arm").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("value") > gain).cast("int")), 6).alias("gain_share"),
        F.round(F.avg((F.col("value") < loss).cast("int")), 6).alias("loss_share"), F.count("*").alias("bins"),
    )
    return out.withColumn("share", F.greatest("gain_share", "loss_share"))


#: Beyond this bin width nothing is called.  Fixed value.
WIDEST_BIN = 10_000_000


def arm_places(bands: DataFrame, genes: DataFrame) -> DataFrame:
    """(chrom, arm, start_pos, end_pos, genes) of both arms and, with a null arm, of the whole chromosome.

    Genes are the distinct names that touch an arm, ends included; a whole chromosome has all of its own.
    """
    b = bands.withColumn("arm", F.substring("band", 1, 1))
    bounds = [F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")]
    arms = b.where(F.col("arm").isin("p", "q")).groupBy("chrom", "arm").agg(*bounds)
    whole = b.groupBy("chrom").agg(*bounds).select("chrom", F.lit(None).cast("string").alias("arm"), "start_pos", "end_pos")
    g = genes.select("chrom", F.col("start_pos").alias("g0"), F.col("end_pos").alias("g1"), "gene")
    met = g.join(small(arms.unionByName(whole)), "chrom").where("arm is null or (g0 <= end_pos and g1 >= start_pos)")
    names = met.groupBy("chrom", F.coalesce("arm", F.lit("")).alias("_a")).agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    every = arms.unionByName(whole).withColumn("_a", F.coalesce("arm", F.lit("")))
    return every.join(names, ["chrom", "_a"], "left").select("chrom", "arm", "start_pos", "end_pos", F.coalesce("genes", F.array().cast("array<string>")).alias("genes"))


def call_events(bins: DataFrame, bands: DataFrame, genes: DataFrame, sexes: DataFrame | None = None, width: int = BIN_WIDTH) -> DataFrame:
    """Whole-chromosome and arm events with their place, genes and share; both kinds may appear for one chromosome.

    Whole: both arms beyond the threshold the same way, one share over 0.7 and both over 0.4; its mean is the
    chromosome's, its confidence High if both shares exceed 0.8.  Arm: share over 0.4 and the mean beyond the threshold,
    High over 0.8; never on chrY.  A chromosome with one arm: the size of its mean over 1.5 gain thresholds, always Medium and
    with a share of 1.  chrM, names without ``chr`` and chrY of males are left out; nothing is called on bins over ``WIDEST_BIN``.
    """
    if width > WIDEST_BIN:
        bins = bins.limit(0)
    bins = with_sex(bins.where("chrom like 'chr%' and chrom <> 'chrM'"), sexes).where((F.col("chrom") != "chrY") | ~is_male(F.col("sex"))).drop("sex")
    gain, loss = thresholds(F.col("chrom"), F.col("sex"))
    means = bins.groupBy(*KEY).agg(F.round(F.avg("value"), 6).alias("chrom_mean"))
    a = arm_statistics(bins, bands, sexes, width).where(F.col("arm").isin("p", "q"))
    side = lambda s, c: F.max(F.when(F.col("arm") == s, F.col(c)))
    both = a.groupBy(*KEY).agg(side("p", "mean").alias("p"), side("q", "mean").alias("q"), side("p", "share").alias("ps"), side("q", "share").alias("qs"))
    c = with_sex(means.join(both, KEY, "left"), sexes)
    two = F.col("p").isNotNull() & F.col("q").isNotNull()
    label = lambda share: F.when(share > 0.8, "High").otherwise("Medium")
    wide = (F.greatest("ps", "qs") > 0.7) & (F.least("ps", "qs") > 0.4)
    up, down = (F.col("p") > gain) & (F.col("q") > gain), (F.col("p") < loss) & (F.col("q") < loss)
    whole = F.when(two & wide & up, "WHOLE_CHR_GAIN").when(two & wide & down, "WHOLE_CHR_LOSS").when(
        ~two & (F.abs("chrom_mean") > 1.5 * F.abs(gain)), F.when(F.col("chrom_mean") > gain, "WHOLE_CHR_GAIN").otherwise("WHOLE_CHR_LOSS"))
    event = lambda kind, arm, mean, conf, share: F.struct(kind.alias("event"), F.lit(arm).cast("string").alias("arm"), mean.alias("mean"), conf.alias("confidence"), share.alias("share"))
    sided = [
        event(F.when(two & (F.col("chrom") != "chrY") & (s > 0.4), F.when(m > gain, "GAIN").when(m < loss, "LOSS")), arm, m, label(s), s)
        for arm, m, s in (("p", F.col("p"), F.col("ps")), ("q", F.col("q"), F.col("qs")))
    ]
    conf = F.when(two, label(F.least("ps", "qs"))).otherwise("Medium")
    all_ = F.array(event(whole, None, F.col("chrom_mean"), conf, F.when(two, F.greatest("ps", "qs")).otherwise(1.0)), *sided)
    found = c.select(*KEY, F.explode(all_).alias("e")).where("e.event is not null").select(*KEY, "e.*")
    places = arm_places(bands, genes).withColumn("_a", F.coalesce("arm", F.lit(""))).drop("arm")
    out = found.withColumn("_a", F.coalesce("arm", F.lit(""))).join(small(places), ["chrom", "_a"])
    return out.select(*KEY, "event", "arm", "mean", "start_pos", "end_pos", (F.col("end_pos") - F.col("start_pos")).alias("length"), "genes", "confidence", "share")


def event_summary(events: DataFrame) -> DataFrame:
    """Per sample: events by kind and confidence, those that hold genes, and the distinct genes in them."""
    c = lambda x: F.count_if(x)
    whole = F.col("event").startswith("WHOLE_CHR_")
    counts = events.groupBy("sample").agg(
        F.count("*").alias("events"), c(whole).alias("whole"), c(~whole).alias("arms"), c(F.size("genes") > 0).alias("with_genes"),
        c(F.col("confidence") == "High").alias("high"), c(F.col("confidence") == "Medium").alias("medium"),
    )
    genes = events.select("sample", F.explode("genes").alias("g")).groupBy("sample").agg(F.countDistinct("g").alias("genes"))
    return counts.join(genes, "sample", "left").withColumn("genes", F.coalesce("genes", F.lit(0).cast("long")))


def estimate_sex(bins: DataFrame, x: str = "chrX", y: str = "chrY") -> DataFrame:
    """Sex label from the means of non-zero bins on the two sex chromosomes, by an ordered ladder.  Fixed values."""
    mean = lambda c: F.avg(F.when((F.col("chrom") == c) & (F.col("value") != 0), F.col("value")))
    m = bins.groupBy("sample").agg(F.round(mean(x), 6).alias("x_mean"), F.round(mean(y), 6).alias("y_mean"))
    a, b = F.col("x_mean"), F.col("y_mean")
    label = (
        F.when(a.isNull() | b.isNull(), "Unknown").when((a >= 0.1) & (b <= -0.1), "Female").when((a <= 0.1) & (b >= -0.2), "Male")
        .when((a >= 0.1) & (b >= -0.1), "Male (query X/Y copy number changes)").when((a < 0.1) & (b < -0.2), "Unknown (Query XY copy number changes)").otherwise("Unknown")
    )
    return m.withColumn("sex", label)


def band_runs(bins: DataFrame, bands: DataFrame, genes: DataFrame, sexes: DataFrame | None = None, width: int = BIN_WIDTH) -> DataFrame:
    """Neighbouring bands in one state as one row, and one row for a chromosome that is one way over 70 % of its bins.

    A band's state comes from its mean (0 without bins) and the thresholds of chromosome and sex.  Rows of gain and
    loss carry the distinct genes they touch; normal ones have none.  A whole chromosome's mean is that of its bins.
    """
    if width > WIDEST_BIN:
        bins = bins.limit(0)
    gain, loss = thresholds(F.col("chrom"), F.col("sex"))
    way = lambda up, down: F.when(up, "GAIN").when(down, "LOSS")
    value = F.col("value")
    chroms = with_sex(bins, sexes).groupBy(*KEY, "sex").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.avg((value > gain).cast("int")).alias("g"), F.avg((value < loss).cast("int")).alias("l"))
    edges = bands.groupBy("chrom").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    whole = chroms.withColumn("state", way(F.col("g") > 0.7, F.col("l") > 0.7)).where("state is not null").join(small(edges), "chrom").select(
        *KEY, F.concat_ws(" ", "chrom", F.lit("WHOLE CHROMOSOME"), "state").alias("name"), "state", "start_pos", "end_pos", "mean", F.lit(None).cast("long").alias("bands"))
    means = bins_in_bands(bins, bands, width).groupBy(*KEY, "band", "band_start", "band_end").agg(F.round(F.avg("value"), 6).alias("mean"))
    b = small(bands.select("chrom", "band", F.col("start_pos").alias("band_start"), F.col("end_pos").alias("band_end")))
    per = chroms.select(*KEY, "sex").join(b, "chrom").join(means, [*KEY, "band", "band_start", "band_end"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    w = Window.partitionBy(*KEY).orderBy("band_start")
    s = per.withColumn("state", F.coalesce(way(F.col("mean") > gain, F.col("mean") < loss), F.lit("NORMAL")))
    s = s.withColumn("_c", F.coalesce((F.lag("state").over(w) != F.col("state")).cast("int"), F.lit(1))).withColumn("_i", F.sum("_c").over(w))
    runs_ = s.groupBy(*KEY, "_i", "state").agg(
        F.min("band_start").alias("start_pos"), F.max("band_end").alias("end_pos"), F.round(F.avg("mean"), 6).alias("mean"),
        F.min_by("band", "band_start").alias("first_band"), F.max_by("band", "band_start").alias("last_band"), F.count("*").alias("bands"),
    ).select(*KEY, F.concat_ws(" ", "chrom", F.concat_ws("-", "first_band", "last_band")).alias("name"), "state", "start_pos", "end_pos", "mean", "bands")
    rows = whole.unionByName(runs_)
    # the distinct stretches are few, whatever the number of samples
    spots = rows.where("state <> 'NORMAL'").select("chrom", "start_pos", "end_pos").distinct()
    g = genes.select(F.col("chrom").alias("_c"), F.col("start_pos").alias("g0"), F.col("end_pos").alias("g1"), "gene")
    named = spots.join(g, (F.col("chrom") == F.col("_c")) & (F.col("g0") <= F.col("end_pos")) & (F.col("g1") >= F.col("start_pos"))).groupBy("chrom", "start_pos", "end_pos").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    named = named.withColumn("_hit", F.lit(True))
    out = rows.join(named, ["chrom", "start_pos", "end_pos"], "left").withColumn("length", F.col("end_pos") - F.col("start_pos"))
    own = F.when((F.col("state") != "NORMAL") & F.col("_hit"), F.col("genes"))
    return out.select(*KEY, "name", "state", "start_pos", "end_pos", "length", "mean", "bands", F.coalesce(own, F.array().cast("array<string>")).alias("genes"))


def downsample(bins: DataFrame, k: int, width: int = BIN_WIDTH) -> DataFrame:
    """Mean of every ``k`` bins; groups that lack bins are left out.  ``x`` is the group's middle."""
    return bins.groupBy(*KEY, F.floor(F.col("bin") / k).alias("g")).agg(F.round(F.avg("value"), 6).alias("value"), F.count("*").alias("_n")).where(F.col("_n") == k).select(
        *KEY, ((F.col("g") + 0.5) * k * width).alias("x"), "value"
    )


def evenly(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows per key, spread evenly over its order."""
    w = Window.partitionBy(*keys)
    r = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    slot = F.floor(F.col("_r") * most / F.col("_n"))
    before = F.floor((F.col("_r") - 1) * most / F.col("_n"))
    return r.where((F.col("_n") <= most) | (F.col("_r") == 0) | (slot != before)).drop("_r", "_n")


def segment_ends(values: np.ndarray, penalty: float = 10.0, least: int = 2) -> list[int]:
    """Ends of the segments of least squared error plus ``penalty`` each (optimal partitioning with pruning)."""
    n = len(values)
    s1, s2 = np.concatenate(([0.0], np.cumsum(values))), np.concatenate(([0.0], np.cumsum(values**2)))
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = -penalty
    open_ = np.array([0])
    for e in range(least, n + 1):
        size = e - open_
        fits = size >= least
        gap = s1[e] - s1[open_]
        cost = best[open_] + s2[e] - s2[open_] - gap * gap / size
        k = int(np.where(fits, cost, np.inf).argmin())
        best[e], back[e] = cost[k] + penalty, open_[k]
        open_ = np.append(open_[(cost <= best[e]) | ~fits], e - least + 1 if e - least + 1 >= least else []).astype(int)
        open_ = np.unique(open_)
    out, e = [], n
    while e > 0:
        out.append(e)
        e = int(back[e])
    return out[::-1]


def change_points(bins: DataFrame, penalty: float = 10.0, width: int = BIN_WIDTH, more_than: int = 3) -> DataFrame:
    """Mean shifts of the raw series per sample and chromosome of more than three bins; the end counts as one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("bin")["value"].to_numpy(dtype=float)
        ends = segment_ends(v, penalty) if len(v) > more_than else []
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "chrom": pdf["chrom"].iloc[0], "start_pos": [e * width - width for e in ends], "end_pos": [e * width + width for e in ends]})

    return bins.groupBy(*KEY).applyInPandas(run, "sample string, chrom string, start_pos long, end_pos long")

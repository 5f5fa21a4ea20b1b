"""Methylation: pileups from per-read calls, folds over batches, strand collapse, probe votes, site pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseq.operators.intervals import points_in, small

THRESHOLD = 178  # int(0.7 * 255)
SITE = ["sample", "chrom", "pos", "strand"]


def best_calls(calls: DataFrame) -> DataFrame:
    """One row per read, site and code: its highest probability."""
    return calls.groupBy(*SITE, "read_id", "mod_code").agg(F.max("prob").alias("prob"))


def pileup_combined(calls: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per site: modified, canonical and failed reads over all codes; sites with nothing but failures go.

    A read's canonical probability is what its codes leave of 255.  The call is the larger of the best code and
    canonical if it reaches ``threshold``; ties go to canonical.  The percentage counts failures in its base.
    """
    per = best_calls(calls).groupBy(*SITE, "read_id").agg(F.max("prob").alias("best"), F.greatest(F.lit(0), F.lit(255) - F.sum("prob")).alias("canon"))
    kind = F.when(F.greatest("best", "canon") < threshold, "fail").when(F.col("canon") >= F.col("best"), "canonical").otherwise("modified")
    out = per.withColumn("k", kind).groupBy(*SITE).agg(
        F.count_if(F.col("k") == "modified").alias("n_mod"), F.count_if(F.col("k") == "canonical").alias("n_canonical"), F.count_if(F.col("k") == "fail").alias("n_fail")
    ).where("n_mod + n_canonical > 0")
    return out.withColumn("percent", F.round(100 * F.col("n_mod") / (F.col("n_mod") + F.col("n_canonical") + F.col("n_fail")), 2))


def pileup_by_code(calls: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per site and code: modified, canonical, other-code and failed reads.

    A call below ``threshold`` counts as other-modified where another code of the same read and site reaches it.
    """
    top = F.max("prob").over(Window.partitionBy(*SITE, "read_id"))
    rest = F.lit(255) - F.sum("prob").over(Window.partitionBy(*SITE, "read_id"))
    kind = (
        F.when(F.col("prob") >= threshold, "modified").when(F.col("top") >= threshold, "other")
        .when(F.col("rest") >= threshold, "canonical").otherwise("fail")
    )
    per = best_calls(calls).withColumns({"top": top, "rest": rest}).withColumn("k", kind)
    return per.groupBy(*SITE, "mod_code").agg(*[F.count_if(F.col("k") == k).alias(f"n_{k}") for k in ("modified", "canonical", "other", "fail")])


def fold_batches(bed: DataFrame, mode: str = "sum") -> DataFrame:
    """bedMethyl rows of several batches as one per (sample, chrom, pos).

    ``sum`` takes the percentage from the summed counts, so the number of batches does not matter; ``mean``
    averages the batches' percentages.  Code and strand are the smallest met.
    """
    percent = F.avg("percent_modified") if mode == "mean" else 100 * F.sum("n_mod") / F.sum("valid_cov")
    return bed.groupBy("sample", "chrom", "pos").agg(
        F.min("mod_code").alias("mod_code"), F.min("strand").alias("strand"), F.sum("valid_cov").alias("valid_cov"),
        F.round(percent, 6).alias("percent_modified"), F.sum("n_mod").alias("n_mod"), F.sum("n_canonical").alias("n_canonical"),
    )


def collapse_strands_minimal(bed: DataFrame) -> DataFrame:
    """Both strands as ``.``: mean percentage per position and code."""
    return bed.groupBy("sample", "chrom", "pos", "mod_code").agg(F.round(F.avg("percent_modified"), 6).alias("percent_modified")).withColumn("strand", F.lit(".")).withColumn("end_pos", F.col("pos") + 1)


def collapse_strands_full(*beds: DataFrame) -> DataFrame:
    """Counters of both strands (and of several tables) summed; the fraction is taken from the sums."""
    every = beds[0]
    for b in beds[1:]:
        every = every.unionByName(b)
    return every.groupBy("sample", "chrom", "pos", "mod_code").agg(*[F.sum(c).alias(c) for c in ("valid_cov", "n_mod", "n_canonical")]).withColumn(
        "fraction", F.round(F.col("n_mod") / F.col("valid_cov") * 100, 6)
    )


def probe_votes(probes: DataFrame, calls: DataFrame, margin: int = 25, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Per probe: the calls from start - margin to start + margin + 1 and their vote.

    Scores over ``high`` vote 1, under ``low`` -1, others not; the vote is the median of those, cut towards 0, so
    an even split is no call.  Calls are counted per place before the join, and of two kinds of votes the more frequent
    is the median: no list of votes is kept.
    """
    spots = probes.select("probe_id", "chrom", F.col("start_pos"), (F.col("start_pos") + 1).alias("end_pos"))
    score = F.col("score")
    places = calls.groupBy("chrom", "pos").agg(F.count("*").alias("n"), F.count_if(score > high).alias("up"), F.count_if(score < low).alias("down"))
    hits = points_in(places, spots, margin, margin, width=64)
    vote = F.signum(F.sum("up") - F.sum("down")).cast("int")
    return hits.groupBy(F.col("r_probe_id").alias("probe_id")).agg(F.sum("n").alias("calls"), vote.alias("vote"))


def site_pairs(bed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per sample and pair (pair_id, chrom, p1, p2): forward calls at p1 - 1 and reverse ones at p2 - 1 put together.

    The percentage is weighted by coverage; modified counts are rounded.  Pairs of one place share their sums, which are
    taken once per place and sample; only those meet the pairs.
    """
    place = ["chrom", "p1", "p2"]
    each = pairs.select(*place).distinct().select(*place, F.explode(F.array(
        F.struct((F.col("p1") - 1).alias("pos"), F.lit("+").alias("strand")), F.struct((F.col("p2") - 1).alias("pos"), F.lit("-").alias("strand")))).alias("e"))
    hits = bed.join(small(each.select(*place, "e.pos", "e.strand")), ["chrom", "pos", "strand"])
    cov = lambda s: F.coalesce(F.sum(F.when(F.col("strand") == s, F.col("valid_cov"))), F.lit(0))
    weighted = F.col("valid_cov") * F.col("percent_modified")
    sums = {"forward_cov": cov("+"), "reverse_cov": cov("-"), "total_cov": F.sum("valid_cov"), "_mod": F.sum(weighted / 100), "_weighted": F.sum(weighted)}
    per = hits.groupBy("sample", *place).agg(*[c.alias(n) for n, c in sums.items()])
    # an id may name several places
    out = pairs.join(small(per), place).groupBy("sample", "pair_id").agg(*[F.sum(n).alias(n) for n in sums])
    return out.select(
        "sample", "pair_id", "forward_cov", "reverse_cov", "total_cov", F.round("_mod").cast("long").alias("total_mod"), F.round(F.col("_weighted") / F.col("total_cov"), 2).alias("meth_pct"),
    )


def full_layout(bed: DataFrame, assumed_cov: int | None = None) -> DataFrame:
    """The 18-column layout from the 8 columns; with ``assumed_cov`` counts come from the percentage (half to even)."""
    cov = F.lit(assumed_cov).cast("long") if assumed_cov else F.col("valid_cov")
    n = F.bround(F.col("percent_modified") * cov / 100).cast("long") if assumed_cov else F.col("n_mod")
    zero = F.lit(0).cast("long")
    return bed.select(
        "sample", "chrom", "pos", (F.col("pos") + 1).alias("end_pos"), "mod_code", cov.alias("score"), "strand", F.col("pos").alias("thick_start"),
        (F.col("pos") + 1).alias("thick_end"), F.lit("255,0,0").alias("color"), cov.alias("valid_cov"), F.round("percent_modified", 2).alias("percent_modified"),
        n.alias("n_mod"), (cov - n).alias("n_canonical"), *[zero.alias(c) for c in ("n_other", "n_delete", "n_fail", "n_diff", "n_nocall")],
    )


def forest_layout(bed: DataFrame) -> DataFrame:
    """Eleven tab-separated fields, the last holding coverage and fraction with a blank between."""
    return bed.select("sample", F.concat_ws("\t", "chrom", "pos", F.col("pos") + 1, "mod_code", "valid_cov", F.lit("+"), "pos", F.col("pos") + 1, F.lit("0,0,0"),
                      F.concat_ws(" ", "valid_cov", F.format_number(F.col("percent_modified"), 2))).alias("line"))


def enough_evidence(calls: DataFrame, reads: int = 10) -> DataFrame:
    """Per sample: reads with calls, codes met, and whether that is enough to go on."""
    return calls.groupBy("sample").agg(F.countDistinct("read_id").alias("reads"), F.array_sort(F.collect_set("mod_code")).alias("codes")).withColumn(
        "enough", (F.col("reads") >= reads) & (F.size("codes") > 0)
    )

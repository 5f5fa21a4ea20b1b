"""Variants: predicates on INFO, grouping, summaries, evidence from pileups, per-gene roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.operators.intervals import points_in


def info_value(info: Column, key: str) -> Column:
    """The value of ``key`` in an INFO text, null where it is absent; values may hold ``=``."""
    v = F.regexp_extract(info, f"(?:^|;){key}=([^;]*)", 1)
    return F.when(v != "", v)


def info_map(info: Column) -> Column:
    """INFO as a map; flags without ``=`` have an empty value."""
    return F.map_from_entries(F.transform(F.array_distinct(F.split(info, ";")), lambda x: F.struct(F.split(x, "=", 2)[0].alias("key"), F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit("")).alias("value"))))


def pathogenic(info: Column, strict: bool = False) -> Column:
    """Whether CLNSIG speaks of pathogenic in any form; ``strict`` leaves out the conflicting class."""
    sig = F.coalesce(info_value(info, "CLNSIG"), F.lit(""))
    any_ = F.lower(sig).contains("pathogenic")
    return any_ & ~F.lower(sig).contains("conflicting") if strict else any_


def clinvar_pathogenic(sig: Column, onc: Column) -> Column:
    """CLNSIG decides where it is present, else ONC."""
    return F.when(sig.isNotNull(), F.lower(sig).contains("pathogenic")).otherwise(F.coalesce(F.lower(onc).contains("oncogenic"), F.lit(False)))


def annotations(ann: Column) -> Column:
    """ANN as an array of its entries' fields; entries of fewer than 16 fields are left out."""
    return F.filter(F.transform(F.split(ann, ","), lambda e: F.split(e, r"\|")), lambda p: F.size(p) >= 16)


def variant_filter(v: DataFrame, passed: bool = True, only_pathogenic: bool = False, min_qual: float | None = None, min_depth: int | None = None) -> DataFrame:
    """Rows that meet the bounds asked for; a null number fails a bound."""
    if passed:
        v = v.where("filter_status = 'PASS'")
    if only_pathogenic:
        v = v.where(pathogenic(F.col("info")))
    if min_qual is not None:
        v = v.where(F.col("qual").try_cast("double") >= min_qual)
    if min_depth is not None:
        v = v.where(info_value(F.col("info"), "DP").try_cast("int") >= min_depth)
    return v


def grouped(v: DataFrame, keys: list[str], others: list[str]) -> DataFrame:
    """One row per key, other columns as their sorted distinct values; rows with a null key go."""
    full = v.dropna(subset=keys)
    return full.groupBy(*keys).agg(*[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ", ").alias(c) for c in others])


def summary(v: DataFrame) -> DataFrame:
    p = pathogenic(F.col("info"))
    gene = F.split(info_value(F.col("info"), "GENEINFO"), ":")[0]
    return v.agg(
        F.count("*").alias("variants"), F.count_if(F.col("filter_status") == "PASS").alias("passed"), F.count_if(p).alias("pathogenic"),
        F.countDistinct(F.when(p, gene)).alias("genes"), F.countDistinct(F.when(p, F.struct("chrom", "pos"))).alias("places"),
    )


def pileup_counts(bases: DataFrame, first_reads: int = 10) -> DataFrame:
    """Per position: counts of each base and of gaps, coverage without gaps, mean quality, the commonest base, first reads.

    The commonest base stands for the reference; ties go to the first letter.
    """
    n = {b: F.count_if(F.col("base") == s) for b, s in (("A", "A"), ("C", "C"), ("G", "G"), ("T", "T"), ("N", "N"), ("indel", "-"))}
    out = bases.groupBy("chrom", "pos").agg(
        *[c.alias(b) for b, c in n.items()], F.round(F.avg("qual"), 6).alias("mean_qual"),
    )
    # the group limit is applied before the exchange, so a deep position never gathers its reads
    place = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("read_id"))
    named = bases.select("chrom", "pos", "read_id").where("read_id is not null").distinct().withColumn("_r", place).where(F.col("_r") <= first_reads)
    named = named.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list("read_id")).alias("reads"))
    none = F.array().cast("array<string>")
    out = out.join(named, ["chrom", "pos"], "left").withColumn("reads", F.coalesce("reads", none))
    depth = F.col("A") + F.col("C") + F.col("G") + F.col("T") + F.col("N")
    top = F.greatest("A", "C", "G", "T")
    major = F.when(top == 0, F.lit(None).cast("string")).when(F.col("A") == top, "A").when(F.col("C") == top, "C").when(F.col("G") == top, "G").otherwise("T")
    return out.withColumns({"coverage": depth, "major": major})


def evidence(variants: DataFrame, pile: DataFrame) -> DataFrame:
    """Known variants beside the pileup at their place: support, allele share, level and zygosity.

    A variant whose reference and alternate differ in length is an indel: a deletion is left to review, an insertion
    too where the pileup's base is the first of the reference, and its reads of that base are its reference support.
    """
    j = variants.join(pile, ["chrom", "pos"])
    of = lambda base: F.coalesce(*[F.when(base == b, F.col(b)) for b in "ACGT"], F.lit(0).cast("long"))
    indel = F.length("ref") != F.length("alt")
    head = F.substring("ref", 1, 1)
    inserted = indel & (F.length("ref") < F.length("alt"))
    meets = F.coalesce(F.col("major"), F.lit("N")) == head
    none = F.lit(0).cast("long")
    j = j.withColumns({
        "is_indel": indel,
        "ref_support": F.when(inserted & meets, of(F.upper(head))).when(indel, none).otherwise(of(F.upper("ref"))),
        "alt_support": F.when(indel, none).otherwise(of(F.upper("alt"))),
    })
    share = F.when((F.col("coverage") > 0) & ~indel, F.col("alt_support") / F.col("coverage")).otherwise(0.0)
    j = j.withColumn("share", share)
    n, x = F.col("alt_support"), F.col("share")
    level = (
        F.when(inserted & ~meets, "reference_mismatch").when(inserted, "insertion_requires_review").when(indel, "indel_requires_review")
        .when(n == 0, "no_support").when(n < 3, "low_support").when(x < 0.1, "low_frequency").when(x < 0.3, "medium_frequency").otherwise("high_frequency")
    )
    zyg = (
        F.when(indel, "indel_requires_review").when(F.col("coverage") <= 0, "unknown")
        .when(x > 0.8, "homozygous").when(x > 0.2, "heterozygous").otherwise("low_frequency")
    )
    j = j.withColumns({"level": level, "zygosity": zyg, "vaf": F.round("share", 6)})
    return j.select("chrom", "pos", "ref", "alt", "coverage", "ref_support", "alt_support", "vaf", "level", "zygosity", "is_indel")


def region_quality(pile: DataFrame, regions: DataFrame) -> DataFrame:
    """Coverage of the positions in each region (chrom, start_pos, end_pos, name; ends included) and what it is worth.

    High: mean of 30 on a region of 1000 bases; medium: 10 on 500.  A region without a covered position is low.  Copies of a
    region are one region.
    """
    regions = regions.select("chrom", "start_pos", "end_pos", "name").distinct()
    spots = points_in(pile.select("chrom", "pos", "coverage"), regions).groupBy(
        "chrom", F.col("r_start_pos").alias("start_pos"), F.col("r_end_pos").alias("end_pos"), F.col("r_name").alias("name")
    ).agg(F.count("*").alias("positions"), F.sum("coverage").alias("total"), F.avg("coverage").alias("m"), F.round(F.stddev_pop("coverage"), 6).alias("sd"))
    s = regions.join(spots, ["chrom", "start_pos", "end_pos", "name"], "left")
    size, m = F.col("end_pos") - F.col("start_pos"), F.coalesce("m", F.lit(0.0))
    label = F.when((m >= 30) & (size >= 1000), "high").when((m >= 10) & (size >= 500), "medium").otherwise("low")
    zero = F.lit(0).cast("long")
    return s.select(
        "chrom", "start_pos", "end_pos", "name", F.coalesce("positions", zero).alias("positions"), F.coalesce("total", zero).alias("total"),
        F.round(m, 6).alias("mean"), F.coalesce("sd", F.lit(0.0)).alias("sd"), label.alias("quality"),
    )


def gene_rollup(ev: DataFrame, gene: str = "gene", good: int = 10) -> DataFrame:
    """Per gene: variants at good and at low coverage, and the status that follows."""
    seen = F.col("alt_support") > 0
    out = ev.groupBy(gene).agg(F.count_if(seen & (F.col("coverage") >= good)).alias("high"), F.count_if(seen & (F.col("coverage") < good)).alias("low"))
    return out.withColumn("status", F.when(F.col("high") > 0, "present_with_good_coverage").when(F.col("low") > 0, "present_but_low_coverage").otherwise("none_detected"))

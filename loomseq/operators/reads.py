"""Alignments and reads: quality gates, supplementary expansion, per-file statistics, sample roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_PRIMARY_QS = 12
MAPQ_OVER, SPAN_OVER = 49, 249


def quality_gate(aln: DataFrame, least: float = MIN_PRIMARY_QS) -> DataFrame:
    """Alignments of reads without a low-quality primary; a missing ``qs`` passes.  Does not depend on file order."""
    low = aln.where(~F.col("is_supplementary") & (F.col("qs") < least)).select("sample", "read_id").distinct()
    return aln.join(low, ["sample", "read_id"], "left_anti")


def well_mapped() -> Column:
    """Mapping quality over 49 and span over 249 (both strict), not on chrM."""
    return (F.col("mapq") > MAPQ_OVER) & (F.col("end_pos") - F.col("start_pos") > SPAN_OVER) & (F.col("chrom") != "chrM")


def supplementary_from_tag(aln: DataFrame, sa: str = "sa") -> DataFrame:
    """One supplementary row per ``chrom,pos,strand,cigar,mapq,nm;`` entry of the tag, filtered like any alignment.

    The end is the position plus the query length in the CIGAR, or plus 100 without one.
    """
    e = aln.select("sample", "read_id", F.explode(F.split(sa, ";")).alias("_e")).where("_e <> ''").withColumn("_p", F.split("_e", ","))
    query = F.aggregate(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MIS=X]"), 1), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    rows = e.select(
        "sample", "read_id", F.get("_p", F.lit(0)).alias("chrom"), F.get("_p", F.lit(1)).try_cast("long").alias("start_pos"),
        F.get("_p", F.lit(2)).alias("strand"), F.get("_p", F.lit(3)).alias("cigar"), F.get("_p", F.lit(4)).try_cast("int").alias("mapq"),
    )
    span = F.when(F.col("cigar").isin("*", "") | F.col("cigar").isNull(), F.lit(100)).otherwise(query)
    return rows.withColumn("end_pos", F.col("start_pos") + span).where(well_mapped()).drop("cigar")


def reads_with_supplementary(aln: DataFrame) -> DataFrame:
    return aln.where("is_supplementary").select("sample", "read_id").distinct()


def primary_and_supplementary(aln: DataFrame) -> DataFrame:
    """Reads that have both kinds of alignment."""
    primary = aln.where(~F.col("is_supplementary")).select("sample", "read_id")
    return primary.intersect(aln.where("is_supplementary").select("sample", "read_id"))


#: The region whose reads are counted by default: chromosome, start, end.  Fixed values.
REGION = ("chr10", 129466536, 129467536)


def file_statistics(aln: DataFrame, region: tuple[str, int, int] = REGION) -> DataFrame:
    """Per file: alignments and bases by pass/fail, supplementary rows, reads with one, region reads, last start.

    Region reads are primary rows that overlap ``region``.
    """
    chrom, first, last = region
    met = (F.col("chrom") == chrom) & (F.col("start_pos") < last) & (F.col("end_pos") > first)
    ok = F.coalesce(F.col("qs") >= MIN_PRIMARY_QS, F.lit(True))
    span = F.col("end_pos") - F.col("start_pos")
    primary = ~F.col("is_supplementary")
    return aln.groupBy("sample", "file_no").agg(
        F.count_if(primary & ok).alias("pass_reads"), F.count_if(primary & ~ok).alias("fail_reads"),
        F.coalesce(F.sum(F.when(primary & ok, span)), F.lit(0)).alias("pass_bases"),
        F.coalesce(F.sum(F.when(primary & ~ok, span)), F.lit(0)).alias("fail_bases"),
        F.sum(F.when(primary, span).otherwise(0)).alias("yield_bases"), F.count_if("is_supplementary").alias("supplementary"),
        F.countDistinct(F.when(F.col("is_supplementary"), F.col("read_id"))).alias("reads_with_supplementary"),
        F.count_if(met & primary).alias("region_reads"), F.max("start_time").alias("last_start"),
    ).withColumn("has_region_reads", F.col("region_reads") > 0)


def mean_or_zero(total: str, n: str) -> Column:
    return F.when(F.col(n) > 0, F.col(total) / F.col(n)).otherwise(0.0)


def sample_rollup(stats: DataFrame) -> DataFrame:
    """Per sample: sums over its files, the files in order, and the last file by start time."""
    return stats.groupBy("sample").agg(
        *[F.sum(c).alias(c) for c in ("pass_reads", "fail_reads", "pass_bases", "fail_bases", "yield_bases", "supplementary")],
        (F.sum("pass_reads") + F.sum("fail_reads")).alias("reads"), F.count("*").alias("files"),
        F.array_join(F.array_sort(F.collect_set("file_no")).cast("array<string>"), ",").alias("file_list"),
        F.max(F.struct("last_start", "file_no"))["file_no"].alias("last_file"),
    )


def sanity_label(reads: Column, mapped: Column) -> Column:
    """What a file's counts say before anything is computed on it."""
    return (
        F.when(reads == 0, "no_reads").when(mapped == 0, "none_mapped")
        .when((reads > 100) & (mapped < 0.01 * reads), "few_mapped").when(reads > 50_000, "too_many").otherwise("ok")
    )


def first_failing_rule() -> Column:
    """The first rule that a fusion candidate fails, in fixed order, or ``valid``.

    The overlap here needs 99 bases or more, one less than the overlap join asks for.
    """
    return (
        F.when(~F.col("has_supplementary"), "no_supplementary").when(~F.col("multi_gene"), "single_gene")
        .when(F.col("mapq") <= MAPQ_OVER, "mapping_quality").when(F.col("span") <= SPAN_OVER, "mapping_span")
        .when(F.col("overlap") < 99, "gene_overlap").when(F.col("support") < 3, "support").otherwise("valid")
    )


def windowed_yield(aln: DataFrame, length: str = "30 days", late: str | None = None) -> DataFrame:
    """Primary reads and bases per sample and tumbling window of start time.

    On a stream, ``late`` sets a watermark: in append mode a window is given once, when the latest start time seen is ``late``
    past its end; rows that come for a window already closed are dropped, so state is kept for open windows only.
    """
    src = aln.where(~F.col("is_supplementary"))
    src = src.withWatermark("start_time", late) if late else src
    return src.groupBy("sample", F.window("start_time", length).alias("w")).agg(
        F.count("*").alias("reads"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases")
    ).select("sample", F.col("w.start").alias("window_start"), "reads", "bases")

"""Queries on sources and sinks, reads, variants, scores, logs, scalar functions and streams."""

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomseq.functions import text as tx
from loomseq.operators import cnv, scores as sc
from loomseq.operators import reads as rd
from loomseq.operators import variants as va
from loomseq.plans.registry import query
from loomseq.sources import tables as src
from loomseq.sources.scratch import new_folder
from loomseq.streaming import batches as ba
from loomseq.streaming import folds
from loomseq.streaming import state as st


def lines(df, *cols):
    return df.select(F.concat_ws("\t", *cols).alias("value"))


@query("S1_alignment_scan", """select sample, chrom, strand, is_supplementary, count(*) as n, sum(end_pos - start_pos)::bigint as bases from @aln group by all""")
def s1(t):
    a = t.aln
    flag = F.when(F.col("is_supplementary"), 0x800).otherwise(0) + F.when(F.col("strand") == "-", 0x10).otherwise(0)
    sam = a.select(F.concat_ws("\t", F.concat_ws(";", "sample", "read_id"), flag, "chrom", F.col("start_pos") + 1, "mapq", F.concat((F.col("end_pos") - F.col("start_pos")).cast("string"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*")).alias("value"))
    p = src.parse_sam(sam).withColumn("sample", F.split("read_id", ";")[0])
    return p.groupBy("sample", "chrom", "strand", "is_supplementary").agg(F.count("*").alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))


@query("S2_sa_expansion", """select sample, chrom, count(*) as n, sum(end_pos - start_pos)::bigint as bases from @aln where is_supplementary and mapq > 49 and end_pos - start_pos > 249 group by all""")
def s2(t):
    entry = F.concat_ws(",", "chrom", "start_pos", "strand", F.concat((F.col("end_pos") - F.col("start_pos")).cast("string"), F.lit("M")), "mapq", F.lit("0"))
    tagged = t.aln.where("is_supplementary").groupBy("sample", "read_id").agg(F.concat(F.array_join(F.collect_list(entry), ";"), F.lit(";")).alias("sa"))
    return rd.supplementary_from_tag(tagged).groupBy("sample", "chrom").agg(F.count("*").alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))


@query("S4_bed_scan", "select chrom, strand, count(*) as n, sum(end_pos)::bigint as ends, min(name) as first_name from @regions group by all")
def s4(t):
    r = t.regions.withColumn("strand", F.when(F.col("strand") == ".", "?").otherwise(F.col("strand")))
    bed = lines(r, "chrom", "start_pos", "end_pos", "name", F.lit("."), "strand").union(t.regions.select(F.lit("# comment")))
    return src.parse_bed(bed).groupBy("chrom", "strand").agg(F.count("*").alias("n"), F.sum("end_pos").alias("ends"), F.min("name").alias("first_name"))


@query("S6_probe_scan", "select substr(chrom, 4) as chrom, count(*) as n, sum(start_pos)::bigint as starts from @probes group by all")
def s6(t):
    rows = t.probes.select(F.concat_ws(" ", "probe_id", "chrom", F.col("start_pos") + 1, F.col("start_pos") + 2).alias("value"))
    return src.parse_probes(rows).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("start_pos").alias("starts"))


def vcf_text(t):
    v = t.vcf.select(F.concat_ws("\t", "chrom", "pos", F.lit("."), "ref", "alt", "qual", "filter_status", "info", F.lit("GT"), F.lit("0/1")).alias("value"))
    return v.union(t.vcf.limit(1).select(F.lit("##fileformat=VCFv4.2")))


@query("S7_vcf_scan", "select chrom, alt, count(*) as n, sum(pos)::bigint as positions, sum(qual)::double as qual from @vcf group by all")
def s7(t):
    return src.parse_vcf(vcf_text(t)).groupBy("chrom", "alt").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"), F.sum("qual").alias("qual"))


@query("S8_clinvar", """select chrom, pos, max(alt) as alt from @vcf where info like '%athogenic%' group by chrom, pos""")
def s8(t):
    v = src.parse_vcf(vcf_text(t)).withColumn("line_no", F.col("alt"))
    return src.clinvar(v).select("chrom", "pos", "alt")


@query("S9_genome_index", "select chrom, length from @lens")
def s9(t):
    return src.parse_index(lines(t.lens, "chrom", "length", F.lit("6"), F.lit("60"), F.lit("61")))


@query("S10_candidate_scan", "select sample, count(*) as n, sum(mapq)::bigint as mapq from @aln where mapq > 49 group by sample")
def s10(t):
    return t.aln.select("sample", "mapq").where("mapq > 49").groupBy("sample").agg(F.count("*").alias("n"), F.sum("mapq").alias("mapq"))


@query("S11_append_sink", "select sample, count(*) as n from @aln group by sample")
def s11(t):
    path = new_folder(t.spark)
    a = t.aln.select("sample", "read_id", "file_no")
    for k in (0, 1, 1):  # the second batch is written twice and counts once
        src.append_batch(a.where(F.col("file_no") % 2 == k), path, k, ["sample"])
    return t.spark.read.parquet(path).groupBy("sample").agg(F.count("*").alias("n"))


@query("S12_bedmethyl_sink", "select chrom, sum(valid_cov)::bigint as cov, count(*) as n from @bedm group by chrom")
def s12(t):
    path = new_folder(t.spark)
    src.write_lines(t.bedm, path, ["chrom", "pos", "mod_code", "strand", "valid_cov", "n_mod"], ["chrom", "pos", "strand", "mod_code", "sample", "batch"])
    p = F.split("value", "\t")
    back = t.spark.read.text(path).select(p[0].alias("chrom"), p[4].cast("long").alias("cov"))
    return back.groupBy("chrom").agg(F.sum("cov").alias("cov"), F.count("*").alias("n"))


@query("S14_latest_version", "select concat(name, '.bed') as stem, concat(name, '_', max(v), '.bed') as path, max(v) as version from (select name, start_pos // 1000 as v from @regions) group by name")
def s14(t):
    return src.latest_version(t.regions.select(F.concat("name", F.lit("_"), F.floor(F.col("start_pos") / 1000).cast("string"), F.lit(".bed")).alias("path")))


@query("S15_report_export", "select 'regions' as name, count(*) as rows from @regions union all select 'genes', count(*) from @genes")
def s15(t):
    return src.export_tables({"regions": t.regions, "genes": t.genes}, new_folder(t.spark)).select("name", "rows")


@query("S16_job_log", "select job_type, count(*) as n from @jobs group by job_type")
def s16(t):
    path = new_folder(t.spark)
    t.jobs.withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    return t.spark.read.parquet(path).groupBy("job_type").agg(F.count("*").alias("n"))


GATED = "gated as (select * from @aln where (sample, read_id) not in (select (sample, read_id) from @aln where not is_supplementary and qs < 12))"


@query("F1_quality_gate", f"with {GATED} select sample, count(*) as n, count(distinct read_id) as n_reads from gated group by sample")
def f1(t):
    return rd.quality_gate(t.aln).groupBy("sample").agg(F.count("*").alias("n"), F.countDistinct("read_id").alias("n_reads"))


@query("F2_mapping_filter", "select sample, chrom, count(*) as n from @aln where mapq > 49 and end_pos - start_pos > 249 and chrom <> 'chrM' group by all")
def f2(t):
    return t.aln.where(rd.well_mapped()).groupBy("sample", "chrom").agg(F.count("*").alias("n"))


@query("F3_has_supplementary", "select sample, count(distinct read_id) as n from @aln where is_supplementary group by sample")
def f3(t):
    return rd.reads_with_supplementary(t.aln).groupBy("sample").agg(F.count("*").alias("n"))


@query("F5_pathogenic", """select regexp_extract(info, 'CLNSIG=([^;]*)', 1) as sig, info ilike '%clnsig=%pathogenic%' as hit, info ilike '%pathogenic%' and info not ilike '%conflicting%' as strict_hit, count(*) as n from @vcf group by all""")
def f5(t):
    i = F.col("info")
    return t.vcf.groupBy(va.info_value(i, "CLNSIG").alias("sig"), va.pathogenic(i).alias("hit"), va.pathogenic(i, strict=True).alias("strict_hit")).agg(F.count("*").alias("n"))


@query("F6_clinvar_pathogenic", """select case when pos % 4 = 0 then pos % 3 = 0 else info ilike '%pathogenic%' end as hit, count(*) as n from @vcf group by all""")
def f6(t):
    sig = F.when(F.col("pos") % 4 != 0, va.info_value(F.col("info"), "CLNSIG"))
    onc = F.when(F.col("pos") % 3 == 0, F.lit("Oncogenic"))
    return t.vcf.groupBy(va.clinvar_pathogenic(sig, onc).alias("hit")).agg(F.count("*").alias("n"))


@query("F7_variant_filter", "select chrom, count(*) as n from @vcf where filter_status = 'PASS' and info ilike '%pathogenic%' and qual >= 20 and qual * 2 >= 50 group by chrom")
def f7(t):
    return va.variant_filter(t.vcf, only_pathogenic=True, min_qual=20, min_depth=50).groupBy("chrom").agg(F.count("*").alias("n"))


@query("F8_chromosome_whitelist", "select count(*) as n from @aln where regexp_full_match(chrom, 'chr([0-9]+|X|Y)')")
def f8(t):
    return t.aln.where(F.col("chrom").rlike("^chr([0-9]+|X|Y)$")).agg(F.count("*").alias("n"))


@query("F9_bed_validation", """select p_partkey as line_no, 'bad interval' as error from part where p_partkey % 5 = 0 order by p_partkey limit 10""")
def f9(t):
    bed = t.table("part").select(F.col("p_partkey").alias("line_no"), F.concat_ws("\t", F.lit("chr1"), F.when(F.col("p_partkey") % 5 == 0, 500).otherwise(100), F.lit(400), F.lit("g"), F.lit("0"), F.lit("+")).alias("value"))
    return src.bed_errors(bed)


FILES = "f as (select sample, file_no, count(*) as reads, count(*) filter (mapq > 45) as mapped from @aln group by all)"


@query("F10_sanity_label", f"""with {FILES} select sample, file_no, case when reads = 0 then 'no_reads' when mapped = 0 then 'none_mapped' when reads > 100 and mapped < 0.01 * reads then 'few_mapped' when reads > 50000 then 'too_many' else 'ok' end as label from f""")
def f10(t):
    f = t.aln.groupBy("sample", "file_no").agg(F.count("*").alias("reads"), F.count_if(F.col("mapq") > 45).alias("mapped"))
    return f.select("sample", "file_no", rd.sanity_label(F.col("reads"), F.col("mapped")).alias("label"))


@query("F12_report_layout", "select read_id as \"Read\", chrom as \"Chromosome\", start_pos as \"Start\", end_pos as \"End\" from @aln where mapq = 60")
def f12(t):
    return t.aln.where("mapq = 60").select("read_id", "chrom", "start_pos", "end_pos").withColumnsRenamed({"read_id": "Read", "chrom": "Chromosome", "start_pos": "Start", "end_pos": "End"}).orderBy("Chromosome", "Start")


@query("F15_read_lookup", """select is_supplementary as is_supp, count(*) as n from @aln where read_id in (select concat('r', o_orderkey) from orders where o_orderkey % 100 = 0) group by all""")
def f15(t):
    want = t.table("orders").where("o_orderkey % 100 = 0").select(F.concat(F.lit("r"), F.col("o_orderkey")).alias("read_id")).distinct()
    return t.aln.join(want, "read_id", "left_semi").groupBy(F.col("is_supplementary").alias("is_supp")).agg(F.count("*").alias("n"))


@query("F16_sample_table", """with r as (select sample, ts, event_id, case when event_id % 2 = 0 then 'Live' else 'Done' end as status, event_id % 3 as jobs, row_number() over (partition by sample order by ts desc, event_id desc) as k from @scores),
    n as (select sample, case when status = 'Live' and jobs = 0 then 'Complete' else status end as status, jobs from r where k = 1)
    select sample, status, jobs from n""")
def f16(t):
    return newest(t).select("sample", "status", "jobs")


def newest(t):
    s = t.scores.withColumns({"status": F.when(F.col("event_id") % 2 == 0, "Live").otherwise("Done"), "jobs": F.col("event_id") % 3})
    return sc.newest_samples(s, "ts", 3600, F.lit("2200-01-01").cast("timestamp"))


@query("F16_filtered_samples", """with r as (select sample, event_id, row_number() over (partition by sample, classifier order by ts desc, event_id desc) as k, classifier from @scores),
    n as (select sample || classifier as sample, case when event_id % 2 = 0 then 'Live' else 'Done' end as status, event_id % 3 as jobs from r where k = 1), j as (select sample_id || job_type as sample, string_agg(distinct status, ', ' order by status) as job_types from @jobs where event_id % 7 = 0 group by 1)
    select n.sample, case when n.status = 'Live' and jobs = 0 then 'Complete' else n.status end as status, jobs, job_types from n join j using (sample)
    where (n.status <> 'Live' or jobs <> 0) and n.status = 'Done' and list_contains([trim(x) for x in string_split(job_types, ',')], 'completed') and (contains(lower(n.sample), '1') or contains(jobs::varchar, '1') or contains(lower(job_types), '1'))""")
def f16b(t):
    s = t.scores.withColumns({"sample": F.concat("sample", "classifier"), "status": F.when(F.col("event_id") % 2 == 0, "Live").otherwise("Done"), "jobs": F.col("event_id") % 3})
    last = sc.newest_samples(s, "ts", 3600, F.lit("2200-01-01").cast("timestamp"))
    types = t.jobs.where("event_id % 7 = 0").groupBy(F.concat("sample_id", "job_type").alias("sample")).agg(F.array_join(F.array_sort(F.collect_set("status")), ", ").alias("job_types"))
    return sc.filter_samples(last.join(types, "sample"), "Done", "completed", "1").select("sample", "status", "jobs", "job_types")


@query("F17_missing_step", """select sample from (select distinct sample from @scores where class = 'C1') where sample in (select distinct sample from @aln) and sample not in (select sample from @scores where class = 'C2' and sample = 'S1')""")
def f17(t):
    s = t.scores
    ready = s.where("class = 'C1'").select("sample").distinct().join(t.aln.select("sample").distinct(), "sample", "left_semi")
    return ready.join(s.where("class = 'C2' and sample = 'S1'").select("sample").distinct(), "sample", "left_anti")


STATS = """st as (select sample, file_no, count(*) filter (not is_supplementary and qs >= 12) as pass_reads, count(*) filter (not is_supplementary and qs < 12) as fail_reads,
    coalesce(sum(end_pos - start_pos) filter (not is_supplementary and qs >= 12), 0)::bigint as pass_bases, coalesce(sum(end_pos - start_pos) filter (not is_supplementary and qs < 12), 0)::bigint as fail_bases,
    coalesce(sum(end_pos - start_pos) filter (not is_supplementary), 0)::bigint as yield_bases, count(*) filter (is_supplementary) as supplementary, count(distinct read_id) filter (is_supplementary) as reads_with_supplementary,
    count(*) filter (chrom = 'chr10' and start_pos < 600000 and end_pos > 400000 and not is_supplementary) as region_reads, max(start_time) as last_start from @aln group by sample, file_no)"""


@query("A1_file_statistics", f"with {STATS} select * exclude (last_start), region_reads > 0 as has_region_reads, epoch(last_start)::bigint as last_start from st")
def a1(t):
    return rd.file_statistics(t.aln, ("chr10", 400000, 600000)).withColumn("last_start", F.unix_timestamp("last_start"))


@query("A2_means", f"with {STATS} select sample, file_no, round(case when pass_reads > 0 then pass_bases / pass_reads else 0 end, 6) as mean_pass, round(case when fail_reads > 0 then fail_bases / fail_reads else 0 end, 6) as mean_fail from st")
def a2(t):
    s = rd.file_statistics(t.aln)
    return s.select("sample", "file_no", F.round(rd.mean_or_zero("pass_bases", "pass_reads"), 6).alias("mean_pass"), F.round(rd.mean_or_zero("fail_bases", "fail_reads"), 6).alias("mean_fail"))


@query("A3_sample_rollup", f"""with {STATS} select sample, sum(pass_reads)::bigint as pass_reads, sum(fail_reads)::bigint as fail_reads, sum(pass_bases)::bigint as pass_bases, sum(fail_bases)::bigint as fail_bases, sum(yield_bases)::bigint as yield_bases,
    sum(supplementary)::bigint as supplementary, (sum(pass_reads) + sum(fail_reads))::bigint as reads, count(*) as files, string_agg(file_no::varchar, ',' order by file_no) as file_list, arg_max(file_no, (last_start, file_no)) as last_file from st group by sample""")
def a3(t):
    return rd.sample_rollup(rd.file_statistics(t.aln))


@query("A35_grouped_variants", "select chrom, pos, string_agg(distinct alt, ', ' order by alt) as alt, string_agg(distinct qual::varchar, ', ' order by qual::varchar) as qual from @vcf group by chrom, pos")
def a35(t):
    return va.grouped(t.vcf, ["chrom", "pos"], ["alt", "qual"])


@query("A36_variant_summary", """select count(*) as variants, count(*) filter (filter_status = 'PASS') as passed, count(*) filter (info ilike '%pathogenic%') as pathogenic,
    count(distinct regexp_extract(info, 'GENEINFO=([^:;]*)', 1)) filter (info ilike '%pathogenic%') as genes, count(distinct (chrom, pos)) filter (info ilike '%pathogenic%') as places from @vcf""")
def a36(t):
    return va.summary(t.vcf)


PILE = """b as (select chrom, pos, count(*) filter (base = 'A') as "A", count(*) filter (base = 'C') as "C", count(*) filter (base = 'G') as "G", count(*) filter (base = 'T') as "T", count(*) filter (base = 'N') as "N",
    count(*) filter (base = '-') as indel, round(avg(qual), 6) as mean_qual, list_sort(list(distinct read_id))[1:10] as reads from @pile group by chrom, pos),
    pc as (select *, "A" + "C" + "G" + "T" + "N" as coverage, case when greatest("A", "C", "G", "T") = 0 then null when "A" = greatest("A", "C", "G", "T") then 'A' when "C" = greatest("A", "C", "G", "T") then 'C' when "G" = greatest("A", "C", "G", "T") then 'G' else 'T' end as major from b)"""
EVID = """e0 as (select v.chrom, v.pos, v.ref, v.alt, coverage, len(v.ref) <> len(v.alt) as is_indel, len(v.ref) < len(v.alt) as ins, coalesce(major, 'N') = v.ref[1] as meets, upper(case when len(v.ref) < len(v.alt) then v.ref[1] else v.ref end) as rb, upper(v.alt) as ab, "A", "C", "G", "T" from @vcf2 v join pc using (chrom, pos)),
    e1 as (select *, case when is_indel and not (ins and meets) then 0 when rb = 'A' then "A" when rb = 'C' then "C" when rb = 'G' then "G" when rb = 'T' then "T" else 0 end as ref_support,
    case when is_indel then 0 when ab = 'A' then "A" when ab = 'C' then "C" when ab = 'G' then "G" when ab = 'T' then "T" else 0 end as alt_support from e0),
    e2 as (select *, case when coverage > 0 and not is_indel then alt_support / coverage else 0 end as x from e1),
    ev as (select chrom, pos, ref, alt, coverage, ref_support, alt_support, round(x, 6) as vaf, is_indel,
    case when is_indel and not ins then 'indel_requires_review' when is_indel and not meets then 'reference_mismatch' when is_indel then 'insertion_requires_review' when alt_support = 0 then 'no_support' when alt_support < 3 then 'low_support' when x < 0.1 then 'low_frequency' when x < 0.3 then 'medium_frequency' else 'high_frequency' end as level,
    case when is_indel then 'indel_requires_review' when coverage = 0 then 'unknown' when x > 0.8 then 'homozygous' when x > 0.2 then 'heterozygous' else 'low_frequency' end as zygosity from e2)"""


@query("A37_pileup", f"with {PILE} select * replace (array_to_string(reads, ',') as reads) from pc")
def a37(t):
    return va.pileup_counts(t.pile).withColumn("reads", F.array_join("reads", ","))


@query("A38_evidence", f"with {PILE}, {EVID} select * from ev")
def a38(t):
    return va.evidence(t.vcf2, va.pileup_counts(t.pile))


@query("J18_pileup_variants", f"with {PILE} select v.chrom, count(*) as n, sum(coverage)::bigint as coverage from @vcf v join pc using (chrom, pos) group by v.chrom")
def j18(t):
    return t.vcf.join(va.pileup_counts(t.pile), ["chrom", "pos"]).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("coverage").alias("coverage"))


@query("A39_region_quality", f"""with {PILE}, rg as (select distinct chrom, start_pos, end_pos, name from @regions),
    s as (select rg.chrom, start_pos, end_pos, name, count(coverage) as positions, coalesce(sum(coverage), 0)::bigint as total, coalesce(avg(coverage), 0) as m, round(coalesce(stddev_pop(coverage), 0), 6) as sd from rg left join pc on pc.chrom = rg.chrom and pc.pos between start_pos and end_pos group by all)
    select chrom, start_pos, end_pos, name, positions, total, round(m, 6) as mean, sd, case when m >= 30 and end_pos - start_pos >= 1000 then 'high' when m >= 10 and end_pos - start_pos >= 500 then 'medium' else 'low' end as quality from s""")
def a39(t):
    return va.region_quality(va.pileup_counts(t.pile), t.regions)


@query("A42_gene_rollup", f"""with {PILE}, {EVID}, g as (select *, concat('G', pos % 8) as gene from ev), r as (select gene, count(*) filter (alt_support > 0 and coverage >= 10) as high, count(*) filter (alt_support > 0 and coverage < 10) as low from g group by gene)
    select *, case when high > 0 then 'present_with_good_coverage' when low > 0 then 'present_but_low_coverage' else 'none_detected' end as status from r""")
def a42(t):
    ev = va.evidence(t.vcf2, va.pileup_counts(t.pile)).withColumn("gene", F.concat(F.lit("G"), (F.col("pos") % 8).cast("string")))
    return va.gene_rollup(ev)


@query("A43_job_overview", """select sample_id, count(*) as total, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'running') as active,
    count(*) filter (status = 'queued') as pending, string_agg(distinct job_type, ',' order by job_type) as types from @jobs group by sample_id""")
def a43(t):
    return sc.job_overview(t.jobs).withColumn("types", F.array_join("types", ","))


TREE = "concat('SF', event_id % 2) as superfamily, concat('F', event_id % 4) as family, concat('K', event_id % 8) as class, concat('U', event_id % 16) as subclass"


@query("A40_hierarchy_totals", f"""with l as (select sample, score, {TREE} from (select sample, event_id, score from @scores)), u as (select sample, superfamily as name, 0 as level, score from l union all select sample, family, 1, score from l union all select sample, class, 2, score from l union all select sample, subclass, 3, score from l),
    s as (select sample, name, level, round(sum(score), 6) as score from u group by all), r as (select *, row_number() over (partition by sample, level order by score desc, name) as rank from s) select sample, name, level, round(score, 3) as score, rank::int as rank from r where rank <= 10""")
def a40(t):
    leaves = t.scores.selectExpr("sample", "score", "concat('SF', event_id % 2) as superfamily", "concat('F', event_id % 4) as family", "concat('K', event_id % 8) as class", "concat('U', event_id % 16) as subclass")
    return sc.hierarchy_totals(leaves, ["superfamily", "family", "class", "subclass"]).withColumn("score", F.round("score", 3))


@query("E15_hierarchy_flatten", """select sample, concat('SF', event_id % 2) as superfamily, concat('F', event_id % 4) as family, concat('K', event_id % 8) as class, concat('U', event_id % 16) as subclass, event_id from @scores""")
def e15(t):
    s = t.scores
    name = lambda p, k: F.concat(F.lit(p), (F.col("event_id") % k).cast("string")).alias("group")
    leaf = F.struct(name("U", 16), F.lit(1.0).alias("score"))
    tree = F.array(F.struct(name("SF", 2), F.array(F.struct(name("F", 4), F.array(F.struct(name("K", 8), F.array(leaf).alias("members"))).alias("members"))).alias("members")))
    flat = src.flatten_hierarchy(s.select("sample", "event_id", F.to_json(tree).alias("json")))
    return flat.select("sample", "superfamily", "family", "class", "subclass", "event_id")


@query("T1_top_class", """with n as (select * replace (case event_id % 5 when 0 then 'sturgeon' when 1 then 'nanodx' when 2 then 'pannanodx' when 3 then 'random_forest' else 'other' end as classifier) from @scores),
    l as (select *, row_number() over (partition by sample, classifier order by ts desc, event_id desc, score desc, class) as k from n)
    select sample, classifier, class, score, case when score >= case classifier when 'sturgeon' then 95 when 'nanodx' then 50 when 'pannanodx' then 50 when 'random_forest' then 85 else 80 end then 'High confidence'
    when score >= case classifier when 'sturgeon' then 80 when 'nanodx' then 25 when 'pannanodx' then 25 when 'random_forest' then 65 else 50 end then 'Medium confidence'
    when score >= case when classifier = 'other' then 20 else 0 end then 'Low confidence' else 'Very low confidence' end as label from l where k = 1""")
def t1(t):
    named = t.scores.withColumn("classifier", F.expr("case event_id % 5 when 0 then 'sturgeon' when 1 then 'nanodx' when 2 then 'pannanodx' when 3 then 'random_forest' else 'other' end"))
    return sc.latest_top(named).withColumn("label", sc.confidence_label(F.col("score"), F.col("classifier")))


LAST = "last as (select sample, classifier, class, arg_max(score, (ts, event_id)) as last, max(score) as best from @scores group by all)"


@query("T2_top_history", f"""with {LAST}, r as (select *, row_number() over (partition by sample, classifier order by last desc, class) as k from last) select s.sample, s.classifier, s.class, s.event_id, round(s.score * 100, 4) as percent from @scores s join r using (sample, classifier, class) where k <= 3""")
def t2(t):
    return sc.top_history(t.scores)


@query("T6_plotted_classes", f"""with {LAST}, r as (select *, row_number() over (partition by sample, classifier order by last desc, class) as k from last where best > 0.05) select sample, classifier, class, best, last from r where k <= 3""")
def t6(t):
    return sc.plotted_classes(t.scores)


@query("T4_mixed_sort", """select sample, chrom, n, row_number() over (order by n desc, chrom, sample) as place from (select sample, chrom, count(*) as n from @aln group by all)""")
def t4(t):
    from pyspark.sql import Window

    c = t.aln.groupBy("sample", "chrom").agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "chrom", "sample")))


@query("T5_first_reads", "select sample, chrom, array_to_string(list_sort(list(distinct read_id))[1:10], ',') as reads from @aln group by all")
def t5(t):
    place = F.row_number().over(Window.partitionBy("sample", "chrom").orderBy("read_id"))
    first = t.aln.select("sample", "chrom", "read_id").distinct().withColumn("_r", place).where(F.col("_r") <= 10)
    return first.groupBy("sample", "chrom").agg(F.array_join(F.array_sort(F.collect_list("read_id")), ",").alias("reads"))


@query("W9_rolling_median", """with r as (select job_type, event_id, duration_seconds, row_number() over (partition by job_type order by ts, event_id) as r, greatest(10, count(*) over (partition by job_type) // 20) as k from @jobs)
    select a.job_type, a.event_id, median(b.duration_seconds) as median, count(*) as n from r a join r b on a.job_type = b.job_type and b.r between a.r - a.k + 1 and a.r group by all having count(*) >= 5""")
def w9(t):
    return sc.rolling_median(t.jobs)


@query("E1_read_group", "select concat('run', o_custkey) as run, concat('m', o_orderkey % 3) as model, count(*) as n from orders group by all")
def e1(t):
    ds = F.concat(F.lit("runid=run"), F.col("o_custkey").cast("string"), F.lit(" basecall_model=m"), (F.col("o_orderkey") % 3).cast("string"))
    return t.table("orders").groupBy(tx.run_id(ds).alias("run"), tx.basecall_model(ds).alias("model")).agg(F.count("*").alias("n"))


@query("E2_sample_id", """select case when p_size % 3 = 0 then concat('lib', p_size) when p_size % 3 = 1 then concat('run', p_size) else concat('f_barcode', p_size) end || case when p_size % 3 < 2 then concat('_barcode', lpad(p_size::varchar, 2, '0')) else '' end as id, count(*) as n from part group by all""")
def e2(t):
    p = t.table("part")
    s = F.col("p_size").cast("string")
    lib, run = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("lib"), s)), F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("run"), s))
    return p.groupBy(tx.sample_id(lib, run, F.concat(F.lit("/data/f_barcode"), s, F.lit(".bam"))).alias("id")).agg(F.count("*").alias("n"))


@query("E3_file_kind", "select case o_orderkey % 3 when 0 then 'pass' when 1 then 'fail' else 'unknown' end as kind, count(*) as n from orders group by all")
def e3(t):
    path = F.concat(F.lit("/run/"), F.when(F.col("o_orderkey") % 3 == 0, "bam_pass/").when(F.col("o_orderkey") % 3 == 1, "bam_fail/").otherwise("bam/"), F.col("o_orderkey").cast("string"), F.lit(".bam"))
    return t.table("orders").groupBy(tx.file_kind(path).alias("kind")).agg(F.count("*").alias("n"))


@query("E4_info_map", "select regexp_extract(info, 'GENEINFO=([^;]*)', 1) as gene, sum(qual * 2)::bigint as depth, count(*) as n from @vcf group by all")
def e4(t):
    m = t.vcf.withColumn("m", va.info_map(F.col("info")))
    return m.groupBy(F.col("m")["GENEINFO"].alias("gene")).agg(F.sum(F.col("m")["DP"].cast("long")).alias("depth"), F.count("*").alias("n"))


@query("E5_disease_name", "select case p_size % 2 when 0 then 'Tumour of the Brain' else 'Cancer in Lung' end as name, count(*) as n from part group by all")
def e5(t):
    return t.table("part").groupBy(tx.disease_name(F.when(F.col("p_size") % 2 == 0, F.lit("tumour_of_the_brain")).otherwise(F.lit("cancer_in|lung"))).alias("name")).agg(F.count("*").alias("n"))


@query("E6_overlap_share", "select name, round(sum(case when end_pos > start_pos then greatest(0, least(end_pos, start_pos + 9000) - greatest(start_pos, start_pos + 3000)) / least(end_pos - start_pos, 6000) else 0 end), 6) as share from @regions group by name")
def e6(t):
    s, e = F.col("start_pos"), F.col("end_pos")
    return t.regions.groupBy("name").agg(F.round(F.sum(tx.overlap_share(s, e, s + 3000, s + 9000)), 6).alias("share"))


@query("E7_proximity", "select name, count(*) filter (least(abs(start_pos - 500000), abs(start_pos - 510000), abs(end_pos - 500000), abs(end_pos - 510000)) <= 50000) as n from @regions group by name")
def e7(t):
    near = tx.close(F.col("start_pos"), F.col("end_pos"), F.lit(500_000), F.lit(510_000), 50_000)
    return t.regions.groupBy("name").agg(F.count_if(near).alias("n"))


@query("E8_elapsed", "select sample, (epoch(max(start_time)) - epoch(min(start_time)))::bigint as seconds from @aln group by sample")
def e8(t):
    ms = (F.unix_timestamp("start_time") * 1000).alias("ms")
    back = t.aln.select("sample", F.timestamp_millis(ms).alias("ts"))
    return back.groupBy("sample").agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))


@query("E9_short_names", "select substr(chrom, 4) as chrom, count(*) as n from @aln group by all")
def e9(t):
    return t.aln.groupBy(tx.short_chrom(F.col("chrom")).alias("chrom")).agg(F.count("*").alias("n"))


@query("E12_softmax", """with m as (select concat('S', o_orderkey % 50) as sample, o_orderkey as member, [(o_orderkey % 7)::double, (o_orderkey % 11)::double, (o_orderkey % 13)::double] as z, case when o_orderkey % 2 = 0 then 2.0 end::double as t from (select distinct o_orderkey from orders)),
    e as (select *, [exp((x - list_max(z)) / coalesce(t, 1.0)) for x in z] as e from m), p as (select *, [x / list_sum(e) for x in e] as p from e),
    r as (select *, row_number() over (partition by sample order by list_max(p) desc, member) as k from p) select sample, member, round(list_max(p), 6) as best from r where k = 1""")
def e12(t):
    o = t.table("orders").select("o_orderkey").distinct()
    z = F.array(*[(F.col("o_orderkey") % k).cast("double") for k in (7, 11, 13)])
    m = o.select(F.concat(F.lit("S"), (F.col("o_orderkey") % 50).cast("string")).alias("sample"), F.col("o_orderkey").alias("member"), sc.softmax(z, F.when(F.col("o_orderkey") % 2 == 0, 2.0)).alias("p"))
    return sc.best_member(m).select("sample", "member", F.round(F.array_max("p"), 6).alias("best"))


@query("E13_file_key", "select o_orderstatus, min(sha256(concat_ws('|', concat('/d/', o_orderkey), o_custkey::varchar, '7'))) as low, count(*) as n from orders group by all")
def e13(t):
    k = sc.file_key(F.concat(F.lit("/d/"), F.col("o_orderkey").cast("string")), F.col("o_custkey"), F.lit(7))
    return t.table("orders").groupBy("o_orderstatus").agg(F.min(k).alias("low"), F.count("*").alias("n"))


@query("E14_stage_bits", "select sample_id, bit_or(case status when 'completed' then 1 when 'failed' then 2 else 0 end)::bigint as bits from @jobs group by sample_id")
def e14(t):
    b = sc.stage_bits(F.array("status"), ["completed", "failed"])
    return t.jobs.groupBy("sample_id").agg(F.bit_or(b).alias("bits"))


@query("E17_methylation_status", "select case when l_linenumber = 1 then 'Known' when l_discount > 0.1 then 'Methylated' else 'Unmethylated' end as status, count(*) as n from lineitem group by all")
def e17(t):
    return t.table("lineitem").groupBy(tx.methylation_status(F.when(F.col("l_linenumber") == 1, "Known"), F.col("l_discount")).alias("status")).agg(F.count("*").alias("n"))


def arriving(t, parts, fold, every=8):
    """Folder to which ``parts`` came one after the other, each folded by a run over what is new."""
    base = new_folder(t.spark)
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        stream = folds.folder_stream(t.spark, f"{base}/in", part.schema, files_per_batch=1_000_000)
        st.run_fold(stream, base, fold, every).awaitTermination()
    return base


@query("R1_file_source", "select sample, count(*) as n from @aln where file_no % 3 <> 2 group by sample")
def r1(t):
    base = new_folder(t.spark)
    a = t.aln.select("sample", "file_no", "read_id")
    for k, name in enumerate(("pass", "fail", "skipped")):
        a.where(F.col("file_no") % 3 == k).write.parquet(f"{base}/in/{name}")
    stream = folds.folder_stream(t.spark, f"{base}/in", a.schema, ignore="/skipped/", recursive=True).withColumn("n", F.lit(1))
    fold = st.summed(["sample"], ["n"], stream.schema)
    st.run_fold(stream, base, fold).awaitTermination()
    return st.DeltaState(t.spark, f"{base}/state", fold).rows()


@query("R2_micro_batches", """with g as (select sample_id, job_type, ts, event_id, case when epoch(ts) - epoch(lag(ts) over w) > 600 then 1 else 0 end as fresh from @jobs window w as (partition by sample_id, job_type order by ts, event_id)),
    r as (select *, sum(fresh) over (partition by sample_id, job_type order by ts, event_id rows unbounded preceding) as run from g),
    p as (select *, (row_number() over (partition by sample_id, job_type, run order by ts, event_id) - 1) // (case job_type when 'view' then 5 else 2 end) as k from r)
    select sample_id, job_type, count(*) as jobs, count(distinct (run, k)) as batches from p group by all""")
def r2(t):
    cap = F.when(F.col("job_type") == "view", 5).otherwise(2)
    b = folds.micro_batches(t.jobs, ["sample_id", "job_type"], ["ts", "event_id"], "ts", cap, idle=600)
    return b.groupBy("sample_id", "job_type").agg(F.count("*").alias("jobs"), F.max("batch").cast("long").alias("batches"))


@query("R3_claim_once", "select file_no % 3 as v, sample, count(distinct file_no) as files from @aln group by all")
def r3(t):
    files = t.aln.select("sample", F.col("file_no").cast("long").alias("file_no"), F.concat_ws(":", "sample", "file_no").alias("file_key"))
    # files that came before come again with each later part
    base = arriving(t, [files.where(F.col("file_no") % 3 <= k) for k in range(3)], st.claims("file_key", files.schema), every=2)
    return folds.emitted(t.spark, base).groupBy(F.col("v").cast("long").alias("v"), "sample").agg(F.count("*").alias("files"))


STAGED = """c as (select sample, ts % 3 as b, count(distinct ts) as f, max(ts) as ts, sum(reads)::bigint as reads from @tcov group by all),
    p as (select sample, max(f) filter (b = 0) as f0, max(f) filter (b = 1) as f1, max(f) filter (b = 2) as f2, max(ts) filter (b = 0) as t0, max(ts) filter (b = 1) as t1, max(ts) filter (b = 2) as t2,
    max(reads) filter (b = 0) as r0, max(reads) filter (b = 1) as r1, max(reads) filter (b = 2) as r2 from c group by sample),
    w as (select *, case when f0 >= 10 then 0 else f0 end as w0 from p), x as (select *, case when w0 + f1 >= 10 then 0 else w0 + f1 end as w1 from w), y as (select *, case when w1 + f2 >= 10 then 0 else w1 + f2 end as w2 from x),
    pts as (select sample, 0 as v, t0 as ts, r0 as reads from y where f0 >= 10 union all select sample, 1, case when w0 > 0 then greatest(t0, t1) else t1 end, r0 + r1 from y where w0 + f1 >= 10
    union all select sample, 2, case when w1 = 0 then t2 when w0 = 0 then greatest(t1, t2) else greatest(t0, t1, t2) end, r0 + r1 + r2 from y where w1 + f2 >= 10),
    fl as (select sample, 3 as v, case when w1 = 0 then t2 when w0 = 0 then greatest(t1, t2) else greatest(t0, t1, t2) end as ts, r0 + r1 + r2 as reads from y where w2 > 0)"""


def staged_points(t):
    c = t.tcov.select("sample", "gene", F.col("ts").cast("long").alias("ts"), F.col("reads").cast("long").alias("reads"))
    return arriving(t, [c.where(F.col("ts") % 3 == k) for k in range(3)], st.staged(["sample", "gene"], ["reads"], "ts", c.schema)), c.schema


@query("R4_staged_accumulation", f"with {STAGED} select sample, v::bigint as v, ts, reads from pts")
def r4(t):
    base, _ = staged_points(t)
    return folds.emitted(t.spark, base).select("sample", F.col("v").cast("long").alias("v"), "ts", "reads")


@query("R8_flush", f"with {STAGED} select sample, v::bigint as v, ts, reads from pts union all select sample, v, ts, reads from fl")
def r8(t):
    base, shape = staged_points(t)
    force = st.staged(["sample", "gene"], ["reads"], "ts", shape, force=True)
    for _ in range(2):  # the second flush finds nothing held and emits nothing
        folds.end_of_run(t.spark, base, shape, force).awaitTermination()
    return folds.emitted(t.spark, base).select("sample", F.col("v").cast("long").alias("v"), "ts", "reads")


@query("R5_tag_support", """with t1 as (select read_id, string_agg(distinct chrom, ',' order by chrom) as tag from @aln where chrom < 'chr2' group by read_id), e1 as (select read_id, tag from t1 where tag in (select tag from t1 group by tag having count(*) >= 3)),
    t2 as (select read_id, string_agg(distinct chrom, ',' order by chrom) as tag from @aln group by read_id), e2 as (select read_id, tag from t2 where tag in (select tag from t2 group by tag having count(*) >= 3) and read_id not in (select read_id from e1))
    select 0::bigint as v, tag, count(*) as reads from e1 group by tag union all select 1, tag, count(*) from e2 group by tag""")
def r5(t):
    pairs = t.aln.select("read_id", "chrom")  # as they arrive; the fold takes a read's names together
    early = F.col("chrom") < "chr2"
    base = arriving(t, [pairs.where(early), pairs.where(~early)], st.grown_tags("read_id", "chrom"))
    return folds.emitted(t.spark, base).groupBy(F.col("v").cast("long").alias("v"), "tag").agg(F.count("*").alias("reads"))


@query("R7_score_history", "select sample, classifier, count(*) as n from @scores group by all")
def r7(t):
    base = new_folder(t.spark)
    rows = t.scores.select("sample", "classifier", "ts", "class", "score", "event_id")
    for k in (0, 1):
        rows.where(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{base}/in")
        stream = folds.folder_stream(t.spark, f"{base}/in", rows.schema, files_per_batch=1_000_000)
        sink = lambda batch, number: src.append_batch(batch.drop("event_id"), f"{base}/history", number, ["sample"])
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/history").groupBy("sample", "classifier").agg(F.count("*").alias("n"))


@query("R9_windowed_yield", """select sample, (floor(epoch(start_time) / 2592000) * 2592000)::bigint as window_start, count(*) as reads, sum(end_pos - start_pos)::bigint as bases from @aln where not is_supplementary group by all""")
def r9(t):
    return rd.windowed_yield(t.aln).withColumn("window_start", F.unix_timestamp("window_start"))


@query("R2_batch_stream", """with j as (select sample_id, job_type, event_id % 2 as part, case job_type when 'view' then 50 else 20 end as cap, event_id % 97 = 0 as alone from @jobs),
    p as (select sample_id, job_type, part, any_value(cap) as cap, count(*) filter (alone) as one, count(*) filter (not alone) as n from j group by sample_id, job_type, part)
    select sample_id, job_type, sum(one + n)::bigint as jobs, sum(one)::bigint as alone, sum(n // cap)::bigint as by_cap, sum(case when n % cap > 0 then 1 else 0 end)::bigint as by_idle from p group by all""")
def r2_stream(t):
    base, rows = new_folder(t.spark), t.jobs.select("sample_id", "job_type", "ts", "event_id")
    cap = F.when(F.col("job_type") == "view", 50).otherwise(20)
    part = [rows.where(F.col("event_id") % 2 == k) for k in (0, 1)]
    part[0].coalesce(1).write.parquet(f"{base}/in")
    stream = folds.folder_stream(t.spark, f"{base}/in", rows.schema, files_per_batch=1_000)
    jobs = ba.job_batches(stream, ["sample_id", "job_type"], "event_id", "ts", cap, alone=F.col("event_id") % 97 == 0)
    query = folds.sink_versions(jobs, base, every="500 milliseconds")
    try:  # the second part comes when the first one's last batches are closed
        folds.await_rows(query, t.spark, base, part[0].count())
        part[1].coalesce(1).write.mode("append").parquet(f"{base}/in")
        folds.await_rows(query, t.spark, base, rows.count())
    finally:
        query.stop()
    got = folds.emitted(t.spark, base)
    closed = lambda by: F.countDistinct(F.when(F.col("closed_by") == by, F.col("batch")))
    return got.groupBy("sample_id", "job_type").agg(F.count("*").alias("jobs"), closed("alone").alias("alone"), closed("cap").alias("by_cap"), closed("idle").alias("by_idle"))


@query("R9_event_time", """with p as (select *, year(start_time) - 1990 + case when file_no % 5 = 0 then 2 else 0 end as part, (floor(epoch(start_time) / 2592000) * 2592000)::bigint as w from @aln where not is_supplementary),
    m as (select part, max(epoch(start_time)) as top from p group by part), u as (select part, max(top) over (order by part rows between unbounded preceding and 1 preceding) - 5184000 as mark from m),
    k as (select p.* from p join u using (part) where mark is null or w + 2592000 > mark), e as (select max(top) - 5184000 as mark from m)
    select sample, w as window_start, count(*) as reads, sum(end_pos - start_pos)::bigint as bases from k, e where w + 2592000 <= e.mark group by all""")
def r9_stream(t):
    base = new_folder(t.spark)
    rows = t.aln.withColumn("start_time", F.col("start_time").cast("timestamp"))
    rows = rows.select("sample", "start_pos", "end_pos", "is_supplementary", "start_time", (F.year("start_time") - 1990 + F.when(F.col("file_no") % 5 == 0, 2).otherwise(0)).alias("part"))
    for k in sorted(r["part"] for r in rows.select("part").distinct().collect()):  # parts are years of a run
        rows.where(F.col("part") == k).write.mode("append").parquet(f"{base}/in")
        stream = folds.folder_stream(t.spark, f"{base}/in", rows.schema, files_per_batch=1_000_000)
        folds.sink_versions(rd.windowed_yield(stream, "30 days", "60 days"), base).awaitTermination()
    return folds.emitted(t.spark, base).select("sample", F.unix_timestamp("window_start").alias("window_start"), "reads", "bases")


@query("X2_score_batches", "select sample, count(*) as probes, round(sum(percent_modified) / count(*), 4) as score from @bedm group by sample")
def x2(t):
    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sample": [pdf["sample"].iloc[0]], "probes": [int(pdf["probes"].sum())], "score": [round(float(pdf["total"].sum() / pdf["probes"].sum()), 4)]})

    small = t.bedm.groupBy("sample", "chrom").agg(F.count("*").alias("probes"), F.sum("percent_modified").alias("total"))
    return sc.score_batches(small, model, "sample string, probes long, score double")


PIPELINES = {"coverage": lambda t: t.tcov.groupBy("sample").agg(F.sum("reads").alias("n")), "cnv": lambda t: cnv.runs(t.cnv).groupBy("sample").agg(F.count("*").alias("n"))}


@query("X3_pipeline_registry", """with s as (select *, case when value > 0.5 then 1 when value < -0.5 then -1 end as sign from @cnv), r as (select *, bin - row_number() over (partition by sample, chrom, sign order by bin) as i from s where sign is not null),
    g as (select sample, chrom, sign, i from r group by all) select 'coverage' as pipeline, sample, sum(reads)::bigint as n from @tcov group by sample union all select 'cnv', sample, count(*) from g group by sample""")
def x3(t):
    out = None
    for name, run in PIPELINES.items():
        one = run(t).withColumn("pipeline", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out

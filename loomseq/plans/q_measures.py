"""Queries on coverage, methylation and copy number."""

from pyspark.sql import functions as F

from loomseq.functions import text as tx
from loomseq.operators import cnv
from loomseq.operators import coverage as cov
from loomseq.operators import methylation as me
from loomseq.operators.intervals import points_in
from loomseq.plans.registry import query
from loomseq.sources import tables as src

BEST = "best as (select sample, chrom, pos, strand, read_id, mod_code, max(prob) as prob from @modcalls group by all)"
SEXES = """sm as (select sample, round(avg(value) filter (chrom = 'chrX' and value <> 0), 6) as x_mean, round(avg(value) filter (chrom = 'chrY' and value <> 0), 6) as y_mean from @cnvx group by sample),
    sx as (select *, case when x_mean is null or y_mean is null then 'Unknown' when x_mean >= 0.1 and y_mean <= -0.1 then 'Female' when x_mean <= 0.1 and y_mean >= -0.2 then 'Male'
    when x_mean >= 0.1 and y_mean >= -0.1 then 'Male (query X/Y copy number changes)' when x_mean > 0.1 and y_mean > 0.1 then 'Male (query X/Y copy number changes)'
    when x_mean < 0.1 and y_mean < -0.2 then 'Unknown (Query XY copy number changes)' else 'Unknown' end as sex from sm),
    lim as (select sample, chrom, upper(sex) in ('XY', 'MALE') as male,
    case chrom when 'chrX' then case when upper(sex) in ('XY', 'MALE') then 0.3 else 0.75 end when 'chrY' then case when upper(sex) in ('XY', 'MALE') then 0.5 else 0.2 end else 0.4 end as up,
    case chrom when 'chrX' then case when upper(sex) in ('XY', 'MALE') then -0.3 else -0.75 end when 'chrY' then case when upper(sex) in ('XY', 'MALE') then -0.5 else -1.0 end else -0.4 end as down
    from (select distinct sample, chrom from @cnvx) join sx using (sample))"""
ARMS = f"""{SEXES}, j as (select c.sample, c.chrom, substr(b.band, 1, 1) as arm, value, up, down from @cnvx c join @bandsx b on b.chrom = c.chrom and c.bin between b.start_pos // 10000 and b.end_pos // 10000 join lim l on l.sample = c.sample and l.chrom = c.chrom),
    arms as (select sample, chrom, arm, round(avg(value), 6) + 0.0 as mean, round(avg(case when value > up then 1 else 0 end), 6) as gain_share, round(avg(case when value < down then 1 else 0 end), 6) as loss_share,
    count(*) as bins, greatest(round(avg(case when value > up then 1 else 0 end), 6), round(avg(case when value < down then 1 else 0 end), 6)) as share from j group by 1, 2, 3)"""
EVENTS = """cm as (select sample, chrom, round(avg(value), 6) as m from @cnvx group by all),
    tw as (select cm.sample, cm.chrom, m, p.mean as p, q.mean as q, p.share as ps, q.share as qs, up, down from cm join lim using (sample, chrom)
    left join (select * from arms where arm = 'p') p on p.sample = cm.sample and p.chrom = cm.chrom left join (select * from arms where arm = 'q') q on q.sample = cm.sample and q.chrom = cm.chrom
    where not (cm.chrom = 'chrY' and male)),
    e0 as (select sample, chrom, case when p > up and q > up then 'WHOLE_CHR_GAIN' else 'WHOLE_CHR_LOSS' end as event, null::varchar as arm, m as mean, case when least(ps, qs) > 0.8 then 'High' else 'Medium' end as confidence, greatest(ps, qs) as share
    from tw where p is not null and q is not null and (ps > 0.7 or qs > 0.7) and ps > 0.4 and qs > 0.4 and ((p > up and q > up) or (p < down and q < down))
    union all select sample, chrom, case when m > up then 'WHOLE_CHR_GAIN' else 'WHOLE_CHR_LOSS' end, null, m, 'Medium', 1.0 from tw where (p is null or q is null) and abs(m) > abs(up) * 1.5
    union all select sample, chrom, case when p > up then 'GAIN' else 'LOSS' end, 'p', p, case when ps > 0.8 then 'High' else 'Medium' end, ps from tw where p is not null and q is not null and chrom <> 'chrY' and ps > 0.4 and (p > up or p < down)
    union all select sample, chrom, case when q > up then 'GAIN' else 'LOSS' end, 'q', q, case when qs > 0.8 then 'High' else 'Medium' end, qs from tw where p is not null and q is not null and chrom <> 'chrY' and qs > 0.4 and (q > up or q < down)),
    pl as (select chrom, substr(band, 1, 1) as arm, min(start_pos) as s, max(end_pos) as e from @bandsx group by 1, 2 union all select chrom, null, min(start_pos), max(end_pos) from @bandsx group by 1),
    pg as (select pl.chrom, pl.arm, s, e, coalesce(list_sort(list(distinct gene) filter (gene is not null)), []) as genes from pl left join @genesx g on g.chrom = pl.chrom and (pl.arm is null or (g.start_pos <= e and g.end_pos >= s)) group by all),
    ev as (select e0.sample, e0.chrom, event, e0.arm, mean + 0.0 as mean, s as start_pos, e as end_pos, e - s as length, genes, confidence, share from e0 join pg on pg.chrom = e0.chrom and pg.arm is not distinct from e0.arm)"""


@query("S3_best_calls", f"with {BEST} select sample, chrom, mod_code, count(*) as n, sum(prob)::bigint as prob from best group by all")
def s3(t):
    return me.best_calls(t.modcalls).groupBy("sample", "chrom", "mod_code").agg(F.count("*").alias("n"), F.sum("prob").alias("prob"))


@query("A8_pileup_combined", f"""with {BEST}, r as (select sample, chrom, pos, strand, read_id, max(prob) as best, greatest(0, 255 - sum(prob)) as canon from best group by 1, 2, 3, 4, 5),
    k as (select *, case when greatest(best, canon) < 178 then 'fail' when canon >= best then 'canonical' else 'modified' end as k from r),
    s as (select sample, chrom, pos, strand, count(*) filter (k = 'modified') as n_mod, count(*) filter (k = 'canonical') as n_canonical, count(*) filter (k = 'fail') as n_fail from k group by 1, 2, 3, 4)
    select *, round(100 * n_mod / (n_mod + n_canonical + n_fail), 2) as percent from s where n_mod + n_canonical > 0""")
def a8(t):
    return me.pileup_combined(t.modcalls)


@query("A8b_pileup_by_code", f"""with {BEST}, w as (select *, max(prob) over (partition by sample, chrom, pos, strand, read_id) as top, 255 - sum(prob) over (partition by sample, chrom, pos, strand, read_id) as rest from best),
    k as (select *, case when prob >= 178 then 'modified' when top >= 178 then 'other' when rest >= 178 then 'canonical' else 'fail' end as k from w)
    select sample, chrom, pos, strand, mod_code, count(*) filter (k = 'modified') as n_modified, count(*) filter (k = 'canonical') as n_canonical, count(*) filter (k = 'other') as n_other, count(*) filter (k = 'fail') as n_fail from k group by 1, 2, 3, 4, 5""")
def a8b(t):
    return me.pileup_by_code(t.modcalls)


FOLD = """select sample, chrom, pos, min(mod_code) as mod_code, min(strand) as strand, sum(valid_cov)::bigint as valid_cov, {p} as percent_modified, sum(n_mod)::bigint as n_mod, sum(n_canonical)::bigint as n_canonical from @bedm group by all"""


@query("A10_fold_batches", FOLD.format(p="round(100 * sum(n_mod) / sum(valid_cov), 6)"))
def a10(t):
    return me.fold_batches(t.bedm)


@query("A10_fold_batches_mean", "select chrom, count(*) as n, min(p) as low, max(p) as high from (select sample, chrom, pos, round(avg(percent_modified), 4) as p from @bedm group by all) group by chrom")
def a10m(t):
    f = me.fold_batches(t.bedm, mode="mean").withColumn("p", F.round("percent_modified", 4))
    return f.groupBy("chrom").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))


@query("A11_strand_collapse", "select sample, chrom, pos, mod_code, round(avg(percent_modified), 6) as percent_modified, '.' as strand, pos + 1 as end_pos from @bedm group by all")
def a11(t):
    return me.collapse_strands_minimal(t.bedm)


@query("A12_strand_collapse_full", "select sample, chrom, pos, mod_code, sum(valid_cov)::bigint as valid_cov, sum(n_mod)::bigint as n_mod, sum(n_canonical)::bigint as n_canonical, round(sum(n_mod) / sum(valid_cov) * 100, 6) as fraction from @bedm group by all")
def a12(t):
    b = t.bedm
    return me.collapse_strands_full(b.where("batch = 0"), b.where("batch <> 0"))


@query("A9_probe_votes", """with h as (select p.probe_id, case when b.percent_modified / 100 > 0.7 then 1 when b.percent_modified / 100 < 0.3 then -1 else 0 end as v
    from @probes p join @bedm b on b.chrom = p.chrom and b.pos between p.start_pos - 25 and p.start_pos + 26)
    select probe_id, count(*) as calls, coalesce(trunc(median(v) filter (v <> 0)), 0)::int as vote from h group by probe_id""")
def a9(t):
    return me.probe_votes(t.probes, t.bedm.select("chrom", "pos", (F.col("percent_modified") / 100).alias("score")))


@query("J8_probe_window", """select p.chrom, count(*) as n, count(distinct p.probe_id) as probes from @probes p join @bedm b on b.chrom = p.chrom and b.pos between p.start_pos - 25 and p.start_pos + 26 group by p.chrom""")
def j8(t):
    # probes of one place and calls of one place are compared once
    spots = t.probes.select("chrom", "start_pos").distinct().withColumn("end_pos", F.col("start_pos") + 1)
    near = points_in(t.bedm.groupBy("chrom", "pos").agg(F.count("*").alias("w")), spots, 25, 25, width=64)
    per = near.groupBy("chrom", F.col("r_start_pos").alias("start_pos")).agg(F.sum("w").alias("w"))
    return t.probes.join(per, ["chrom", "start_pos"]).groupBy("chrom").agg(F.sum("w").alias("n"), F.countDistinct("probe_id").alias("probes"))


@query("J9_site_filter", "select sample, count(*) as n from @bedm b where exists (select 1 from @probes p where p.chrom = b.chrom and p.start_pos = b.pos) group by sample")
def j9(t):
    return t.bedm.join(t.probes.select("chrom", F.col("start_pos").alias("pos")), ["chrom", "pos"], "left_semi").groupBy("sample").agg(F.count("*").alias("n"))


@query("J10_probe_list", "select b.sample, count(*) as n, count(distinct p.probe_id) as probes from @bedm b join @probes p on p.chrom = b.chrom and p.start_pos = b.pos group by b.sample")
def j10(t):
    j = t.bedm.join(t.probes.withColumnRenamed("start_pos", "pos"), ["chrom", "pos"])
    return j.groupBy("sample").agg(F.count("*").alias("n"), F.countDistinct("probe_id").alias("probes"))


PAIRS = "p as (select concat('p', p_partkey) as pair_id, concat('chr', 1 + p_partkey % 3) as chrom, p_partkey * 7 % 500 + 1 as p1, p_partkey * 7 % 500 + 2 as p2 from part)"
PAIRED = f"""{PAIRS}, e as (select pair_id, chrom, p1 - 1 as pos, '+' as strand from p union all select pair_id, chrom, p2 - 1, '-' from p)
    select sample, pair_id, coalesce(sum(valid_cov) filter (strand = '+'), 0)::bigint as forward_cov, coalesce(sum(valid_cov) filter (strand = '-'), 0)::bigint as reverse_cov, sum(valid_cov)::bigint as total_cov,
    round(sum(valid_cov * percent_modified / 100))::bigint as total_mod, round(sum(valid_cov * percent_modified) / sum(valid_cov), 2) as meth_pct from @bedm join e using (chrom, pos, strand) group by all"""


def site_pairs(t):
    p = t.table("part").selectExpr("concat('p', p_partkey) as pair_id", "concat('chr', 1 + p_partkey % 3) as chrom", "p_partkey * 7 % 500 + 1 as p1", "p_partkey * 7 % 500 + 2 as p2")
    return me.site_pairs(t.bedm, p)


@query("A13_site_pairs", f"with {PAIRED}")
def a13(t):
    return site_pairs(t)


@query("A14_site_pairs_all", f"with q as (with {PAIRED}) select pair_id, count(*) as samples, sum(total_cov)::bigint as cov, sum(total_mod)::bigint as mods, round(sum(total_mod) / sum(total_cov) * 100, 2) as meth_pct from q group by pair_id")
def a14(t):
    return site_pairs(t).groupBy("pair_id").agg(F.count("*").alias("samples"), F.sum("total_cov").alias("cov"), F.sum("total_mod").alias("mods"), F.round(F.sum("total_mod") / F.sum("total_cov") * 100, 2).alias("meth_pct"))


@query("F11_enough_evidence", "select sample, count(distinct read_id) as reads, string_agg(distinct mod_code, ',' order by mod_code) as codes, count(distinct read_id) >= 10 as enough from @modcalls group by sample")
def f11(t):
    return me.enough_evidence(t.modcalls).withColumn("codes", F.array_join("codes", ","))


@query("F13_full_layout", """select sample, chrom, pos, pos + 1 as end_pos, mod_code, valid_cov as score, strand, pos as thick_start, pos + 1 as thick_end, '255,0,0' as color, valid_cov, round(percent_modified, 2) as percent_modified,
    n_mod::bigint as n_mod, (valid_cov - n_mod)::bigint as n_canonical, 0::bigint as n_other, 0::bigint as n_delete, 0::bigint as n_fail, 0::bigint as n_diff, 0::bigint as n_nocall from @bedm""")
def f13(t):
    return me.full_layout(t.bedm)


@query("F14_forest_layout", """select sample, concat_ws(chr(9), chrom, pos, pos + 1, mod_code, valid_cov, '+', pos, pos + 1, '0,0,0', concat_ws(' ', valid_cov, format('{:.2f}', percent_modified))) as line from @bedm""")
def f14(t):
    return me.forest_layout(t.bedm)


@query("S5_bedmethyl_columns", "select chrom, strand, count(*) as n, sum(valid_cov)::bigint as cov from @bedm group by all")
def s5(t):
    named = t.bedm.select(F.col("chrom").alias("#chrom"), F.col("pos").alias("start"), F.col("mod_code").alias("name"), "strand", F.col("valid_cov").alias("Nvalid_cov"), F.col("percent_modified").alias("fraction"), F.col("n_mod").alias("Nmod"), F.col("n_canonical").alias("Ncanon"))
    return src.bedmethyl(named).groupBy("chrom", "strand").agg(F.count("*").alias("n"), F.sum("valid_cov").alias("cov"))


@query("E10_binarised", "select sample, case when percent_modified < 60 then -1 else 1 end as v, count(*) as n from @bedm group by all")
def e10(t):
    return t.bedm.groupBy("sample", tx.binarised(F.col("percent_modified")).alias("v")).agg(F.count("*").alias("n"))


@query("J11_inner_add", """with o as (select sample, gene, sum(reads) as r from @tcov where ts < 3 and gene <> 'G1' group by all), n as (select sample, gene, sum(reads) as r from @tcov where ts >= 3 and gene <> 'G2' group by all)
    select sample, gene, (o.r + n.r)::bigint as reads from o join n using (sample, gene)""")
def j11(t):
    c = t.tcov
    return cov.add_totals(c.where("ts < 3 and gene <> 'G1'"), c.where("ts >= 3 and gene <> 'G2'"), ["sample", "gene"], ["reads"], how="inner")


@query("J12_outer_add", """select sample, gene, sum(reads)::bigint as reads, sum(bases)::bigint as bases from @tcov where (ts < 3 and gene <> 'G1') or (ts >= 3 and gene <> 'G2') group by all""")
def j12(t):
    c = t.tcov
    return cov.add_totals(c.where("ts < 3 and gene <> 'G1'"), c.where("ts >= 3 and gene <> 'G2'"), ["sample", "gene"], ["reads", "bases"])


@query("J13_left_zero_fill", """with r as (select sample, gene, sum(reads) as reads from @tcov where ts = 5 group by all), b as (select sample, gene, sum(bases)::bigint as bases from @tcov group by all)
    select sample, gene, bases, coalesce(reads, 0)::bigint as reads from b left join r using (sample, gene)""")
def j13(t):
    c = t.tcov
    r = c.where("ts = 5").groupBy("sample", "gene").agg(F.sum("reads").alias("reads"))
    return c.groupBy("sample", "gene").agg(F.sum("bases").alias("bases")).join(r, ["sample", "gene"], "left").na.fill(0, ["reads"])


@query("J14_latest_snapshot", """with c as (select sample, chrom, gene, ts, reads, bases, row_number() over (partition by sample, chrom, gene order by ts desc) as k from @tcov) select sample, chrom, gene, reads, bases::bigint as bases from c where k = 1""")
def j14(t):
    return cov.latest_snapshot(t.tcov, ["sample", "chrom", "gene"], "ts", ["reads", "bases"])


@query("A29_distribution", """select median(coverage) as median, round(avg(coverage), 6) as mean, min(coverage) as min, max(coverage) as max, round(100 * avg((coverage >= 30)::int), 6) as pct_30,
    round(100 * avg((coverage >= 20)::int), 6) as pct_20, round(100 * avg((coverage >= 10)::int), 6) as pct_10 from @tcov""")
def a29(t):
    return cov.distribution(t.tcov)


BOX = """b as (select chrom, min(coverage) as min, round(quantile_cont(coverage, 0.25), 6) as q1, round(quantile_cont(coverage, 0.5), 6) as median, round(quantile_cont(coverage, 0.75), 6) as q3, max(coverage) as max, count(*) as n from @tcov group by chrom)"""


@query("A30_box_statistics", f"with {BOX} select * from b")
def a30(t):
    return cov.box_statistics(t.tcov, ["chrom"])


@query("A31_iqr_outliers", f"""with {BOX} select sample, chrom, gene, ts, coverage, case when coverage > q3 + 1.5 * (q3 - q1) then 'Gain' else 'Loss' end as label from @tcov join b using (chrom)
    where b.n >= 4 and (coverage > q3 + 1.5 * (q3 - q1) or coverage < q1 - 1.5 * (q3 - q1))""")
def a31(t):
    return cov.iqr_outliers(t.tcov.select("sample", "chrom", "gene", "ts", "coverage"), ["chrom"])


@query("A32_sd_outliers", """with w as (select sample, chrom, gene, ts, coverage, avg(coverage) over p as m, stddev_samp(coverage) over p as s, count(*) over p as n from @tcov window p as (partition by ts))
    select sample, chrom, gene, ts, coverage, case when coverage > m + 2 * s then 'high' else 'low' end as label from w where n >= 3 and s <> 0 and (coverage > m + 2 * s or coverage < m - 2 * s)""")
def a32(t):
    return cov.sd_outliers(t.tcov.select("sample", "chrom", "gene", "ts", "coverage"), ["ts"], "coverage")


@query("A33_mean_band", """with p as (select ts, avg(coverage) as mean from @tcov group by ts), b as (select avg(mean) as m, stddev_samp(mean) as s from p)
    select ts, round(mean, 6) as mean, round(m - 2 * s, 6) as low, round(m + 2 * s, 6) as high from p, b""")
def a33(t):
    return cov.mean_band(t.tcov, "ts", "coverage")


@query("W10_cumulative", """with c as (select sample, gene, ts, sum(reads)::bigint as reads from @tcov group by all) select *, (sum(reads) over (partition by sample, gene order by ts rows unbounded preceding))::bigint as total from c""")
def w10(t):
    c = t.tcov.groupBy("sample", "gene", "ts").agg(F.sum("reads").alias("reads"))
    return cov.cumulative(c, ["sample", "gene"], "ts", "reads")


@query("W11_coverage_series", """with c as (select sample, ts, sum(bases)::bigint as bases from @tcov group by all), l as (select sum(length) as g from @lens)
    select sample, ts, bases, (sum(bases) over (partition by sample order by ts rows unbounded preceding))::bigint as total, round(sum(bases) over (partition by sample order by ts rows unbounded preceding) / g, 6) as depth from c, l""")
def w11(t):
    c = cov.cumulative(t.tcov.groupBy("sample", "ts").agg(F.sum("bases").alias("bases")), ["sample"], "ts", "bases")
    return c.crossJoin(t.lens.agg(F.sum("length").alias("g"))).withColumn("depth", F.round(F.col("total") / F.col("g"), 6)).drop("g")


@query("E11_tiers", """select sample, case when coverage >= 30 then 'Excellent' when coverage >= 20 then 'Good' when coverage >= 10 then 'Moderate' else 'Insufficient' end as quality,
    case when coverage >= 30 then 'high' when coverage >= 20 then 'medium' else 'low' end as tier, case when coverage >= 10 then 'high' when coverage >= 5 then 'medium' else 'low' end as meth, count(*) as n from @tcov group by all""")
def e11(t):
    c = F.col("coverage")
    return t.tcov.groupBy("sample", cov.depth_quality(c).alias("quality"), cov.depth_tier(c).alias("tier"), cov.methylation_tier(c).alias("meth")).agg(F.count("*").alias("n"))


@query("A41_binned_counts", """select sample, chrom, start_pos // 10000 as bin, count(*) as n from @aln where mapq >= 60 group by all""")
def a41(t):
    return cnv.binned_counts(t.aln)


@query("A41_copy_numbers", """with m as (select sample, median(n) as m from @bins group by sample) select sample, chrom, bin, round(2 * n / m, 6) as value from @bins join m using (sample)""")
def a41b(t):
    return cnv.copy_numbers(t.bins)


@query("A24_chromosome_statistics", "select sample, chrom, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, min(value) as min, max(value) as max, count(*) as bins from @cnv group by all")
def a24(t):
    return cnv.chromosome_statistics(t.cnv)


def sexes(t):
    return cnv.estimate_sex(t.cnvx)


@query("A25_arm_statistics", f"with {ARMS} select * from arms")
def a25(t):
    return cnv.arm_statistics(t.cnvx, t.bandsx, sexes(t))


@query("A26_events", f"with {ARMS}, {EVENTS} select * replace (array_to_string(genes, ',') as genes) from ev")
def a26(t):
    return cnv.call_events(t.cnvx, t.bandsx, t.genesx, sexes(t)).withColumn("genes", F.array_join("genes", ","))


@query("A27_event_summary", f"""with {ARMS}, {EVENTS} select sample, count(*) as events, count(*) filter (event like 'WHOLE%') as whole, count(*) filter (event not like 'WHOLE%') as arms, count(*) filter (len(genes) > 0) as with_genes,
    count(*) filter (confidence = 'High') as high, count(*) filter (confidence = 'Medium') as medium, len(list_distinct(flatten(list(genes)))) as genes from ev group by sample""")
def a27(t):
    return cnv.event_summary(cnv.call_events(t.cnvx, t.bandsx, t.genesx, sexes(t)))


@query("A28_sex_estimate", f"with {SEXES} select * from sx")
def a28(t):
    return cnv.estimate_sex(t.cnvx)


@query("W4_runs", """with s as (select *, case when value > 0.5 then 1 when value < -0.5 then -1 end as sign from @cnv), r as (select *, bin - row_number() over (partition by sample, chrom, sign order by bin) as i from s where sign is not null)
    select sample, chrom, min(bin) * 10000 as start_pos, (max(bin) + 1) * 10000 as end_pos, case sign when 1 then 'gain' else 'loss' end as kind from r group by sample, chrom, sign, i""")
def w4(t):
    return cnv.runs(t.cnv)


@query("W5_band_runs", f"""with {SEXES}, b as (select l.sample, l.chrom, b.band, b.start_pos, b.end_pos, up, down, coalesce(round(avg(value), 6), 0) as mean from lim l join @bandsx b on b.chrom = l.chrom
    left join @cnvx c on c.sample = l.sample and c.chrom = l.chrom and c.bin between b.start_pos // 10000 and b.end_pos // 10000 group by all),
    s as (select *, case when mean > up then 'GAIN' when mean < down then 'LOSS' else 'NORMAL' end as state from b),
    f as (select *, case when state = lag(state) over (partition by sample, chrom order by start_pos) then 0 else 1 end as c from s), i as (select *, sum(c) over (partition by sample, chrom order by start_pos) as i from f),
    r as (select sample, chrom, concat(chrom, ' ', arg_min(band, start_pos), '-', arg_max(band, start_pos)) as name, state, min(start_pos) as start_pos, max(end_pos) as end_pos, round(avg(mean), 6) as mean, count(*) as bands from i group by sample, chrom, i, state),
    wh as (select sample, chrom, round(avg(value), 6) as mean, case when avg((value > up)::int) > 0.7 then 'GAIN' when avg((value < down)::int) > 0.7 then 'LOSS' end as state from @cnvx join lim using (sample, chrom) group by all),
    al as (select * from r union all select sample, chrom, concat(chrom, ' WHOLE CHROMOSOME ', state), state, (select min(start_pos) from @bandsx b where b.chrom = wh.chrom), (select max(end_pos) from @bandsx b where b.chrom = wh.chrom), mean, null from wh where state is not null)
    select al.sample, al.chrom, name, state, al.start_pos, al.end_pos, al.end_pos - al.start_pos as length, mean + 0.0 as mean, bands, coalesce(string_agg(distinct gene, ',' order by gene), '') as genes from al
    left join @genesx g on state <> 'NORMAL' and g.chrom = al.chrom and g.start_pos <= al.end_pos and g.end_pos >= al.start_pos group by all""")
def w5(t):
    return cnv.band_runs(t.cnvx, t.bandsx, t.genesx, sexes(t)).withColumn("genes", F.array_join("genes", ","))


SMOOTH = "round((coalesce(lag(value) over w, value) + value + coalesce(lead(value) over w, value)) / 3, 6) + 0.0"


@query("W6_moving_average", f"select sample, chrom, bin, value, {SMOOTH} as smooth from @cnv window w as (partition by sample, chrom order by bin)")
def w6(t):
    return cnv.moving_average(t.cnv)


@query("W7_normalised", f"""with m as (select sample, chrom, bin, {SMOOTH} as v from @cnv window w as (partition by sample, chrom order by bin)), s as (select * from m where sample <> 'S0'), c as (select chrom, bin, v from m where sample = 'S0'),
    g as (select distinct o.sample, o.chrom, c.bin from (select distinct sample, chrom from s) o join c using (chrom) union select sample, chrom, bin from s)
    select g.sample, g.chrom, g.bin, round(coalesce(s.v, 0) - coalesce(c.v, 0), 6) + 0.0 as value from g left join s using (sample, chrom, bin) left join c using (chrom, bin)""")
def w7(t):
    c = t.cnv
    return cnv.normalised(c.where("sample <> 'S0'"), c.where("sample = 'S0'"))


#: The programme over all starts of the last segment, bin after bin, with running sums in the order of the bins; then the walk back.
@query("W8_change_points", """with recursive o as materialized (select sample, chrom, value, row_number() over (partition by sample, chrom order by bin) as e, count(*) over (partition by sample, chrom) as n from @cnv),
    walk(sample, chrom, n, e, s1, s2, best, back) as (select sample, chrom, n, 0::bigint, [0.0::double], [0.0::double], [-10.0::double], [0::bigint] from o where e = 1 and n > 3
      union all select sample, chrom, n, e, s1, s2, list_append(best, case when e < 2 then 'inf'::double else list_min(cost) + 10 end), list_append(back, case when e < 2 then 0 else starts[list_position(cost, list_min(cost))] end)
      from (select *, [best[s + 1] + s2[e + 1] - s2[s + 1] - (s1[e + 1] - s1[s + 1]) * (s1[e + 1] - s1[s + 1]) / (e - s) for s in starts] as cost
      from (select w.sample, w.chrom, w.n, o.e, list_append(w.s1, w.s1[w.e + 1] + o.value) as s1, list_append(w.s2, w.s2[w.e + 1] + o.value * o.value) as s2, w.best, w.back, [x for x in range(0, o.e - 1) if x <> 1] as starts
      from walk w join o on o.sample = w.sample and o.chrom = w.chrom and o.e = w.e + 1) q) r),
    trace(sample, chrom, e, back) as (select sample, chrom, e, back from walk where e = n union all select sample, chrom, back[e + 1], back from trace where back[e + 1] > 0)
    select sample, chrom, e * 10000 - 10000 as start_pos, e * 10000 + 10000 as end_pos from trace""")
def w8(t):
    return cnv.change_points(t.cnv)


@query("X1_group_step", """with d as (select sample, chrom, bin, value - lag(value) over (partition by sample, chrom order by bin) as step from @cnv)
    select sample, chrom, count(*) as bins, round(coalesce(max(abs(step)), 0), 6) as largest from d group by all""")
def x1(t):
    def largest(pdf):
        v = pdf.sort_values("bin")["value"]
        step = v.diff().abs().max()
        return pdf.iloc[:1][["sample", "chrom"]].assign(bins=len(v), largest=round(0.0 if step != step else float(step), 6))

    return t.cnv.groupBy("sample", "chrom").applyInPandas(largest, "sample string, chrom string, bins long, largest double")


@query("W12_downsample", "select sample, chrom, (bin // 8 + 0.5)::double * 20000 as x, round(avg(value), 6) + 0.0 as value from @cnv group by sample, chrom, bin // 8 having count(*) = 2")
def w12(t):
    # the derived bins lie four apart
    return cnv.downsample(t.cnv.withColumn("bin", F.floor(F.col("bin") / 4)), 2)


@query("W13_even_sample", """with r as (select sample, chrom, bin, value, row_number() over (partition by sample, chrom order by bin) - 1 as r, count(*) over (partition by sample, chrom) as n from @cnv)
    select sample, chrom, bin, value from r where n <= 10 or r = 0 or (r * 10) // n <> ((r - 1) * 10) // n""")
def w13(t):
    return cnv.evenly(t.cnv, ["sample", "chrom"], ["bin"], 10)


@query("S13_region_lines", """with s as (select *, case when value > 0.5 then 1 when value < -0.5 then -1 end as sign from @cnv), r as (select *, bin - row_number() over (partition by sample, chrom, sign order by bin) as i from s where sign is not null)
    select concat_ws(chr(9), chrom, min(bin) * 10000, (max(bin) + 1) * 10000, case sign when 1 then 'gain' else 'loss' end) as value from r group by sample, chrom, sign, i""")
def s13(t):
    return cnv.runs(t.cnv).select(F.concat_ws("\t", "chrom", "start_pos", "end_pos", "kind").alias("value"))


@query("E16_series_json", """with c as (select sample, gene, ts * 1000 as ms, sum(bases)::double as v from @tcov group by all) select sample, gene, to_json({'series': list([ms::double, v] order by ms)}) as json from c group by all""")
def e16(t):
    c = t.tcov.groupBy("sample", "gene", (F.col("ts") * 1000).alias("ms")).agg(F.sum("bases").cast("double").alias("v"))
    return src.series_json(c, ["sample", "gene"], "ms", "v")

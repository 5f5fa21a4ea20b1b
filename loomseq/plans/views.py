"""Genomic-shaped views over the given tables, by integer arithmetic; one text serves Spark and the SQL check."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "aln": """select concat('S', l_orderkey % 4) as sample, l_orderkey % 17 as file_no, concat('r', l_orderkey) as read_id,
        concat('chr', 1 + l_partkey % 22) as chrom, (l_partkey % 50) * 20000 + (l_orderkey % 40) * 220 as start_pos,
        (l_partkey % 50) * 20000 + (l_orderkey % 40) * 220 + 200 + 10 * cast(l_quantity as bigint) as end_pos,
        40 + (l_orderkey + l_linenumber) % 21 as mapq, 8 + l_orderkey % 12 as qs,
        case when l_linestatus = 'O' then '+' else '-' end as strand, l_linenumber > 1 as is_supplementary, l_shipdate as start_time from {lineitem}""",
    "genes": """select concat('chr', 1 + p_partkey % 22) as chrom, (p_partkey % 50) * 20000 + cast(floor(p_partkey / 1100) as bigint) % 40 * 100 as start_pos,
        (p_partkey % 50) * 20000 + cast(floor(p_partkey / 1100) as bigint) % 40 * 100 + 8000 as end_pos, concat('G', p_partkey % 1100 % 8) as gene from {part}""",
    "regions": """select concat('chr', 1 + p_partkey % 22) as chrom, (p_partkey % 50) * 20000 + (p_size % 7) * 1000 as start_pos,
        (p_partkey % 50) * 20000 + (p_size % 7) * 1000 + 6000 + (p_size % 5) * 3000 as end_pos, concat('G', p_partkey % 8) as name,
        case p_size % 3 when 0 then '+' when 1 then '-' else '.' end as strand from {part}""",
    "lens": """select concat('chr', n_nationkey + 1) as chrom, 950000 + n_nationkey * 5000 as length from {nation}""",
    "bands": """select concat('chr', n_nationkey + 1) as chrom, concat(case when r_regionkey < 2 then 'p' else 'q' end, r_regionkey) as band,
        r_regionkey * 200000 as start_pos, (r_regionkey + 1) * 200000 as end_pos from {nation} cross join {region}""",
    "modcalls": """select concat('S', l_orderkey % 4) as sample, l_orderkey % 3 as batch, concat('r', l_orderkey) as read_id, concat('chr', 1 + l_suppkey % 3) as chrom,
        l_partkey % 500 as pos, case when l_linestatus = 'O' then '+' else '-' end as strand, case when l_linenumber % 2 = 1 then 'm' else 'h' end as mod_code,
        (l_orderkey * 7 + l_partkey * 13 + l_linenumber * 29) % 256 as prob from {lineitem}""",
    "bedm": """select sample, batch, chrom, pos, strand, mod_code, count(*) as valid_cov, sum(case when prob >= 178 then 1 else 0 end) as n_mod,
        sum(case when prob < 178 then 1 else 0 end) as n_canonical, round(100.0 * cast(sum(case when prob >= 178 then 1 else 0 end) as double) / count(*), 4) as percent_modified
        from (@modcalls) q group by sample, batch, chrom, pos, strand, mod_code""",
    "bins": """select concat('S', l_orderkey % 4) as sample, concat('chr', 1 + l_partkey % 22) as chrom,
        cast(floor(((l_partkey % 50) * 20000 + (l_orderkey % 40) * 220) / 10000) as bigint) as bin, count(*) as n from {lineitem} group by 1, 2, 3""",
    "cnv": """select sample, chrom, bin, cast((n * 7 + cast(floor(bin / 6) as bigint) * 13) % 30 - 15 as double) / 10 as value from (@bins) q""",
    "cnvx": """select sample, case chrom when 'chr21' then 'chrX' when 'chr22' then 'chrY' else chrom end as chrom, bin, value from (@cnv) q""",
    "bandsx": """select case chrom when 'chr21' then 'chrX' when 'chr22' then 'chrY' else chrom end as chrom, band, start_pos, end_pos from (@bands) q where chrom <> 'chr3' or band like 'q%'""",
    "genesx": """select case chrom when 'chr21' then 'chrX' when 'chr22' then 'chrY' else chrom end as chrom, start_pos, end_pos, gene from (@genes) q""",
    "tcov": """select concat('S', l_orderkey % 4) as sample, concat('chr', 1 + l_partkey % 22) as chrom, concat('G', l_partkey % 8) as gene, l_orderkey % 17 as ts,
        count(*) as reads, sum(200 + 10 * cast(l_quantity as bigint)) as bases, cast(sum(200 + 10 * cast(l_quantity as bigint)) as double) / 400 as coverage from {lineitem} group by 1, 2, 3, 4""",
    "pile": """select concat('chr', 1 + l_suppkey % 22) as chrom, l_partkey * 37 % 100000 as pos, concat('r', l_orderkey) as read_id,
        substr('ACGTN-', cast(1 + (l_orderkey * 7 + l_linenumber * 3) % 6 as int), 1) as base, cast(l_quantity as bigint) as qual from {lineitem}""",
    "scores": """select concat('S', user_id % 4) as sample, event_type as classifier, ts, event_id, concat('C', event_id % 5) as class, value as score from {events}""",
    "jobs": """select ts, event_id, concat('S', user_id % 4) as sample_id, event_type as job_type, value as duration_seconds,
        case event_id % 5 when 0 then 'failed' when 1 then 'running' when 2 then 'queued' else 'completed' end as status from {events}""",
    "vcf": """select concat('chr', 1 + p_partkey % 22) as chrom, p_partkey * 37 % 100000 as pos, 'A' as ref, case when p_partkey % 3 = 0 then 'G' else 'T' end as alt,
        p_size as qual, case when p_size > 10 then 'PASS' else 'LowQual' end as filter_status,
        concat('CLNSIG=', case p_partkey % 5 when 0 then 'Pathogenic' when 1 then 'Likely_pathogenic' when 2 then 'Benign'
        when 3 then 'Conflicting_classifications_of_pathogenicity' else 'Uncertain_significance' end, ';GENEINFO=G', p_partkey % 8, ':1;DP=', p_size * 2) as info from {part}""",
    "vcf2": """select chrom, pos, case when qual % 7 = 0 then 'AT' when qual % 7 = 1 then 'C' else ref end as ref, case when qual % 7 = 1 or qual % 7 = 2 then concat(alt, 'C') else alt end as alt from (@vcf) q""",
    "probes": """select concat('cg', p_partkey) as probe_id, concat('chr', 1 + p_partkey % 3) as chrom, p_partkey * 3 % 500 as start_pos from {part}""",
}


def _whole(name: str) -> str:
    return re.sub(r"@(\w+)", lambda m: _whole(m[1]), VIEWS[name])


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; timestamps without zone become timestamps of the session's zone."""
    text = _whole(name)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)


def with_views(body: str) -> str:
    """SQL text with the views it names with ``@`` as common table expressions before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in re.findall(r"@(\w+)", text):
            if n not in need:
                need.append(n)

    add(body)
    ctes = ", ".join(f"{n} as ({re.sub(r'\{(\w+)\}', r'\1', _whole(n))})" for n in need)
    body = re.sub(r"@(\w+)", r"\1", body).strip()
    if not need:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes}, {body[len('with recursive '):]}"
    return f"with {ctes}, {body[5:]}" if body.lower().startswith("with ") else f"with {ctes} {body}"

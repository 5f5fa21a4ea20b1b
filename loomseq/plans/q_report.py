"""The report's frames, each the result of a registered query, exported with one manifest."""

from __future__ import annotations

from loomseq.plans import q_intervals, q_measures, q_reads  # noqa: F401  (their queries are the frames)
from loomseq.plans.registry import PLANS, QUERIES, SQL, Tables
from loomseq.sources import exports
from loomseq.sources.scratch import new_folder

#: Frame -> query.  The names of the frames are fixed values: readers of an export look for them.
FRAMES = {
    "classification_summary": "T1_top_class",
    "classification_history": "T2_top_history",
    "cnv_whole_chromosome_events": "A24_chromosome_statistics",
    "cnv_arm_events": "A25_arm_statistics",
    "cnv_gene_containing_events": "W5_band_runs",
    "cnv_detailed_events": "A26_events",
    "coverage_summary": "A5_genome_summary",
    "coverage_chromosome": "A6_on_off_target",
    "coverage_targets_bed": "W1_merge_regions",
    "coverage_targets": "A4_target_coverage",
    "coverage_distribution": "A29_distribution",
    "coverage_outliers": "A31_iqr_outliers",
    "fusions_networks": "G1_gene_groups",
    "fusions_target_panel": "A22_validated_pairs",
    "fusions_genome_wide": "A16_support",
    "mgmt_summary": "A14_site_pairs_all",
    "mgmt_cpg_sites": "A13_site_pairs",
    "variants_detailed": "A35_grouped_variants",
    "variants_summary": "A36_variant_summary",
}


def exported(spark, sf_dir):
    t = Tables(spark, sf_dir, several=True)
    frames = exports.side_by_side(lambda key: PLANS[key](t), FRAMES.values())
    return exports.export_report(spark, dict(zip(FRAMES, frames, strict=True)), new_folder(spark), "run").select("name", "rows")


QUERIES["S15_whole_export"] = exported
SQL["S15_whole_export"] = " union all ".join(f"select '{name}' as name, (select count(*) from ({SQL[key]}) q) as rows" for name, key in FRAMES.items())

"""Text and table sources and sinks of the domain: BED, bedMethyl, probes, VCF, genome index, SAM; exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BEDMETHYL = {
    "chrom": ("chrom", "chr", "#chrom"), "chromStart": ("chromStart", "start", "start_pos", "pos"), "mod_code": ("mod_code", "name", "code"), "strand": ("strand",),
    "valid_cov": ("valid_cov", "Nvalid_cov", "coverage"), "percent_modified": ("percent_modified", "fraction", "percent"), "n_mod": ("n_mod", "Nmod"), "n_canonical": ("n_canonical", "Ncanon"),
}
VCF_COLUMNS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter_status", "info", "format", "gt")


def _field(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def parse_bed(lines: DataFrame, column: str = "value") -> DataFrame:
    """BED of any width from text lines; comments, blanks, headers and rows without numbers go."""
    p = F.split(F.trim(column), r"\t| +")
    rows = lines.where(~F.col(column).rlike(r"^\s*(#|$|track|browser)")).select(
        _field(p, 0).alias("chrom"), _field(p, 1).try_cast("long").alias("start_pos"), _field(p, 2).try_cast("long").alias("end_pos"),
        F.coalesce(F.nullif(_field(p, 3), F.lit("")), F.lit(".")).alias("name"), F.coalesce(F.nullif(_field(p, 4), F.lit(".")), F.lit("0")).alias("score"),
        F.when(_field(p, 5).isin("+", "-"), _field(p, 5)).otherwise(".").alias("strand"),
    )
    return rows.where("chrom <> '' and start_pos is not null and end_pos is not null")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(spark.read.text(path))


def bed_errors(lines: DataFrame, most: int = 10) -> DataFrame:
    """(line_no, error): the first ``most`` faults of BED lines (line_no, value) in line order."""
    p = F.split("value", "\t")
    start, end = _field(p, 1).try_cast("long"), _field(p, 2).try_cast("long")
    wide = F.size(p) >= 3
    checks = F.array(
        F.when(~wide, "fewer than 3 columns"), F.when(wide & ~_field(p, 0).startswith("chr"), "chromosome without chr"),
        F.when(wide & (start.isNull() | end.isNull() | (start < 0) | (start >= end)), "bad interval"),
        F.when((F.size(p) >= 4) & (F.trim(_field(p, 3)) == ""), "no gene name"),
        F.when((F.size(p) >= 5) & (_field(p, 4) != ".") & F.coalesce(_field(p, 4).try_cast("int") < 0, F.lit(True)), "bad score"),
        F.when((F.size(p) >= 6) & ~_field(p, 5).isin("+", "-", "."), "bad strand"),
    )
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).select("line_no", F.explode(F.array_compact(checks)).alias("error"))
    return rows.orderBy("line_no", "error").limit(most)


def bedmethyl(df: DataFrame) -> DataFrame:
    """The 8 columns from a table with any known spelling of them, or from 18 unnamed ones by position."""
    have = {c.lower(): c for c in df.columns}
    if len(df.columns) == 18 and "chrom" not in have:
        at = dict(zip(BEDMETHYL, (0, 1, 3, 5, 9, 10, 11, 12)))
        return df.select(*[F.col(f"`{df.columns[i]}`").alias(n) for n, i in at.items()])
    pick = {n: next((have[a.lower()] for a in alias if a.lower() in have), None) for n, alias in BEDMETHYL.items()}
    if missing := [n for n, c in pick.items() if c is None]:
        raise ValueError(f"bedMethyl columns not found: {missing}")
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in pick.items()])


def parse_probes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Probe sites: white-space separated, 1-based to 0-based, names without ``chr``."""
    p = F.split(F.trim(column), r"\s+")
    return lines.select(_field(p, 0).alias("probe_id"), F.regexp_replace(_field(p, 1), "^chr", "").alias("chrom"), (_field(p, 2).try_cast("long") - 1).alias("start_pos"), _field(p, 3).try_cast("long").alias("end_pos")).where("start_pos is not null")


def parse_vcf(lines: DataFrame, column: str = "value") -> DataFrame:
    """The ten columns of VCF lines, headers dropped; positions stay 1-based, ``.`` in QUAL is null."""
    p = F.split(column, "\t")
    rows = lines.where(~F.col(column).startswith("#") & (F.trim(column) != ""))
    out = rows.select(*[_field(p, i).alias(n) for i, n in enumerate(VCF_COLUMNS)])
    return out.withColumns({"pos": F.col("pos").try_cast("long"), "qual": F.col("qual").try_cast("double")})


def clinvar(vcf: DataFrame, order: str = "line_no") -> DataFrame:
    """Pathogenic or oncogenic records, the last line of each (chrom, pos)."""
    from loomseq.operators.variants import clinvar_pathogenic, info_value

    keep = vcf.where(clinvar_pathogenic(info_value(F.col("info"), "CLNSIG"), info_value(F.col("info"), "ONC")))
    return keep.groupBy("chrom", "pos").agg(F.max_by(F.struct("ref", "alt", "info"), order).alias("_l")).select("chrom", "pos", "_l.*")


def parse_index(lines: DataFrame, column: str = "value") -> DataFrame:
    """chrom and length of a genome index."""
    p = F.split(column, "\t")
    return lines.select(_field(p, 0).alias("chrom"), _field(p, 1).try_cast("long").alias("length")).where("length is not null")


def parse_sam(lines: DataFrame, column: str = "value") -> DataFrame:
    """Alignments from SAM text: flags told apart, the end from the CIGAR's reference length, SA/qs/RG tags typed."""
    p = F.split(column, "\t")
    ref = F.aggregate(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    tag = lambda n, t: F.nullif(F.regexp_extract(column, rf"\t{n}:{t}:([^\t]*)", 1), F.lit(""))
    rows = lines.where(~F.col(column).startswith("@")).select(
        _field(p, 0).alias("read_id"), _field(p, 1).cast("int").alias("flag"), _field(p, 2).alias("chrom"), (_field(p, 3).cast("long") - 1).alias("start_pos"),
        _field(p, 4).cast("int").alias("mapq"), _field(p, 5).alias("cigar"), F.length(_field(p, 9)).alias("read_length"),
        tag("SA", "Z").alias("sa"), tag("qs", "[fi]").cast("double").alias("qs"), tag("RG", "Z").alias("rg"),
    )
    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b)) != 0
    return rows.withColumns({"end_pos": F.col("start_pos") + ref, "strand": F.when(bit(0x10), "-").otherwise("+"), "is_unmapped": bit(0x4), "is_secondary": bit(0x100), "is_supplementary": bit(0x800)}).drop("cigar")


def latest_version(df: DataFrame, path: str = "path") -> DataFrame:
    """The row whose file name carries the greatest numeric suffix, per name without it."""
    stem = F.regexp_replace(path, r"_?(\d+)(\.[A-Za-z]+)$", "$2")
    number = F.regexp_extract(path, r"_?(\d+)\.[A-Za-z]+$", 1).try_cast("long")
    return df.groupBy(stem.alias("stem")).agg(F.max_by(path, number).alias("path"), F.max(number).alias("version"))


def write_lines(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """Tab-separated text without header, in order within and across files."""
    df.orderBy(*order).select(F.concat_ws("\t", *columns).alias("value")).write.mode("overwrite").text(path)


def append_batch(df: DataFrame, path: str, batch_id: int, keys: list[str]) -> None:
    """Append one batch under its own folder: a batch written twice replaces itself."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/batch_id={batch_id}")


def export_tables(frames: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each frame as CSV with a header and return the manifest (name, rows)."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    manifest = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        manifest = one if manifest is None else manifest.unionByName(one)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.json(f"{path}/manifest")


def json_number(v: Column) -> Column:
    """A double as JSON text: its shortest digits, written out from 1e-6 up to 1e21 and with an exponent beyond."""
    text, size = v.cast("string"), F.abs(v)
    whole = F.regexp_replace(text.try_cast("decimal(38,16)").cast("string"), "0+$", "")
    part = F.regexp_replace(text.try_cast("decimal(38,24)").cast("string"), "0+$", "")
    whole = F.when(F.endswith(whole, F.lit(".")), F.concat(whole, F.lit("0"))).otherwise(whole)
    short = F.regexp_replace(F.lower(text), "\\.0e", "e")
    return (
        F.when(F.isnan(v) | (size == float("inf")), F.concat(F.lit('"'), text, F.lit('"'))).when(~F.contains(text, F.lit("E")), text)
        .when((size >= 1) & (size < 1e21), whole).when((size >= 1e-6) & (size < 1), part).otherwise(short)
    )


def series_json(df: DataFrame, keys: list[str], ts_ms: str, value: str) -> DataFrame:
    """Per key a JSON text ``{"series": [[ms, value], ...]}`` in time order; rows with a null value are left out."""
    number = lambda c: F.coalesce(json_number(c.cast("double")), F.lit("null"))
    pts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ts_ms).alias("t"), F.col(value).alias("v")))), lambda s: F.concat(F.lit("["), number(s["t"]), F.lit(","), number(s["v"]), F.lit("]")))
    series = F.concat(F.lit('{"series":['), F.array_join(pts, ","), F.lit("]}"))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(series.alias("json"))


def flatten_hierarchy(df: DataFrame, column: str = "json") -> DataFrame:
    """Leaves of a four-level class hierarchy in JSON, with the path of group names; a missing score is 0."""
    leaf = "struct<group:string,score:double,description:string>"
    for _ in range(3):
        leaf = f"struct<group:string,score:double,description:string,members:array<{leaf}>>"
    out = df.withColumn("n0", F.explode(F.from_json(column, f"array<{leaf}>")))
    for i in range(3):
        out = out.withColumn(f"n{i + 1}", F.explode_outer(F.col(f"n{i}.members")))
    names = ("superfamily", "family", "class", "subclass")
    keep = [c for c in df.columns if c != column]
    score = F.coalesce("n3.score", "n2.score", "n1.score", "n0.score", F.lit(0.0))
    return out.select(*keep, *[F.col(f"n{i}.group").alias(n) for i, n in enumerate(names)], score.alias("score"),
                      F.array_distinct(F.array_compact(F.array(*[F.col(f"n{i}.description") for i in range(4)]))).alias("descriptions"))


def manifest_text(rows: dict[str, int]) -> str:
    return json.dumps(rows, sort_keys=True)

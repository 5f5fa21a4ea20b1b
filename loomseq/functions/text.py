"""Scalar helpers on names, labels and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def run_id(ds: Column) -> Column:
    """Run id of a read-group description ``runid=... basecall_model=...``."""
    return F.nullif(F.regexp_extract(ds, r"runid=(\S+)", 1), F.lit(""))


def basecall_model(ds: Column) -> Column:
    return F.nullif(F.regexp_extract(ds, r"basecall_model=(\S+)", 1), F.lit(""))


def sample_id(library: Column, run: Column, path: Column) -> Column:
    """Library, else run id, else file name; a barcode 1-96 from the file name is appended once, two digits wide."""
    name = F.regexp_extract(path, r"([^/]+?)(\.[a-z0-9]+)?$", 1)
    base = F.coalesce(F.nullif(library, F.lit("")), F.nullif(run, F.lit("")), name)
    number = F.nullif(F.regexp_extract(path, r"_barcode(\d{1,2})(?:\D|$)", 1), F.lit("")).cast("int")
    tag = F.concat(F.lit("_barcode"), F.lpad(number.cast("string"), 2, "0"))
    return F.when(number.between(1, 96) & ~base.contains("_barcode"), F.concat(base, tag)).otherwise(base)


def file_kind(path: Column) -> Column:
    """pass, fail or unknown from a path."""
    return F.when(path.rlike("(?i)(^|[/_])fail([/_.]|$)"), "fail").when(path.rlike("(?i)(^|[/_])pass([/_.]|$)"), "pass").otherwise("unknown")


def disease_name(raw: Column) -> Column:
    """Words of a ``_``/``|`` separated name with capitals, small words excepted."""
    small = F.array(*[F.lit(w) for w in ("of", "and", "the", "in", "with", "to")])
    words = F.split(F.regexp_replace(raw, r"\|", "_"), "_")
    return F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.when(F.array_contains(small, F.lower(w)), F.lower(w)).otherwise(F.initcap(w))), " ")


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared bases over the smaller interval's length, 0 for an empty one."""
    shared = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    short = F.least(a1 - a0, b1 - b0)
    return F.when(short > 0, shared / short).otherwise(0.0)


def close(a0: Column, a1: Column, b0: Column, b1: Column, distance: int) -> Column:
    """Whether the nearest of the four end distances is at most ``distance``."""
    return F.least(F.abs(a0 - b0), F.abs(a0 - b1), F.abs(a1 - b0), F.abs(a1 - b1)) <= distance


def short_chrom(name: Column) -> Column:
    return F.regexp_replace(name, "(?i)^chr", "")


def binarised(percent: Column, least: float = 60) -> Column:
    return F.when(percent >= least, 1).otherwise(-1)


def methylation_status(status: Column, prediction: Column) -> Column:
    return F.coalesce(status, F.when(prediction > 0.1, "Methylated").otherwise("Unmethylated"))

"""Interval algebra: overlap and containment joins, island merging, expansion, genome shares.

Intervals are 0-based and half-open unless a function says otherwise; columns are ``chrom, start_pos, end_pos``.
Range joins never fall back to a nested loop: both sides are cut into bins and joined on (chrom, bin); a pair is
kept only in the bin that holds the larger start, so it appears once.  Long intervals go to coarser bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.sources.scratch import settle

BIN = 20_000
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: An interval over this many bins goes to bins that are wider by STEP, and if need be by STEP squared.
LONG, STEP, LEVELS = 16, 256, 3


def level(start: Column, last: Column, width: int) -> Column:
    """0, 1 or 2: the finest bins of which the interval covers at most ``LONG``; the widest take any."""
    span = lambda k: F.floor(last / (width * STEP**k)) - F.floor(start / (width * STEP**k)) < LONG
    return F.when(span(0), 0).when(span(1), 1).otherwise(2)


def cells(start: Column, last: Column, width: int, own: Column, upto: int) -> Column:
    """One row per bin that the interval covers, at its own level and at those up to ``upto`` that are coarser.

    A bin is one number, four times its place plus its level, so that joins go by a long.
    """
    last = F.greatest(last, start)

    def at(k: int) -> Column:
        w = width * STEP**k
        every = F.sequence(F.floor(start / w) * 4 + k, F.floor(last / w) * 4 + k, F.lit(4).cast("long"))
        return F.when((own == k) | ((own < k) & F.lit(k <= upto)), every).otherwise(F.array().cast("array<bigint>"))

    return F.explode(F.concat(*[at(k) for k in range(LEVELS)]))


def bin_width(cell: Column, width: int) -> Column:
    k = cell % 4
    return F.when(k == 0, width).when(k == 1, width * STEP).otherwise(width * STEP**2)


def region_side(df: DataFrame, start: Column, last: Column, width: int, upto: int, rows: int = SMALL_ROWS) -> tuple[DataFrame, int]:
    """The smaller side of a range join in its bins, with its own level and its level's bins up to ``upto``; the coarsest level in it.

    One pass over at most ``rows`` rows tells both: up to that many rows are broadcast; beyond, all levels are assumed.
    """
    df = df.withColumn("_rlev", level(start, F.greatest(last, start), width))
    seen = df.select("_rlev").limit(rows + 1).agg(F.count("*").alias("n"), F.max("_rlev").alias("top")).head()
    few = seen["n"] <= rows
    out = df.withColumn("_rcell", cells(start, last, width, F.col("_rlev"), upto))
    return (F.broadcast(out) if few else out), (seen["top"] or 0) if few else LEVELS - 1


def overlap_join(left: DataFrame, right: DataFrame, min_overlap: int = 99, width: int = BIN, how: str = "inner") -> DataFrame:
    """Pairs on one chromosome that share more than ``min_overlap`` bases; the right side's columns get ``r_``.

    Two intervals meet in the bins of the longer one's level, so an interval of any length is cut into at most ``LONG`` bins
    at its own level and a few at the coarser ones (the coarsest: length / (65,536 * ``width``)).
    ``how`` may be ``left``: rows without a partner stay, with nulls.  Zero-length intervals meet nothing.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    rb, top = region_side(r, F.col("r_start_pos"), F.col("r_end_pos") - 1, width, LEVELS - 1)
    last = F.greatest(F.col("end_pos") - 1, F.col("start_pos"))
    lb = left.withColumn("_lev", level(F.col("start_pos"), last, width)).withColumn("_cell", cells(F.col("start_pos"), last, width, F.col("_lev"), top))
    shared = F.least("end_pos", "r_end_pos") - F.greatest("start_pos", "r_start_pos")
    lb = lb.withColumn("_w", bin_width(F.col("_cell"), width))
    one = (F.col("_cell") % 4 == F.greatest("_lev", "_rlev")) & (F.floor(F.col("_cell") / 4) == F.floor(F.greatest("start_pos", "r_start_pos") / F.col("_w")))
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("_cell") == F.col("_rcell")) & (shared > min_overlap) & one
    pairs = lb.join(rb, on).withColumn("overlap", shared).drop("_cell", "_rcell", "_lev", "_rlev", "_w")
    if how == "inner":
        return pairs
    keys = left.columns
    alone = left.join(pairs.select(*keys).distinct(), keys, "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)


def stretches(right: DataFrame, labels: list[str], min_overlap: int = 0) -> DataFrame:
    """What the regions of each label cover: disjoint stretches, each with the end of the one before it (``_before``).

    Two intervals share more than ``min_overlap`` bases exactly if both, made shorter by that at their ends, share any; so
    the regions are cut first and then united, and no copy or crowd of regions is met more than once per label.
    """
    cut = right.select("chrom", "start_pos", (F.col("end_pos") - min_overlap).alias("end_pos"), *labels).where("start_pos < end_pos").distinct()
    one = merge_regions(cut, ["chrom", *labels], names=None).drop("n")
    line = Window.partitionBy("chrom", *labels)
    return one.withColumns({"_before": F.lag("end_pos").over(line.orderBy("start_pos")), "_first": F.min("start_pos").over(line), "_last": F.max("end_pos").over(line)})


def label_hits(left: DataFrame, right: DataFrame, labels: list[str], min_overlap: int = 99) -> DataFrame:
    """Each left row once per label (``r_``) of which it shares more than ``min_overlap`` bases with some region."""
    return line_hits(left, right, labels, min_overlap).select(*left.columns, *[f"r_{c}" for c in labels])


def line_hits(left: DataFrame, right: DataFrame, labels: list[str], min_overlap: int) -> DataFrame:
    """``label_hits`` with where the label's stretches begin and end on the chromosome (``r__first``, ``r__last``)."""
    cut = left.withColumn("_end", F.col("end_pos")).withColumn("end_pos", F.col("end_pos") - min_overlap).where("start_pos < end_pos")
    # the stretches are few and asked for twice, by their number and by the join
    j = overlap_join(cut, settle(stretches(right, labels, min_overlap)), 0)
    first = F.col("r__before").isNull() | (F.col("r__before") <= F.col("start_pos"))
    whole = [F.col("_end").alias(c) if c == "end_pos" else F.col(c) for c in left.columns]
    return j.where(first).select(*whole, *[f"r_{c}" for c in labels], "r__first", "r__last")


SPOT = ["chrom", "start_pos", "end_pos"]
#: Bins of the steps of a running count, and up to how many steps are broadcast.
STEP_BIN, STEP_ROWS = 512, 300_000


def same_line(labels: list[str], a: str, b: str) -> Column:
    on = F.col(f"{a}chrom") == F.col(f"{b}chrom")
    for c in labels:
        on = on & F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}"))
    return on


def bound_steps(right: DataFrame, labels: list[str], min_overlap: int) -> DataFrame:
    """How many regions of a label, cut by ``min_overlap``, begin (``begun``) and end (``ended``) up to a position: (start_pos, end_pos) of equal counts.

    The steps of a label on a chromosome lie end to end, from one base before its first region to its last region's end.
    Counts run within parts of the chromosome and are added to those of the parts before.
    """
    line = ["chrom", *labels]
    cut = right.select("chrom", "start_pos", (F.col("end_pos") - min_overlap).alias("end_pos"), *labels).where("start_pos < end_pos")
    mark = lambda at, begun, ended: F.struct(at.cast("long").alias("at"), F.lit(begun).cast("long").alias("b"), F.lit(ended).cast("long").alias("e"))
    bounds = cut.select(*line, F.explode(F.array(mark(F.col("start_pos"), 1, 0), mark(F.col("end_pos"), 0, 1))).alias("m")).groupBy(*line, "m.at").agg(F.sum("m.b").alias("b"), F.sum("m.e").alias("e"))
    before = bounds.groupBy(*line).agg((F.min("at") - 1).alias("at"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("e"))
    every = bounds.unionByName(before).withColumn("part", F.floor(F.col("at") / 1_000_000))
    far = Window.partitionBy(*line).orderBy("part")
    earlier = lambda c: F.coalesce(F.sum(c).over(far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = every.groupBy(*line, "part").agg(F.sum("b").alias("b"), F.sum("e").alias("e"), F.min("at").alias("head"))
    parts = parts.select(*[F.col(c).alias(f"p_{c}") for c in (*line, "part")], earlier("b").alias("b0"), earlier("e").alias("e0"), F.lead("head").over(far).alias("next"))
    near = Window.partitionBy(*line, "part").orderBy("at")
    runs = every.select(*line, "part", "at", F.sum("b").over(near).alias("b"), F.sum("e").over(near).alias("e"), F.lead("at").over(near).alias("then"))
    runs = runs.select(*[F.col(c).alias(f"s_{c}") for c in line], "part", "at", "b", "e", "then")
    on = same_line(labels, "s_", "p_") & (F.col("part") == F.col("p_part"))
    return runs.join(parts, on).select(
        *[F.col(f"s_{c}").alias(c) for c in line], F.col("at").alias("start_pos"), F.coalesce("then", "next", F.col("at") + 1).alias("end_pos"),
        (F.col("b") + F.col("b0")).alias("begun"), (F.col("e") + F.col("e0")).alias("ended"),
    )


def label_counts(left: DataFrame, right: DataFrame, labels: list[str], min_overlap: int = 99, width: int = STEP_BIN) -> DataFrame:
    """``label_hits`` with ``n``, the number of regions of the label that the row meets; no pairs are made.

    Of regions and a row, both cut by ``min_overlap``, those begin before the row ends that it meets or that end before it
    starts.  So n is a difference of two running counts over a label's bounds, each looked up in the one step that holds
    the row's bound.  Left rows of one place ask once.
    """
    steps = settle(bound_steps(right, labels, min_overlap))
    s = steps.select(*[F.col(c).alias(f"s_{c}") for c in steps.columns])
    s, top = region_side(s, F.col("s_start_pos"), F.col("s_end_pos") - 1, width, 0, STEP_ROWS)
    lab = [f"r_{c}" for c in labels]
    asks = line_hits(left.select(*SPOT).distinct(), right, labels, min_overlap).withColumn("r_chrom", F.col("chrom"))

    def look(df: DataFrame, pos: Column, value: str) -> DataFrame:
        on = same_line(labels, "r_", "s_") & (F.col("_cell") == F.col("_rcell")) & (F.col("_at") >= F.col("s_start_pos")) & (F.col("_at") < F.col("s_end_pos"))
        at = with_point(df.withColumn("_at", pos), F.col("_at"), width, top)
        return at.join(s, on).select(*df.columns, F.col(f"s_{value}").alias(f"_{value}"))

    asks = look(asks, F.least(F.col("end_pos") - min_overlap - 1, "r__last"), "begun")
    asks = look(asks, F.greatest(F.col("start_pos"), F.col("r__first") - 1), "ended")
    n = asks.select(*SPOT, *lab, (F.col("_begun") - F.col("_ended")).alias("n"))
    return left.join(n, SPOT).select(*left.columns, *lab, "n")


def touching(left: DataFrame, right: DataFrame, min_overlap: int = 0) -> DataFrame:
    """Semi join: rows of ``left`` that overlap any row of ``right``."""
    return label_hits(left, right, [], min_overlap)


def contained(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs in which the left interval lies fully inside the right one (``r_``); overlapping windows keep all pairs."""
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    rb, top = region_side(r, F.col("r_start_pos"), F.col("r_end_pos"), width, 0)
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("_cell") == F.col("_rcell"))
    pairs = with_point(left, F.col("start_pos"), width, top).join(rb, on & (F.col("start_pos") >= F.col("r_start_pos")) & (F.col("end_pos") <= F.col("r_end_pos")))
    return pairs.drop("_cell", "_rcell", "_rlev")


def with_point(df: DataFrame, pos: Column, width: int, top: int) -> DataFrame:
    """Each row once per level up to ``top``, in the bin that holds ``pos``; a region is in the bins of one level only."""
    return df.withColumn("_cell", F.explode(F.array(*[F.floor(pos / (width * STEP**k)) * 4 + k for k in range(top + 1)])))


def points_in(points: DataFrame, regions: DataFrame, before: int = 0, after: int = 0, width: int = BIN, pos: str = "pos") -> DataFrame:
    """Pairs with ``start_pos - before <= pos <= end_pos + after``, both ends inclusive; chromosome names as given."""
    r = regions.select(*[F.col(c).alias(f"r_{c}") for c in regions.columns])
    rb, top = region_side(r, F.col("r_start_pos") - before, F.col("r_end_pos") + after, width, 0)
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("_cell") == F.col("_rcell"))
    near = F.col(pos).between(F.col("r_start_pos") - before, F.col("r_end_pos") + after)
    return with_point(points, F.col(pos), width, top).join(rb, on & near).drop("_cell", "_rcell", "_rlev")


def islands(df: DataFrame, keys: list[str], slack: int = 0) -> DataFrame:
    """``df`` plus ``island``: the number, within ``keys``, of the run of rows with start <= running end + slack."""
    order = Window.partitionBy(*keys).orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start_pos") > reach + slack), 1).otherwise(0)
    return df.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(order)).drop("_new")


def merge_regions(df: DataFrame, keys: list[str], slack: int = 0, names: str | None = "name", width: int = 1_000_000) -> DataFrame:
    """Overlapping or touching regions united per ``keys``: bounds, row count and sorted distinct names.

    Regions are first united within (keys, stretch of the chromosome), which many tasks share and which shrinks
    the input of the pass over whole chromosomes.  The result does not depend on row order.
    """
    name = F.array_sort(F.collect_set(names)) if names else None
    aggs = [F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")]
    near = islands(df.withColumn("_part", F.floor(F.col("start_pos") / width)), [*keys, "_part"], slack)
    first = near.groupBy(*keys, "_part", "island").agg(*aggs, F.count("*").alias("n"), *([name.alias("names")] if names else [])).drop("_part", "island")
    far = islands(first, keys, slack).groupBy(*keys, "island").agg(
        *aggs, F.sum("n").alias("n"), *([F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names")] if names else [])
    )
    return far.drop("island")


def collapse_ranges(df: DataFrame, keys: list[str], slack: int = 10_000, keep: tuple[str, ...] = ("name",)) -> DataFrame:
    """Ranges within ``slack`` united after dropping repeats; other columns from the first row by (start, end, value)."""
    marked = islands(df.select(*keys, "start_pos", "end_pos", *keep).distinct(), keys, slack)
    first = F.struct("start_pos", "end_pos", *keep)
    out = marked.groupBy(*keys, "island").agg(F.min("start_pos").alias("lo"), F.max("end_pos").alias("hi"), F.min(first).alias("_f"))
    return out.select(*keys, F.col("lo").alias("start_pos"), F.col("hi").alias("end_pos"), *[F.col(f"_f.{c}").alias(c) for c in keep])


def unstranded_twice(df: DataFrame) -> DataFrame:
    """Regions of strand ``.`` become one ``+`` and one ``-`` row."""
    return df.withColumn("strand", F.explode(F.when(F.col("strand") == ".", F.array(F.lit("+"), F.lit("-"))).otherwise(F.array("strand"))))


def expand_to_breakpoints(df: DataFrame, by: int = 10_000) -> DataFrame:
    """Each region becomes four: both ends, both strands, ``by`` bases around, starts floored at 0."""
    ends = F.explode(F.array(F.col("start_pos"), F.col("end_pos")))
    return df.withColumn("_e", ends).withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-")))).withColumn(
        "start_pos", F.greatest(F.col("_e") - by, F.lit(0))
    ).withColumn("end_pos", F.col("_e") + by).drop("_e")


def genome_share(regions: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: bases covered on each strand, clipped to chromosome length, and their share of twice the genome."""
    clipped = regions.join(small(lengths), "chrom").withColumn(
        "_b", F.greatest(F.lit(0), F.least("end_pos", "length") - F.greatest(F.col("start_pos"), F.lit(0)))
    )
    plus, minus = (F.coalesce(F.sum(F.when(F.col("strand") == s, F.col("_b"))), F.lit(0)) for s in "+-")
    total = lengths.agg(F.sum("length").alias("genome"))
    return clipped.agg(plus.alias("plus_bases"), minus.alias("minus_bases")).crossJoin(total).withColumn(
        "share", F.round((F.col("plus_bases") + F.col("minus_bases")) / (2 * F.col("genome")), 9)
    )


def chrom_order(chrom: Column) -> Column:
    """Sort key of chromosome names: 1..22, X, Y, M, then others."""
    name = F.regexp_replace(chrom, "^chr", "")
    number = F.when(name.rlike("^[0-9]{1,2}$"), name.cast("int"))
    return F.coalesce(number, F.when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), 25).otherwise(26))

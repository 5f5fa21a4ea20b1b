"""Density clusters of breakpoint pairs, and the table of events made of them.

DBSCAN in the plane of the two alignments' midpoints, in Manhattan distance, without comparing all pairs of a dense
place.  Coordinates are doubled (start + end), so midpoints are whole numbers and distances exact.

The plane is cut into cells whose side is half the reach, so that points of one cell are always neighbours:

* a cell with ``least`` pairs is *full*: all its points are core points of one cluster and need no comparison;
* a point of any other cell is compared with the 25 cells around it.  Such cells hold under ``least`` pairs each, so a
  point, in however dense a place, meets a bounded number of them;
* two full cells are joined if any two of their points are neighbours.  For cells one above the other that is the least
  of |dx| + dy; it needs only the highest point per x of the lower cell and the lowest per x of the upper one, and a
  running maximum over x.  Cells side by side go the same way with the axes exchanged.
  Most full cells are joined by their outermost points already; only pairs of cells that these leave apart go that way.

Full cells and single core points are then the nodes of a graph whose components are the clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.operators.fusion import MIN_SUPPORT, components
from loomseq.operators.intervals import islands
from loomseq.sources.scratch import drop, settle

READ = ["sample", "read_id"]
PLACE = ["chrom_1", "chrom_2"]


def _around(df: DataFrame, reach: int = 2) -> DataFrame:
    """Each row once per cell around its own, as (nx, ny)."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return df.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumns(
        {"nx": F.col("cx") + F.col("_i"), "ny": F.col("cy") + F.col("_j")}
    ).drop("_i", "_j")


#: From a full cell to those above it and beside it that can hold a neighbour; the others are steps from there to here.
SIDEWAYS, ALONG = [(i, j) for j in (1, 2) for i in range(-2, 3)], [(1, 0), (2, 0)]


def _outer_links(full_spots: DataFrame, keys: list[str], reach: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of full cells within two steps of each other, as (keys, cx, cy, i, j): those whose outermost points are at most ``reach`` apart, and the rest."""
    ways = [F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")]
    tips = F.array(*[f(F.struct("x", "y"), w) for w in ways for f in (F.min_by, F.max_by)])
    cells = settle(full_spots.groupBy(*keys, "cx", "cy").agg(tips.alias("tips")))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in SIDEWAYS + ALONG])
    one = cells.withColumn("_s", F.explode(steps)).select(*keys, "cx", "cy", "_s.*", (F.col("cx") + F.col("_s.i")).alias("nx"), (F.col("cy") + F.col("_s.j")).alias("ny"), "tips")
    other = cells.select(*keys, F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("tips").alias("tips2"))
    near = lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]) <= reach
    met = one.join(other, [*keys, "nx", "ny"]).select(*keys, "cx", "cy", "i", "j", F.exists("tips", lambda a: F.exists("tips2", lambda b: near(a, b))).alias("close"))
    met = settle(met)
    drop(cells)
    return met.where("close").drop("close"), met.where("not close").drop("close")


def _close_cells(full_spots: DataFrame, keys: list[str], reach: int, asked: DataFrame) -> DataFrame:
    """Those of the pairs of full cells in ``asked`` (keys, cx, cy, i, j) that hold two points at most ``reach`` apart."""
    out = None
    # a runs along the border between two cells, b across it; cells of one row wait for the second round
    for a, b, some in (("x", "y", F.col("j") > 0), ("y", "x", F.col("j") == 0)):
        low = full_spots.groupBy(*keys, "cx", "cy", F.col(a).alias("along")).agg(F.max(b).alias("top"), F.min(b).alias("foot"))
        # a pair is named by its lower cell and the step to the upper one
        pair = [*keys, "la", "lb", "i", "j"]
        lower = asked.where(some).select(*keys, "cx", "cy", F.col("cx").alias("la"), F.col("cy").alias("lb"), "i", "j")
        upper = asked.where(some).select(*keys, (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"), F.col("cx").alias("la"), F.col("cy").alias("lb"), "i", "j")
        below = low.join(lower, [*keys, "cx", "cy"]).select(*pair, "along", F.col("top").alias("h"), F.lit(True).alias("lower"))
        above = low.join(upper, [*keys, "cx", "cy"]).select(*pair, "along", F.col("foot").alias("h"), F.lit(False).alias("lower"))
        both = below.unionByName(above)
        order = Window.partitionBy(*pair).orderBy("along")
        left = F.max(F.when(F.col("lower"), F.col("h") + F.col("along"))).over(order.rangeBetween(Window.unboundedPreceding, 0))
        right = F.max(F.when(F.col("lower"), F.col("h") - F.col("along"))).over(order.rangeBetween(0, Window.unboundedFollowing))
        gap = F.least(F.col("h") + F.col("along") - left, F.col("h") - F.col("along") - right)
        met = both.withColumn("_gap", F.when(~F.col("lower"), gap)).groupBy(*pair).agg(F.min("_gap").alias("_gap")).where(F.col("_gap") <= reach)
        met = met.select(*keys, F.col("la").alias("cx"), F.col("lb").alias("cy"), "i", "j")
        out = met if out is None else out.unionByName(met)
    return out


def spot_clusters(spots: DataFrame, keys: list[str], eps: float, least: int) -> DataFrame:
    """(keys, x, y, cluster) for the points of ``spots`` (keys, doubled x and y, w) that belong to a cluster.

    ``cluster`` is the smallest (x, y) of the cluster's core points.  A border point goes to the cluster of the smallest
    number that has a core point in reach, which is where a scan by (x, y) puts it; noise is left out.
    """
    reach, side = int(2 * eps), max(1, int(eps))
    on = [*keys, "x", "y"]
    cells = Window.partitionBy(*keys, "cx", "cy")
    own = spots.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})
    weight = own.groupBy(*keys, "cx", "cy").agg(F.sum("w").alias("_cw"))
    own = settle(own.join(weight, [*keys, "cx", "cy"]).withColumn("full", F.col("_cw") >= least).drop("_cw"))
    thin = own.where("not full")
    other = own.select(*keys, F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("w").alias("w2"), F.col("full").alias("full2"))
    apart = F.abs(F.col("x") - F.col("x2")) + F.abs(F.col("y") - F.col("y2"))
    near = settle(_around(thin.select(*on, "cx", "cy")).join(other, [*keys, "nx", "ny"]).where(apart <= reach).select(*on, "x2", "y2", "w2", "full2", "nx", "ny"))
    thin_core = settle(near.groupBy(*on).agg(F.sum("w2").alias("_n")).where(F.col("_n") >= least).select(*on))
    spot = lambda x, y: F.concat_ws(":", *keys, F.lit("p"), F.col(x), F.col(y))
    cell = lambda x, y: F.concat_ws(":", *keys, F.lit("c"), F.col(x), F.col(y))
    seen = near.join(thin_core, on)
    to_cell = seen.where("full2").select(spot("x", "y").alias("src"), cell("nx", "ny").alias("dst"))
    to_spot = seen.where("not full2").join(thin_core.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2")), [*keys, "x2", "y2"]).select(spot("x", "y").alias("src"), spot("x2", "y2").alias("dst"))
    ends = lambda df: df.withColumns({"_x": F.col("cx") + F.col("i"), "_y": F.col("cy") + F.col("j")}).withColumns({"src": cell("cx", "cy"), "dst": cell("_x", "_y")}).drop("_x", "_y")
    joined, rest = (ends(p) for p in _outer_links(own.where("full"), keys, reach))
    known = settle(joined.select("src", "dst").union(to_cell).union(to_spot).where("src <> dst").distinct())
    parts = settle(components(known))
    # a pair of cells that other links join already needs no answer
    group = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    apart_yet = F.coalesce("src_c", "src") != F.coalesce("dst_c", "dst")
    asked = settle(rest.join(group("src"), "src", "left").join(group("dst"), "dst", "left").where(apart_yet).select(*keys, "cx", "cy", "i", "j"))
    if not asked.isEmpty():
        more = settle(known.union(ends(_close_cells(own.where("full"), keys, reach, asked)).select("src", "dst")))
        drop(parts)
        parts = settle(components(more))
    cores = own.where("full").select(*on, cell("cx", "cy").alias("node")).unionByName(thin_core.select(*on, spot("x", "y").alias("node")))
    named = cores.join(parts, "node", "left").withColumn("_g", F.coalesce("component", "node"))
    least_spot = named.groupBy("_g").agg(F.min(F.struct("x", "y")).alias("cluster"))
    core = settle(named.join(least_spot, "_g").select(*on, "cluster"))
    rim = near.join(thin_core, on, "left_anti").join(core.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2"), "cluster"), [*keys, "x2", "y2"])
    out = settle(core.unionByName(rim.groupBy(*on).agg(F.min("cluster").alias("cluster"))))
    drop(own, near, thin_core, parts, core)
    return out


def density_clusters(pairs: DataFrame, eps: float = 7_500, least: int = MIN_SUPPORT, by: tuple[str, ...] = ()) -> DataFrame:
    """Clusters of breakpoint pairs (from ``breakpoint_pairs``) per chromosome pair and ``by``, with ``least`` or more reads.

    Columns: ``by``, chrom_1, chrom_2, and per side start, end (the box around its alignments), span and, where pairs have it, mapq
    (means over the cluster's pairs); support = distinct reads.
    """
    keys = [*by, *PLACE]
    at = pairs.withColumns({"x": F.col("start_pos_1") + F.col("end_pos_1"), "y": F.col("start_pos_2") + F.col("end_pos_2")})
    member = spot_clusters(at.groupBy(*keys, "x", "y").agg(F.count("*").alias("w")), keys, eps, least)
    means = [F.avg(F.col(f"end_pos_{k}") - F.col(f"start_pos_{k}")).alias(f"span_{k}") for k in (1, 2)]
    means += [F.avg(c).alias(c) for c in ("mapq_1", "mapq_2") if c in pairs.columns]
    box = [f(f"{c}_pos_{k}").alias(f"{c}_{k}") for k in (1, 2) for c, f in (("start", F.min), ("end", F.max))]
    out = at.join(member, [*keys, "x", "y"]).groupBy(*keys, "cluster").agg(*box, F.countDistinct(*READ).alias("support"), *means)
    return out.where(F.col("support") >= least).drop("cluster")


def event_pairs(aln: DataFrame, min_mapq: int = 50) -> DataFrame:
    """Breakpoint pairs for the event table: every primary alignment beside each supplementary one of ``min_mapq`` or more."""
    from loomseq.operators.fusion import breakpoint_pairs

    return breakpoint_pairs(aln.where(~F.col("is_supplementary") | (F.col("mapq") >= min_mapq)))


def event_table(pairs: DataFrame, eps: float = 7_500, distance: int = 5_000, least: int = MIN_SUPPORT, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """The events of each ``by``: both sides of every cluster, events of one kind within ``distance`` of each other united.

    Columns: ``by``, chrom, start_pos, end_pos, event_type (breakpoint_pair_primary or _supplementary), read_count,
    avg_mapping_quality (one digit) and avg_mapping_span (whole): the largest of the united events each.  A side that starts at 0 or
    has no length makes no event.  Order them by read_count descending, chrom, start_pos to show them.
    """
    found = density_clusters(pairs, eps, least, by)

    def side(k: int, kind: str) -> Column:
        return F.struct(
            F.col(f"chrom_{k}").alias("chrom"), F.col(f"start_{k}").alias("start_pos"), F.col(f"end_{k}").alias("end_pos"), F.lit(f"breakpoint_pair_{kind}").alias("event_type"),
            F.bround(f"mapq_{k}", 1).alias("avg_mapping_quality"), F.bround(f"span_{k}", 0).alias("avg_mapping_span"),
        )

    events = found.select(*by, F.col("support").alias("read_count"), F.explode(F.array(side(1, "primary"), side(2, "supplementary"))).alias("_e"))
    events = events.select(*by, "_e.*", "read_count").where("start_pos > 0 and end_pos > start_pos")
    keys = [*by, "chrom", "event_type"]
    return islands(events, keys, distance).groupBy(*keys, "island").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.max("read_count").alias("read_count"),
        F.max("avg_mapping_quality").alias("avg_mapping_quality"), F.max("avg_mapping_span").alias("avg_mapping_span"),
    ).drop("island")

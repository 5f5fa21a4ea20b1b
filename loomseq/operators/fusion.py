"""Gene fusions from split reads: candidates, tags and support, artifacts, breakpoints, clusters, gene groups."""

from __future__ import annotations

from collections import deque
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomseq.sources.scratch import drop, settle

MIN_SUPPORT = 3
READ = ["sample", "read_id"]
#: Rows of a read are brought together by the id first: samples are few, and a sort that begins with them compares whole rows.
BY_READ = READ[::-1]


def candidates(hits: DataFrame) -> DataFrame:
    """Alignment-gene hits of reads that meet more than one gene: gathered once per read, whose hits are few."""
    rest = [c for c in hits.columns if c not in READ]
    per = hits.groupBy(*BY_READ).agg(F.collect_set("gene").alias("_genes"), F.collect_list(F.struct(*rest)).alias("_hits")).where(F.size("_genes") > 1)
    return per.select(*READ, F.explode("_hits").alias("_h")).select(*[c if c in READ else F.col(f"_h.{c}").alias(c) for c in hits.columns])


def read_genes(hits: DataFrame, genes: int = 1) -> DataFrame:
    """Each read with its distinct genes in order (``genes``), of reads with at least so many."""
    return hits.groupBy(*BY_READ).agg(F.array_sort(F.collect_set("gene")).alias("genes")).where(F.size("genes") >= genes).select(*READ, "genes")


def read_tags(hits: DataFrame, genes: int = 0) -> DataFrame:
    """Each read's tag, its distinct genes in order, joined by a comma; of reads with at least ``genes`` genes."""
    return set_tags(read_genes(hits, genes))


def set_tags(sets: DataFrame) -> DataFrame:
    """The tags of reads given with their ``genes``."""
    return sets.select(*READ, F.array_join("genes", ",").alias("tag"))


def tag_support(hits: DataFrame, least: int = MIN_SUPPORT, genes: int = 0) -> DataFrame:
    """Tags with at least ``least`` distinct reads (a read has one tag)."""
    return set_support(read_genes(hits, genes), least)


def set_support(sets: DataFrame, least: int = MIN_SUPPORT) -> DataFrame:
    """``tag_support`` of reads given with their ``genes``."""
    return set_tags(sets).groupBy("tag").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def supported_middles(hits: DataFrame, least: int = MIN_SUPPORT) -> DataFrame:
    """(chrom, mid): distinct middles of the alignments of reads with more than one gene whose tag has ``least`` reads.

    A read's tag and middles are gathered once, in one row, for both the count of its tag and what comes of it.
    """
    mid = F.struct("chrom", F.floor((F.col("start_pos") + F.col("end_pos")) / 2).alias("mid"))
    per = hits.groupBy(*BY_READ).agg(F.collect_set("gene").alias("genes"), F.collect_set(mid).alias("mids")).where(F.size("genes") > 1)
    per = settle(per.select(*READ, F.array_join(F.array_sort("genes"), ",").alias("tag"), "mids"))
    told = per.groupBy("tag").agg(F.count("*").alias("support")).where(F.col("support") >= least).select("tag")
    named = per.where(F.col("sample").isNotNull() & F.col("read_id").isNotNull())
    return named.join(told, "tag", "left_semi").select(F.explode("mids").alias("m")).select("m.*").distinct()


def artifact_reads(hits: DataFrame, similar: int = 50) -> DataFrame:
    """Reads one alignment of which meets two genes, or with two alignments whose ends both lie within ``similar``.

    Two different alignments are compared within their read, from one row per read; an alignment that meets several genes
    shows as more (alignment, gene) pairs than alignments.
    """
    spot = F.struct("chrom", "start_pos", "end_pos")
    per = hits.groupBy(*READ).agg(F.collect_set(spot).alias("_spots"), F.size(F.collect_set(F.struct(spot.alias("s"), "gene"))).alias("_pairs"))

    def near(a, b):
        return (a["chrom"] == b["chrom"]) & (a != b) & (F.abs(a["start_pos"] - b["start_pos"]) <= similar) & (F.abs(a["end_pos"] - b["end_pos"]) <= similar)

    close = F.exists("_spots", lambda a: F.exists("_spots", lambda b: near(a, b)))
    return per.where((F.col("_pairs") > F.size("_spots")) | close).select(*READ)


def breakpoint_pairs(aln: DataFrame) -> DataFrame:
    """Every primary alignment of a read beside every supplementary one."""
    side = ["chrom", "start_pos", "end_pos", "strand", "mapq"]
    p = aln.where(~F.col("is_supplementary")).select(*READ, *[F.col(c).alias(f"{c}_1") for c in side])
    s = aln.where("is_supplementary").select(*READ, *[F.col(c).alias(f"{c}_2") for c in side])
    return p.join(s, READ)


def binned_pairs(pairs: DataFrame, width: int = 500, least: int = MIN_SUPPORT) -> DataFrame:
    """Pairs by the bins of their midpoints, endpoints in canonical order, with ``least`` or more distinct reads."""

    def end(k: int):
        mid = F.floor((F.col(f"start_pos_{k}") + F.col(f"end_pos_{k}")) / 2)
        return F.struct(F.col(f"chrom_{k}").alias("chrom"), (F.floor(mid / width) * width).alias("pos"), F.col(f"strand_{k}").alias("strand"))

    ends = pairs.select(*READ, F.least(end(1), end(2)).alias("a"), F.greatest(end(1), end(2)).alias("b"))
    return ends.groupBy("a", "b").agg(F.countDistinct(*READ).alias("support")).where(F.col("support") >= least).select(
        F.col("a.chrom").alias("chrom_1"), F.col("a.pos").alias("pos_1"), F.col("a.strand").alias("strand_1"),
        F.col("b.chrom").alias("chrom_2"), F.col("b.pos").alias("pos_2"), F.col("b.strand").alias("strand_2"), "support",
    )


def breakpoint_regions(binned: DataFrame, width: int = 500) -> DataFrame:
    """Both ends of binned pairs as distinct regions of one bin before to one bin after."""
    ends = [binned.select(F.col(f"chrom_{k}").alias("chrom"), (F.greatest(F.col(f"pos_{k}") - width, F.lit(0))).alias("start_pos"), (F.col(f"pos_{k}") + width).alias("end_pos"), F.col(f"strand_{k}").alias("strand")) for k in (1, 2)]
    return ends[0].union(ends[1]).distinct()


def gene_pairs(hits: DataFrame) -> DataFrame:
    """All gene pairs of a read (gene_1 < gene_2) with each gene's first alignment and the smaller quality."""
    first = F.min(F.struct("chrom", "start_pos", "end_pos", "mapq")).alias("f")
    g = hits.groupBy(*READ, "gene").agg(first)
    a = g.select(*READ, F.col("gene").alias("gene_1"), F.col("f").alias("f1"))
    b = g.select(*READ, F.col("gene").alias("gene_2"), F.col("f").alias("f2"))
    return a.join(b, READ).where("gene_1 < gene_2").select(
        *READ, "gene_1", "gene_2", F.col("f1.chrom").alias("chrom_1"), F.col("f1.start_pos").alias("pos_1"),
        F.col("f2.chrom").alias("chrom_2"), F.col("f2.start_pos").alias("pos_2"), F.least("f1.mapq", "f2.mapq").alias("mapq"),
    )


def pair_support(hits: DataFrame, least: int = 4) -> DataFrame:
    """Gene pairs with ``least`` or more distinct reads, without regard to where they break."""
    return set_pairs(read_genes(hits, 2), least)


def set_pairs(sets: DataFrame, least: int = 4) -> DataFrame:
    """``pair_support`` of reads given with their ``genes``."""
    named = sets.where(F.col("sample").isNotNull() & F.col("read_id").isNotNull())
    pairs = named.select("genes", F.posexplode("genes").alias("at", "gene_1"))
    pairs = pairs.select("gene_1", F.explode(F.slice("genes", F.col("at") + 2, F.size("genes"))).alias("gene_2"))
    return pairs.groupBy("gene_1", "gene_2").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def greedy_clusters(pairs: DataFrame, distance: int = 100, least: int = 4) -> DataFrame:
    """Pairs of one gene pair and chromosome pair grouped around seeds; groups of ``least`` or more reads.

    Rows are taken by (pos_1, pos_2, sample, read_id), so the result does not depend on arrival; a row joins the first
    seed within ``distance`` at both ends, or becomes a seed.

    A seed takes no row beyond a stretch of ``distance`` bases without first ends, so a gene pair is dealt out by such
    stretches: its occupied cells of that width, not its rows, are put in order.  A task walks its sorted rows and holds
    only the seeds still in reach, by the cell of their second end.
    """
    key = ["gene_1", "gene_2", "chrom_1", "chrom_2"]
    ends = ["pos_1", "pos_2"]
    shape = StructType([*[pairs.schema[c] for c in key], *[StructField(c, LongType()) for c in (*ends, "support")]])
    celled = settle(pairs.withColumn("_c", F.floor(F.col("pos_1") / distance)))
    order = Window.partitionBy(*key).orderBy("_c")
    held = celled.select(*key, "_c").distinct().withColumn("_new", (F.col("_c") - F.lag("_c").over(order) > 1).cast("int"))
    held = held.withColumn("part", F.floor(F.sum(F.coalesce("_new", F.lit(0))).over(order) / 256)).drop("_new")
    dealt = celled.join(held, [*key, "_c"]).select(*key, "part", *ends, *READ).repartition(*key, "part").sortWithinPartitions(*key, "part", *ends, *READ)

    def run(batches):
        group, seeds, reach, ticket = None, deque(), {}, count()

        def leave(done: list) -> None:
            a, b, reads = seeds.popleft()
            near = reach[b // distance]
            near.popleft()  # seeds of a cell leave in the order they came
            if not near:
                del reach[b // distance]
            if len(reads) >= least:
                done.append((*group[:-1], a, b, len(reads)))

        for pdf in batches:
            done: list[tuple] = []
            for g1, g2, c1, c2, part, a, b, sample, read in pdf.itertuples(index=False, name=None):
                if (g1, g2, c1, c2, part) != group:
                    while seeds:
                        leave(done)
                    group = (g1, g2, c1, c2, part)
                while seeds and seeds[0][0] < a - distance:  # seeds are in the order of their first end
                    leave(done)
                c = b // distance
                # the first seed in reach, by the order in which seeds came
                near = [(at, seed) for k in (c - 1, c, c + 1) for at, seed in reach.get(k, ()) if abs(b - seed[1]) <= distance]
                if near:
                    min(near, key=lambda n: n[0])[1][2].add((sample, read))
                else:
                    seed = (a, b, {(sample, read)})
                    reach.setdefault(c, deque()).append((next(ticket), seed))
                    seeds.append(seed)
            yield pd.DataFrame(done, columns=shape.names)
        done = []
        while seeds:
            leave(done)
        yield pd.DataFrame(done, columns=shape.names)

    return dealt.mapInPandas(run, shape)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by min-label rounds over an undirected edge list (src, dst).

    Labels halve their paths each round (a node also takes its label's label), and rounds go on until none moves.  Every
    round is a scratch table, so lost executors cost no recomputation of earlier ones.
    """
    there = edges.where("src <> dst").select("src", "dst")
    both = settle(there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = settle(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("component"), F.lit(True).alias("moved")))
    while True:
        heard = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("m"))
        near = labels.join(heard, labels["node"] == heard["src"]).select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        lowest = F.least("component", F.coalesce("up", "component"))
        new = settle(near.join(up, "component", "left").select("node", lowest.alias("component"), (lowest != F.col("old")).alias("moved")))
        drop(labels)
        labels = new
        if labels.where("moved").isEmpty():
            drop(both)
            return labels.drop("moved")


def gene_groups(hits: DataFrame, least: int = MIN_SUPPORT) -> DataFrame:
    """Connected groups of genes: tags of exactly two genes are edges; groups with ``least`` or more distinct reads."""
    return edge_groups(pair_edges(hits), least)


def pair_edges(hits: DataFrame, *by: Column) -> DataFrame:
    """(src, dst, ``by``, n): gene pairs that are a read's whole tag, with the number of such reads."""
    return set_edges(read_genes(hits, 2), *by)


def set_edges(sets: DataFrame, *by: Column) -> DataFrame:
    """``pair_edges`` of reads given with their ``genes``."""
    tags = set_tags(sets).withColumn("g", F.split("tag", ",")).where(F.size("g") == 2)
    return tags.groupBy(F.col("g")[0].alias("src"), F.col("g")[1].alias("dst"), *by).agg(F.count("*").alias("n"))


def edge_groups(edges: DataFrame, least: int = MIN_SUPPORT) -> DataFrame:
    """(genes, support) of the connected groups of an edge list with read counts; a read counts for one edge only."""
    edges = settle(edges)
    parts = components(edges)
    reads = edges.join(parts, edges["src"] == parts["node"]).groupBy("component").agg(F.sum("n").alias("support"))
    genes = parts.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("node")), ",").alias("genes"))
    return genes.join(reads, "component").where(F.col("support") >= least).select("genes", "support")


def merge_events(events: DataFrame, distance: int = 5_000) -> DataFrame:
    """Events of one chromosome and type with gaps of at most ``distance`` united: largest support and mean quality."""
    from loomseq.operators.intervals import islands

    return islands(events, ["chrom", "event_type"], distance).groupBy("chrom", "event_type", "island").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.max("support").alias("support"), F.count("*").alias("n")
    ).drop("island")


def validated_genes(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Gene pairs beside the groups that hold both genes."""
    g = groups.select(F.col("genes").alias("group_genes"), F.split("genes", ",").alias("_g"))
    each = g.select("group_genes", F.explode("_g").alias("gene_1"), "_g")
    return pairs.join(each, "gene_1").where(F.array_contains("_g", F.col("gene_2"))).drop("_g")


def newly_supported(seen: DataFrame, batch: DataFrame, keys: list[str], least: int = MIN_SUPPORT) -> DataFrame:
    """Keys whose distinct reads first reach ``least`` with this batch; ``seen`` and ``batch`` hold (keys, read_id)."""
    before = seen.select(*keys, "read_id").distinct().groupBy(*keys).agg(F.count("*").alias("b"))
    after = seen.select(*keys, "read_id").union(batch.select(*keys, "read_id")).distinct().groupBy(*keys).agg(F.count("*").alias("support"))
    return after.join(before, keys, "left").where((F.col("support") >= least) & (F.coalesce("b", F.lit(0)) < least)).drop("b")

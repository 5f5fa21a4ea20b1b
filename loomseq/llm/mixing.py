"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies expected of each of its documents.  The whole part is given to
every document (certain copies); the rest is an inclusion probability.  Documents are then ranked by random odds
divided by inclusion odds, and a sample of fixed size is taken from the front of that order.

One order per source would leave its words to the luck of a few long documents, so the order is taken per (source, power
of two of the size), from the longest documents down: what a class takes above or below its share is made up by the sample
sizes of the classes below it.  Spark counts documents and words per cell of the rank; the sample sizes of one source are
found from its cells, whose number is bounded whatever the input, and each document reads its fate from its source's cuts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseq.llm.common import cut, drop_cut

#: The weights of sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No document, and so no source, is taken more often than this.
MOST = 3
#: Cells of the rank in a (source, size class).
CELLS = 1 << 14
#: Fully equal rows are numbered in runs of this many.
RUN = 1_000
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["_id", "_s", "_t", "_v"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(_s, source_size) with weight and ``target``: all sizes shared by weight, no target above ``most`` times its size.

    ``_s`` sorts null last.  Taking the capped sources out in the order of cap over weight gives a level that rises until no
    more are capped; the highest one is the level at which every source stands or is capped.  The rows here are sources.
    """
    at = F.pmod(F.row_number().over(Window.orderBy("_s")) - 1, F.lit(len(weights))) + 1
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), at.cast("int")))
    top = F.lit(float(most)) * F.col("source_size")
    order = Window.orderBy(top / F.col("weight"), "_s")
    gone = F.coalesce(F.sum(top).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(Window.partitionBy()) - gone) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    out = w.withColumn("_level", level)
    return out.withColumn("target", F.least(top, F.max("_level").over(Window.partitionBy()) * F.col("weight"))).drop("_level")


def units(docs: DataFrame, key: str, value: str | None) -> DataFrame:
    """One row per different (id, source, text, value) with its words and how many equal rows there are (``_m``)."""
    text = F.col("`text`")
    source = F.coalesce(F.concat(F.lit("s"), F.col("`source`").cast("string")), F.lit("t"))
    v = F.greatest(F.coalesce(F.nanvl(F.col(f"`{value}`").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) if value else F.lit(1.0)
    rows = docs.select(F.col(f"`{key}`").alias("_id"), source.alias("_s"), F.xxhash64(text).alias("_t"), v.alias("_v"), word_count(text).alias("size"))
    return rows.groupBy(*KEY, "size").agg(F.count("*").alias("_m"))


def numbered(table: DataFrame) -> DataFrame:
    """Equal rows told apart by ``_k``; large groups are numbered run by run, in many tasks."""
    few = table.where(F.col("_m") <= RUN).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    runs = table.where(F.col("_m") > RUN).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / RUN))))
    runs = runs.repartition(*KEY, "_r")
    many = runs.withColumn("_k", F.explode(F.sequence(F.col("_r") * RUN, F.least(F.col("_m"), (F.col("_r") + 1) * RUN) - 1)))
    return few.unionByName(many.drop("_r"))


def expected_copies(table: DataFrame, sources: DataFrame, value: str | None, most: float) -> DataFrame:
    """``sources`` with ``_c``: a document of value v is expected min(most, _c * v) times, which adds up to the target.

    Without values that is target over size.  With values, documents that reach ``most`` are capped and the rest of the
    target is shared again until no more are; every round is one aggregation by source.
    """
    if value is None:
        return sources.withColumn("_c", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    cur, before = sources.withColumn("_c", F.lit(0.0)), -1
    while True:
        full = F.col("_c") * F.col("_v") >= most
        words = F.col("size") * F.col("_m")
        per = table.join(cur.select("_s", "_c"), "_s").groupBy("_s").agg(
            F.sum(F.when(full, words).otherwise(0)).alias("_full"), F.sum(F.when(full, F.lit(0.0)).otherwise(words * F.col("_v"))).alias("_open"), F.count(F.when(full, 1)).alias("_n"),
        )
        new = cut(cur.drop("_n").join(per, "_s").select("_s", "source_size", "weight", "target", F.when(F.col("_open") > 0, (F.col("target") - most * F.col("_full")) / F.col("_open")).otherwise(F.col("_c")).alias("_c"), "_n"), "mixrates")
        drop_cut(cur)
        cur, now = new, new.agg(F.sum("_n")).head()[0]
        if now == before:
            return cur.drop("_n")
        before = now


def uniform(seed: int) -> Column:
    """A number in (0, 1) that depends on the document, its source, its text and its place among equal rows alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_id", "_s", "_t", "_k"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def ranked(rows: DataFrame, most: float, seed: int) -> DataFrame:
    """``rows`` with certain copies, inclusion probability, size class, Pareto rank and the rank's cell."""
    e = F.least(F.lit(float(most)), F.col("_c") * F.col("_v"))
    out = rows.withColumn("_e", e).withColumn("_sure", F.floor("_e").cast("long")).withColumn("_p", F.col("_e") - F.col("_sure"))
    out = out.withColumn("_u", uniform(seed)).withColumn("_h", F.length(F.bin("size")))
    q = F.when((F.col("_p") > 0) & (F.col("size") > 0), (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p"))))
    cell = F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * CELLS), F.lit(CELLS - 1)).cast("int")
    return out.withColumn("_q", q).withColumn("_b", F.when(F.col("_q").isNotNull(), cell))


def sample_sizes(cells: pd.DataFrame, seed: int) -> pd.DataFrame:
    """The cuts of one source: per size class the cell in which its sample ends and how many of that cell it takes.

    ``cells``: _h, _b, n, words, p (sum of probabilities), e (words expected).  Classes go from the longest documents
    down.  A class's sample size is its expected one times what is still to be taken over what the classes left expect,
    rounded at random; where the rest could not make up for the rounding, the size is taken that leaves the least over.
    """
    cells = cells.sort_values(["_h", "_b"], ascending=[False, True])
    source, out = cells["_s"].iloc[0], []
    left = rest = float(cells["e"].sum())
    room = float(cells["words"].sum())
    for h, c in cells.groupby("_h", sort=False):
        n, words = (np.concatenate([[0], c[x].to_numpy(dtype=float).cumsum()]) for x in ("n", "words"))
        room -= words[-1]
        want = min(max(float(c["p"].sum()) * (left / rest if rest > 0 else 0.0), 0.0), n[-1])
        rest -= float(c["e"].sum())

        def missed(k: float) -> float:
            over = left - np.interp(k, n, words)
            return max(0.0, -over, over - room)

        draw = zlib.crc32(f"{seed}|{source}|{h}".encode()) / (1 << 32)
        k = np.floor(want) + (draw < want - np.floor(want))
        if missed(k) > 0:
            near = np.interp(min(max(left, 0.0), left + room), words, n)
            k = min([k, np.floor(want), np.ceil(want), np.floor(near), np.ceil(near)], key=missed)
        cell = int(np.searchsorted(n, k, side="right")) - 1
        out.append((source, h, int(c["_b"].iloc[cell]) if cell < len(c) else CELLS, int(k - n[cell])))
        left -= float(np.interp(k, n, words))
    return pd.DataFrame(out, columns=["_s", "_h", "_cell", "_part"])


def mix(
    docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, value: str | None = None, seed: int = 42
) -> DataFrame:
    """How often the mix takes each document: id, source, size, source_size, target, copies, taken (words).

    ``docs`` needs the columns ``key``, ``text`` and ``source``; others are not read.  Sources are weighted in the order
    of their names by code point, null last, with ``weights`` repeating, and share all words; no target is above ``most`` times
    its source's words.  With ``value``, a document's expected copies are in proportion to that column (null,
    NaN and negative count as 0), otherwise equal within a source; no document is taken more than ``most`` times.

    One row per row of ``docs``.  Rows equal in id, source, text and value are told apart by a running number, so they
    have fates of their own and are interchangeable.  Null ids and null sources are values like any other; a null
    or empty text has size 0 and is taken 0 words.  The same rows and seed give the same mix, however Spark cuts the
    work.  An empty table gives an empty result.
    """
    table = cut(units(docs, key, value), "mixunits")
    sources = source_targets(table.groupBy("_s").agg(F.sum(F.col("size") * F.col("_m")).alias("source_size")), weights, most)
    sources = cut(expected_copies(table, sources, value, most), "mixsources")
    rows = ranked(numbered(table).join(sources, "_s"), most, seed)
    cells = rows.where(F.col("_b").isNotNull()).groupBy("_s", "_h", "_b").agg(
        F.count("*").alias("n"), F.sum("size").alias("words"), F.sum("_p").alias("p"), F.sum(F.col("_p") * F.col("size")).alias("e")
    )
    cuts = cut(cells.groupBy("_s").applyInPandas(lambda c: sample_sizes(c, seed), "_s string, _h int, _cell int, _part long"), "mixcuts")
    placed = rows.join(cuts, ["_s", "_h"], "left").withColumn("_edge", F.coalesce((F.col("_b") == F.col("_cell")) & (F.col("_part") > 0), F.lit(False)))
    # only the cells in which samples end are put in order; a cell holds few documents of its class
    order = Window.partitionBy("_s", "_h").orderBy("_q", "_u", *KEY, "_k")
    edge = placed.where("_edge").withColumn("_more", (F.row_number().over(order) <= F.col("_part")).cast("long"))
    plain = placed.where("not _edge").withColumn("_more", F.coalesce(F.col("_b") < F.col("_cell"), F.lit(False)).cast("long"))
    copies = F.col("_sure") + F.col("_more")
    return plain.unionByName(edge).select(
        F.col("_id").alias(key), F.when(F.col("_s") != "t", F.substring("_s", 2, 1 << 30)).alias("source"), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), F.col("_t").alias("text_hash"),
    )


def mixed_corpus(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` (from ``mix``) takes them, with all their columns.

    Rows that are equal in id, source and text stand for one another: their copies are added up and given to one of them.
    """
    cols = docs.columns
    link = [F.col("_row")[c] for c in (key, "source", "text")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))
    rows = rows.withColumn("_on", F.struct(link[0].alias("i"), link[1].cast("string").alias("s"), F.xxhash64(link[2]).alias("t")))
    per = mixed.select(F.struct(F.col(f"`{key}`").alias("i"), F.col("source").alias("s"), F.col("text_hash").alias("t")).alias("_on2"), "copies")
    per = per.groupBy("_on2").agg(F.sum("copies").alias("_n"), F.count("*").alias("_m")).where("_n > 0")
    met = rows.join(per, F.col("_on").eqNullSafe(F.col("_on2")))
    one = met.where("_m = 1").unionByName(met.where("_m > 1").dropDuplicates(["_on"]))
    one = one.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return one.select(*[F.col("_row")[c].alias(c) for c in cols])


def mix_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")

"""State of a stream's folds as deltas: a batch writes the rows it changed, and every few batches all rows are put together.

``path/delta/v=<batch>`` holds the rows a batch wrote, ``path/full/v=<batch>`` all rows as they were after it.  The row of a key
is the one of the newest version; a row marked ``_gone`` takes the key out.  Both are laid out in buckets by hash, so a
batch reads the buckets of the keys it asks for.  Batch ``n`` reads versions under ``n`` only and replaces
its own: run again after a failure, it finds the same state and writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructType

from loomseq.sources.scratch import drop, filesystem, remove, settle

Lookup = Callable[[DataFrame], DataFrame]
Hold = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Fold:
    """``step(lookup, hold, batch) -> (changed, emitted)``: lookup gives the state's rows whose ``by`` columns are in a frame.

    ``hold`` writes a frame that several others are made of as a scratch table, so that plans stay small; ``key`` names a row of the state, ``by`` is the part of it that rows are looked up by; changed rows may have ``_gone``.
    """

    schema: StructType
    key: tuple[str, ...]
    by: tuple[str, ...]
    step: Callable[[Lookup, Hold, DataFrame], tuple[DataFrame, DataFrame]]


def same(a: DataFrame, b: DataFrame, cols: tuple[str, ...]) -> Column:
    """Null-safe equality of columns of two frames; ``b``'s carry a leading underscore."""
    return reduce(Column.__and__, [a[c].eqNullSafe(b[f"_{c}"]) for c in cols])


class DeltaState:
    """The versions of one fold's state under ``path``."""

    def __init__(self, spark: SparkSession, path: str, fold: Fold, buckets: int = 8, every: int = 8):
        self.spark, self.path, self.fold, self.buckets, self.every = spark, path, fold, buckets, every

    def versions(self, kind: str, before: int | None = None) -> list[int]:
        """Numbers of complete versions, in order."""
        fs, p = filesystem(self.spark, f"{self.path}/{kind}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        found = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(filesystem(self.spark, f"{self.path}/{kind}/{n}/_SUCCESS")[1])]
        return sorted(v for v in found if before is None or v < before)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.fold.by), F.lit(self.buckets)).cast("int")

    def rows(self, before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """The state's rows before a batch; with ``touched`` (``by`` columns), those that it asks for."""
        full = self.versions("full", before)[-1:]
        deltas = [v for v in self.versions("delta", before) if not full or v > full[0]]
        shape = StructType(list(self.fold.schema)).add("_gone", BooleanType()).add("_b", "integer")
        parts = [self.spark.read.schema(shape).parquet(f"{self.path}/{k}/v={v}").withColumn("_v", F.lit(v).cast("long")) for k, vs in (("full", full), ("delta", deltas)) for v in vs]
        if not parts:
            return self.spark.createDataFrame([], self.fold.schema)
        out = reduce(DataFrame.unionByName, parts)
        if touched is not None:
            there = [r[0] for r in touched.select(self.bucket()).distinct().collect()]  # at most one per bucket
            keys = touched.select(*self.fold.by).toDF(*[f"_{c}" for c in self.fold.by])
            out = out.where(F.col("_b").isin(there))
            out = out.join(keys, same(out, keys, self.fold.by), "left_semi")
        if len(parts) == 1:  # a version has one row per key
            return out.where(~F.coalesce("_gone", F.lit(False))).select(*self.fold.schema.names)
        newest = F.max("_v").over(Window.partitionBy(*self.fold.key))
        out = out.withColumn("_newest", newest).where((F.col("_v") == F.col("_newest")) & ~F.coalesce("_gone", F.lit(False)))
        return out.select(*self.fold.schema.names)

    def write(self, version: int, changed: DataFrame) -> None:
        """Store a batch's changed rows; each ``every`` versions also all rows, after which older versions go."""
        rows = changed if "_gone" in changed.columns else changed.withColumn("_gone", F.lit(False))
        rows.select(*self.fold.schema.names, "_gone", self.bucket().alias("_b")).hint("rebalance", "_b").write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/delta/v={version}")
        full = self.versions("full", version)
        if len([v for v in self.versions("delta", version + 1) if not full or v > full[-1]]) >= self.every:
            whole = self.rows(version + 1).withColumn("_gone", F.lit(False)).withColumn("_b", self.bucket())
            whole.hint("rebalance", "_b").write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/full/v={version}")
            # the version before stays: this batch may have to run again
            for kind in ("delta", "full"):
                for v in self.versions(kind, full[-1] if full else 0):
                    remove(self.spark, f"{self.path}/{kind}/v={v}")


def run_fold(stream: DataFrame, base: str, fold: Fold, every: int = 8) -> StreamingQuery:
    """Fold all files there are; what batch ``n`` emits is ``base/out/v=<n>``, beside its delta of the state."""

    def step(batch: DataFrame, batch_id: int) -> None:
        state = DeltaState(batch.sparkSession, f"{base}/state", fold, every=every)
        held: list[DataFrame] = []

        def hold(df: DataFrame) -> DataFrame:
            held.append(settle(df))
            return held[-1]

        changed, out = fold.step(lambda touched: hold(state.rows(batch_id, touched)), hold, batch)
        out.write.mode("overwrite").parquet(f"{base}/out/v={batch_id}")
        state.write(batch_id, changed)
        drop(*held)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()


def _anti(a: DataFrame, b: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """Rows of ``a`` whose ``cols`` are not in ``b``, nulls being equal."""
    other = b.select(*cols).distinct().toDF(*[f"_{c}" for c in cols])
    return a.join(other, same(a, other, cols), "left_anti")


def claims(key: str, batch: StructType) -> Fold:
    """Emit the first row of each key; the ledger of keys is the state.  Null is a key like any other."""

    def step(lookup: Lookup, hold: Hold, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = hold(_anti(rows, lookup(rows.select(key)), (key,)).dropDuplicates([key]))
        return new.select(key), new

    return Fold(StructType([batch[key]]), (key,), (key,), step)


def summed(keys: list[str], values: list[str], batch: StructType) -> Fold:
    """Totals per key: a batch's sums are added to the state's; emits the new totals of the keys it touched."""

    def step(lookup: Lookup, hold: Hold, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = hold(rows.groupBy(*keys).agg(*[F.sum(v).cast("long").alias(v) for v in values]))
        total = lookup(new).unionByName(new).groupBy(*keys).agg(*[F.sum(v).cast("long").alias(v) for v in values])
        total = hold(total)
        return total, total

    shape = StructType([*[batch[k] for k in keys], *StructType.fromDDL(", ".join(f"`{v}` long" for v in values))])
    return Fold(shape, tuple(keys), tuple(keys), step)


def crossings(key: str, item: str, batch: StructType, least: int = 3) -> Fold:
    """Emit a key, with its support, in the batch in which its distinct items first number ``least``.

    State rows are (key, item) met, and (key, null) with the number of them; rows with a null item count nothing.
    """

    def step(lookup: Lookup, hold: Hold, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = hold(rows.select(key, item).where(F.col(item).isNotNull()).distinct())
        head = pairs.select(key).distinct().withColumn(item, F.lit(None).cast(batch[item].dataType))
        known = lookup(pairs.unionByName(head))
        new = hold(_anti(pairs, known.where(F.col(item).isNotNull()), (key, item)))
        counts = known.where(F.col(item).isNull()).select(key, F.col("n").alias("_old"), F.lit(0).cast("long").alias("_add"))
        counts = counts.unionByName(new.select(key, F.lit(0).cast("long").alias("_old"), F.lit(1).cast("long").alias("_add")))
        counts = hold(counts.groupBy(key).agg(F.sum("_old").alias("_old"), (F.sum("_old") + F.sum("_add")).alias("n")))
        crossed = counts.where((F.col("_old") < least) & (F.col("n") >= least)).select(key, F.col("n").alias("support"))
        heads = counts.select(key, F.lit(None).cast(batch[item].dataType).alias(item), "n")
        return new.withColumn("n", F.lit(1).cast("long")).unionByName(heads), crossed

    return Fold(StructType([batch[key], batch[item], *StructType.fromDDL("n long")]), (key, item), (key, item), step)


LINKED = "kind string, id string, member string, root string, label string, size long, n long"


def grown_groups(src: str, dst: str, weight: str, least: int = 3) -> Fold:
    """Connected groups of a graph whose edges come in batches; emits the groups that a batch touched and that weigh ``least``.

    State rows are stars: ``node`` rows hold a node's root, ``member`` rows a root's nodes, ``group`` rows a root's smallest node
    (``label``), its number of nodes and the summed weight of its edges.  A batch is joined with the roots of the
    nodes it names only, and where groups meet, the largest keeps its root and the others' nodes move: a node moves at most as
    often as its group can double.  Edges with a null end are left out, and loops make no group.  Emits (label, size, n).
    """

    def step(lookup: Lookup, hold: Hold, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        from loomseq.operators.fusion import components

        none = lambda kind: F.lit(None).cast(kind)
        a, b = F.col(src).cast("string"), F.col(dst).cast("string")
        edges = hold(rows.where(a.isNotNull() & b.isNotNull() & (a != b)).groupBy(a.alias("a"), b.alias("b")).agg(F.sum(weight).cast("long").alias("w")))
        ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
        known = lookup(ends.select(F.lit("node").alias("kind"), "id")).select("id", "root")
        named = hold(ends.join(known, "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.col("root").isNull().alias("fresh")))
        at = lambda end: named.select(F.col("id").alias(end), F.col("root").alias(f"r{end}"))
        between = hold(edges.join(at("a"), "a").join(at("b"), "b").groupBy("ra", "rb").agg(F.sum("w").alias("w")))
        parts = components(between.select(F.col("ra").alias("src"), F.col("rb").alias("dst"))).select(F.col("node").alias("root"), "component")
        roots = named.groupBy("root").agg(F.max("fresh").alias("fresh"))
        heads = lookup(roots.select(F.lit("group").alias("kind"), F.col("root").alias("id"))).select(F.col("id").alias("root"), "label", "size", "n")
        met = roots.join(heads, "root", "left").join(parts, "root", "left").select(
            "root", "fresh", F.coalesce("component", "root").alias("c"), F.coalesce("label", "root").alias("label"), F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("n", F.lit(0)).alias("n")
        )
        met = hold(met)
        weights = between.join(met.select(F.col("root").alias("ra"), "c"), "ra").groupBy("c").agg(F.sum("w").alias("w"))
        merged = met.groupBy("c").agg(F.max(F.struct("size", "root"))["root"].alias("keeps"), F.min("label").alias("label"), F.sum("size").alias("size"), F.sum("n").alias("n"))
        merged = hold(merged.join(weights, "c").select("c", "keeps", "label", "size", (F.col("n") + F.col("w")).alias("n")))
        gone = hold(met.join(merged.select("c", "keeps"), "c").where("root <> keeps").select("root", "keeps", "fresh"))
        stored = lookup(gone.where("not fresh").select(F.lit("member").alias("kind"), F.col("root").alias("id"))).select(F.col("id").alias("root"), "member")
        moved = hold(stored.join(gone.select("root", "keeps"), "root"))
        new = met.where("fresh").join(merged.select("c", "keeps"), "c").select(F.col("root").alias("member"), "keeps")
        placed = hold(moved.select("member", "keeps").unionByName(new))

        def shaped(df: DataFrame, kind: str, gone: bool, **cols: str) -> DataFrame:
            empty = {"member": none("string"), "root": none("string"), "label": none("string"), "size": none("long"), "n": none("long")}
            values = [F.col(cols[c]).alias(c) if c in cols else e.alias(c) for c, e in empty.items()]
            return df.select(F.lit(kind).alias("kind"), F.col(cols["id"]).alias("id"), *values, F.lit(gone).alias("_gone"))

        changed = shaped(placed, "node", False, id="member", root="keeps").unionByName(shaped(placed, "member", False, id="keeps", member="member"))
        changed = changed.unionByName(shaped(moved, "member", True, id="root", member="member")).unionByName(shaped(gone.where("not fresh"), "group", True, id="root"))
        changed = changed.unionByName(shaped(merged, "group", False, id="keeps", label="label", size="size", n="n"))
        return changed, merged.where(F.col("n") >= least).select("label", "size", "n")

    return Fold(StructType.fromDDL(LINKED), ("kind", "id", "member"), ("kind", "id"), step)


def group_lists(state: DataFrame, least: int = 3) -> DataFrame:
    """(genes, support): the groups of a ``grown_groups`` state of at least ``least``, members in order."""
    heads = state.where("kind = 'group'").where(F.col("n") >= least).select("id", F.col("n").alias("support"))
    names = state.where("kind = 'member'").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("member")), ",").alias("genes"))
    return heads.join(names, "id").select("genes", "support")


TAGS = "kind string, id string, tag string, done boolean, n long, waiting array<string>"


def grown_tags(item: str, name: str, least: int = 3) -> Fold:
    """Sets of names per item grow; an item is emitted once, in the first batch that ends with ``least`` items of its very set.

    State rows of kind ``item`` hold an item's tag (its names in order) and whether it was emitted; rows of kind ``tag`` hold
    how many items have the tag now and which of them wait, under ``least`` each.  An item that moves to another tag
    is taken from the old one's count.  Items and names are strings; rows in which one is null are left out.
    """

    def step(lookup: Lookup, hold: Hold, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        fresh = hold(rows.where(F.col(item).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(item).cast("string").alias("id")).agg(F.collect_set(F.col(name).cast("string")).alias("_new")))
        old = lookup(fresh.select(F.lit("item").alias("kind"), "id")).select("id", F.col("tag").alias("_old"), "done")
        met = fresh.join(old, "id", "left")
        names = F.array_union("_new", F.coalesce(F.split("_old", ","), F.array().cast("array<string>")))
        met = met.select("id", "_old", F.coalesce("done", F.lit(False)).alias("done"), F.array_join(F.array_sort(names), ",").alias("tag"))
        moved = hold(met.where(F.col("_old").isNull() | (F.col("_old") != F.col("tag"))))
        plus = moved.select("tag", "id", "done", F.lit(1).alias("_d"))
        minus = moved.where(F.col("_old").isNotNull()).select(F.col("_old").alias("tag"), "id", "done", F.lit(-1).alias("_d"))
        steps = hold(plus.unionByName(minus).groupBy("tag").agg(F.sum("_d").alias("_d")))
        before = lookup(steps.select(F.lit("tag").alias("kind"), F.col("tag").alias("id"))).select(F.col("id").alias("tag"), "n", "waiting")
        count = hold(steps.join(before, "tag", "left").select("tag", (F.coalesce("n", F.lit(0)) + F.col("_d")).alias("n"), "waiting"))
        # who is at a touched tag now: those that waited and have not left, under ``least`` each, and those that moved to it
        left = moved.where(F.col("_old").isNotNull()).join(count.where("waiting is not null").select(F.col("tag").alias("_old")), "_old", "left_semi")
        stayed = _anti(count.select("tag", "n", F.explode("waiting").alias("id")), left.select(F.col("_old").alias("tag"), "id"), ("tag", "id"))
        # no one is in both: who moved to a tag did not wait there
        at = moved.select("id", "tag", "done").join(count.select("tag", "n"), "tag").unionByName(stayed.withColumn("done", F.lit(False)))
        enough = F.col("n") >= least
        short = at.where(~F.col("done") & ~enough).groupBy("tag").agg(F.collect_set("id").alias("waiting"))
        told = at.where(~F.col("done") & enough)
        # who waits on is stored as it is
        items = moved.select("id", "tag", "done").join(count.select("tag", "n"), "tag").unionByName(stayed.where(enough).withColumn("done", F.lit(False)))
        none = lambda kind: F.lit(None).cast(kind)
        items = items.select(F.lit("item").alias("kind"), "id", "tag", (F.col("done") | enough).alias("done"), none("long").alias("n"), none("array<string>").alias("waiting"))
        tags = count.drop("waiting").join(short, "tag", "left").select(F.lit("tag").alias("kind"), F.col("tag").alias("id"), none("string").alias("tag"), none("boolean").alias("done"), "n", "waiting", (F.col("n") <= 0).alias("_gone"))
        return items.withColumn("_gone", F.lit(False)).unionByName(tags), told.select(F.col("id").alias(item), "tag")

    return Fold(StructType.fromDDL(TAGS), ("kind", "id"), ("kind", "id"), step)


def staged(keys: list[str], values: list[str], at: str, batch: StructType, least: int = 10, force: bool = False) -> Fold:
    """Hold files (told apart by ``at`` per first key) until ``least`` are staged, then add them up; ``force`` takes any.

    State rows are totals (``at`` null) or staged; staged rows that are added up go.  Each time emits one point: the newest
    ``at`` and the totals then.  With ``force`` every group is looked at, otherwise those of the batch.
    """
    group = keys[0]

    def step(lookup: Lookup, hold: Hold, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        cols = [*keys, at, *values]
        new = hold(rows.select(*cols).groupBy(*keys, at).agg(*[F.sum(v).cast("long").alias(v) for v in values]))
        known = lookup(None if force else new.select(group))
        came = known.where(F.col(at).isNotNull()).unionByName(new)
        waiting = hold(came.groupBy(*keys, at).agg(*[F.sum(v).cast("long").alias(v) for v in values]))
        due = waiting.groupBy(group).agg(F.countDistinct(at).alias("_n"), F.max(at).alias("_at")).where(F.col("_n") >= (1 if force else least)).select(group, "_at")
        due = hold(due)
        taken = waiting.join(due.select(group), group, "left_semi")
        sums = known.where(F.col(at).isNull()).join(due.select(group), group, "left_semi").select(*keys, *values).unionByName(taken.select(*keys, *values))
        sums = hold(sums.groupBy(*keys).agg(*[F.sum(v).cast("long").alias(v) for v in values]))
        points = sums.groupBy(group).agg(*[F.sum(v).alias(v) for v in values]).join(due.withColumnRenamed("_at", at), group)
        totals = sums.withColumn(at, F.lit(None).cast(batch[at].dataType)).select(*cols).withColumn("_gone", F.lit(False))
        held = waiting.join(new.select(*keys, at), [*keys, at], "left_semi").join(due.select(group), group, "left_anti").select(*cols).withColumn("_gone", F.lit(False))
        return totals.unionByName(held).unionByName(taken.select(*cols).withColumn("_gone", F.lit(True))), points

    shape = StructType([*[batch[k] for k in keys], batch[at], *StructType.fromDDL(", ".join(f"`{v}` long" for v in values))])
    return Fold(shape, (*keys, at), (group,), step)

"""Classifier scores over time, job logs, sample tables, file ledgers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["sample", "classifier"]


def latest_top(scores: DataFrame) -> DataFrame:
    """The best class of each classifier's newest row; ties of time by event, of score by class name."""
    last = scores.groupBy(*KEY).agg(F.max(F.struct("ts", "event_id")).alias("_l"))
    now = scores.join(last, KEY).where((F.col("ts") == F.col("_l.ts")) & (F.col("event_id") == F.col("_l.event_id")))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), "class"))
    return now.withColumn("_r", rank).where("_r = 1").select(*KEY, "class", "score")


#: High, medium and low bound (percent) per classifier, and for any other.  Fixed values.
CONFIDENCE = {"sturgeon": (95.0, 80.0, 0.0), "nanodx": (50.0, 25.0, 0.0), "pannanodx": (50.0, 25.0, 0.0), "random_forest": (85.0, 65.0, 0.0)}
OTHER_CONFIDENCE = (80.0, 50.0, 20.0)


def confidence_label(percent: Column, classifier: Column) -> Column:
    """The verbal level of a score by its classifier's own bounds."""
    bound = lambda i: F.coalesce(*[F.when(classifier == c, F.lit(v[i])) for c, v in CONFIDENCE.items()], F.lit(OTHER_CONFIDENCE[i]))
    return F.when(percent >= bound(0), "High confidence").when(percent >= bound(1), "Medium confidence").when(percent >= bound(2), "Low confidence").otherwise("Very low confidence")


def top_history(scores: DataFrame, n: int = 3) -> DataFrame:
    """All rows, as percentages, of the ``n`` classes that score best at their own newest time."""
    last = scores.groupBy(*KEY, "class").agg(F.max_by("score", F.struct("ts", "event_id")).alias("_s"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("_s"), "class"))
    keep = last.withColumn("_r", rank).where(F.col("_r") <= n).select(*KEY, "class")
    return scores.join(keep, [*KEY, "class"], "left_semi").select(*KEY, "class", "event_id", F.round(F.col("score") * 100, 4).alias("percent"))


def plotted_classes(scores: DataFrame, above: float = 0.05, most: int = 3) -> DataFrame:
    """Classes that ever exceed ``above``; of more than ``most``, those highest at the end."""
    per = scores.groupBy(*KEY, "class").agg(F.max("score").alias("best"), F.max_by("score", F.struct("ts", "event_id")).alias("last")).where(F.col("best") > above)
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("last"), "class"))
    return per.withColumn("_r", rank).where(F.col("_r") <= most).select(*KEY, "class", "best", "last")


def softmax(logits: Column, temperature: Column) -> Column:
    """Temperature-scaled softmax of an array, shifted by its maximum; a null temperature is 1."""
    t = F.coalesce(temperature, F.lit(1.0))
    e = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def best_member(members: DataFrame) -> DataFrame:
    """Of each sample's ensemble members (``p`` array) the one that holds the greatest probability."""
    return members.groupBy("sample").agg(F.max_by(F.struct("member", "p"), F.struct(F.array_max("p"), -F.col("member"))).alias("_m")).select("sample", "_m.member", "_m.p")


def rolling_median(jobs: DataFrame, least: int = 5) -> DataFrame:
    """Median duration over the last max(10, n // 20) jobs of a type, from ``least`` values on.

    Jobs are ranked within (type, day) and moved by the counts of earlier days, so no type is ordered in one task.  A
    type is cut into blocks of its window's width; each block gets the block before it and slides its window once.
    """
    day = F.to_date("ts").alias("_day")
    counts = jobs.groupBy("job_type", day).agg(F.count("*").alias("_c"))
    by_type = Window.partitionBy("job_type")
    before = counts.select("job_type", "_day", (F.sum("_c").over(by_type.orderBy("_day")) - F.col("_c")).alias("_before"), F.sum("_c").over(by_type).alias("_n"))
    r = jobs.select("job_type", "event_id", "ts", "duration_seconds", day).withColumn("_at", F.row_number().over(Window.partitionBy("job_type", "_day").orderBy("ts", "event_id")))
    r = r.join(before, ["job_type", "_day"]).select("job_type", "event_id", "duration_seconds", (F.col("_at") + F.col("_before") - 1).alias("at"), F.greatest(F.lit(10), F.floor(F.col("_n") / 20)).alias("k"))
    own = F.floor(F.col("at") / F.col("k"))
    dealt = r.withColumn("own", own).withColumn("block", F.explode(F.array(own, own + 1)))

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        win = pdf["duration_seconds"].rolling(int(pdf["k"].iloc[0]), min_periods=least)
        out = pd.DataFrame({"job_type": pdf["job_type"], "event_id": pdf["event_id"], "median": win.median(), "n": win.count()})
        out = out[(pdf["own"] == pdf["block"]) & (out["n"] >= least)]
        return out.astype({"n": "int64"})

    return dealt.groupBy("job_type", "block").applyInPandas(slide, "job_type string, event_id long, median double, n long")


def job_overview(jobs: DataFrame) -> DataFrame:
    s = F.col("status")
    return jobs.groupBy("sample_id").agg(
        F.count("*").alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "running").alias("active"), F.count_if(s == "queued").alias("pending"), F.array_sort(F.collect_set("job_type")).alias("types"),
    )


def newest_samples(rows: DataFrame, ts: str, idle_seconds: int, now: Column) -> DataFrame:
    """Newest row per known sample; live ones that idle without jobs become complete."""
    known = rows.where("sample is not null and sample <> 'unknown'")
    last = known.groupBy("sample").agg(F.max(F.struct(ts, "event_id", "status", "jobs")).alias("_l")).select("sample", f"_l.{ts}", "_l.status", "_l.jobs")
    idle = (F.col("status") == "Live") & (F.col("jobs") == 0) & (F.unix_timestamp(now) - F.unix_timestamp(ts) >= idle_seconds)
    return last.withColumn("status", F.when(idle, "Complete").otherwise(F.col("status")))


def filter_samples(rows: DataFrame, origin: str | None = None, job_type: str | None = None, search: str = "", text: tuple[str, ...] = ("sample", "status", "job_types", "jobs")) -> DataFrame:
    """Rows of one origin (``status``), with a job type among their comma list's tokens, and a text in any of some columns.

    The search does not tell upper from lower case; a null column holds no text.
    """
    out = rows if origin is None else rows.where(F.col("status") == origin)
    if job_type is not None:
        out = out.where(F.array_contains(F.transform(F.split("job_types", ","), lambda x: F.trim(x)), job_type))
    if search:
        hit = F.lit(False)
        for c in text:
            hit = hit | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(search.lower())
        out = out.where(hit)
    return out


def score_batches(vectors: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "sample") -> DataFrame:
    """A caller's model over each sample's probe vector; the model gets and returns pandas frames."""
    return vectors.groupBy(key).applyInPandas(model, schema)


def stage_bits(stages: Column, names: list[str]) -> Column:
    """Bit mask of the named stages in an array."""
    out = F.lit(0).cast("long")
    for i, n in enumerate(names):
        out = out.bitwiseOR(F.when(F.array_contains(stages, n), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def file_key(path: Column, size: Column, mtime: Column) -> Column:
    """Fingerprint of a file's path, size and change time."""
    return F.sha2(F.concat_ws("|", path, size.cast("string"), mtime.cast("string")), 256)


def unclaimed(batch: DataFrame, ledger: DataFrame, stage: str) -> DataFrame:
    """Files of a batch whose key the ledger does not list as done for ``stage``; a failed stage is not done."""
    done = ledger.where(F.array_contains("stages", stage)).select("file_key")
    return batch.join(done, "file_key", "left_anti")


def upsert_ledger(ledger: DataFrame, seen: DataFrame) -> DataFrame:
    """Ledger rows with stages united; the first time seen stays, the last error is the newest."""
    return ledger.unionByName(seen).groupBy("file_key").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("stages")))).alias("stages"), F.max_by("last_error", "last_seen").alias("last_error"),
    )


def hierarchy_totals(leaves: DataFrame, levels: list[str], score: str = "score", top: int = 10) -> DataFrame:
    """Score sums of every group on every level of a class hierarchy, the ``top`` of each level."""
    every = leaves.select("sample", F.col(score).alias("score"), F.posexplode(F.array(*levels)).alias("level", "name"))
    out = every.groupBy("sample", "name", "level").agg(F.round(F.sum("score"), 6).alias("score")).select("sample", "name", "score", "level")
    rank = F.row_number().over(Window.partitionBy("sample", "level").orderBy(F.desc("score"), "name"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top)

"""Folds over delta state, batches with timers, windows by event time."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from loomseq.operators import reads
from loomseq.streaming import batches, folds
from loomseq.streaming import state as st


def came(spark, base, rows, shape, fold, every=8):
    """One more file of ``rows``, folded."""
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = folds.folder_stream(spark, f"{base}/in", spark.createDataFrame([], shape).schema)
    st.run_fold(stream, base, fold, every).awaitTermination()
    return st.DeltaState(spark, f"{base}/state", fold)


def out(spark, base, *cols):
    return sorted(tuple(str(r[c]) for c in cols) for r in folds.emitted(spark, base).collect())


def test_stream_of_files_equals_batch(spark, tmp_path):
    base, shape = f"file://{tmp_path}", "sample string, k int, v long"
    df = spark.createDataFrame([("a", i % 3, i) for i in range(60)], shape)
    df.repartition(5).write.parquet(f"{base}/in")
    fold = st.summed(["sample", "k"], ["v"], df.schema)
    st.run_fold(folds.folder_stream(spark, f"{base}/in", df.schema, files_per_batch=1), base, fold, every=2).awaitTermination()
    state = st.DeltaState(spark, f"{base}/state", fold)
    assert sorted(tuple(r) for r in state.rows().collect()) == [("a", 0, 570), ("a", 1, 590), ("a", 2, 610)]


def test_deltas_follow_the_batch_and_are_put_together(spark, tmp_path):
    base, shape = f"file://{tmp_path}", "key string, x int"
    fold = st.claims("key", spark.createDataFrame([], shape).schema)
    state = came(spark, base, [(f"k{i}", 0) for i in range(500)] + [(None, 1), (None, 2)], shape, fold, every=3)
    for n in range(1, 6):
        came(spark, base, [(f"k{i}", n) for i in range(490, 500 + n)] + [(None, n)], shape, fold, every=3)
        if n in state.versions("delta"):
            assert spark.read.parquet(f"{state.path}/delta/v={n}").count() <= 1
    assert state.versions("full") == [2, 5] and min(state.versions("delta")) >= 2
    assert state.rows().count() == 506 and folds.emitted(spark, base).count() == 506
    assert state.rows(touched=spark.createDataFrame([("k1",), (None,), ("no",)], "key string")).count() == 2


def test_a_batch_that_runs_again_writes_the_same(spark, tmp_path):
    shape = "g string, read string"
    fold = st.crossings("g", "read", spark.createDataFrame([], shape).schema)
    state = st.DeltaState(spark, f"file://{tmp_path}/s", fold)
    batch = [spark.createDataFrame(x, shape) for x in ([("a", "1"), ("a", "2"), ("a", "2"), ("b", "1"), ("a", None)], [("a", "2"), ("a", "3"), (None, "1"), (None, "2"), (None, "3")], [("a", "4")])]
    seen = []
    for v, again in ((0, 1), (1, 2), (2, 1)):
        for _ in range(again):
            changed, crossed = fold.step(lambda t, v=v: state.rows(v, t), lambda df: df, batch[v])
            seen.append(sorted((str(r.g), r.support) for r in crossed.collect()))
            state.write(v, changed)
    assert seen == [[], [("None", 3), ("a", 3)], [("None", 3), ("a", 3)], []]
    assert {(r.g, r.n) for r in state.rows().where("read is null").collect()} == {("a", 4), ("b", 1), (None, 3)}


def test_tags_move_and_items_are_emitted_once(spark, tmp_path):
    base, shape, fold = f"file://{tmp_path}", "item string, name string", st.grown_tags("item", "name", 2)
    state = came(spark, base, [("a", "x"), ("b", "x"), ("c", "y"), (None, "x"), ("d", None)], shape, fold)
    assert out(spark, base, "v", "item", "tag") == [("0", "a", "x"), ("0", "b", "x")]
    came(spark, base, [("c", "x"), ("a", "y"), ("e", "x"), ("e", "y")], shape, fold)
    # a is done already; c and e are new to x,y, which now has three
    assert out(spark, base, "v", "item", "tag")[2:] == [("1", "c", "x,y"), ("1", "e", "x,y")]
    came(spark, base, [("f", "x")], shape, fold)  # b still holds x, so f is the second one there
    assert out(spark, base, "v", "item", "tag")[4:] == [("2", "f", "x")]
    came(spark, base, [("g", "z"), ("b", "q")], shape, fold)
    came(spark, base, [("h", "z")], shape, fold)
    assert out(spark, base, "v", "item", "tag")[5:] == [("4", "g", "z"), ("4", "h", "z")]
    counts = {r.id: (r.n, sorted(r.waiting or [])) for r in state.rows().where("kind = 'tag'").collect()}
    assert counts == {"x": (1, []), "x,y": (3, []), "q,x": (1, []), "z": (2, [])}


def test_staged_files_and_flush(spark, tmp_path):
    base, shape = f"file://{tmp_path}", "g string, gene string, at long, w long"
    schema = spark.createDataFrame([], shape).schema
    fold, force = (st.staged(["g", "gene"], ["w"], "at", schema, least=3, force=f) for f in (False, True))
    state = came(spark, base, [("g", "A", 1, 5), ("g", "B", 2, 5), ("h", "A", 1, 1)], shape, fold)
    assert state.rows().count() == 3 and folds.emitted(spark, base).count() == 0
    came(spark, base, [("g", "A", 3, 1)], shape, fold)
    assert out(spark, base, "g", "at", "w") == [("g", "3", "11")]
    assert sorted((r.g, r.gene, r.at or 0, r.w) for r in state.rows().collect()) == [("g", "A", 0, 6), ("g", "B", 0, 5), ("h", "A", 1, 1)]
    came(spark, base, [("g", "B", 4, 2)], shape, fold)
    for _ in range(2):
        folds.end_of_run(spark, base, schema, force).awaitTermination()
    assert out(spark, base, "v", "g", "at")[1:] == [("3", "g", "4"), ("3", "h", "1")] and state.rows().where("at is not null").count() == 0


def test_job_batches_close_by_cap_by_idle_and_alone_and_survive_a_restart(spark, tmp_path):
    base, shape = f"file://{tmp_path}", "sample string, job_type string, path string, ts long, big boolean"

    def start():
        stream = folds.folder_stream(spark, f"{base}/in", spark.createDataFrame([], shape).schema)
        return folds.sink_versions(batches.job_batches(stream, ["sample", "job_type"], "path", "ts", batches.cap_of(F.col("job_type")), idle=4.0, alone=F.col("big")), base, every="300 milliseconds")

    jobs = [("s", "mgmt", f"m{i:02d}", i, None) for i in range(45)] + [("s", "cnv", f"c{i:02d}", i, i == 7) for i in range(60)] + [(None, "mgmt", "n", 0, False), ("s", "preprocessing", "p1", 1, False), ("s", "preprocessing", "p2", 2, False)]
    spark.createDataFrame(jobs, shape).coalesce(1).write.parquet(f"{base}/in")
    query = start()
    folds.await_rows(query, spark, base, 40 + 51 + 2)
    query.stop()
    assert folds.emitted(spark, base).where("closed_by = 'idle'").count() == 0
    spark.createDataFrame([("s", "mgmt", "m99", 99, False)], shape).coalesce(1).write.mode("append").parquet(f"{base}/in")
    query = start()
    try:
        folds.await_rows(query, spark, base, len(jobs) + 1)
    finally:
        query.stop()
    got = {}
    for r in folds.emitted(spark, base).collect():
        got.setdefault((r["sample"], r.job_type, r.batch), (r.closed_by, []))[1].append(r.job)
    sizes = {k: (by, len(v)) for k, (by, v) in got.items()}
    assert sizes == {
        ("s", "mgmt", 1): ("cap", 20), ("s", "mgmt", 2): ("cap", 20), ("s", "mgmt", 3): ("idle", 6), ("s", "cnv", 1): ("alone", 1), ("s", "cnv", 2): ("cap", 50), ("s", "cnv", 3): ("idle", 9),
        (None, "mgmt", 1): ("idle", 1), ("s", "preprocessing", 1): ("cap", 1), ("s", "preprocessing", 2): ("cap", 1),
    }
    assert sorted(got["s", "mgmt", 3][1]) == ["m40", "m41", "m42", "m43", "m44", "m99"] and got["s", "cnv", 1][1] == ["c07"]


def test_a_failed_stream_is_reported(spark, tmp_path):
    base, shape = f"file://{tmp_path}", "k string"
    spark.createDataFrame([("a",)], shape).write.parquet(f"{base}/in")
    stream = folds.folder_stream(spark, f"{base}/in", spark.createDataFrame([], shape).schema)
    query = folds.sink_versions(stream.select(F.raise_error(F.lit("broken")).alias("x")), base, every="200 milliseconds")
    with pytest.raises(Exception, match="broken"):
        folds.await_rows(query, spark, base, 1, seconds=60)


def test_late_rows_are_dropped_and_windows_come_once(spark, tmp_path):
    base, shape = f"file://{tmp_path}", "sample string, start_pos long, end_pos long, is_supplementary boolean, start_time timestamp"
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    schema = spark.createDataFrame([], shape).schema
    for part in ([0, 1, 2], [40], [1, 39], [100]):  # after day 40 the first window is closed
        spark.createDataFrame([("s", 0, 10, False, day(n)) for n in part] + [("s", 0, 10, True, day(500))], shape).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = folds.folder_stream(spark, f"{base}/in", schema)
        folds.sink_versions(reads.windowed_yield(stream, "10 days", "5 days"), base).awaitTermination()
        time.sleep(0.1)
    got = sorted((r.window_start.isoformat()[:10], r.reads, r.bases) for r in folds.emitted(spark, base).collect())
    assert got == [("2023-12-29", 3, 30), ("2024-02-07", 2, 20)]


def test_groups_grow_and_meet_over_batches(spark, tmp_path):
    base, shape = f"file://{tmp_path}", "a string, b string, w long"
    fold = st.grown_groups("a", "b", "w", least=1)
    r = random.Random(11)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}", r.randrange(1, 4)) for _ in range(45)]
    edges += [("n1", "n1", 9), (None, "n1", 9), ("n1", None, 9), ("n2", "n3", 2), ("n2", "n3", 2)]
    so_far = []
    for k in range(4):
        batch = edges[k::4]
        state = came(spark, base, batch, shape, fold, every=2)
        so_far += [e for e in batch if None not in e and e[0] != e[1]]
        group = {}
        for a, b, _ in so_far:
            whole = group.get(a, {a}) | group.get(b, {b})
            for n in whole:
                group[n] = whole
        want = {(",".join(sorted(g)), sum(w for a, _, w in so_far if a in g)) for g in map(frozenset, group.values())}
        assert {tuple(x) for x in st.group_lists(state.rows(), 1).collect()} == want
    heads = state.rows().where("kind = 'group'").collect()
    assert {(h.label, h["size"], h.n) for h in heads} == {(min(g.split(",")), len(g.split(",")), n) for g, n in want}
    last = folds.emitted(spark, base).where("v = 3").count()
    # the last batch once more, after a failure: the same state and the same rows
    v = 3
    before = sorted(map(str, state.rows().collect()))
    changed, told = fold.step(lambda t: state.rows(v, t), lambda df: df, spark.createDataFrame(edges[3::4], shape))
    assert told.count() == last
    state.write(v, changed)
    assert sorted(map(str, state.rows().collect())) == before


def test_a_fold_that_reads_one_version_of_the_state_sorts_nothing(spark, tmp_path):
    fold = st.grown_tags("item", "name")
    state = st.DeltaState(spark, f"file://{tmp_path}/state", fold)
    rows = spark.createDataFrame([("item", f"i{k}", "a", False, None, None) for k in range(50)], fold.schema)
    state.write(0, rows)
    touched = rows.where("id < 'i3'").select("kind", "id")
    got = state.rows(1, touched.union(touched))  # asked for twice, given once
    assert sorted(r.id for r in got.collect()) == sorted(f"i{k}" for k in range(50) if f"i{k}" < "i3")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()

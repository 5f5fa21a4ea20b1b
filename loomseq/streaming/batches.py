"""Batches of jobs in a running stream: keyed state with processing-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Jobs of one batch, and seconds without a new job after which a smaller one closes.
CAP, CAPS, IDLE = 20, {"cnv": 50, "preprocessing": 1}, 2.0


def cap_of(job_type: Column) -> Column:
    """The cap of a job type, ``CAP`` where none is named."""
    out = F.lit(CAP)
    for name, cap in CAPS.items():
        out = F.when(job_type == name, cap).otherwise(out)
    return out


def job_batches(
    jobs: DataFrame, keys: list[str], job: str, order: str, cap: Column, idle: float = IDLE, alone: Column | None = None
) -> DataFrame:
    """A stream of ``jobs`` as (keys, job, batch, closed_by): each job in the batch of its key that took it.

    Per key, jobs wait in the order of (``order``, ``job``) of a trigger and of triggers.  A batch closes when ``cap`` jobs wait
    (``closed_by`` cap), or when ``idle`` seconds of processing time passed since the last job came (idle); a job for which
    ``alone`` holds is a batch by itself (alone).  Batches of a key are numbered from 1.

    What waits and the number of batches are the key's state, so under ``cap`` jobs are kept per key and a restarted
    query goes on with them: its timers are in the checkpoint.  A trigger's new jobs of one key meet in one task; the
    source's limit per trigger (``maxFilesPerTrigger``) bounds them.  A null ``alone`` counts as false, null keys are a key.
    """
    kinds = [jobs.schema[k] for k in keys]
    out = StructType([*kinds, *StructType.fromDDL("job string, batch long, closed_by string")])
    state = StructType.fromDDL("waiting array<string>, batch long")
    rows = jobs.select(
        *keys, F.col(job).cast("string").alias("_job"), F.col(order).alias("_at"), cap.cast("int").alias("_cap"),
        F.coalesce(alone, F.lit(False)).alias("_alone") if alone is not None else F.lit(False).alias("_alone"),
    )
    names = [f.name for f in out]

    def step(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        waiting, batch = held.get if held.exists else ([], 0)
        waiting, done = list(waiting), []

        def close(some: list[str], by: str) -> None:
            nonlocal batch
            batch += 1
            done.extend((*key, j, batch, by) for j in some)

        if held.hasTimedOut:
            close(waiting, "idle")
            waiting = []
        else:
            new = pd.concat(list(parts)).sort_values(["_at", "_job"], kind="stable")
            most = int(new["_cap"].iloc[0])
            for j in new.loc[new["_alone"], "_job"]:
                close([j], "alone")
            waiting += new.loc[~new["_alone"], "_job"].tolist()
            while len(waiting) >= most:
                close(waiting[:most], "cap")
                waiting = waiting[most:]
        held.update((waiting, batch))
        if waiting:
            held.setTimeoutDuration(int(idle * 1000))
        yield pd.DataFrame(done, columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.ProcessingTimeTimeout)

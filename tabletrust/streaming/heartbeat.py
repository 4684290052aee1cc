"""Jobs that stopped reporting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabletrust.functions import rules

ACTIVE = ["analyzing", "profiling", "planning", "executing", "validating"]


def sweep(beats: DataFrame, now: Column, after: int = rules.STALE_AFTER_SECONDS) -> DataFrame:
    """(job, status, last_beat, stale): active jobs silent for too long become `failed`.

    `beats(job, status, ts)`; the status of the latest beat counts. Only the latest beat per job
    leaves a task.
    """
    latest = beats.groupBy("job").agg(
        F.max("ts").alias("last_beat"), F.max_by("status", F.struct("ts", "status")).alias("last_status")
    )
    silent = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_beat").cast("timestamp"))
    stale = F.col("last_status").isin(ACTIVE) & (silent > after * 1_000_000)
    return latest.select(
        "job",
        F.when(stale, "failed").otherwise(F.col("last_status")).alias("status"),
        "last_beat",
        stale.alias("stale"),
    )


def _latest_beats(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The latest beat of each job in every batch of rows, so busy jobs do not travel whole."""
    for frame in frames:
        yield frame.loc[frame.groupby("job")["ms"].idxmax()]


def _silence(after_ms: int):
    """Re-arms a job's timer on each beat; a timer that goes off reports the job."""

    def watch_job(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            last_ms, status = state.get
            state.remove()
            if status in ACTIVE:
                yield pd.DataFrame({"job": [key[0]], "status": ["failed"], "ms": [last_ms]})
            return
        seen = state.get if state.exists else (-1, "")
        for frame in frames:
            top = frame.loc[frame["ms"].idxmax()]
            if top["ms"] >= seen[0]:
                seen = (int(top["ms"]), top["status"])
        state.update(seen)
        state.setTimeoutTimestamp(max(seen[0] + after_ms, state.getCurrentWatermarkMs() + 1))

    return watch_job


def watch(
    beats: DataFrame, delay: str = "0 seconds", after: int = rules.STALE_AFTER_SECONDS
) -> DataFrame:
    """Stream of jobs whose beats ended, judged in event time.

    Late beats older than `delay` are still compared by their own time, so an old beat never
    hides a newer one.
    """
    return (
        beats.select("job", "status", "ts", F.unix_millis("ts").alias("ms"))
        .mapInPandas(_latest_beats, "job string, status string, ts timestamp, ms bigint")
        .withWatermark("ts", delay)
        .groupBy("job")
        .applyInPandasWithState(
            _silence(after * 1000),
            "job string, status string, ms bigint",
            "last_ms bigint, status string",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
        .select("job", "status", F.timestamp_millis("ms").alias("last_beat"))
    )

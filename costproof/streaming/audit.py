"""Structured Streaming over job events and login attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from costproof import fixed_values as fx
from costproof.operators.events import job_state
from costproof.sources.readers import read_audit_log


def stream_job_state(spark: SparkSession, path: str) -> DataFrame:
    """Current state of every job, as an update-mode stream over the audit log folder."""
    return job_state(read_audit_log(spark, path, streaming=True))


_OUTPUT = "address string, locked_at double, locked_until double"
_STATE = "hits array<double>, until double, waiting array<double>, waiting_ok array<boolean>"


def _guard(max_attempts: int, window: float, lock: float):
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hits, until, waiting, waiting_ok = state.get if state.exists else ([], float("-inf"), [], [])
        hits, pending = list(hits), list(zip(waiting, waiting_ok))
        if not state.hasTimedOut:
            for part in batches:
                pending += zip(part["ts"].tolist(), part["ok"].tolist())
        passed = state.getCurrentWatermarkMs() / 1000
        ready = sorted(p for p in pending if p[0] <= passed)
        pending = [p for p in pending if p[0] > passed]
        locks = []
        for ts, ok in ready:
            if ts < until:
                continue
            if ok:
                hits, until = [], float("-inf")
                continue
            hits = [h for h in hits if ts - h < window] + [ts]
            if len(hits) >= max_attempts:
                locks.append((key[0], ts, ts + lock))
                hits, until = [], ts + lock
        if pending:
            wake = min(p[0] for p in pending)
        else:
            wake = max([until, *(h + window for h in hits)])
        if wake == float("-inf") or (not pending and wake <= passed):
            state.remove()
        else:
            state.update((hits, until, [p[0] for p in pending], [p[1] for p in pending]))
            state.setTimeoutTimestamp(max(int(wake * 1000), state.getCurrentWatermarkMs() + 1))
        if locks:
            yield pd.DataFrame(locks, columns=["address", "locked_at", "locked_until"])

    return advance


def stream_lockouts(attempts: DataFrame, delay: str = "10 minutes", max_attempts: int = fx.MAX_ATTEMPTS, window: float = fx.WINDOW_SECONDS,
                    lock: float = fx.LOCKOUT_SECONDS) -> DataFrame:
    """Lockouts per address over a stream of (address, ts seconds, ok).

    Attempts wait in the state until the watermark passes them and are then taken in order of event time, so attempts
    that arrive out of order within ``delay`` lock as in the batch; later ones are not counted. State per address is
    the attempts of one delay, at most four times and a lock; it goes once the watermark passes all of them."""
    timed = attempts.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1000000).cast("bigint"))).withWatermark("event_time", delay)
    return timed.groupBy("address").applyInPandasWithState(
        _guard(max_attempts, window, lock), _OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)

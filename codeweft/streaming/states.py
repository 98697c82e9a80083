"""Jobs and sessions as streams: state kept for each project, bounded by what it retains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codeweft.streaming.traces import TRANSITIONS

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ORDER = {"Queued": 0, "Running": 1, "Failed": 2, "Completed": 2}
JOB_STATES = "project string, job string, state string, at timestamp, kept boolean"
SESSION_STATES = "project string, session string, created_at timestamp, kept boolean"


class _Jobs(StatefulProcessor):
    """A project's jobs: those that run and the newest finished ones."""

    def __init__(self, finished: int) -> None:
        self.finished = finished

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "job string", "state string, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = [r for part in rows for r in part[["job", "state", "at"]].itertuples(index=False) if r.state in _ORDER and r.job is not None and not pd.isna(r.at)]
        known = {k[0]: tuple(v) for k, v in self.jobs.iterator()}
        before = dict(known)
        for job, state, at in sorted(log, key=lambda r: (r.at, r.state)):
            if state in TRANSITIONS[known[job][0] if job in known else None]:
                known[job] = (state, at)
        ended = sorted((j for j, (state, _) in known.items() if state in ("Completed", "Failed")), key=lambda j: (-pd.Timestamp(known[j][1]).value, j))
        dropped = set(ended[self.finished :])
        told = [(key[0], j, *v, j not in dropped) for j, v in known.items() if before.get(j) != v or j in dropped]
        for _, job, state, at, kept in told:
            if kept:
                self.jobs.updateValue((job,), (state, pd.Timestamp(at).to_pydatetime()))
            elif job in before:
                self.jobs.removeKey((job,))
        yield pd.DataFrame(told, columns=["project", "job", "state", "at", "kept"])


class _Sessions(StatefulProcessor):
    """A project's sessions: the newest ones, until the watermark passes their time to live."""

    def __init__(self, ttl_seconds: int, newest: int) -> None:
        self.ttl, self.newest = ttl_seconds * 1000, newest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.sessions = handle, handle.getMapState("sessions", "session string", "created_at timestamp")

    def _told(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["project", "session", "created_at", "kept"])

    @staticmethod
    def _ms(at) -> int:
        return pd.Timestamp(at).value // 1_000_000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known = {k[0]: v[0] for k, v in self.sessions.iterator()}
        before = dict(known)
        for part in rows:
            for session, at in part[["session", "created_at"]].itertuples(index=False):
                if session is not None and not pd.isna(at) and (session not in known or self._ms(at) > self._ms(known[session])):
                    known[session] = at
        young = [s for s in known if self._ms(known[s]) + self.ttl >= now]
        kept = set(sorted(young, key=lambda s: (-self._ms(known[s]), s))[: self.newest])
        told = [(s, at, s in kept) for s, at in known.items() if s not in kept or s not in before or self._ms(before[s]) != self._ms(at)]
        for session, at, stays in told:
            if stays:
                self.sessions.updateValue((session,), (pd.Timestamp(at).to_pydatetime(),))
                self.handle.registerTimer(self._ms(at) + self.ttl + 1)
            elif session in before:
                self.sessions.removeKey((session,))
        yield from self._told(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        old = [(k[0], v[0], False) for k, v in self.sessions.iterator() if self._ms(v[0]) + self.ttl < now]
        for session, _, _ in old:
            self.sessions.removeKey((session,))
        yield from self._told(key, old)


def job_changes(log: DataFrame, finished: int = 32) -> DataFrame:
    """Rows (project, job, state, at, kept) for each job of a streamed log (project, job, state, at) that changes.

    Steps that the state before does not allow, unknown states and rows without a job or time change nothing; kept is false for a
    finished job that newer ones have displaced. Within a batch steps count in order of time. On a log in order, what is
    kept at the end is what streaming.traces.job_states() finds. Start it with start_stateful().
    """
    return log.groupBy("project").transformWithStateInPandas(_Jobs(finished), JOB_STATES, "Update", "None")


def session_changes(sessions: DataFrame, delay: str = "0 seconds", ttl_seconds: int = 3600, newest: int = 50) -> DataFrame:
    """Rows (project, session, created_at, kept) as sessions of a stream (project, session, created_at) come and go.

    kept is false once the watermark, `delay` behind the newest session, has passed the time to live, or when `newest` newer
    ones of the project are there. Rows without a session or time change nothing. Start it with start_stateful().
    """
    timed = sessions.withWatermark("created_at", delay)
    return timed.groupBy("project").transformWithStateInPandas(_Sessions(ttl_seconds, newest), SESSION_STATES, "Update", "EventTime")


def start_stateful(spark: SparkSession, writer):
    """Start a stream writer whose state needs RocksDB; the session's own state store stays as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)

"""The life of crawl jobs, folded from their events.

A job is queued, claimed by a worker, and then done, failed (to be tried again, or dead after the last
attempt) or cancelled. Between events time acts: a claimed job whose worker gave no sign for the
heartbeat's timeout, or that runs longer than a job may, is released at that moment, as one that
failed. Pause keeps a job from being claimed; cancel ends a waiting job at once and a claimed one at its
worker's next sign. Events of a worker that doesn't hold the job, and of jobs that ended, do nothing.

Events go to partitions by job and are sorted there by time and number, so that the fold holds one
state and no list of events, however many a job has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import astuple, dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.functions.times import millis

WAITING, OPEN = ("queued", "retrying"), ("queued", "retrying", "claimed")
STATE = "job_id long, status string, attempts int, control string, worker string, scheduled_ms long, started_ms long, beat_ms long, finished_ms long, moves long"


@dataclass(frozen=True)
class Rules:
    """Times in milliseconds; the waiting time doubles with each attempt up to the longest."""

    beat_ms: int = 60_000
    most_ms: int = 6 * 3_600_000
    attempts: int = 3
    wait_ms: int = 15_000
    longest_ms: int = 900_000

    def wait(self, attempts: int) -> int:
        return min(self.wait_ms * 2**attempts, self.longest_ms)


@dataclass
class Job:
    status: str | None = None
    attempts: int = 0
    control: str | None = None
    worker: str | None = None
    scheduled_ms: int | None = None
    started_ms: int | None = None
    beat_ms: int | None = None
    finished_ms: int | None = None
    moves: int = 0

    def to(self, status: str) -> None:
        self.status = status
        self.moves += 1

    def ended(self, status: str, at: int) -> None:
        self.to(status)
        self.finished_ms, self.control = at, None

    def missed(self, at: int, rules: Rules) -> None:
        """An attempt that came to nothing."""
        self.attempts += 1
        self.worker = self.beat_ms = None
        if self.attempts >= rules.attempts:
            self.ended("dead", at)
        else:
            self.to("retrying")
            self.scheduled_ms = at + rules.wait(self.attempts)

    def passed(self, now: int, rules: Rules) -> None:
        """What time alone has done up to now."""
        if self.status == "claimed" and now > (due := min(self.beat_ms + rules.beat_ms, self.started_ms + rules.most_ms)):
            self.missed(due, rules)

    def told(self, at: int, action: str, worker: str | None, rules: Rules) -> None:
        """One event."""
        self.passed(at, rules)
        held = self.status == "claimed" and worker is not None and worker == self.worker
        if action == "enqueue" and self.status is None:
            self.to("queued")
            self.scheduled_ms = at
        elif action == "claim" and self.status in WAITING and self.scheduled_ms <= at and self.control != "pause" and worker is not None:
            self.to("claimed")
            self.worker, self.started_ms, self.beat_ms = worker, at, at
        elif action == "heartbeat" and held:
            if self.control == "cancel":
                self.ended("cancelled", at)
            else:
                self.beat_ms = at
        elif action == "complete" and held:
            self.ended("done", at)
        elif action == "fail" and held:
            self.missed(at, rules)
        elif action == "pause" and self.status in OPEN:
            self.control = "pause"
        elif action == "resume" and self.status in OPEN:
            self.control = None
        elif action == "cancel" and self.status == "claimed":
            self.control = "cancel"
        elif action == "cancel" and self.status in WAITING:
            self.ended("cancelled", at)


def _folded(rules: Rules, as_of: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5]
    names = ["job_id", *(f.name for f in fields(Job))]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, job = None, None
        for batch in batches:
            out = []
            for job_id, at, action, worker in zip(*(batch.column(c).to_pylist() for c in ("job_id", "at_ms", "action", "worker")), strict=True):
                if job is None or job_id != own:
                    if job is not None:
                        job.passed(as_of, rules)
                        out.append((own, *astuple(job)))
                    own, job = job_id, Job()
                job.told(at, action, worker, rules)
            yield told(out)
        if job is not None:
            job.passed(as_of, rules)
            yield told([(own, *astuple(job))])

    return folded


def lives(events: DataFrame, as_of: Column, rules: Rules | None = None) -> DataFrame:
    """The state of each job at a time, and how often it moved (STATE). events: job_id, at, seq (their
    order where times are equal), action (enqueue, claim, heartbeat, complete, fail, pause, resume,
    cancel) and worker. Jobs that were never queued have no status; unknown actions do nothing."""
    spark = events.sparkSession
    (now,) = spark.range(1).select(millis(as_of)).first()
    rows = events.where(F.col("job_id").isNotNull() & (F.col("at") <= as_of)).select("job_id", millis(F.col("at")).alias("at_ms"), "seq", "action", "worker")
    dealt = rows.repartition("job_id").sortWithinPartitions("job_id", "at_ms", "seq")
    return dealt.select("job_id", "at_ms", "action", "worker").mapInArrow(_folded(rules or Rules(), now), STATE)

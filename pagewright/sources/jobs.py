"""Work in the background: its progress, and its end on demand.

A job runs in a thread of its own under a job group, so its Spark jobs can be counted and cancelled without touching
others of the session. Work that publishes does so last (publish_run, snapshots.save), and what a cancelled job has written is removed
by them, so it publishes nothing.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """The job was cancelled before it ended."""


class Progress(NamedTuple):
    status: str
    done: int
    total: int
    title: str


class Job:
    """work(job) in the background; it may call job.report(title) and job.check() between its steps."""

    def __init__(self, spark: SparkSession, work: Callable[[Job], Any], title: str = ""):
        self.spark, self.title, self.group = spark, title, f"job-{uuid.uuid4().hex}"
        self._stop, self._value, self._error = threading.Event(), None, None
        self._thread = InheritableThread(target=lambda: self._run(work))
        self._thread.start()

    def _run(self, work: Callable[[Job], Any]) -> None:
        try:
            self.spark.sparkContext.setJobGroup(self.group, self.title or self.group, True)
            self.check()
            self._value = work(self)
        except BaseException as e:  # noqa: BLE001 - handed to whoever asks for the result
            self._error = e

    def check(self) -> None:
        """Ends the work here if it was cancelled."""
        if self._stop.is_set():
            raise Cancelled(self.title)

    def report(self, title: str) -> None:
        self.check()
        self.title = title

    @property
    def status(self) -> str:
        if self._thread.is_alive():
            return "cancelling" if self._stop.is_set() else "running"
        if self._error is not None:
            return "cancelled" if self._stop.is_set() else "failed"
        return "completed"

    def progress(self) -> Progress:
        """Tasks that have ended and all tasks of the stages that have begun."""
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(self.group):
            for stage in getattr(tracker.getJobInfo(job), "stageIds", ()):
                info = tracker.getStageInfo(stage)
                if info and info.numActiveTasks + info.numCompletedTasks + info.numFailedTasks:
                    done, total = done + info.numCompletedTasks, total + info.numTasks
        return Progress(self.status, done, total, self.title)

    def cancel(self, wait: float = 60.0) -> None:
        """Stops the job's Spark jobs, those that it starts meanwhile too, and waits for its thread."""
        self._stop.set()
        for _ in range(max(1, int(wait * 5))):
            self.spark.sparkContext.cancelJobGroup(self.group)
            self._thread.join(0.2)
            if not self._thread.is_alive():
                return

    def result(self) -> Any:
        """What work returned, once it ends; Cancelled if it was cancelled, else its error."""
        self._thread.join()
        if self._error is not None:
            if self._stop.is_set():
                raise Cancelled(self.title) from self._error
            raise self._error
        return self._value

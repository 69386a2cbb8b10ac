"""Deadlines that stop the work: Spark jobs run in a group of their own, which is cancelled when time is up."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import SparkSession

T = TypeVar("T")


class DeadlineExceeded(TimeoutError):
    """Work was stopped at its deadline, or never began."""


def run_within(spark: SparkSession, seconds: float, work: Callable[[], T], what: str = "work", patience: float = 30.0) -> T:
    """The result of ``work``, or its error. It runs in a thread that Spark's JVM knows as its own, so that all jobs it starts are of one
    group, queries' broadcasts and subqueries too. When ``seconds`` are over the group is cancelled, and again as long as the thread
    goes on to start jobs; DeadlineExceeded is raised once it has ended, or after ``patience`` seconds of that. Work between jobs
    can't be interrupted and is waited for.
    """
    if seconds <= 0:
        raise DeadlineExceeded(f"no time is left for {what}")
    group, done = f"deadline-{uuid.uuid4().hex}", threading.Event()
    outcome: list = []

    def run() -> None:
        try:
            spark.sparkContext.setJobGroup(group, what, interruptOnCancel=True)
            outcome.append((work(), None))
        except BaseException as error:  # noqa: BLE001
            outcome.append((None, error))
        finally:
            done.set()

    thread = InheritableThread(target=run, daemon=True)
    began = time.monotonic()
    thread.start()
    if not done.wait(seconds):
        give_up = time.monotonic() + patience
        while not done.is_set() and time.monotonic() < give_up:
            spark.sparkContext.cancelJobGroup(group)
            done.wait(0.2)
        raise DeadlineExceeded(f"{what} was stopped after {time.monotonic() - began:.1f} of {seconds:.1f} seconds")
    result, error = outcome[0]
    if error is not None:
        raise error
    return result


def active_jobs(spark: SparkSession) -> list[int]:
    return sorted(spark.sparkContext.statusTracker().getActiveJobsIds())


class TimeBudget:
    """Seconds that several pieces of work share: what one takes isn't there for the next."""

    def __init__(self, spark: SparkSession, seconds: float):
        self.spark, self.ends = spark, time.monotonic() + seconds

    def left(self) -> float:
        return max(0.0, self.ends - time.monotonic())

    def run(self, work: Callable[[], T], what: str = "work") -> T:
        return run_within(self.spark, self.left(), work, what)

    def first_of(self, *attempts: Callable[[], T]) -> T | None:
        """The first attempt's result that comes without an error, as far as time goes; None if there is none."""
        for work in attempts:
            with contextlib.suppress(Exception):
                return self.run(work)
        return None

"""Jobs end at their deadline, tasks and all."""

import time

import pytest

from tablesense.plans.deadlines import DeadlineExceeded, TimeBudget, active_jobs, run_within


def endless(spark):
    return spark.range(10**13).selectExpr("bit_xor(xxhash64(id, id + 1))").collect()


def test_a_long_job_is_cancelled_and_its_tasks_end(spark):
    before = active_jobs(spark)
    began = time.monotonic()
    with pytest.raises(DeadlineExceeded, match="big sum"):
        run_within(spark, 2, lambda: endless(spark), "big sum")
    assert 1.9 < time.monotonic() - began < 25
    for _ in range(100):
        if active_jobs(spark) == before and not running_tasks(spark):
            break
        time.sleep(0.1)
    assert active_jobs(spark) == before and not running_tasks(spark)
    assert spark.range(10).count() == 10  # the session goes on


def running_tasks(spark):
    tracker = spark.sparkContext.statusTracker()
    return sum(tracker.getStageInfo(s).numActiveTasks for s in tracker.getActiveStageIds() if tracker.getStageInfo(s))


def test_python_workers_are_stopped_too(spark):
    def slow_rows(batches):
        for b in batches:
            time.sleep(0.5)
            yield b

    began = time.monotonic()
    with pytest.raises(DeadlineExceeded):
        run_within(spark, 2, lambda: spark.range(0, 10**7, 1, 4).mapInPandas(slow_rows, "id long").count())
    assert time.monotonic() - began < 40


def test_jobs_of_others_go_on(spark):
    """A group's end leaves other groups alone, also in the thread that set the deadline."""
    with pytest.raises(DeadlineExceeded):
        run_within(spark, 1, lambda: endless(spark))
    assert run_within(spark, 60, lambda: spark.range(100).count()) == 100
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_results_and_errors_come_through(spark):
    with pytest.raises(ZeroDivisionError):
        run_within(spark, 30, lambda: 1 // 0)
    with pytest.raises(DeadlineExceeded):
        run_within(spark, 0, lambda: 1)


def test_a_budget_is_shared(spark):
    budget = TimeBudget(spark, 4)
    assert budget.run(lambda: spark.range(3).count()) == 3
    assert budget.first_of(lambda: 1 // 0, lambda: spark.range(5).count()) == 5
    with pytest.raises(DeadlineExceeded):
        budget.run(lambda: endless(spark))
    assert budget.left() == 0 and budget.first_of(lambda: 1) is None

"""A run that is stopped anywhere and goes on later gives what one run gives."""

import pytest
from pyspark.sql import functions as F

from brindle.operators.ledger import Ledger

TASKS = [(f"t{i:02}", i % 3) for i in range(20)] + [("t03", 9), (None, 1)]


class Stop(Exception):
    pass


def work(log, stop=None):
    """Sums each task's log; tasks ending in 4 fail once, in 7 always, t05 has no log. ``stop``: raises before or after the rows of that batch."""
    seen = []

    def run(batch):
        seen.append(1)
        if stop == len(seen):
            raise Stop
        sums = batch.join(log, "task").groupBy("task", "attempt").agg(F.sum("n").alias("total"))
        error = F.when(F.col("task").endswith("7") | (F.col("task").endswith("4") & (F.col("attempt") == 1)), "no")
        return sums.select("task", "total", error.alias("error"))

    return run


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(f"t{i:02}", j) for i in range(20) if i != 5 for j in range(i + 1)], "task string, n long").withColumn("attempt_of", F.lit("x"))


def outcome(ledger):
    state = sorted((r.task, r.attempts, r.status) for r in ledger.state().collect())
    return state, sorted((r.task, r.total) for r in ledger.results().collect())


def test_resumed_runs_equal_one_run(spark, log, tmp_path):
    tasks = spark.createDataFrame(TASKS, "task string, priority int")
    whole = Ledger(spark, f"file://{tmp_path}/whole")
    assert whole.results() is None and whole.run(tasks, work(log), 6) == 6 and whole.run(tasks, work(log), 6) == 0
    state, results = outcome(whole)
    assert state == [(f"t{i:02}", 3 if i % 10 == 7 or i == 5 else 2 if i % 10 == 4 else 1, "failed" if i % 10 == 7 or i == 5 else "done") for i in range(20)]
    assert results == [(f"t{i:02}", i * (i + 1) // 2) for i in range(20) if i % 10 != 7 and i != 5]
    parts = Ledger(spark, f"file://{tmp_path}/parts")
    while parts.run(tasks, work(log), 6, batches=1):
        pass
    assert outcome(parts) == (state, results)
    # stopped in the middle of a batch: what was begun is done again, as another attempt
    broken = Ledger(spark, f"file://{tmp_path}/broken")
    with pytest.raises(Stop):
        broken.run(tasks, work(log, stop=2), 6)
    begun = {r.task for r in broken.state().where("status = 'started'").collect()}
    assert len(begun) == 6
    broken.run(tasks, work(log), 6)
    again, found = outcome(broken)
    assert [(t, s) for t, _, s in again if not t.endswith("4") or s == "done"] == [(t, s) for t, _, s in state if not t.endswith("4") or s == "done"] and found == results
    assert all(a <= 3 for _, a, _ in again) and {t for t, a, _ in again if a > dict((x, y) for x, y, _ in state)[t]} <= begun


def test_first_in_priority(spark, log, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/order")
    ledger.run(spark.createDataFrame(TASKS, "task string, priority int"), work(log), 7, batches=1)
    assert {r.task for r in ledger.state().collect()} == {f"t{i:02}" for i in range(20) if i % 3 == 0}
    assert ledger.run(spark.createDataFrame([], "task string, priority int"), work(log)) == 0

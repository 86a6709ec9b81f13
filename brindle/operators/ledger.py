"""Work on stored logs task by task, resumable after a stop at any place: an append-only ledger says what was begun, done and failed.

A batch's results are written before the ledger names them, each batch in a folder of its own, and readers take results only of tasks that the ledger names as done. So a run that is stopped anywhere and goes on later gives the
results of one that wasn't: work that was begun and not finished is done again under its next attempt, and what it may have left behind is never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.models.store import exists

LEDGER = "task string, attempt int, status string, batch long"


class Ledger:
    """The ledger below ``root``; ``most`` attempts a task."""

    def __init__(self, spark: SparkSession, root: str, most: int = 3) -> None:
        self.spark, self.root, self.most = spark, root.rstrip("/"), most

    def rows(self) -> DataFrame:
        path = f"{self.root}/ledger"
        return self.spark.read.schema(LEDGER).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], LEDGER)

    def state(self) -> DataFrame:
        """``task, attempts, status`` by the last attempt; of one attempt an end counts before its beginning."""
        last = F.struct("attempt", (F.col("status") != "started").alias("ended"))
        return self.rows().groupBy("task").agg(F.max("attempt").alias("attempts"), F.max_by("status", last).alias("status"))

    def open(self, tasks: DataFrame) -> DataFrame:
        """Tasks (``task, priority``) still to do with the number of their next attempt: new ones, failed ones with attempts left, and begun ones that never ended. A broken-off attempt counts as an attempt."""
        known = tasks.join(self.state(), "task", "left")
        again = F.col("status").isin("failed", "started") & (F.col("attempts") < self.most)
        return known.where(F.col("status").isNull() | again).select("task", "priority", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempt"))

    def _append(self, rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).select("task", F.col("attempt").cast("int").alias("attempt"), "status", "batch").write.mode("append").parquet(f"{self.root}/ledger")

    def run(self, tasks: DataFrame, work: Callable[[DataFrame], DataFrame], size: int = 100, batches: int | None = None) -> int:
        """Does open tasks in batches of ``size`` by priority and name, until none is left or ``batches`` are done; returns the number of batches.

        ``work`` gets ``task, attempt`` and returns rows with ``task`` and ``error`` (null: fine) and whatever it found, one row or more a task; a task without a row, or with an error in any row, has failed. Tasks that repeat count once.
        """
        tasks = tasks.where("task is not null").groupBy("task").agg(F.min("priority").alias("priority"))
        last = self.rows().agg(F.max("batch")).first()[0]
        number, done = (0 if last is None else last + 1), 0
        while batches is None or done < batches:
            todo = self.open(tasks).orderBy(F.asc_nulls_last("priority"), "task").limit(size).select("task", "attempt").collect()  # at most ``size`` names
            if not todo:
                break
            batch = self.spark.createDataFrame([tuple(r) for r in todo], "task string, attempt int")
            self._append(batch.withColumn("status", F.lit("started")), number)
            path = f"{self.root}/results/{number}"
            work(batch).join(F.broadcast(batch), "task").write.mode("overwrite").parquet(path)
            ended = self.spark.read.parquet(path).groupBy("task").agg(F.count_if(F.col("error").isNotNull()).alias("bad"))
            status = F.when(F.col("bad") == 0, "done").otherwise("failed")
            self._append(batch.join(ended, "task", "left").select("task", "attempt", F.coalesce(status, F.lit("failed")).alias("status")), number)
            number, done = number + 1, done + 1
        return done

    def results(self) -> DataFrame | None:
        """Rows of tasks that are done, each from the attempt that did it; null before the first batch."""
        path = f"{self.root}/results"
        if not exists(self.spark, path):
            return None
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(path)
        return rows.join(self.rows().where("status = 'done'").select("task", "attempt"), ["task", "attempt"], "left_semi")

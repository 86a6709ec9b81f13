"""A grid of linear price models trained from one table of sufficient statistics: nested shares of the groups, columns left out, seeds.

The statistics (moments of the design matrix and the target) are added up once per market and bucket of groups. A cell of the grid adds those of its buckets and solves; no cell reads the rows again. All cells are evaluated in
one pass over the test rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.models.boosting import WHOLE, matrix

#: Buckets that groups are dealt to: shares of the training set are multiples of 1 / BUCKETS. Steps of the error's histogram and its last step.
BUCKETS, STEPS, LAST = 40, 1000, 20_000


def bucket(group: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a group; the rows of a group stay together."""
    return F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int")


def order_of_buckets(seed: int, buckets: int = BUCKETS) -> list[int]:
    return sorted(range(buckets), key=lambda b: hashlib.sha256(f"{seed}:{b}".encode()).digest())


@dataclass(frozen=True)
class Cell:
    """One training: a share of the groups (those of a smaller share are among those of a larger one with the same seed) and columns that count as zeros."""

    name: str
    share: float
    seed: int
    without: tuple[int, ...] = ()

    def buckets(self) -> list[int]:
        return order_of_buckets(self.seed)[: max(1, round(self.share * BUCKETS))]


def cells(shares: Sequence[float], seeds: Sequence[int], ablations: Mapping[str, Sequence[int]]) -> list[Cell]:
    return [Cell(f"{name}/{share:g}/{seed}", share, seed, tuple(cols)) for name, cols in {"full": (), **ablations}.items() for share in shares for seed in seeds]


def statistics(rows: DataFrame, width: int) -> DataFrame:
    """``market, bucket, n, moments``: sums of products of (1, x, y) over the training rows, one row per market and bucket. Tasks add up their own rows first."""
    k = width + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            market, b = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(zero_copy_only=False)
            y = batch.column(2).to_numpy(zero_copy_only=False)
            a = np.column_stack([np.ones(len(y)), matrix(batch.column(3)).astype(float), y])
            for m in sorted(set(market)):
                for own in np.unique(b[market == m]):
                    part = a[(market == m) & (b == own)]
                    total[m, int(own)] = total.get((m, int(own)), 0) + part.T @ part
        for (m, own), s in sorted(total.items()):
            yield pa.RecordBatch.from_pydict({"market": [m], "bucket": pa.array([own], pa.int32()), "moments": [s.astype("<f8").tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        s = sum(np.frombuffer(x, "<f8") for x in sorted(pdf["moments"]))  # in an order that doesn't depend on the tasks
        return pd.DataFrame({"market": pdf["market"].iloc[:1], "bucket": pdf["bucket"].iloc[:1], "n": [round(s[0])], "moments": [s.tobytes()]})

    whole = rows.where(f"bucket is not null and {WHOLE}").select("market", "bucket", F.col("y").cast("double").alias("y"), "x")
    parts = whole.where(F.size("x") == k - 2).mapInArrow(run, "market string, bucket int, moments binary")
    return parts.groupBy("market", "bucket").applyInPandas(merge, "market string, bucket int, n long, moments binary")


def solve(moments: np.ndarray, without: Sequence[int], ridge: float) -> np.ndarray:
    """Coefficients (intercept first) of the ridge regression given by the moments; left-out columns get 0."""
    k = len(moments) - 1
    use = np.array([0, *(i + 1 for i in range(k - 1) if i not in set(without))])
    a = moments[np.ix_(use, use)] + ridge * np.diag([0.0, *[1.0] * (len(use) - 1)])
    out = np.zeros(k)
    out[use] = np.linalg.lstsq(a, moments[use, k], rcond=None)[0]
    return out


def train(stats: DataFrame, grid: Sequence[Cell], width: int, ridge: float = 1.0) -> DataFrame:
    """``cell, market, n, coefficients`` of every cell: the statistics of its buckets meet in one group per cell and market (at most BUCKETS rows) and are solved there."""
    spark = stats.sparkSession
    wanted = spark.createDataFrame([(c.name, b, [int(i) for i in c.without]) for c in grid for b in c.buckets()], "cell string, bucket int, without array<int>")
    k = width + 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        s = sum(np.frombuffer(x, "<f8") for x in pdf["moments"]).reshape(k, k)
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "market": pdf["market"].iloc[:1], "n": [int(pdf["n"].sum())], "coefficients": [solve(s, pdf["without"].iloc[0], ridge)]})

    return stats.join(wanted, "bucket").groupBy("cell", "market").applyInPandas(run, "cell string, market string, n long, coefficients array<double>")


def errors(test: DataFrame, trained: DataFrame) -> DataFrame:
    """``cell, market, n_test, mdape, within25`` of all cells over the test rows (``market, y, x``), in one pass: shares of error are counted in steps of 0.1% up to 2000%, so that no task holds all errors.

    The grid's coefficients go to every task: their number is that of the cells.
    """
    models: dict[str, tuple[list[str], np.ndarray]] = {}
    for r in sorted(trained.select("cell", "market", "coefficients").collect(), key=lambda r: (r.market, r.cell)):
        names, rows = models.setdefault(r.market, ([], []))
        names.append(r.cell)
        rows.append(r.coefficients)
    models = {m: (names, np.array(rows).T) for m, (names, rows) in models.items()}
    held = test.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            market, y = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(zero_copy_only=False)
            x = matrix(batch.column(2)).astype(float)
            for m in set(market) & set(held.value):
                own = market == m
                names, w = held.value[m]
                ape = np.abs(np.exp(w[0] + x[own] @ w[1:] - y[own, None]) - 1)
                step = np.minimum(np.floor(ape * STEPS), LAST).astype(np.int64)
                for c in range(len(names)):
                    counts = np.bincount(step[:, c], minlength=LAST + 1)
                    total[m] = total.get(m, np.zeros((len(names), LAST + 1), np.int64))
                    total[m][c] += counts
        for m, counts in sorted(total.items()):
            for c, name in enumerate(held.value[m][0]):
                at = np.flatnonzero(counts[c])
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([m] * n, pa.string()), pa.array(at, pa.int32()), pa.array(counts[c][at])], ["cell", "market", "step", "n"])

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        n = pdf["n"].to_numpy()
        total = n.cumsum()
        at = int(np.searchsorted(total, total[-1] / 2))
        inside = (total[-1] / 2 - (total[at] - n[at])) / n[at]
        near = pdf["n"][pdf["step"] < STEPS // 4].sum() / total[-1]
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "market": pdf["market"].iloc[:1], "n_test": [int(total[-1])], "mdape": [(pdf["step"].iloc[at] + inside) / STEPS], "within25": [near]})

    whole = test.where(WHOLE).select("market", F.col("y").cast("double").alias("y"), "x")
    steps = whole.mapInArrow(run, "cell string, market string, step int, n long").groupBy("cell", "market", "step").agg(F.sum("n").alias("n"))
    return steps.groupBy("cell", "market").applyInPandas(read, "cell string, market string, n_test long, mdape double, within25 double")


def power_law(rows: Sequence[float], errors: Sequence[float]) -> dict | None:
    """error = a rows^(-b) + c with b > 0: for each of 40 values of c a line through the logarithms, the best of which stays. None for fewer than three points or errors that don't fall."""
    n, e = np.asarray(rows, float), np.asarray(errors, float)
    if len(n) < 3 or (e <= 0).any():
        return None
    best = None
    for c in np.linspace(0, e.min() * 0.95, 40):
        target = np.log(e - c)
        slope, level = np.polyfit(np.log(n), target, 1)
        miss = float(((level + slope * np.log(n) - target) ** 2).sum())
        if slope < 0 and (best is None or miss < best[0]):
            best = (miss, math.exp(level), -float(slope), float(c))
    return None if best is None else {"a": best[1], "b": best[2], "c": best[3]}


def rows_needed(law: dict | None, error: float) -> float | None:
    return None if law is None or error <= law["c"] else ((error - law["c"]) / law["a"]) ** (-1 / law["b"])

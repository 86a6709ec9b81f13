"""Collection of a search source that shows a bounded window of each result: price ranges are halved until they fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slices(items: DataFrame, low: int, high: int, window: int = 10_000, split_above: int = 9_600, least_width: int = 50) -> DataFrame:
    """Price ranges that a harvest of ``items`` (``query``, ``cents``) visits: query, lo, hi, total, status (``split`` or ``done``), fetched, truncated.

    A range with more than ``split_above`` items and wider than ``least_width`` cents is cut at its geometric mean (its middle, if that is no inner point). Where it is
    cut does not depend on the items, so each price knows the ranges on its way down: one aggregation counts all of them, and a range is visited if the one above it was
    cut. Items without a price or outside the first range take no part; ranges without items are reported with 0.
    """
    # once its ends differ by less than a factor of 2, a range shrinks to at most 0.59 of its width; some rounds more get it there
    bits = max(1, (high - low).bit_length())
    rounds = bits + bits // 3 + 8

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(lo=np.int64(low), hi=np.int64(high))
            for _ in range(rounds):
                yield b.groupby(["query", "lo", "hi"], as_index=False, dropna=False)["n"].sum()[["query", "lo", "hi", "n"]]
                b = b[b["hi"] - b["lo"] > least_width]
                if b.empty:
                    break
                lo, hi = b["lo"].to_numpy(), b["hi"].to_numpy()
                mid = np.floor(np.sqrt(np.maximum(lo, 1).astype(float) * hi) + 0.5).astype(np.int64)
                mid = np.where((mid <= lo) | (mid >= hi), np.floor((lo + hi) / 2 + 0.5).astype(np.int64), mid)
                left = b["cents"].to_numpy() <= mid
                b = b.assign(lo=np.where(left, lo, mid + 1), hi=np.where(left, mid, hi))

    long = lambda v: F.lit(v).cast("long")
    cells = items.where(F.col("cents").between(low, high)).groupBy("query", F.col("cents").cast("long").alias("cents")).agg(F.count("*").alias("n"))
    nodes = cells.mapInPandas(down, "query string, lo long, hi long, n long").groupBy("query", "lo", "hi").agg(F.sum("n").alias("total"))
    wide = F.col("hi") - F.col("lo") > least_width
    mean = F.floor(F.sqrt(F.greatest(F.col("lo"), long(1)).cast("double") * F.col("hi")) + 0.5)
    mid = F.when((mean <= F.col("lo")) | (mean >= F.col("hi")), F.floor((F.col("lo") + F.col("hi")) / 2 + 0.5)).otherwise(mean)
    children = nodes.where((F.col("total") > split_above) & wide).withColumn("mid", mid).select("query", F.explode(F.array(F.struct("lo", F.col("mid").alias("hi")), F.struct((F.col("mid") + 1).alias("lo"), "hi"))).alias("r")).select("query", "r.lo", "r.hi")
    roots = items.select("query").distinct().select("query", long(low).alias("lo"), long(high).alias("hi"))
    visited = roots.unionByName(children).join(nodes, ["query", "lo", "hi"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    split = (F.col("total") > split_above) & wide
    return visited.select("query", "lo", "hi", "total", F.when(split, "split").otherwise("done").alias("status"), F.when(split, 0).otherwise(F.least("total", F.lit(window))).alias("fetched"), (~split & (F.col("total") > window)).alias("truncated"))

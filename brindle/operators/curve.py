"""How near the mean of n sales of an article comes to the median of its other sales: the error of a price by the number of sales it is known from."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.models.tables import written
from brindle.operators.order import ranked
from brindle.operators.stats import quantiles_of_counts

#: Articles with more sales are drawn from by Spark's sorts, others inside one row; draws of sales that are held at once.
LISTED, HELD = 512, 1 << 20
#: Expected number of an article's sales below the digest up to which a draw is looked for, as a multiple of the largest size.
SPARE = 4


def own_ranks(sales: DataFrame) -> DataFrame:
    """``sales`` with the number ``n`` of sales of the article and the rank ``own`` (from 0) by value, then group. All sales are ranked together by ranges, so an article with any share of the rows is many tasks."""
    rows = written(ranked(sales.select("market", "sku", "y", "group"), [F.col("market"), F.col("sku"), F.col("y"), F.col("group")]).drop("total"))
    facts = rows.groupBy("market", "sku").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    return rows.join(facts, ["market", "sku"]).select("market", "sku", "group", "y", "n", (F.col("rank") - F.col("first")).alias("own"))


def middles(ranks: DataFrame, reach: int) -> DataFrame:
    """``market, sku, n, low, ys``: an article's values at the ranks within ``reach`` of the middle, the first of which has rank ``low``: at most 2 ``reach`` + 1 of them come together."""
    near = ranks.where(F.abs(F.col("own") - F.col("n") / 2) <= reach)
    listed = near.groupBy("market", "sku").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("own", "y"))).alias("at"))
    return listed.select("market", "sku", "n", F.col("at")[0]["own"].alias("low"), F.transform("at", lambda a: a["y"]).alias("ys"))


def rest_median(n: int, low: int, ys: np.ndarray, ranks: np.ndarray) -> float:
    """Median of what is left of ``n`` ordered values when those at ``ranks`` are taken away; ``ys`` are the values from rank ``low`` on, around the middle."""
    left = n - len(ranks)
    out = []
    for want in ((left - 1) // 2, left // 2):
        at = want
        for r in np.sort(ranks):
            if r <= at:
                at += 1
        out.append(ys[at - low])
    return float(np.mean(out))


def price_curve(sales: DataFrame, sizes: Sequence[int] = (1, 3, 5, 10, 20, 40), least_rest: int = 5, repeats: int = 20, seed: int = 0) -> DataFrame:
    """``market, n, samples, mdape, within10`` over all articles with at least n + ``least_rest`` sales and ``repeats`` random draws without replacement of each.

    ``sales``: ``market, sku, group, y`` (logarithm of the price, adjusted for condition), one row per article and group. A draw orders an article's sales by a digest of seed, draw and group, and takes the first n: the draws of one
    article are nested, the others are its reference. Sales with a null in any column take no part; equal groups of an article count once (the smallest y). Reruns give the same.
    """
    rows = sales.where("market is not null and sku is not null and group is not null and y is not null and not isnan(y)")
    large = written(rows.groupBy("market", "sku").agg(F.count("*").alias("sold")).where(F.col("sold") > LISTED).select("market", "sku"))
    errors = _listed(rows.join(large, ["market", "sku"], "left_anti"), sizes, least_rest, repeats, seed)
    if not large.isEmpty():
        errors = errors.unionByName(_ranged(rows.join(large, ["market", "sku"], "left_semi"), sizes, least_rest, repeats, seed))
    errors = written(errors)
    median = quantiles_of_counts(errors.withColumn("times", F.lit(1)), ["market", "size"], "error", (0.5,), "times", few=True).select("market", "size", F.col("q")[0].alias("mdape"))
    shares = errors.groupBy("market", "size").agg(F.count("*").alias("samples"), F.avg((F.col("error") <= 0.10).cast("double")).alias("within10"))
    return shares.join(median, ["market", "size"]).select("market", F.col("size").alias("n"), "samples", "mdape", "within10")


def _listed(rows: DataFrame, sizes: Sequence[int], least_rest: int, repeats: int, seed: int) -> DataFrame:
    """``market, size, error`` of articles with at most LISTED rows: an article's sales come together in one row and all its draws are made there, so that no draw is shuffled."""
    at = rows.repartition("market", "sku").groupBy("market", "sku").agg(F.collect_list(F.struct(F.col("group").cast("string").alias("group"), "y")).alias("at"))

    def draws(groups: list[bytes], count: int, n: int) -> np.ndarray:
        """Places of the sales of ``count`` articles of ``n`` sales each in the order of each draw."""
        digests = b"".join([hashlib.md5(b"%d|%d|%s" % (seed, draw, g)).digest() for draw in range(repeats) for g in groups])
        halves = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(repeats, count, n, 2)
        return np.lexsort((halves[..., 1], halves[..., 0]), axis=-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same: dict[tuple[str, int], tuple[list, list]] = {}
            sold = zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True)
            for market, groups, ys in sold:
                groups, ys = groups.values.to_pylist(), ys.values.to_numpy(zero_copy_only=False)
                if len(set(groups)) < len(groups):
                    least: dict[str, float] = {}
                    for g, y in zip(groups, ys, strict=True):
                        least[g] = min(y, least.get(g, y))
                    groups, ys = list(least), np.array(list(least.values()))
                if len(ys) >= min(sizes) + least_rest:
                    own = same.setdefault((market, len(ys)), ([], []))
                    own[0].append([g.encode() for g in groups])
                    own[1].append(ys)
            for (market, n), (groups, ys) in sorted(same.items()):
                step = max(1, HELD // (repeats * n))
                for lo in range(0, len(ys), step):
                    y = np.array(ys[lo : lo + step])
                    drawn = np.take_along_axis(y[None], draws([g for own in groups[lo : lo + step] for g in own], len(y), n), 2)
                    for size in sizes:
                        if n >= size + least_rest:
                            error = np.abs(np.exp(drawn[..., :size].mean(-1) - np.median(drawn[..., size:], -1)) - 1).ravel()
                            yield pa.RecordBatch.from_arrays([pa.array([market] * len(error), pa.string()), pa.array(np.full(len(error), size, np.int32)), pa.array(error)], ["market", "size", "error"])

    lists = at.select("market", F.transform("at", lambda a: a["group"]).alias("groups"), F.transform("at", lambda a: a["y"].cast("double")).alias("ys"))
    return lists.mapInArrow(run, "market string, size int, error double")


def _ranged(rows: DataFrame, sizes: Sequence[int], least_rest: int, repeats: int, seed: int) -> DataFrame:
    """``market, size, error`` of articles with any number of sales, which no task holds as a whole."""
    most = max(sizes)
    key = ["market", "sku"]
    rows = written(rows.groupBy("market", F.col("sku").cast("string").alias("sku"), F.col("group").cast("string").alias("group")).agg(F.min("y").alias("y")))
    ranks = written(own_ranks(rows))
    draw = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    order = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("draw").cast("string"), "group"))
    digests = ranks.withColumn("draw", draw).withColumn("digest", order)
    # a draw's first sales have the smallest digests: few are looked at, and all of a draw that finds too few of them
    low = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = digests.where(low < SPARE * most / F.col("n"))
    found = near.groupBy(*key, "draw").agg(F.count("*").alias("found"))
    short = ranks.groupBy(*key).agg(F.max("n").alias("n")).withColumn("draw", draw).join(found, [*key, "draw"], "left").where(F.coalesce("found", F.lit(0)) < F.least(F.lit(most), F.col("n")))
    short = written(short.select(*key, "draw"))
    looked = near.join(short, [*key, "draw"], "left_anti").unionByName(digests.join(short, [*key, "draw"], "left_semi"))
    taken = looked.withColumn("k", F.row_number().over(Window.partitionBy(*key, "draw").orderBy("digest", "group"))).where(F.col("k") <= most)
    chosen = taken.groupBy(*key, "draw").agg(F.array_sort(F.collect_list(F.struct("k", "y", "own"))).alias("c"))  # at most the largest size each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                y, own, ys = np.array([c["y"] for c in r.c]), np.array([c["own"] for c in r.c]), np.asarray(r.ys)
                for n in sizes:
                    if r.n >= n + least_rest:
                        out.append((r.market, n, abs(np.exp(y[:n].mean() - rest_median(r.n, r.low, ys, own[:n])) - 1)))
            yield pd.DataFrame(out, columns=["market", "size", "error"])

    return chosen.join(middles(ranks, most + 2), key).select("market", "n", "low", "ys", "c").mapInPandas(run, "market string, size int, error double")

"""Queries on tables with many copies: whole results, and plans that don't hold a table of rows in the driver or in one task."""

import hashlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF
from pyspark.sql import functions as F

from brindle import plans
from brindle.operators import curve, dataset, stats
from brindle.operators.stats import values_of_ranks
from brindle.models import boosting, grid, network, tables, textsvd
from brindle.plans import models, training


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Articles five times, under shifted keys."""
    d = str(tmp_path_factory.mktemp("copies"))
    spark.read.parquet(f"{SF}/part.parquet").crossJoin(spark.range(5)).selectExpr("p_partkey + id * 1000 p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice").coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


@pytest.mark.parametrize("name", ["dedup_jaccard", "dedup_minhash"])
def test_copies_are_paired_but_not_broadcast(spark, copies, name):
    db = duckdb.connect()
    db.sql(f"create view part as select * from '{copies}/part.parquet/*.parquet'")
    got = plans.QUERIES[name](spark, copies)
    want = sorted(db.sql(f"select a, b, jaccard from ({plans.ORACLE[name]})").fetchall())
    assert sorted((r.a, r.b, r.jaccard) for r in got.collect()) == want and len(want) >= 2000
    assert "Broadcast" not in plan(plans.QUERIES[name](spark, copies))


def drawn(sales, sizes=(1, 3, 5, 10, 20, 40)):
    """The price curve in plain loops."""
    own, errors = {}, {}
    for market, sku, group, y in sales:
        at = own.setdefault((market, sku), {})
        at[group] = min(y, at.get(group, y))
    for (market, _), at in own.items():
        for draw in range(20):
            y = np.array([at[g] for g in sorted(at, key=lambda g: hashlib.md5(f"0|{draw}|{g}".encode()).hexdigest())])
            for n in sizes:
                if len(y) >= n + 5:
                    errors.setdefault((market, n), []).append(abs(np.exp(y[:n].mean() - np.median(y[n:])) - 1))
    return {k: (len(e), round(float(np.median(e)), 9), round(float(np.mean(np.array(e) <= 0.1)), 9)) for k, e in errors.items()}


def test_curve_shuffles_no_draw(spark, monkeypatch):
    """Few sales are drawn from inside a row, many by ranges, with the same result; the sales are shuffled once and not once a draw."""
    rng = np.random.default_rng(5)
    sales = [(m, f"s{i}", f"g{j % 70}", float(rng.normal(i, 0.2))) for m in ("HU", "US") for i, n in enumerate((3, 6, 9, 30, 75, 75)) for j in range(n)]
    df = spark.createDataFrame([*sales, (None, "s1", "g1", 1.0), ("HU", "s3", None, 1.0), ("HU", "s3", "g99", float("nan"))], "market string, sku string, group string, y double")
    want = drawn(sales)
    many = []
    whole = curve._ranged
    monkeypatch.setattr(curve, "_ranged", lambda *a: many.append(1) or whole(*a))
    for listed, spare in ((512, 4), (20, 4), (20, 0.5)):
        monkeypatch.setattr(curve, "LISTED", listed)
        monkeypatch.setattr(curve, "SPARE", spare)
        got = {(r.market, r.n): (r.samples, round(r.mdape, 9), round(r.within10, 9)) for r in curve.price_curve(df).collect()}
        assert got == want, (listed, spare)
    assert len(many) == 2


def test_medians_hold_no_group(spark):
    """No exact median, percentile or window over a market is left in the plans of the evaluation, and no quantile of the levels is asked for twice."""
    for name in ("agg_eval_metrics", "agg_eval_by_market", "agg_conformal"):
        text = plan(plans.QUERIES[name](spark, SF))
        assert "median(" not in text and "percentile(" not in text and "row_number" not in text, name


def test_values_of_ranks_are_those_of_a_sort(spark):
    rng = np.random.default_rng(3)
    values = {g: np.sort(np.round(rng.normal(0, 50, n), 1)) for g, n in (("a", 1), ("b", 7), ("c", 3000))}
    df = spark.createDataFrame([(g, float(v), 1) for g, own in values.items() for v in own], "g string, v double, n int")
    for few in (False, True):
        got = {r.g: (r["__n"], r["__0"], r["__1"]) for r in values_of_ranks(df, ["g"], "v", lambda n: [n - 1, (n - 1) / 3], "n", few).collect()}
        assert got == {g: (len(v), v[-1], v[(len(v) - 1) // 3]) for g, v in values.items()}


def test_hashes_are_not_broadcast(spark):
    assert "Broadcast" not in plan(plans.QUERIES["dedup_hamming"](spark, SF))


@pytest.mark.parametrize("name", ["feature_extract", "feature_canonical", "feature_missing", "harvest_items", "text_identify"])
def test_texts_of_one_file_are_read_by_all_cores(spark, name):
    """A small file is one row group, hence one task, whatever its number of texts."""
    got = plans.QUERIES[name](spark, SF)
    with_rows = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(with_rows) >= spark.sparkContext.defaultParallelism


def test_rules_read_no_text_of_a_record(spark):
    """Features are a table by the time that records meet them: no condition on them is worked out again on records, however the texts come."""
    kept, _ = training.training_set(spark, SF)
    assert "ArrowEvalPython" not in plan(kept)
    r = training.records(spark, SF)
    with_texts = r.join(training.titles(spark, SF).select(F.col("id").alias("sku"), "title", "description"), "sku")
    same, _ = dataset.build(with_texts, training.images(spark, SF, r), training.LEAST, training.RULES)
    assert "ArrowEvalPython" not in plan(same)
    cols = ["id", "brand", "corpus", "title", "canonical_en", "has_image"]
    assert sorted(map(str, same.select(cols).collect())) == sorted(map(str, kept.select(cols).collect()))


def test_spread_and_noise_hold_no_market(spark):
    """Markets and kinds are few: their medians come from counts, not from a buffer or a window of all rows."""
    rows = spark.createDataFrame([("a", None, float(v)) for v in (1, 2, 4, 8, 16)] + [("a", "x", 3.0), ("a", "x", None), ("b", "x", None)], "g string, k string, y double")
    few = stats.robust_sd(rows, ["g", "k"], "y", few=True)
    assert sorted(map(str, few.collect())) == sorted(map(str, stats.robust_sd(rows, ["g", "k"], "y").collect()))
    for name in ("agg_sales_needed", "agg_noise_floor"):
        assert "median(" not in plan(plans.QUERIES[name](spark, SF)), name


def test_models_read_rows_from_all_cores(spark, monkeypatch):
    """The rows of the models come from a table that all cores wrote, and a title that is repeated is cut once a batch."""
    seen = []
    monkeypatch.setattr(grid, "statistics", lambda rows, width: seen.append(rows) or rows.select("market"))
    models.moments(spark, SF)
    tasks = seen[0].select(F.input_file_name().alias("f")).distinct().count()
    assert tasks >= spark.sparkContext.defaultParallelism


def test_blocks_of_texts_are_small(spark):
    texts = spark.createDataFrame([(" ".join(f"word{i}x{j}" for j in range(400)),) for i in range(60)], "text string").coalesce(1)
    n, terms = textsvd.vocabulary(texts, "text", 1)
    space = textsvd.TextSpace(terms["term"].tolist(), np.ones(len(terms)), np.zeros(0), np.zeros((len(terms), 0)))
    sizes = [r.n for r in textsvd._blocks(texts, "text", space).selectExpr("length(weights) n").collect()]
    assert len(sizes) > 1 and max(sizes) < 100 * (1 << 20) / 100


def test_packed_rows_are_few_and_small(spark, monkeypatch):
    """No block of rows is a whole Arrow batch and no reader's group holds more than a few blocks; the blocks still hold every row."""
    rows = spark.range(0, 9000, 1, 1).selectExpr("'HU' market", "double(id % 97) y", "transform(sequence(1, 128), i -> float(pmod(hash(id, i), 9))) x")
    got = network._pack(rows, network.Net(["HU"], [0.0], 128, 4), 2)
    sizes = [r.n for r in got.selectExpr("length(x) n").collect()]
    assert max(sizes) <= tables.BLOCK and sum(sizes) == 9000 * 128 * 4 and got.select("block").distinct().count() == len(sizes)
    seen = []
    monkeypatch.setattr(boosting, "removed", lambda df: seen.append(df))
    boosting.fit(rows, rounds=1, depth=1)
    sizes = [r.n for r in seen[0].selectExpr("length(x) n").collect()]
    assert max(sizes) <= tables.BLOCK and len(sizes) > 1 and sum(sizes) == 9000 * 128
    wide = spark.range(0, 150, 1, 1).selectExpr("repeat(sha2(string(id), 512), 4096) x")  # rows of half a megabyte
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in tables.written(wide, **tables.PACKED).inputFiles()]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 16


def test_repeated_titles_are_cut_once(spark):
    """Titles with their numbers give the space of all rows."""
    texts = ["small ring", "red widget", "small widget", "brass ring", None, "red ring"] * 5 + ["brass ring"] * 30
    df = spark.createDataFrame([(t,) for t in texts], "title string").repartition(3)
    whole, once = textsvd.fit(df, "title", rank=3), textsvd.fit(df.groupBy("title").agg(F.count("*").alias("times")), "title", rank=3, times="times")
    assert whole.terms == once.terms and np.array_equal(whole.idf, once.idf)
    assert np.allclose(whole.values, once.values) and np.allclose(whole.vectors, once.vectors, atol=1e-6)

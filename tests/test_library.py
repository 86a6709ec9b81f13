"""Sources, sinks, configuration, history and the identities of the economics."""

import json

import pytest
from pyspark.sql import functions as F

from brindle.config import DEFAULT
from brindle.operators.economics import max_bid, scenario
from brindle.operators.history import change_log, fold, upsert
from brindle.sources import files
from brindle.sources.schema import KEYS, SCHEMAS, conform


def test_price_csv(spark, tmp_path):
    p = tmp_path / "prices.csv"
    p.write_text("source,source_ref,market,price_type,amount,currency,observed_at,title,buyer_premium_rate\na,1,HU,auction_hammer,1000,HUF,2026-01-02,Vase,0.2\na,2,HU,gift,10,HUF,2026-01-02,Cup,\na,3,XX,retail,10,HUF,2026-01-02,Cup,\na,4,US,retail,x,USD,2026-01-02,Cup,\n")
    good, bad = files.price_csv(spark, str(p))
    assert [(r.source_ref, r.amount, r.premium) for r in good.collect()] == [("1", 1000.0, 0.2)]
    assert sorted((r.source_ref, r.reason) for r in bad.collect()) == [("2", "price_type"), ("3", "market"), ("4", "amount")]
    p.write_text("source,market\na,HU\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.price_csv(spark, str(p))


def test_other_sources(spark, tmp_path):
    (tmp_path / "r.md").write_text("# Report\n| Title | Price |\n|---|---|\n| [Vase](https://x.example/item-12.html) | 5 |\n| plain | 6 |\n")
    md = files.markdown_tables(spark, str(tmp_path / "r.md")).orderBy("line").collect()
    assert [(r.title, r.listing_id, r.row["Price"]) for r in md] == [("Vase", "12", "5"), (None, None, "6")]
    (tmp_path / "e.json").write_text(json.dumps({"candidates": [{"id": "1", "brand": "b"}, {"id": None, "brand": "b"}], "rejected": [{"id": "2", "brand": "c", "why": "x"}]}))
    assert sorted((r.id, r.part) for r in files.evidence_json(spark, str(tmp_path / "e.json")).collect()) == [("1", "candidates"), ("2", "rejected")]
    run = tmp_path / "run_20260102_030405"
    run.mkdir()
    (run / "l.csv").write_text("listing_id,title\n1,Vase\n,Cup\n")
    rows = files.legacy_csv(spark, str(run)).collect()
    assert len(rows) == 1 and str(rows[0].observed_at) == "2026-01-02 03:04:05"
    (tmp_path / "c.csv").write_text("brand,form_no,pattern_code,name\nacme,00722,VBO,Vase\n")
    assert files.catalog_csv(spark, str(tmp_path / "c.csv")).first().sku_key == "acme|722|VBO"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "a|b"), (1, None)], "id int, t string")
    files.write_markdown(df, str(tmp_path / "m"), ["id"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert lines[0] == "| id | t |" and "| 1 | - |" in lines and "| 2 | a\\|b |" in lines
    for write, read in ((files.write_table, spark.read.parquet), (files.write_json, spark.read.json)):
        write(df, str(tmp_path / "t"))
        assert read(str(tmp_path / "t")).count() == 2
    files.write_csv(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 2


def test_more_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "fix", 5), (2, None, 6), (3, "aukcio", 7)], "id int, sale_type string, extra int")
    files.write_sale_types(df, str(tmp_path), ["id", "sale_type"])
    by = spark.read.csv(f"{tmp_path}/by_type", header=True, inferSchema=True)
    assert sorted((r.id, r.kind) for r in by.collect()) == [(1, "fix"), (2, "ismeretlen"), (3, "aukcio")] and "extra" not in by.columns
    assert spark.read.json(f"{tmp_path}/all_json").count() == spark.read.csv(f"{tmp_path}/all_csv", header=True).count() == 3
    files.export_training(df, f"{tmp_path}/training")
    assert spark.read.csv(f"{tmp_path}/training", header=True).columns == df.columns
    meta = files.set_meta(files.set_meta(spark.createDataFrame([("a", "1")], "key string, value string"), "b", '{"x": 2}'), "a", "3")
    assert sorted(tuple(r) for r in meta.collect()) == [("a", "3"), ("b", '{"x": 2}')] and files.get_meta(meta, "b", "x int").first().x == 2


def test_schema(spark):
    assert set(KEYS) == set(SCHEMAS)
    out = conform(spark.createDataFrame([("k", 1)], "key string, other int"), "meta")
    assert out.columns == ["key", "value"] and out.first().value is None


def test_overrides():
    a = DEFAULT.override({"tax": 0.3, "hu_fee": -1, "x": 2, "us_fx": float("inf"), "reserve": True})
    assert (a.tax, a.hu_fee, a.us_fx, a.reserve) == (0.3, DEFAULT.hu_fee, DEFAULT.us_fx, DEFAULT.reserve)


def test_max_bid_leaves_the_profit(spark):
    df = spark.range(1, 200).select((F.col("id") * 997.0).alias("v"), F.when(F.col("id") % 2 == 0, "HU").otherwise("US").alias("m"), (F.col("id") % 3 == 0).alias("large"))
    bid = df.withColumn("bid", max_bid(F.col("m"), F.col("v"), F.lit(False), F.col("large"))).where("bid > 0")
    profit = scenario(F.col("m"), F.col("bid"), F.col("v"), F.lit(False), F.col("large"))["profit"]
    assert bid.where(profit < DEFAULT.min_profit - 2).isEmpty() and bid.count() > 50


def test_history(spark):
    rows = [(1, 1, 10, "a"), (1, 2, None, "a"), (1, 3, 12, None), (1, 4, 12, None), (2, 1, None, None)]
    df = spark.createDataFrame(rows, "k int, t int, p int, s string")
    log = change_log(df, ["k"], ["t"], ["p", "s"])
    assert sorted((r.k, r.t) for r in log.collect()) == [(1, 1), (1, 3), (2, 1)]
    state = {r.k: (r.p, r.s, r.updates) for r in fold(df, ["k"], ["t"], ["p", "s"]).collect()}
    assert state == {1: (12, "a", 4), 2: (None, None, 1)}
    old, new = spark.createDataFrame([(1, 5), (2, 6)], "k int, p int"), spark.createDataFrame([(2, None), (3, 7)], "k int, p int")
    once = upsert(old, new, ["k"], ["p"])
    assert {r.k: r.p for r in once.collect()} == {1: 5, 2: 6, 3: 7}
    assert {r.k: r.p for r in upsert(once, new, ["k"], ["p"]).collect()} == {1: 5, 2: 6, 3: 7}

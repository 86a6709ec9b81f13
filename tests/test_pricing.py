"""Training grid, stored versions, kept results and the evaluation of price models, against plain computations."""

import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from conftest import SF
from test_models import data, frame, odd

from brindle.models import boosting, grid, network, pricing, store, textsvd
from brindle.models.design import Design
from brindle.plans import models


def test_cells_are_plain_regressions(spark):
    rows = data(600)
    df = frame(spark, odd(rows)).withColumn("bucket", grid.bucket(F.col("id")))
    bucket = {r.id: r.bucket for r in df.select("id", "bucket").collect()}
    cells = grid.cells((0.1, 0.5, 1.0), (1, 2), {"no_x2": [2]})
    stats = grid.statistics(df, 4)
    trained = {(r.cell, r.market): r for r in grid.train(stats, cells, 4).collect()}
    for c in cells:
        own = set(c.buckets())
        smaller = [set(o.buckets()) for o in cells if o.seed == c.seed and o.share < c.share]
        assert all(s < own for s in smaller)  # nested
        for market in ("HU", "US"):
            part = [r for r in rows if r[1] == market and bucket[r[0]] in own]
            x = np.array([r[3] for r in part], np.float32).astype(float)
            use = [i for i in range(4) if i not in c.without]
            a, y = np.column_stack([np.ones(len(x)), x[:, use]]), np.array([r[2] for r in part])
            want = np.linalg.solve(a.T @ a + np.diag([0.0] + [1.0] * len(use)), a.T @ y)
            got = trained[c.name, market]
            assert got.n == len(part) and np.allclose([got.coefficients[0], *[got.coefficients[i + 1] for i in use]], want, atol=1e-6)
            assert all(got.coefficients[i + 1] == 0 for i in c.without)
    new = data(300, 5)
    measured = {(r.cell, r.market): r for r in grid.errors(frame(spark, odd(new)), grid.train(stats, cells, 4)).collect()}
    for (cell, market), r in trained.items():
        part = [t for t in new if t[1] == market]
        if not part:
            continue
        w, x = np.array(r.coefficients), np.array([t[3] for t in part], np.float32).astype(float)
        ape = np.abs(np.exp(w[0] + x @ w[1:] - np.array([t[2] for t in part])) - 1)
        got = measured[cell, market]
        assert got.n_test == len(part) and abs(got.mdape - np.median(ape)) < 0.02 and got.within25 == pytest.approx((np.floor(ape * 1000) < 250).mean())


def test_law_of_errors():
    n = [100, 200, 400, 800, 1600]
    law = grid.power_law(n, [3 * x**-0.5 + 0.02 for x in n])
    assert abs(law["b"] - 0.5) < 0.03 and law["c"] < 0.03
    assert grid.rows_needed({"a": 3.0, "b": 0.5, "c": 0.1}, 0.4) == pytest.approx(100) and grid.rows_needed(law, 0.0) is None
    assert grid.power_law([1, 2], [1, 1]) is None and grid.power_law([1, 2, 3], [1.0, 2.0, 3.0]) is None


def predicted(n=400, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for model in ("a", "b"):
        for i in range(n):
            y = float(rng.normal())
            m = y + float(rng.normal()) * (0.3 if model == "a" else 0.6)
            out.append((model, i, "HU" if i % 3 else "US", y, m - 0.1, m, m + 0.1))
    return out + [("a", -1, "HU", 1.0, None, None, None), ("few", 1, "HU", 1.0, 0.0, 0.5, 0.6)]


SCHEMA = "model string, id long, market string, y double, q10 double, q50 double, q90 double"


def test_offsets_and_metrics(spark):
    rows = predicted()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.model, r.market): r.offset for r in pricing.offsets(df).collect()}
    assert got["few", "HU"] == 0.0
    table = {(r.model, r.market): r for r in pricing.evaluation(df, ["model", "market"]).collect()}
    for model in ("a", "b"):
        for market in ("HU", "US"):
            own = np.array([r[3:] for r in rows if r[0] == model and r[2] == market and r[5] is not None])
            s = np.sort(np.maximum(own[:, 1] - own[:, 0], own[:, 0] - own[:, 3]))
            assert got[model, market] == pytest.approx(s[min(len(s) - 1, math.ceil(0.8 * (len(s) + 1)) - 1)])
            ape = np.abs(np.exp(own[:, 2] - own[:, 0]) - 1)
            t = table[model, market]
            assert (t.n, t.n_rows) == (len(own), len(own) + (model == "a" and market == "HU"))
            assert t.mdape == pytest.approx(np.sort(np.floor(np.minimum(ape, 20) * 1000))[(len(ape) + 1) // 2 - 1] / 1000)
            e = own[:, :1] - own[:, 1:]
            taus = np.array([0.1, 0.5, 0.9])
            assert t.pinball == pytest.approx(np.maximum(taus * e, (taus - 1) * e).mean(), abs=1e-4) and t.within25 == pytest.approx((ape <= 0.25).mean(), abs=1e-4)
    wide = pricing.widened(df, pricing.offsets(df)).where("model = 'b' and market = 'HU'")
    assert abs(pricing.evaluation(wide, ["model"]).first().coverage - 0.8) < 0.01
    assert pricing.choose(pricing.evaluation(df, ["model", "market"])) == {"HU": "few" if table["few", "HU"].pinball < table["a", "HU"].pinball else "a", "US": "a"}
    assert pricing.offsets(df.where("false")).count() == 0 and pricing.evaluation(df.where("false"), ["model"]).count() == 0


def test_versions_never_change_and_the_pointer_moves_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/models"
    assert store.current(spark, root) is None
    one = store.save(spark, root, {"a.json": b"1"}, {"n": 1}, {"t": spark.range(3)})
    assert store.save(spark, root, {"a.json": b"1"}, {"n": 1}) == one != store.save(spark, root, {"a.json": b"2"}, {"n": 1})
    with pytest.raises(ValueError):
        store.load(spark, root, ["a.json"])
    with pytest.raises(ValueError):
        store.publish(spark, root, "v-none")
    for version in (one, store.save(spark, root, {"a.json": b"2"}, {"n": 1}), one):
        store.publish(spark, root, version)
        assert store.current(spark, root) == version
        facts, parts = store.load(spark, root, ["a.json"])
        assert facts["version"] == version and parts["a.json"] == (b"1" if version == one else b"2")
    assert spark.read.parquet(f"{root}/{one}/t").count() == 3
    assert not [p for p in (tmp_path / "models").iterdir() if "draft" in p.name or p.name.startswith(".CURRENT-")]


def test_kept_results_follow_their_inputs(spark, tmp_path):
    source, root = f"{tmp_path}/in.parquet", f"file://{tmp_path}/root"
    spark.range(5).write.parquet(source)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(source).agg(F.sum("id").alias("s"))

    one = store.kept(spark, "sum", [source], build, root=root)
    two = store.kept(spark, "sum", [source], build, root=root)
    assert one.first().s == two.first().s == 10 and len(built) == 1
    assert all("/root/kept/sum/" in f for f in two.inputFiles())  # no source rows are read
    spark.range(6).write.mode("overwrite").parquet(source)
    assert store.kept(spark, "sum", [source], build, root=root).first().s == 15 and len(built) == 2
    assert store.kept(spark, "sum", [source], build, more={"tax": 1}, root=root).first().s == 15 and len(built) == 3


def test_scores_of_a_stored_version_are_those_of_training(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        kind, pieces = ("vase", "cup")[i % 2], int(rng.integers(1, 9))
        y = 3.0 + (kind == "vase") + math.log(pieces) + float(rng.normal()) * 0.2
        rows.append((i, ("HU", "US")[i % 5 == 0], "A", kind, f"{kind} no {i % 4}", float(pieces), y, ("train", "train", "pretrain", "val", "test")[i % 7 % 5]))
    df = spark.createDataFrame(rows, "id long, market string, brand string, object_type string, title string, pieces double, y double, part string").repartition(3)
    small = {"seeds": 1, "hidden": 8, "epochs": 2, "batches": 1, "rate": 0.05}
    fitted = pricing.train(df, Design((("object_type", ("cup", "vase")),), logs=("pieces",)), {"rounds": 4, "depth": 2, "rate": 0.5}, small, {"rank": 3}, pretrain_least=100)
    assert set(fitted.models) == {"boosted", "net", "net_no_text", "net_pretrained"} and set(fitted.chosen) == {"HU", "US"}
    table = {(r.model, r.market): r for r in fitted.metrics.where("part = 'test' and slice = 'all'").collect()}
    for market, name in fitted.chosen.items():
        assert table[name, market].pinball < table["group_median", market].pinball
    root = f"file://{tmp_path}/models"
    store.publish(spark, root, pricing.save(spark, root, fitted))
    again = pricing.load(spark, root)
    assert again.chosen == fitted.chosen and again.offsets == fitted.offsets and again.design == fitted.design
    items = df.select("id", "brand", "object_type", "title", "pieces")
    a, b = ({(r.id, r.market): tuple(r) for r in pricing.score(items, m).collect()} for m in (fitted, again))
    assert a == b and len(a) == 1800 and all(0 < r[3] <= r[4] <= r[5] for r in a.values())
    odd_items = spark.createDataFrame([(1, None, None, None, None), (2, "?", "?", "zzz", float("nan"))], items.schema)
    assert all(r.q50 > 0 for r in pricing.score(odd_items, again).where("model <> 'group_median'").collect())


def test_queries_train_as_far_as_the_library(spark, tmp_path, monkeypatch):
    """No setting of the queries leaves rounds, epochs, members, units or dimensions out."""
    seen = []
    monkeypatch.setattr(models, "root_of", lambda spark, d: f"file://{tmp_path}/none")
    monkeypatch.setattr(pricing, "train", lambda rows, design, *settings: seen.extend(settings) or (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        models.trained(spark, SF)
    for fit, given in zip((boosting.fit, network.fit, textsvd.fit), seen, strict=True):
        usual = {k: p.default for k, p in inspect.signature(fit).parameters.items()}
        assert given == {k: usual[k] for k in given}, fit.__module__

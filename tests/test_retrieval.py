"""Nearest rows inside parts against brute force, odd vectors, large parts, and recall of the inverted file on clustered data."""

import numpy as np
from pyspark.sql import functions as F

from brindle.operators import retrieval
from brindle.operators.retrieval import combined, fit_cells, nearest, neighbour_features

SCHEMA = "id long, v array<double>, market string, sale string"


def clustered(n, clusters=60, d=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d)) * 3
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, d))


def brute(rows, asked, k):
    out = []
    for i, x, m, s in asked:
        sims = sorted((-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), j) for j, y, n, t in rows if (n or "") == (m or "") and j != i and (s is None or s != t))
        out += [(m or "", i, j, r) for r, (_, j) in enumerate(sims[:k], 1)]
    return sorted(out)


def test_parts_groups_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 16)
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    x = clustered(200, 8, 5)
    x[150:170] = x[100]  # ties
    rows = [(i, x[i].tolist(), ["HU", "US", "HU", "HU", None][i % 5], str(i // 4) if i % 3 else None) for i in range(200)]
    odd = [(300, None, "HU", None), (301, [0.0] * 5, "HU", None), (302, [1.0, None, 1.0, 1.0, 1.0], "HU", None), (303, [float("nan")] + [1.0] * 4, "HU", None), (304, [float("inf")] + [1.0] * 4, "US", None), (305, [1.0, 2.0], "HU", None), (None, [1.0] * 5, "HU", None), (306, [], "HU", None)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(3).withColumn("part", F.lit("clash")).withColumn("cell", F.lit("clash")).withColumn("tile", F.lit("clash"))
    got = sorted((r.part, r.q, r.v, r.r) for r in nearest(df, k=7, part="market", group="sale").collect())
    assert got == brute(rows, rows, 7)
    asked = df.where("id % 7 = 0")
    got = sorted((r.part, r.q, r.v, r.r) for r in nearest(df, asked, k=300).collect())
    assert got == brute([(i, v, "", None) for i, v, _, _ in rows], [(i, v, "", None) for i, v, _, _ in rows if i % 7 == 0], 300)
    assert nearest(df.where("false")).count() == 0 and nearest(df, df.where("false")).count() == 0


def test_recall_on_clustered_parts(spark):
    """Two large parts and a small one: over 1,500 queries find nine tenths of their exact neighbours in under a third of the cells."""
    x = clustered(9000)
    rows = [(i, x[i].tolist(), "HU" if i % 3 else "US", None) for i in range(9000)] + [(9000 + i, x[i].tolist(), "few", None) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    asked = df.where("id % 6 = 0")
    exact = {(r.part, r.q, r.v) for r in nearest(df, asked, k=10, part="market").collect()}
    found = [(r.part, r.q, r.v) for r in nearest(df, asked, k=10, part="market", exact_below=2000).collect()]
    assert len(set(found)) == len(found) and len({f[1] for f in found}) > 1500
    assert len(exact & set(found)) >= 0.9 * len(exact) and {f for f in found if f[0] == "few"} == {e for e in exact if e[0] == "few"}
    clean, width = retrieval._clean(retrieval._standard(df, "id", "v", "market", None))
    centres, visits = fit_cells(clean.where("part <> 'few'"), width, {"HU": 6000, "US": 3000}, 10, 0.97)
    assert all(visits[p] * 3 < len(centres[p]) for p in ("HU", "US"))


def test_blocks_weigh_alike(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [0.0, 5.0], True), (2, [3.0, 4.0], [7.0, 0.0], False), (3, None, [1.0, 0.0], True), (4, [0.0, 0.0], [2.0, 0.0], None)], "id long, a array<double>, b array<double>, there boolean")
    got = {r.id: r.v for r in df.select("id", combined(["a", "b"], {"b": "there"}).alias("v")).collect()}
    assert got[3] is None and all(np.allclose(got[i], v) for i, v in ((1, [0.6, 0.8, 0.0, 1.0]), (2, [0.6, 0.8, 0.0, 0.0]), (4, [0.0] * 4)))


def test_features_of_neighbours(spark):
    found = spark.createDataFrame([("p", 1, 2, 1, 1.0), ("p", 1, 3, 2, 0.9), ("p", 1, 4, 3, 0.5)], "part string, q long, v long, r int, sim double")
    r = neighbour_features(found, spark.createDataFrame([(2, 10.0), (3, 20.0), (4, None)], "v long, y double")).first()
    w = np.exp(np.array([0.0, -2.0]))
    assert np.isclose(r.y, (w @ [10, 20]) / w.sum()) and r.best == 1.0 and np.isclose(r.mean5, 0.95) and np.isclose(r.n, np.log(3))


def test_a_task_holds_one_tile_and_a_few_blocks(spark, monkeypatch):
    """Of a part with many tiles and blocks a task gets one tile and at most AT_ONCE blocks at a time; before, all pairs of a part could come in one batch."""
    monkeypatch.setattr(retrieval, "TILE", 8)
    monkeypatch.setattr(retrieval, "BLOCK", 4)
    v = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 11), 1.0]) for i in range(120)], "id long, v array<double>")
    text = nearest(v, k=3)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in text and "MapInArrow" not in text

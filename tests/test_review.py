"""Contract of replies, ordered import, price curve and quantiles from counts, against plain computations."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import rules as R
from brindle.functions.rules import Rules
from brindle.operators import review
from brindle.operators.curve import price_curve
from brindle.operators.dataset import phash_edges
from brindle.operators.stats import group_quantiles, quantiles_of_counts
from brindle.sources import files
from brindle.sources.snapshot import comps_json, import_snapshot

GOOD = {"listing_id": "1", "url": "u1", "title": "t", "brand": "b", "sale_type": "fix", "price": 5, "category": "both", "value_min": 1, "value_max": 9, "confidence": "high", "reason": "r", "risks": ""}


def test_contract(spark):
    cases = [
        (json.dumps(GOOD), []), (None, ["no object"]), ("[1]", ["no object"]), ("{broken", ["no object"]), ('"x"', ["no object"]), ("{}", [f"missing: {n}" for n in review.PICK]),
        (json.dumps({**GOOD, "price": "5"}), ["type: price"]), (json.dumps({**GOOD, "price": 5.5}), ["type: price"]), (json.dumps({**GOOD, "price": None}), ["type: price"]), (json.dumps({**GOOD, "category": "b"}), ["value: category"]),
        (json.dumps({**GOOD, "z": 1, "a": [2], "confidence": "HIGH"}), ["value: confidence", "extra: a", "extra: z"]), (json.dumps({k: v for k, v in GOOD.items() if k != "url"}), ["missing: url"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", review.violations(F.col("t"), review.PICK).alias("v")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_picks_are_ranked_and_belong_to_the_input(spark):
    pick = lambda **k: {**GOOD, **k}
    replies = [
        (1, "fix", json.dumps({"picks": [pick(), pick(listing_id="2", url="u2", confidence="low", value_max=99), pick(listing_id="3", url="other")], "summary": "one"})),
        (2, "fix", json.dumps({"picks": [pick(listing_id="4", url="u4", value_max=50), pick(value_max=3)], "summary": ""})), (3, "fix", "cut off"), (4, "aukcio", json.dumps({"picks": [pick(listing_id="5", url="u1")], "summary": "two"})), (5, "fix", json.dumps({"picks": [], "summary": "three"})),
    ]
    r = spark.createDataFrame(replies, "chunk int, sale_type string, reply string")
    listings = spark.createDataFrame([(u, "fix", 700, None) for u in ("u1", "u2", "u4")], "url string, sale_type string, price_huf long, damage_flags string")
    checked = review.checked_picks(r, listings)
    assert sorted((c.listing_id, c.chunk, c.faults) for c in checked.collect()) == [("1", 1, []), ("1", 2, []), ("2", 1, []), ("3", 1, ["unknown url"]), ("4", 2, []), ("5", 4, ["unknown url"])]
    assert [(p["listing_id"], p["rank"], p["listed_price"]) for p in review.ranked_picks(checked).orderBy("rank").collect()] == [("4", 1, 700), ("1", 2, 700), ("2", 3, 700)]
    assert sorted(tuple(s) for s in review.summaries(r).collect()) == [("aukcio", 1, 0, "two"), ("fix", 4, 1, "one three")]
    assert review.ranked_picks(checked.where("false")).count() == 0


def write_snapshot(root, order):
    contents = {
        "one.csv": "source,source_ref,market,price_type,amount,currency,observed_at,title,url\na,1,HU,realized_sale,1000,HUF,2026-01-02,Vase,\na,2,HU,realized_sale,50,HUF,2026-01-02,Cup,http://x\na,9,HU,gift,5,HUF,2026-01-02,Cup,\n",
        "two.csv": "source,source_ref,market,price_type,amount,currency,observed_at,title,url\na,1,HU,realized_sale,1200,HUF,2026-01-03,,http://y\n",
        "comps.json": json.dumps({"k": {"cur": "USD", "url": "http://k", "minta": ["12.5 | Cedar &amp; co&#39;s vase", "x | Cedar", "7 | no brand", "9"]}, "e": {"cur": "EUR", "minta": ["20|Cedar cup"]}, "n": {"cur": "USD"}}),
    }
    for name in order:
        (root / name).write_text(contents[name])


def test_snapshot_does_not_depend_on_the_order_of_files(spark, tmp_path):
    rules = Rules(brands={"Cedar": ["cedar"]})
    steps = [("one.csv", "price_records", files.price_csv), ("missing.csv", "price_records", files.price_csv), ("two.csv", "price_records", files.price_csv), ("comps.json", "price_records", lambda s, p: comps_json(s, p, "2026-01-05", rules))]
    results = []
    for i, order in enumerate((["one.csv", "two.csv", "comps.json"], ["comps.json", "two.csv", "one.csv"])):
        root = tmp_path / str(i)
        root.mkdir()
        write_snapshot(root, order)
        tables, report = import_snapshot(spark, str(root), steps)
        results.append((sorted(tuple(r) for r in tables["price_records"].collect()), sorted(((r.step, r.file, r.reason, r.n) for r in report.collect()), key=str)))
    assert results[0] == results[1]
    rows = {r[1]: r for r in results[0][0]}
    columns = tables["price_records"].columns
    first = dict(zip(columns, rows["1"], strict=True))
    assert (first["amount"], first["title"], first["url"]) == (1200.0, "Vase", "http://y")  # the later file wins but for what it leaves open
    refs = sorted(r for r in rows if ":" in r)
    assert len(refs) == 2 and refs[0].startswith("e:") and refs[0].endswith(":20") and refs[1].endswith(":12")
    assert results[0][1] == [(0, "one.csv", "price_type", 1), (0, "one.csv", None, 2), (2, "two.csv", None, 1), (3, "comps.json", "amount", 1), (3, "comps.json", "brand", 2), (3, "comps.json", None, 2)]
    old = tables["price_records"].where("source_ref = '2'").withColumn("currency", F.lit("EUR"))
    again, _ = import_snapshot(spark, str(tmp_path / "0"), steps[:1], {"price_records": old})
    assert {r.source_ref: r.currency for r in again["price_records"].collect()} == {"1": "HUF", "2": "HUF"}


def test_quantiles_from_counts(spark):
    rng = np.random.default_rng(0)
    rows = [("HU", "a", "x", float(v)) for v in rng.normal(size=500) * 100] + [("HU", "b", "x", 5.0)] * 300 + [("US", "a", "y", float(v)) for v in np.round(np.exp(rng.normal(size=200) * 3), 2)] + [("US", "a", "z", 1.0), (None, "a", "x", 3.0), ("HU", "a", None, 3.0), ("HU", "a", "x", None)]
    df = spark.createDataFrame(rows, "market string, brand string, object_type string, y double").repartition(5)
    got = {(r.level, r.market, r.brand, r.object_type): (r.n, r.q10, r.q50, r.q90) for r in group_quantiles(df).collect()}
    whole = [r for r in rows if None not in r]
    for (level, market, brand, kind), (n, *q) in got.items():
        own = [r[3] for r in whole if r[0] == market and (brand is None or r[1] == brand) and (kind is None or r[2] == kind)]
        assert n == len(own) and np.allclose(q, np.quantile(own, [0.1, 0.5, 0.9])), (level, market)
    assert len(got) == 4 + 3 + 2 and group_quantiles(df.where("false")).count() == 0
    counts = spark.createDataFrame([("k", -3.0, 2), ("k", 0.0, 1), ("k", 7.0, 4)], "k string, v double, c long")
    assert quantiles_of_counts(counts, ["k"], "v", (0.0, 0.3, 1.0), "c").first().q == pytest.approx(list(np.quantile([-3, -3, 0, 7, 7, 7, 7], [0.0, 0.3, 1.0])))


def test_price_curve_is_plain_sampling(spark):
    rng = random.Random(2)
    rows = [("HU", "hot", str(i), rng.choice([1.0, 2.0, 2.5]) + rng.random() * (i % 3)) for i in range(90)] + [("HU", "small", str(i), float(i)) for i in range(7)] + [("US", "few", str(i), 1.0) for i in range(4)] + [("HU", "hot", "3", 99.0), (None, "hot", "1", 1.0), ("HU", None, "1", 1.0), ("HU", "hot", "odd", None)]
    df = spark.createDataFrame(rows, "market string, sku string, group string, y double").repartition(4)
    got = {(r["market"], r["n"]): (r["samples"], r["mdape"], r["within10"]) for r in price_curve(df, (1, 2, 10), 5, 6, 3).collect()}
    errors = {}
    for key in {(r[0], r[1]) for r in rows if None not in r}:
        own = {}
        for r in rows:
            if (r[0], r[1]) == key and None not in r:
                own[r[2]] = min(own.get(r[2], 1e9), r[3])
        for n in (1, 2, 10):
            for draw in range(6):
                if len(own) >= n + 5:
                    order = sorted(own, key=lambda g: (hashlib.md5(f"3|{draw}|{g}".encode()).hexdigest(), g))
                    errors.setdefault((key[0], n), []).append(abs(np.exp(np.mean([own[g] for g in order[:n]]) - np.median([own[g] for g in order[n:]])) - 1))
    assert set(got) == set(errors)
    for k, e in errors.items():
        assert got[k][0] == len(e) and got[k][1] == pytest.approx(np.median(e)) and got[k][2] == pytest.approx(np.mean(np.array(e) <= 0.1))


def test_hashes_of_every_distance(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        for distance in (0, 3, 6, 7):
            flipped = b
            for bit in rng.sample(range(64), distance):
                flipped ^= 1 << bit
            rows.append((len(rows), flipped))
    signed = [(i, h - (1 << 64) if h >> 63 else h) for i, h in rows]
    got = {tuple(sorted((r.a, r.b))) for r in phash_edges(spark.createDataFrame(signed, "owner long, phash long")).collect()}
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    want = {tuple(sorted((first[h], i))) for i, h in rows if first[h] != i}
    reps = list(first.items())
    want |= {tuple(sorted((i, j))) for k, (a, i) in enumerate(reps) for b, j in reps[k + 1 :] if (a ^ b).bit_count() <= 6}
    assert got == want
    with pytest.raises(ValueError):
        phash_edges(spark.createDataFrame(signed, "owner long, phash long"), 7)


def test_general_rules_name_no_brand():
    assert dict(R.GENERAL.brands) == {}

"""Features of listing texts and identification against values worked out by hand."""

import hashlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from brindle.functions import features as X
from brindle.functions import rules as R
from brindle.functions import text as T
from brindle.operators.harvest import slices
from brindle.operators.order import ranked

RULES = replace(R.GENERAL, brands={"Alder": [r"\bo?-?alder\w*"], "Birch": [r"\bbirch\w*"]}, stems=("alderi?", "birch"), subjects=[r"\bnyul\b", r"bagoly"])
#: One title for each way in which a form number or code can stand, and for what must not be taken for one.
IDENTITIES = [
    ("Kistálca, Alderi 6312, apponyi szegfű purpur széllel", "Alder|6312|AP"),
    ("Kávéscsésze, Alderi 2744, rotschild madarakkal", "Alder|2744|RO"),
    ("8105 kehely az Alderi gyárból", "Alder|8105|-"),
    ("Alderi kosárka 07410-0-00 RO", "Alder|7410|RO"),
    ("Birch kanna 318/SJ", "Birch|318|SJ"),
    ("Alderi hamutál cikkszám: 925", "Alder|925|-"),
    ("Alderi mokkás csésze (KOR-T 40217)", None),
    ("2K417 Alderi kínáló fedővel 1931", None),
    ("Alderi gyertyatartó az 1930-as évekből", None),
    ("Birch bagoly 18 cm", None),
    ("Kancsó 318/SJ", None),
    ("", None),
    (None, None),
]


def test_identities(spark):
    df = spark.createDataFrame([(i, t, None) for i, (t, _) in enumerate(IDENTITIES)], "i int, title string, description string")
    got = {r.i: r.sku_key for r in X.identify(df, rules=RULES).collect()}
    assert got == {i: k for i, (_, k) in enumerate(IDENTITIES)}


TEXTS = [
    # title, description, brand, basis, type, size, pieces, condition
    ("Birchi váza 12,5 cm", "hibátlan", "Birch", "title", "vase", 12.5, None, "hibatlan"),
    ("Teáskészlet 6 személyes", "A készlet Birch kerámia, nincs rajta sérülés", "Birch", "text", "tea_set", None, 6, "ismeretlen"),
    ("Régi tányér", "Birch utca 5 alatt átvehető", None, "none", "plate", None, None, "ismeretlen"),
    ("Alderi levesestál, fedele hiányzik", "", "Alder", "title", "tureen", None, None, "serult"),
    ("Alder figura", "ragasztott, magasság: 20 cm, 4 db", "Alder", "title", "figurine", 20.0, 4, "javitott"),
    ("ALDERI BOX 3\" pár", None, "Alder", "title", "bonbonniere", 7.6, 2, "ismeretlen"),
    ("", "", None, "none", "other", None, None, "ismeretlen"),
    (None, None, None, "none", "other", None, None, "ismeretlen"),
]


def test_extraction(spark):
    df = spark.createDataFrame([(i, *t[:2]) for i, t in enumerate(TEXTS)], "i int, title string, description string")
    rows = {r.i: r for r in X.extract(df, rules=RULES).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.brand, r.brand_basis, r.object_type, r.size_cm, r.pieces, r.condition) == t[2:], t


def test_subjects_and_clashing_columns(spark):
    df = spark.createDataFrame([("Alderi nyúl, 2 db", "x", "own", 1)], "title string, description string, brand string, pieces int")
    r = X.extract(df, rules=RULES).first()
    assert (r.object_type, r.brand, r.pieces) == ("figurine", "Alder", 2)
    assert X.extract(df).first().object_type == "other"


def test_rules_from_a_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"brands": {"Cedar": ["cedar"]}, "subjects": ["\\\\bbéka|beka"], "marks": {"signed": ["szignalt"]}, "head": 10}')
    rules = R.Rules.load(str(path))
    r = X.extract(spark.createDataFrame([("Cedar béka, szignált", None)], "title string, description string"), rules=rules).first()
    assert (r.brand, r.object_type, r.mark_flags) == ("Cedar", "figurine", "signed")
    late = spark.createDataFrame([("Cedar váza", "." * 10 + " cikkszám: 4711")], "title string, description string")
    assert X.identify(late, rules=rules).first().form_no is None and X.identify(late, rules=replace(rules, head=None)).first().form_no == "4711"
    path.write_text('{"brnads": {}}')
    with pytest.raises(ValueError, match="brnads"):
        R.Rules.load(str(path))


def test_relistings_share_a_key(spark):
    """A run of digits is one mark, however long; dropped characters join what stands beside them."""
    rows = [("Váza 12 cm", "s"), ("VAZA 9 cm", "s"), ("9 cm, váza!", "s"), ("vaza 1,5 cm", "s"), ("vaza 9cm", "s"), ("váza 12 cm", "other"), (None, "s"), ("", "s"), ("vaza-tal", None), ("vazatal", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, seller string")
    got = [r["k"] for r in df.select("i", T.dedup_key(F.col("title"), F.col("seller")).alias("k")).orderBy("i").collect()]
    want = [hashlib.sha1(f"{t}|{s}".encode()).hexdigest()[:16] for t, s in [("# cm vaza", "s"), ("# cm vaza", "s"), ("# cm vaza", "s"), ("## cm vaza", "s"), ("#cm vaza", "s"), ("# cm vaza", "other"), ("", "s"), ("", "s"), ("vazatal", ""), ("vazatal", "")]]
    assert got == want


@pytest.mark.parametrize(("raw", "plain"), [("Ångström ﬁ ½", "angstrom fi 1 2"), ("ß Ж 日本", "ß ж 日本"), ("10×20", "10×20"), (None, None), ("", "")])
def test_norm_decomposes_every_script(spark, raw, plain):
    r = spark.createDataFrame([(raw,)], "t string").select(T.norm(F.col("t")).alias("n")).first()
    assert r.n == plain


def test_slices_cover_each_price_once(spark):
    prices = [100 + (i * i * 37) % 9_000_000 for i in range(5000)] + [777] * 300
    df = spark.createDataFrame([("q", c) for c in prices] + [("empty", None)], "query string, cents long")
    rows = slices(df, 100, 10_000_000, window=200, split_above=190).collect()
    done = sorted((r.lo, r.hi, r.total, r.truncated) for r in rows if r.query == "q" and r.status == "done")
    assert done[0][0] == 100 and done[-1][1] == 10_000_000
    assert all(b[0] == a[1] + 1 for a, b in zip(done, done[1:]))
    assert all(t == sum(lo <= c <= hi for c in prices) for lo, hi, t, _ in done)
    assert all(t <= 200 or (cut and hi - lo <= 50) for lo, hi, t, cut in done)
    assert any(cut for *_, cut in done)  # 300 items of one price never fit
    assert [(r.total, r.status) for r in rows if r.query == "empty"] == [(0, "done")]


def test_ranks_are_those_of_a_sort(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id").repartition(7)
    got = [(r["k"], r["id"]) for r in ranked(df, [F.desc("k"), F.asc("id")]).orderBy("rank").collect()]
    assert got == sorted(got, key=lambda t: (-t[0], t[1])) and len(got) == 1000
    assert ranked(df.where("false"), [F.asc("id")]).count() == 0

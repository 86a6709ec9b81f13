"""Offer and result pages, amounts and times against values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from brindle.functions import pages as P
from brindle.functions import values as V

URL = "https://bolt.hu/x-1234567.html"  # "example" holds a word of shipping


def read(spark, *htmls, url=URL):
    df = spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "i int, url string, html string")
    return [r for r in P.offers(df, F.to_timestamp(F.lit("2026-01-01"))).orderBy("i").collect()]


def ld(text):
    return f'<script type="application/ld+json">{text}</script>'


def test_odd_pages_do_not_stop_the_job(spark):
    rows = read(spark, None, "", "<p>no end", ld("{broken"), ld("[]"), ld("[1, null, \"x\"]"), ld('{"@type": ["Product"], "offers": 5}'), ld('{"offers": [{"price": "12,500"}, {"price": "x"}, {"price": 700}]}'), ld('{"offers": {"price": "1e99"}}'), "<h1></h1><title>T &lt; 1</title>")
    assert [r.title for r in rows] == [URL] * 9 + ["T < 1"]
    assert [r.price for r in rows] == [None] * 7 + [700, None, None] and all(r.listing_id == "1234567" and r.availability == "unverified" and r.status == "active" for r in rows)


def test_sale_types(spark):
    marker = lambda kind: f'<span class="x gtm-auction-type">{kind}</span>'
    rows = read(
        spark, marker("bid") + "fix ár alkudható", marker("fix_price") + "licitálj", marker("fix_price") + '<i id="bestofferform">', marker("other") + "Licitálj!", "<a href='?bid'>bid</a>", "<b data-x='fix_price bid'>irányár</b>", "kosárba", "megegyezés szerint", "semmi",
    )
    assert [(r.sale_type, r.takes_offers) for r in rows] == [("aukcio", False), ("fix", False), ("alku", True), ("aukcio", False), ("aukcio", False), ("alku", True), ("fix", False), ("alku", True), ("ismeretlen", False)]


def test_prices(spark):
    rows = read(
        spark, "fix ár: 12 000 Ft", "szállítás, fix ár: 900 Ft", "szállítás " + "x" * 40 + " fix ár: 900 Ft", "fix ár: 50 Ft fix ár: 600 Ft", "aktuális licit: 5.500 Ft kikiáltási ár 1 000 Ft 7 db licit", "kikiáltási ár 1 000 Ft", "vételár 3000 Ft" + ld('{"offers":{"price":"2500.99"}}'),
        "licitálj" + ld('{"offers":{"price":"2500"}}'), "azonnali vétel ára: 4 000 huf", "200 Ft, 900 forint, 999999999 Ft", "postaköltség vételár: 700 Ft vételár: 800 Ft", "afixára: 700 Ft",
    )
    assert [(r.price, r.price_kind) for r in rows] == [
        (12000, "fix ar"), (900, "egyeb"), (900, "fix ar"), (600, "fix ar"), (5500, "aktualis licit"), (1000, "kikialtasi ar"), (2500, "fix ar"), (2500, "egyeb"), (4000, "fix ar"), (900, "egyeb"), (800, "egyeb"), (700, "egyeb"),
    ]
    assert (rows[4].current_bid, rows[4].start_bid, rows[4].bid_count) == (5500, 1000, 7) and rows[0].bid_count is None and rows[8].buy_now == 4000


def test_availability_belongs_to_the_listing(spark):
    node = lambda sku, state, more="": f'{{"@type":"Product","sku":{sku},"offers":{{"availability":"{state}"{more}}}}}'
    end = lambda t: f',"availabilityEnds":"{t}"'
    rows = read(
        spark, ld(node('"1234567"', "https://schema.org/InStock")), ld(node("1234567", "SoldOut")), ld(node('"7"', "SoldOut")), ld(f"[{node('7', 'SoldOut')},{node('1234567', 'InStock')}]"), ld(f'{{"@graph":[{node("1234567", "OutOfStock")}]}}'),
        ld(node("1234567", "InStock", end("2025-01-01T00:00:00Z"))), ld(node("1234567", "InStock", end("2027-01-01T00:00:00+01:00"))), ld(node("1234567", "InStock", end("soon"))), ld(node("1234567", "Odd")) + ld(node("1234567", "InStock")), "<div>sold out</div>",
    )
    assert [r.availability for r in rows] == ["in_stock", "unavailable", "unverified", "in_stock", "unavailable", "unavailable", "in_stock", "unverified", "in_stock", "unverified"]


def test_status(spark):
    gone = ld('{"@type":"Product","sku":"1234567","offers":{"availability":"SoldOut"}}')
    rows = read(spark, gone + "licitálj 3 licit", gone + "licitálj", gone + "kosárba", "a termék elkelt kosárba", "lejárt hirdetés", "kosárba")
    assert [r.status for r in rows] == ["sold", "ended", "ended", "sold", "ended", "active"] and rows[5].reason == "stock: unverified"


def test_text_fields(spark):
    page = '<title>no</title><h1>Váza <b>szép</b></h1><script>var x="<p>";</script><style>p{}</style><!-- rejtett --><p>az eladó: Bolt_1.hu&nbsp;x</p><p>Hirdetés vége: 2026.07.01. 12:00</p>'
    page += ld('{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"C"},{"position":1,"item":{"name":"B"}},{"position":3}]}') + ld('{"@type":"Product","image":["//a.example/1.jpg",{"url":"https://a.example/2.jpg"},{"x":1}]}')
    page += '<meta property="og:image" content="https://a.example/2.jpg"><img data-large="https://a.example/3.jpg" src="x"><img data-zoom-image="https://a.example/Logo.png"><img src="https://a.example/4.jpg">'
    r = read(spark, page)[0]
    assert (r.title, r.seller, r.category, r.images) == ("Váza szép", "Bolt_1.hu", "B > C", ["https://a.example/1.jpg", "https://a.example/2.jpg", "https://a.example/3.jpg"])
    assert r.end_time == datetime.datetime(2026, 7, 1, 10, 0)


def test_cards(spark):
    el = lambda i, more="", href="/a-{}.html": f'<li data-product-id="{i}" {more}><a href="{href.format(i)}">t</a></li>'
    page = "1 234 db találat <ul>" + el("1000001", 'data-gtm-name="A &amp; b" data-gtm-price="1 500" data-gtm-auction-type="bid"') + el("1000001", 'data-gtm-name="again"') + el("x1") + el("1000002", "", "/other.html") + el("1000003", 'data-gtm-price="20" data-gtm-currency="eur" data-expired="1"')
    page += '<div data-product-id="1000004"><a href="/skip.html">s</a><a class="b product_link" href="https://o.example/b-1000004.html#x" title="From link">t</a></div></ul><nav class="pagination"></nav>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "<p>none</p>")], "q int, html string").withColumn("url", F.lit("clash"))
    got = [(r.id, r.card_url, r.title, r.price, r.sale_type, r.expired) for r in P.cards(df, "https://s.example").orderBy("id").collect()]
    assert got == [("1000001", "https://s.example/a-1000001.html", "A & b", 1500, "aukcio", False), ("1000003", "https://s.example/a-1000003.html", "", None, None, True), ("1000004", "https://o.example/b-1000004.html", "From link", None, None, False)]
    facts = df.select("q", P.reported_total(F.col("html")).alias("t"), P.has_next(F.col("html")).alias("n")).orderBy("q").collect()
    assert [(r.t, r.n) for r in facts] == [(1234, False), (None, None), (None, None)]
    assert spark.createDataFrame([('<a rel="next" href="?p=2">',)], "html string").select(P.has_next(F.col("html")).alias("n")).first().n is True


@pytest.mark.parametrize(("raw", "want"), [("2026. 07. 01. 12:00", (2026, 7, 1, 10, 0)), ("2026.1.2.", (2026, 1, 1, 23, 0)), ("2026-03-05T08:00:00+02:00", (2026, 3, 5, 6, 0)), ("2026-03-05T08:00", (2026, 3, 5, 7, 0)), ("vége 2026/10/03 19:11", (2026, 10, 3, 17, 11)), ("2026.13.40.", None), ("soon", None), (None, None)])
def test_times(spark, raw, want):
    r = spark.createDataFrame([(raw,)], "t string").select(V.local_utc(F.col("t")).alias("u")).first()
    assert r.u == (want and datetime.datetime(*want))

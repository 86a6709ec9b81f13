"""Queries on pages: offers, result pages, visible text. The pages of the tables carry an offer made of their number."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import pages as P
from brindle.functions.text import legacy_norm
from brindle.plans.base import query, table
from brindle.session import dealt

#: What stands at the top of each page, by its number modulo 8; {n} is 1000000 + number, {p} a price of four digits. By hand: what each gives stands in the oracle.
OFFERS = [
    '<script type="application/ld+json">{"@type":"Product","sku":"{n}","offers":{"price":"9 999","availability":"x/InStock"}}</script><span class="a gtm-auction-type b">bid</span><p>Aktuális licit: {p} Ft (3 licit) Kikiáltási ár: 900 Ft</p>',
    '<script type="application/ld+json">[{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"B"},{"position":1,"item":{"name":"A"}}]},{"@type":"Product","sku":{n},"image":["//i.example/{n}.jpg",{"url":"https://i.example/logo.png"}],"offers":{"price":{p}.5,"availability":"https://s/OutOfStock"}}]</script><span class="gtm-auction-type">fix_price</span>',
    '<span class="gtm-auction-type">fix_price</span><form id="bestofferform"></form><p>Fix ár: {p} Ft, irányár</p>',
    "<p>Jelenlegi licit {p} Ft. Az aukció vége: 2026. 03. 05. 15:38</p>",
    "<p>Szállítás, fix ár: 700 Ft. A mai napig érvényes teljes, minden mást kizáró vételár: {p} Ft Az eladó: uzlet_{n}</p>",
    '<script type="application/ld+json">{broken</script><p>Alkudható, {p} Ft vagy 250 Ft</p>',
    "<p>semmi</p>",
    '<script type="application/ld+json">{"@graph":[{"@type":"Product","sku":"{n}","offers":{"price":"12","availability":"InStock","availabilityEnds":"2020-01-01T00:00:00+01:00"}},{"@type":"Product","sku":"1","offers":{"price":"{p},0"}}]}</script><meta property="og:image" content="https://i.example/og.jpg"><p>Kosárba teszem</p>',
]


def offers(spark, d):
    """Pages with an offer of their own at the top."""
    k = F.col("page_id")
    block = F.element_at(F.array(*[F.lit(o) for o in OFFERS]), (F.pmod(k, F.lit(8)) + 1).cast("int"))
    n, p = (k + 1_000_000).cast("string"), (k % 9000 + 1000).cast("string")
    own = F.replace(F.replace(block, F.lit("{n}"), n), F.lit("{p}"), p)
    html = F.concat(F.lit("<html><body><h1>Tétel "), n, F.lit(" &amp; fedél</h1>"), own, F.coalesce("html", F.lit("")), F.lit("</body></html>"))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("https://shop.example/tetel-"), n, F.lit(".html")).alias("url"), html.alias("html"))


def read(spark, d):
    return P.offers(offers(spark, d), F.to_timestamp(F.lit("2026-01-01")))


_KIND = "page_id%8"
_PRICE = "1000+page_id%9000"


@query("page_fields", f"""select page_id, (1000000+page_id)::varchar listing_id, 'Tétel '||(1000000+page_id)||' & fedél' title, case {_KIND} when 0 then 'in_stock' when 1 then 'unavailable' when 7 then 'unavailable' else 'unverified' end availability,
 case {_KIND} when 4 then 'uzlet_'||(1000000+page_id) end seller, case {_KIND} when 3 then timestamp '2026-03-05 14:38:00' end end_utc, case {_KIND} when 1 then 'A > B' end category, case {_KIND} when 1 then 'https://i.example/'||(1000000+page_id)||'.jpg' when 7 then 'https://i.example/og.jpg' else '' end images from pages""")
def page_fields(spark, d):
    """Fields of offer pages from structured data and text."""
    return read(spark, d).select("page_id", "listing_id", "title", "availability", "seller", F.col("end_time").cast("timestamp_ntz").alias("end_utc"), "category", F.array_join("images", " ").alias("images"))


@query("offer_fields", f"""select page_id, case {_KIND} when 0 then 'aukcio' when 1 then 'fix' when 2 then 'alku' when 3 then 'aukcio' when 4 then 'fix' when 5 then 'alku' when 6 then 'ismeretlen' else 'fix' end sale_type, {_KIND} in (2,5) takes_offers,
 case when {_KIND}<>6 then {_PRICE} end price, case {_KIND} when 0 then 'aktualis licit' when 3 then 'aktualis licit' when 1 then 'fix ar' when 2 then 'fix ar' when 4 then 'fix ar' when 7 then 'fix ar' else 'egyeb' end price_kind,
 case when {_KIND} in (0,3) then {_PRICE} end current_bid, case {_KIND} when 0 then 900::bigint end start_bid, case {_KIND} when 0 then 3 end bid_count, case {_KIND} when 1 then 'ended' when 7 then 'ended' else 'active' end status from pages""")
def offer_fields(spark, d):
    """Kind of sale, prices by its rules, and status. Amounts after words of shipping are no prices."""
    return read(spark, d).select("page_id", "sale_type", "takes_offers", "price", "price_kind", "current_bid", "start_bid", "bid_count", "status")


@query("page_health", f"select count(*) n, round_even(avg(({_KIND}<>6)::int),4) with_type, round_even(avg(({_KIND}<>6)::int),4) with_price, round_even(avg(({_KIND} in (0,1,7))::int),4) with_stock, round_even(avg(({_KIND} in (2,5))::int),4) with_offers from pages")
def page_health(spark, d):
    """Shares of offer pages whose fields were recognised."""
    share = lambda c, name: F.bround(F.avg(c.cast("double")), 4).alias(name)
    return read(spark, d).agg(F.count("*").alias("n"), share(F.col("sale_type") != "ismeretlen", "with_type"), share(F.col("price").isNotNull(), "with_price"), share(F.col("availability") != "unverified", "with_stock"), share(F.col("takes_offers"), "with_offers"))


CARD = '<div class="c" data-product-id="{i}" data-gtm-name="Darab {i} &amp; co" data-gtm-price="{p} Ft" data-gtm-currency="{c}" data-gtm-auction-type="{t}" data-expired="{e}"><a class="product_link" href="/darab-{i}.html?x=1#y">kép</a></div>'


@query("search_cards", """with c as (select o_custkey q, o_orderkey o, row_number() over (partition by o_custkey order by o_orderkey) k, count(*) over (partition by o_custkey) total, o_totalprice p from orders)
select q, 1000000+o id, 'Darab '||(1000000+o)||' & co' title, 'https://shop.example/darab-'||(1000000+o)||'.html' url, case when o%4<>0 then floor(p)::bigint end price, case o%3 when 0 then 'aukcio' when 1 then 'fix' end sale_type, o%5=0 expired, total reported_total, total>3 has_next from c""")
def search_cards(spark, d):
    """Cards of result pages: one page a customer, a card an order; every card stands twice and once with a broken number."""
    o = table(spark, d, "orders")
    i = (F.col("o_orderkey") + 1_000_000).cast("string")
    filled = F.lit(CARD)
    values = {"{p}": F.floor("o_totalprice").cast("string"), "{c}": F.when(F.col("o_orderkey") % 4 == 0, "EUR").otherwise("HUF"), "{t}": F.when(F.col("o_orderkey") % 3 == 0, "bid").when(F.col("o_orderkey") % 3 == 1, "fix_price").otherwise(""), "{e}": F.when(F.col("o_orderkey") % 5 == 0, "1").otherwise("0")}
    for name, value in values.items():
        filled = F.replace(filled, F.lit(name), value)
    one = F.concat(F.replace(filled, F.lit("{i}"), i), F.replace(filled, F.lit("{i}"), F.concat(F.lit("x"), i)), F.replace(filled, F.lit("{i}"), i))
    body = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("body"), F.count("*").alias("total"))
    html = F.concat(F.lit("<h1>"), F.col("total").cast("string"), F.lit(" találat</h1>"), F.col("body"), F.when(F.col("total") > 3, '<a rel="next" href="?p=2">tovább</a>').otherwise('<div class="pagination"></div>'))
    pages = dealt(body.select(F.col("o_custkey").alias("q"), html.alias("html")))
    found = P.cards(pages.withColumns({"reported_total": P.reported_total(F.col("html")), "has_next": P.has_next(F.col("html"))}), "https://shop.example")
    return found.select("q", F.col("id").cast("long").alias("id"), "title", F.col("card_url").alias("url"), "price", "sale_type", "expired", "reported_total", "has_next")


_BARE = "regexp_replace(regexp_replace(regexp_replace(html,'(?is)<script\\b.*?</script\\s*>',' ','g'),'(?is)<style\\b.*?</style\\s*>',' ','g'),'(?s)<!--.*?-->',' ','g')"
_SHOWN = f"regexp_replace({_BARE},'(?s)<[^>]*>',' ','g')"
_PLAIN = f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace({_SHOWN},'&nbsp;',' '),'&quot;','\"'),'&#39;',''''),'&apos;',''''),'&lt;','<'),'&gt;','>'),'&amp;','&'),chr(160),' '),'[ \\t\\n\\x0B\\f\\r]+',' ','g'))"


@query("html_cards", f"select page_id, len(list_distinct(regexp_extract_all(html,'<a\\b[^>]*\\bhref=\"([^\"]+)\"',1))) n_links, length({_PLAIN}) n_text, sha256({_PLAIN}) text_sha256 from pages")
def html_cards(spark, d):
    """Distinct links and visible text of each page."""
    text = P.visible(F.col("html"))
    links = F.array_distinct(F.regexp_extract_all("html", F.lit(r'<a\b[^>]*\bhref="([^"]+)"'), 1))
    return table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), F.length(text).cast("long").alias("n_text"), F.sha2(text, 256).alias("text_sha256"))


@query("page_norm", f"select page_id, length(trim(regexp_replace(strip_accents(lower({_PLAIN})),'\\s+',' ','g'))) n_norm from pages")
def page_norm(spark, d):
    """The older normal form of a page's visible text: lower case, no accents, punctuation kept."""
    return table(spark, d, "pages").select("page_id", F.length(legacy_norm(P.visible(F.col("html")))).cast("long").alias("n_norm"))

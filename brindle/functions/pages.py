"""Offer pages and result pages of a marketplace as columns: structured data, sale type, prices, times, images, cards.

All of it stays in the JVM but for the accents of texts outside ASCII. A null page counts as empty. Broken structured data counts as absent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import legacy_norm
from brindle.functions.values import local_utc

# Cues of normalised page text and markup formats as they must be for equal results.
AUCTION_CUES = [
    "aktualis licit", "jelenlegi licit", "licitalok", "licit lepcso", "licitlepcso", "kikialtasi ar", "legyel te az elso licitalo", "licitmegbizas", "licitek szama", "licitalasi elozmenyek", "licitalj", "licittortenet",
]
OFFER_CUES = [
    "ajanlatot tehetsz", "ajanlatot teszek", "ajanlattetel", "ajanlatot vart", "alkudhato", "alkukepes", "alku lehetseges", "iranyar", "irany ar", "megegyezes szerint", "ar megegyezes", "megegyezunk", "alkura van lehetoseg",
]
FIX_CUES = ["fix ar", "azonnali vetel", "kosarba teszem", "kosarba"]
SHIPPING_CUES = ["szallitas", "postakoltseg", "posta", "utanvet", "csomagolas", "futar", "atvetel", "foxpost", "mpl", "kezelesi"]
AMOUNT = r"([0-9][0-9\s. ]{2,})\s*(?:ft|huf|forint)"
MARKER = r'class="[^"]*\bgtm-auction-type\b[^"]*"[^>]*>\s*(\w+)\s*<'
BEST_OFFER = r'"product_bestofferminpercent"\s*:\s*(?!null)\d|id="bestofferform"'
LABELS = {
    "fix": ["fix ar", "fix ara", "vetelar", "ara"], "buy_now": ["azonnali vetel ara", "azonnali vetel", "villamar"], "bid": ["aktualis licit", "jelenlegi licit", "legmagasabb licit"],
    "start": ["kikialtasi ar", "indulo ar", "minimum ar", "minimalar"],
}
GONE = ["OutOfStock", "SoldOut", "Discontinued"]
LISTING = r"-(\d{6,})\.html$"
END_TIME = r"(?i)(?:aukci[óo] v[ée]ge|hirdet[ée]s v[ée]ge|h[áa]tral[ée]v[őo] id[őo])\s*:?\s*([0-9]{4}[.\-/ ]+[0-9]{1,2}[.\-/ ]+[0-9]{1,2}\.?(?:\s+[0-9]{1,2}:[0-9]{2})?)"
SELLER = r"(?:elad[óo]|felhaszn[áa]l[óo]|elad[óo] neve)\s*:\s*([A-Za-z0-9._\-]{3,30})"
TOTAL = r"(?iU)(\d{1,3}(?:[ . ]\d{3})*|\d+)\s*(?:db\s+)?(?:találat|termék|hirdetés)"
LEAST, MOST, VETO = 100, 100_000_000, 40

NODE = "array<struct<`@type`:string,sku:string,image:string,offers:string,itemListElement:string,`@graph`:string>>"
OFFER = "array<struct<price:string,availability:string,availabilityEnds:string>>"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def plain(c: Column) -> Column:
    """Character references of markup that stand for single characters."""
    for name, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def visible(html: Column) -> Column:
    """Text outside of scripts, styles and comments, tags as spaces, white space collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.translate(plain(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), " ", " "), r"\s+", " "))


def heading(html: Column, url: Column) -> Column:
    """First heading, else the page's title, else its address."""
    own = [F.nullif(visible(F.regexp_extract(F.coalesce(html, F.lit("")), rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1)), F.lit("")) for t in ("h1", "title")]
    return F.coalesce(*own, url)


def nodes(html: Column) -> Column:
    """Structured data of a page: objects, members of lists and of one level of ``@graph``, in order. Fields that hold objects stay JSON text."""
    scripts = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), 1)
    top = F.filter(F.flatten(F.transform(scripts, lambda s: F.coalesce(F.from_json(s, NODE), F.array().cast(NODE)))), lambda n: n.isNotNull())
    below = F.flatten(F.transform(top, lambda n: F.coalesce(F.from_json(n["@graph"], NODE), F.array().cast(NODE))))
    return F.concat(top, F.filter(below, lambda n: n.isNotNull()))


def _offers(node: Column) -> Column:
    return F.filter(F.coalesce(F.from_json(node["offers"], OFFER), F.array().cast(OFFER)), lambda o: o.isNotNull())


def offer_price(all_nodes: Column) -> Column:
    """First plausible price of any offer; a comma counts as the decimal point."""
    number = lambda o: F.replace(F.replace(o["price"], F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    prices = F.transform(F.flatten(F.transform(all_nodes, _offers)), lambda o: F.when(F.abs(number(o)) < 1e15, number(o)).cast("long"))
    return F.try_element_at(F.filter(prices, lambda p: p.between(LEAST, MOST)), F.lit(1))


def availability(all_nodes: Column, url: Column, now: Column) -> Column:
    """``unavailable``, ``in_stock`` or ``unverified`` from the product whose sku is the page's listing number and whose offer is one object."""
    own = F.filter(all_nodes, lambda n: (n["@type"] == "Product") & (n["sku"] == _found(url, LISTING)) & n["offers"].startswith("{"))

    def state(n: Column) -> Column:
        o = _offers(n)[0]
        stock, end = F.regexp_extract(F.coalesce(o["availability"], F.lit("")), r"([^/]*)$", 1), F.nullif(o["availabilityEnds"], F.lit(""))
        at = F.try_to_timestamp(end)
        zoned = end.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
        return F.when(stock.isin(GONE) | F.coalesce(zoned & (at <= now), F.lit(False)), "unavailable").when(end.isNotNull() & at.isNull(), "unverified").when(stock == "InStock", "in_stock")

    said = F.filter(F.transform(own, state), lambda s: s.isNotNull())
    return F.coalesce(F.try_element_at(said, F.lit(1)), F.lit("unverified"))


def breadcrumbs(all_nodes: Column) -> Column:
    """Names of the first list of breadcrumbs by position, joined by `` > ``."""
    kind = "array<struct<position:int,name:string,item:string>>"
    first = F.try_element_at(F.filter(all_nodes, lambda n: n["@type"] == "BreadcrumbList"), F.lit(1))
    items = F.array_sort(F.coalesce(F.from_json(first["itemListElement"], kind), F.array().cast(kind)))
    names = F.transform(items, lambda i: F.coalesce(F.get_json_object(i["item"], "$.name"), i["name"]))
    return F.nullif(F.array_join(F.filter(names, lambda n: n.isNotNull() & (n != "")), " > "), F.lit(""))


def images(html: Column, all_nodes: Column, most: int = 8) -> Column:
    """Image addresses: structured data before meta tags before the gallery; no logos, icons or placeholders, each once."""
    page = F.coalesce(html, F.lit(""))
    listed = lambda i: F.when(i.startswith("["), F.from_json(i, "array<string>")).when(i.isNotNull(), F.array(i)).otherwise(F.array().cast("array<string>"))
    product = F.flatten(F.transform(F.filter(all_nodes, lambda n: n["@type"] == "Product"), lambda n: F.transform(listed(n["image"]), lambda u: F.when(u.startswith("{"), F.get_json_object(u, "$.url")).otherwise(u))))
    meta = F.transform(F.regexp_extract_all(page, F.lit(r'(?i)<meta[^>]*(?:property="og:image"|name="twitter:image")[^>]*>'), 0), lambda m: _found(m, r'content="([^"]*)"'))
    tags = F.regexp_extract_all(page, F.lit(r"(?i)<img[^>]*(?:data-zoom-image|data-large)=[^>]*>"), 0)
    gallery = F.transform(tags, lambda t: F.coalesce(*[_found(t, rf'{a}="(?!data:)([^"]+)"') for a in ("data-zoom-image", "data-large", "data-src", r"\ssrc")]))
    whole = F.transform(F.array_compact(F.concat(product, meta, gallery)), lambda u: F.when(F.trim(u).startswith("//"), F.concat(F.lit("https:"), F.trim(u))).otherwise(F.trim(u)))
    return F.slice(F.array_distinct(F.filter(whole, lambda u: u.startswith("http") & ~u.rlike(r"(?i)logo|icon|sprite|placeholder"))), 1, most)


def _any_of(text: Column, cues: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in cues:
        out = out | text.contains(c)
    return out


def sale_type(html: Column, text: Column) -> tuple[Column, Column]:
    """Kind of sale (``aukcio``, ``fix``, ``alku``, ``ismeretlen``) and whether offers are taken. The page's own marker beats every cue in its text; ``text`` is normalised."""
    page = F.coalesce(html, F.lit(""))
    marker = F.regexp_extract(page, MARKER, 1)
    best = page.rlike(BEST_OFFER)
    fix_token, bid_token = page.rlike(r"(?iU)\bfix_price\b"), page.rlike(r"(?iU)\bbid\b")
    offer = _any_of(text, OFFER_CUES)
    fixed = F.when(offer, "alku").otherwise("fix")
    by_text = F.when(_any_of(text, AUCTION_CUES) | (bid_token & ~fix_token), "aukcio").when(fix_token | _any_of(text, FIX_CUES), fixed).when(offer, "alku").otherwise("ismeretlen")
    kind = F.when(marker == "bid", "aukcio").when((marker == "fix_price") & best, "alku").when(marker == "fix_price", "fix").otherwise(by_text)
    return kind, F.when(marker.isin("bid", "fix_price"), best).otherwise(offer)


def _amounts(text: Column, pattern: str) -> Column:
    digits = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda a: F.regexp_replace(a, r"\D", "").try_cast("long"))
    return F.filter(digits, lambda v: v.between(LEAST, MOST))


def amount_after(text: Column, labels: Sequence[str]) -> Column:
    """First plausible amount after the first label that has one. An amount doesn't count if a word of shipping stands in the 40 characters before its label."""
    veto = "".join(f"(?<!{c}.{{0,{VETO - len(c)}}})" for c in SHIPPING_CUES)
    return F.coalesce(*[F.try_element_at(_amounts(text, rf"(?sU)\b(?={label}\b){veto}{label}\b\s*:?\s*{AMOUNT}"), F.lit(1)) for label in labels])


def prices(text: Column, kind: Column, structured: Column, amounts: dict[str, Column]) -> dict[str, Column]:
    """Price and its kind by the kind of sale, and the other amounts. At an auction the bid comes before the start and structured data; else structured data before the label, the instant price and the largest amount."""
    fixed, now, bid, start = (amounts[k] for k in ("fix", "buy_now", "bid", "start"))
    auction = kind == "aukcio"
    price = F.when(auction, F.coalesce(bid, start, structured, now)).otherwise(F.coalesce(structured, fixed, now, F.array_max(_amounts(text, AMOUNT))))
    named = F.when(auction, F.when(bid.isNotNull(), "aktualis licit").when(start.isNotNull(), "kikialtasi ar").otherwise("egyeb")).otherwise(F.when(structured.isNotNull() | fixed.isNotNull(), "fix ar").otherwise("egyeb"))
    count = _found(text, r"(\d+)\s*(?:db\s*)?licit").try_cast("int")
    return {"price": price, "price_kind": named, "buy_now": now, "start_bid": F.when(auction, start), "current_bid": F.when(auction, bid), "bid_count": F.when(auction, count)}


def offers(df: DataFrame, now: Column, html: str = "html", url: str = "url") -> DataFrame:
    """All fields of offer pages beside the other columns: listing_id, title, sale_type, takes_offers, price, price_kind, buy_now, start_bid, current_bid, bid_count, availability, seller, end_time, category, images, status, reason.

    What several fields are read from (visible text, its normal form, structured data) is worked out once, in projections of its own. Columns of these names are replaced.
    """
    h, u = F.col(html), F.col(url)
    out = df.withColumns({"__shown": visible(h), "title": heading(h, u), "__nodes": nodes(h)})
    out = out.withColumn("__text", legacy_norm(F.concat_ws(" ", "title", "__shown")))
    kind, takes = sale_type(h, F.col("__text"))
    out = out.withColumns({"sale_type": kind, "takes_offers": takes, "__structured": offer_price(F.col("__nodes")), **{f"__{k}": amount_after(F.col("__text"), labels) for k, labels in LABELS.items()}})
    own = {k: F.col(f"__{k}") for k in LABELS}
    out = out.withColumns({
        "listing_id": _found(u, LISTING), **prices(F.col("__text"), F.col("sale_type"), F.col("__structured"), own), "availability": availability(F.col("__nodes"), u, now), "seller": _found(F.col("__shown"), SELLER),
        "end_time": local_utc(_found(F.col("__shown"), END_TIME)), "category": breadcrumbs(F.col("__nodes")), "images": images(h, F.col("__nodes")),
    })
    status, reason = closed(F.col("sale_type"), F.col("availability"), F.col("bid_count"), F.col("__shown"))
    return out.withColumns({"status": status, "reason": reason}).drop("__shown", "__nodes", "__text", "__structured", *[f"__{k}" for k in LABELS])


def closed(kind: Column, available: Column, bids: Column, text: Column) -> tuple[Column, Column]:
    """Status of an offer and why: an auction that ended with bids is sold, without bids ended; another offer is sold only where the page says so."""
    sold = text.rlike(r"(?iU)\b(elkelt|a termék elkelt|eladva|sikeresen zárult)\b")
    over = (available == "unavailable") | sold | text.rlike(r"(?i)(lejárt|lezárult|befejeződött)\s+(hirdetés|aukció)|az aukció véget ért")
    bid = F.coalesce(bids, F.lit(0)) > 0
    status = F.when(over & (kind == "aukcio") & bid, "sold").when(over & (kind == "aukcio"), "ended").when(over & sold, "sold").when(over, "ended").otherwise("active")
    reason = F.when(over & (kind == "aukcio") & bid, "closed with bids").when(over & (kind == "aukcio"), "closed without bids").when(over & sold, "the page says sold").when(over, "not available").otherwise(F.concat(F.lit("stock: "), available))
    return status, reason


def cards(df: DataFrame, base: str, html: str = "html") -> DataFrame:
    """A row for each card of a result page, with the page's other columns and ``id, card_url, title, price, sale_type, expired, category``: elements with a numeric product number and a product link, the first of each number.

    The page is cut into elements, whose number and link decide which are cards; only those are read further, a row each. A price in another currency than forint is left out.
    """
    first_tag = r'^<[^>]*\bdata-product-id="(\d+)"'
    anchor = r'<a\b(?=[^>]*class="[^"]*\bproduct_link\b)[^>]*\bhref="([^"]*)"'
    any_anchor = r'<a\b[^>]*\bhref="([^"]*)"'
    parts = F.split(F.coalesce(F.col(html), F.lit("")), r"(?=<[a-zA-Z]+\b[^>]*\bdata-product-id=)")
    entry = lambda s: F.struct(F.regexp_extract(s, first_tag, 1).alias("id"), F.coalesce(_found(s, anchor), _found(s, any_anchor), F.lit("")).alias("link"), s.alias("body"))
    out = df.withColumn("__all", F.filter(F.transform(parts, entry), lambda e: (e["id"] != "") & e["link"].rlike(r"-\d{6,}\.html([?#].*)?$")))
    ids = F.transform("__all", lambda e: e["id"])
    out = out.withColumn("__ids", ids).withColumn("__card", F.explode(F.filter("__all", lambda e, i: F.array_position("__ids", e["id"]) == i + 1))).drop("__all", "__ids")
    body, link = F.col("__card.body"), F.col("__card.link")
    attribute = lambda a: _found(body, rf'^<[^>]*\b{a}="([^"]*)"')
    amount = F.regexp_replace(F.regexp_extract(F.coalesce(attribute("data-gtm-price"), F.lit("")), r"\d[\d .]*", 0), r"\D", "").try_cast("long")
    forint = F.upper(F.coalesce(attribute("data-gtm-currency"), F.lit("HUF"))).isin("HUF", "FT")
    kind = attribute("data-gtm-auction-type")
    return out.withColumns({
        "id": F.col("__card.id"), "card_url": F.regexp_replace(F.when(link.startswith("http"), link).otherwise(F.concat(F.lit(base), link)), r"[#?].*$", ""),
        "title": F.trim(plain(F.coalesce(attribute("data-gtm-name"), _found(body, r'<a\b[^>]*\btitle="([^"]*)"'), F.lit("")))), "price": F.when(forint & amount.between(1, 500_000_000), amount),
        "sale_type": F.when(kind.isin("bid", "auction"), "aukcio").when(kind == "fix_price", "fix"), "expired": ~F.coalesce(attribute("data-expired"), F.lit("0")).isin("0", "false"), "category": attribute("data-gtm-category"),
    }).drop("__card")


def reported_total(html: Column) -> Column:
    """Number of results that the page names."""
    return F.regexp_replace(_found(visible(html), TOTAL), r"\D", "").try_cast("long")


def has_next(html: Column) -> Column:
    """True with a link to a next page, false with pagination that has none, null without pagination."""
    page = F.coalesce(html, F.lit(""))
    return F.when(page.rlike(r'(?i)<(?:a|link)\b[^>]*\brel="?next\b|<a\b[^>]*class="[^"]*\bnext\b|<[a-z]+\b[^>]*class="[^"]*\bnext\b[^"]*"[^>]*>\s*<a\b'), True).when(page.rlike(r'(?i)class="[^"]*\bpagination\b|<nav\b[^>]*aria-label="[^"]*agin'), False)

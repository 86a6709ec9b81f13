"""Text, number, time, JSON and HTML queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import features as X
from brindle.functions import text as T
from brindle.functions import values as V
from brindle.operators import review
from brindle.plans.base import query, table

ADJECTIVES = [("colour", r"\b(red|blue|green|black|white)\b"), ("size", r"\b(small|large|big|tiny)\b"), ("heat", r"\b(hot|cold)\b"), ("shine", r"\b(shiny|dull)\b")]


@query("relevance_class", "select p_partkey, case when contains(p_name,'hot') or regexp_matches(p_name,'\\bbo') then 'rejected' when p_size%9=0 then 'visual_candidate' else 'accepted' end relevance, array_to_string(list_filter([case when contains(p_name,'hot') then 'fake: hot' end, case when regexp_matches(p_name,'\\bbo') then 'item: bo' end], lambda x: x is not null),'; ') reason from part")
def relevance_class(spark, d):
    fake, item = F.col("p_name").contains("hot"), F.col("p_name").rlike(r"\bbo")
    r = F.when(fake | item, "rejected").when(F.col("p_size") % 9 == 0, "visual_candidate").otherwise("accepted")
    return table(spark, d, "part").select("p_partkey", r.alias("relevance"), F.concat_ws("; ", F.when(fake, "fake: hot"), F.when(item, "item: bo")).alias("reason"))


@query("filter_profiles", "select p_partkey, p_name like '%red%' or p_name like '%blue%' as broad, p_name like 'red %' or p_name like 'blue %' as narrow from part")
def filter_profiles(spark, d):
    profiles = {"broad": ("red", "blue"), "narrow": ("^red ", "^blue ")}
    return table(spark, d, "part").select("p_partkey", *[F.col("p_name").rlike("|".join(p)).alias(k) for k, p in profiles.items()])


@query("filter_screening", "select p_partkey, case when regexp_matches(p_name,'broken|case') then 'accessory' when contains(p_name,'ring') and p_type='ECONOMY' then 'collision' when regexp_matches(p_name,'^hot') and p_size>40 then 'model' end reason from part")
def filter_screening(spark, d):
    n = F.col("p_name")
    reason = F.when(n.rlike("broken|case"), "accessory").when(n.contains("ring") & (F.col("p_type") == "ECONOMY"), "collision").when(n.rlike("^hot") & (F.col("p_size") > 40), "model")
    return table(spark, d, "part").select("p_partkey", reason.alias("reason"))


@query("screen_gates", "select coalesce(case when p_size%4=0 then 'not_fixed_price' when contains(p_name,'ring') then 'no_model' when p_size<10 then 'few_comps' when p_retailprice>1500 then 'floor_above_median' when p_retailprice*0.85<900 then 'small_margin' end,'selected') gate, count(*) n from part group by 1")
def screen_gates(spark, d):
    gate = F.when(F.col("p_size") % 4 == 0, "not_fixed_price").when(F.col("p_name").contains("ring"), "no_model").when(F.col("p_size") < 10, "few_comps").when(F.col("p_retailprice") > 1500, "floor_above_median").when(F.col("p_retailprice") * 0.85 < 900, "small_margin")
    return table(spark, d, "part").groupBy(F.coalesce(gate, F.lit("selected")).alias("gate")).agg(F.count("*").alias("n"))


#: Model ranges of a shop in the order of precedence, with what a title must not hold; each colour word is a series, nouns are categories.
SERIES = [
    ("red rotating", r"\bred\b.*\b(gear|ring)\b", None), ("fixings", r"\b(bolt|rod)\b", r"\b(old|hot)\b"), ("small parts", r"\bsmall\b", r"\b(anvil|plate)\b"), ("large parts", r"\blarge\b", r"\b(gizmo|widget)\b"),
    ("used", r"\bold\b", r"\banvil\b"), ("gadgets", r"\b(gizmo|widget)\b", None), ("forge", r"\b(hot|anvil)\b", r"\bplate\b"), ("gearing", r"\bgear\b", None), ("sheets", r"\bplate\b", None),
]


@query("rule_first_match", """with w as (select p_partkey, split_part(p_name,' ',1) a, split_part(p_name,' ',2) b from part) select p_partkey, case when a='red' and b in ('gear','ring') then 'red rotating' when b in ('bolt','rod') and a not in ('old','hot') then 'fixings'
 when a='small' and b not in ('anvil','plate') then 'small parts' when a='large' and b not in ('gizmo','widget') then 'large parts' when a='old' and b<>'anvil' then 'used' when b in ('gizmo','widget') then 'gadgets' when (a='hot' or b='anvil') and b<>'plate' then 'forge' when b='gear' then 'gearing' when b='plate' then 'sheets' else 'other' end object_type from w""")
def rule_first_match(spark, d):
    """Category of a title by the first rule that holds and isn't excluded."""
    return table(spark, d, "part").select("p_partkey", T.first_match(F.col("p_name"), SERIES, "other").alias("object_type"))


@query("rule_all_matches", "select p_partkey, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(p_name,'{p}') then '{c}' end" for c, p in ADJECTIVES) + "], lambda x: x is not null)[1:3],', ') decors from part")
def rule_all_matches(spark, d):
    return table(spark, d, "part").select("p_partkey", T.all_matches(F.col("p_name"), ADJECTIVES).alias("decors"))


NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower(replace(text,chr(160),' '))),'[^\\pL\\pN_\\s.,/×''\"-]',' ','g'),'\\s+',' ','g'))"


@query("text_norm_tokens", f"select doc_id, len(list_distinct(regexp_extract_all({NORM},'[a-z]{{3,}}'))) n_tokens, length({NORM}) n_norm from documents")
def text_norm_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.length(T.norm(F.col("text"))).cast("long").alias("n_norm"))


@query("text_dedup_key", "select p_partkey, substr(sha1(array_to_string(list_sort(list_distinct([split_part(p_name,' ',1), split_part(p_name,' ',2), '#', 'cm', '##ft'])),' ')||'|'||p_brand),1,16) dedup_key from part")
def text_dedup_key(spark, d):
    """Key of relistings: size and price may change. By hand: "small ring 12 cm 900.0-Ft" has the words small, ring, #, cm and ##ft."""
    title = F.concat_ws(" ", F.initcap("p_name"), F.col("p_size"), F.lit("cm"), F.concat(F.col("p_retailprice").cast("string"), F.lit("-Ft")))
    return table(spark, d, "part").select("p_partkey", T.dedup_key(title, F.col("p_brand")).alias("dedup_key"))


@query("text_size_pieces", "select p_partkey, round_even(case when s between 1.5 and 150 then s end,1) size_cm, case when p_size between 1 and 200 and p_partkey%3=0 then p_size when p_partkey%3=1 and p_size between 1 and 24 then p_size*3 when p_partkey%3=2 then 2 end pieces from (select *, case p_partkey%3 when 0 then p_size*1.0::double when 1 then p_size/10.0::double else p_size*2.54::double end s from part)")
def text_size_pieces(spark, d):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    title = F.concat_ws(" ", "p_name", n, F.when(k == 0, "cm").when(k == 1, "mm").otherwise("inch"), F.when(k == 0, F.concat(n, F.lit(" pieces"))).when(k == 1, F.concat(n, F.lit(" persons"))).otherwise("pair"))
    return table(spark, d, "part").select("p_partkey", X.size_cm(X.norm(title)).alias("size_cm"), X.pieces(X.norm(title)).alias("pieces"))


@query("sku_keys", "select p_partkey, 'b'||p_size||'|'||p_partkey||'|'||case when p_partkey%2=0 then 'VBO' else '-' end sku_key, p_partkey::varchar form_no, ('b'||p_size||'|'||p_partkey) form_key from part")
def sku_keys(spark, d):
    form = F.regexp_replace(F.lpad(F.col("p_partkey").cast("string"), 7, "0"), "^0+(?=.)", "")
    key = T.sku_key(F.concat(F.lit("b"), F.col("p_size")), form, F.when(F.col("p_partkey") % 2 == 0, "VBO"))
    p = table(spark, d, "part").select("p_partkey", key.alias("sku_key"))
    parts = F.split("sku_key", r"\|")
    return p.select("p_partkey", "sku_key", parts[1].alias("form_no"), F.concat_ws("|", parts[0], parts[1]).alias("form_key"))


@query("num_huf_parse", """select p_partkey, case p_partkey%6 when 0 then (10+p_partkey%90)*1000+500 when 1 then (1+p_partkey%9)*1000000+250000 when 2 then 100+p_partkey%900 when 5 then nullif(p_partkey%100,0) end huf,
 case p_partkey%6 when 0 then (10+p_partkey%90)*1000+500 when 1 then (1+p_partkey%9)*1000000+250000 when 2 then (100+p_partkey%900)*100+90 when 5 then case when (p_partkey%100)*case when p_size<10 then 10 else 100 end+p_size>=100 then (p_partkey%100)*case when p_size<10 then 10 else 100 end+p_size end end digits from part""")
def num_huf_parse(spark, d):
    """Amounts as sellers write them: thousands by spaces or dots, a comma before small change, no number, zero, another number behind."""
    k = F.col("p_partkey")
    raw = F.when(k % 6 == 0, F.concat((10 + k % 90).cast("string"), F.lit("\u00a0500 Ft"))).when(k % 6 == 1, F.concat((1 + k % 9).cast("string"), F.lit(".250.000 Ft"))).when(k % 6 == 2, F.concat((100 + k % 900).cast("string"), F.lit(",90")))
    raw = raw.when(k % 6 == 3, F.lit("ingyen")).when(k % 6 == 4, F.lit("0 Ft")).otherwise(F.concat((k % 100).cast("string"), F.lit(" Ft "), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", V.huf(raw).alias("huf"), V.all_digits(raw).alias("digits"))


#: Summer time in Budapest at noon: from the last Sunday of March to the last one of September until 1995, of October from then on.
_SUMMER = "o_orderdate::date >= make_date(y,3,31)-dayofweek(make_date(y,3,31))::int and o_orderdate::date < case when y<=1995 then make_date(y,9,30)-dayofweek(make_date(y,9,30))::int else make_date(y,10,31)-dayofweek(make_date(y,10,31))::int end"


@query("time_local_utc", f"""with o as (select *, year(o_orderdate)::int y from orders) select o_orderkey, case o_orderkey%5 when 4 then null when 3 then o_orderdate::date+interval 10 hour when 2 then o_orderdate::date-case when {_SUMMER} then interval 2 hour else interval 1 hour end
 else o_orderdate::date+case when {_SUMMER} then interval 10 hour else interval 11 hour end end::timestamp utc from o""")
def time_local_utc(spark, d):
    """Times as pages write them: local with dots or dashes, a date alone, an instant with its zone, no time."""
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(at, "yyyy. MM. dd. '12:00'")).when(k == 1, F.date_format(at, "yyyy-M-d '12:00'")).when(k == 2, F.date_format(at, "'kb.' yyyy/MM/dd")).when(k == 3, F.date_format(at, "yyyy-MM-dd'T12:00:00+02:00'")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", V.local_utc(raw).cast("timestamp_ntz").alias("utc"))


@query("age_format", "select o_orderkey, round_even(epoch(timestamp '2002-01-01'-o_orderdate)/86400.0,2) age_days, replace(format('{:,}', floor(o_totalprice)::bigint),',',' ') price_text, replace(replace(o_orderpriority,'&','&amp;'),'<','&lt;') label from orders")
def age_format(spark, d):
    o = table(spark, d, "orders")
    age = F.bround((F.unix_timestamp(F.to_timestamp(F.lit("2002-01-01"))) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) / 86400, 2)
    return o.select("o_orderkey", age.alias("age_days"), F.replace(F.format_number(F.floor("o_totalprice").cast("long"), 0), F.lit(","), F.lit(" ")).alias("price_text"), F.replace(F.replace("o_orderpriority", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias("label"))


@query("text_misc", "select conv_id, turn, substr(text,1,70) short, ((row_number() over (partition by conv_id order by turn, role, text)-1)//3)::integer chunk, case when turn%2=0 then 1234.5::double else 1.2345::double end amount from conversations")
def text_misc(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return c.select("conv_id", "turn", F.substring("text", 1, 70).alias("short"), F.floor((F.row_number().over(w) - 1) / 3).cast("int").alias("chunk"), V.locale_number(F.when(F.col("turn") % 2 == 0, "1.234,5").otherwise("1.2345"), F.col("turn") % 2 == 0).alias("amount"))


@query("json_props", "select event_id, cast(props->>'$.k' as bigint) k, cast(props->>'$.k' as bigint)>50 as large from events")
def json_props(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), (k > 50).alias("large"))


@query("hash_fingerprint")
def hash_fingerprint(spark, d):
    """Fingerprint of a table that does not depend on the order of its rows: count and two sums of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in ("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")])
    return table(spark, d, "part").agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("s1"), F.bit_xor(h).alias("s2"))


#: A reviewer's replies: a pick for each third listing of a chunk of 25. Some break the contract: by a value (15), a missing field (21), an extra one (27), a text for a number (39) or a foreign address (33); each eighth chunk's reply is cut off.
_REVIEW = """li as (select p_partkey id, p_partkey//25 chunk, case when p_size%3=0 then 'aukcio' else 'fix' end sale_type, floor(p_retailprice*100)::bigint price from part),
pk as (select *, concat_ws(', ', case when id%39=0 then 'type: price' end, case when id%15=0 then 'value: category' end, case when id%21=0 then 'missing: risks' end, case when id%27=0 then 'extra: note' end, case when id%33=0 then 'unknown url' end) faults,
 id*7%1000 value_max, case id%4 when 0 then 'high' when 1 then 'medium' else 'low' end confidence from li where id%3=0 and chunk%8<>7)"""


def _replies(spark, d):
    own = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 25).alias("chunk"), F.when(F.col("p_size") % 3 == 0, "aukcio").otherwise("fix").alias("sale_type"), F.concat(F.lit("https://s.example/"), F.col("p_partkey").cast("string")).alias("url"), F.floor(F.col("p_retailprice") * 100).cast("long").alias("price_huf"), F.lit(None).cast("string").alias("damage_flags"))
    i = F.col("id")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fields = {
        "listing_id": text(i.cast("string")), "url": text(F.when(i % 33 == 0, F.lit("https://other.example/1")).otherwise(F.col("url"))), "title": text(F.lit("t")), "brand": text(F.lit("b")), "sale_type": text(F.col("sale_type")),
        "price": F.when(i % 39 == 0, text(F.lit("5"))).otherwise("5"), "category": text(F.when(i % 15 == 0, "other").otherwise("both")), "value_min": F.lit("1"), "value_max": (i * 7 % 1000).cast("string"),
        "confidence": text(F.when(i % 4 == 0, "high").when(i % 4 == 1, "medium").otherwise("low")), "reason": text(F.lit("r")),
    }
    pairs = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    pick = F.concat(F.lit("{"), F.concat_ws(",", *pairs, F.when(i % 21 != 0, '"risks":""'), F.when(i % 27 == 0, '"note":1')), F.lit("}"))
    body = own.where("id % 3 = 0").groupBy("chunk", "sale_type").agg(F.array_join(F.array_sort(F.collect_list(pick)), ",").alias("picks"))
    reply = F.concat(F.lit('{"picks":['), "picks", F.lit('],"summary":"part '), F.col("chunk").cast("string"), F.lit('"'), F.when(F.col("chunk") % 8 == 7, "").otherwise("}"))
    return body.select("chunk", "sale_type", reply.alias("reply")), own


@query("review_contract", f"with {_REVIEW} select id::varchar listing_id, sale_type, faults from pk")
def review_contract(spark, d):
    """Every pick with what is wrong with it."""
    return review.checked_picks(*_replies(spark, d)).select("listing_id", "sale_type", F.array_join("faults", ", ").alias("faults"))


@query("review_picks", f"with {_REVIEW} select id::varchar listing_id, sale_type, confidence, value_max, price listed_price, row_number() over (order by case confidence when 'high' then 1 when 'medium' then 2 else 3 end, value_max desc, id::varchar) as rank from pk where faults=''")
def review_picks(spark, d):
    """Picks that keep the contract, ranked by confidence and value."""
    return review.ranked_picks(review.checked_picks(*_replies(spark, d))).select("listing_id", "sale_type", "confidence", "value_max", "listed_price", "rank")


@query("review_summaries", f"with {_REVIEW}, c as (select distinct chunk, sale_type from li where id%3=0) select sale_type, count(*) replies, count(*) filter (chunk%8=7) failed, string_agg('part '||chunk, ' ' order by chunk) filter (chunk%8<>7) summary from c group by 1")
def review_summaries(spark, d):
    """One summary for each kind of sale from those of its chunks."""
    return review.summaries(_replies(spark, d)[0])

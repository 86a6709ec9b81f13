"""Deal ranking, economics and assessment queries."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.config import DEFAULT
from brindle.models import store
from brindle.operators.economics import evaluate, explanation, max_bid, scenario
from brindle.operators.order import ranked
from brindle.operators.stats import fallback, group_quantiles, in_range, native
from brindle.plans.base import LI, PR, listings, price_records, query, table

NAT = PR + """, nat as (select *, amount * case when price_type='auction_hammer' then 1+coalesce(premium,0.0) else 1.0 end price from pr),
rng as (select * from nat where (market='HU' and price between 500 and 20000000) or (market='US' and price between 5 and 60000))"""
#: Quantiles at three levels and the estimate of each listing and market.
LEV = NAT + """, l1 as (select market, brand, object_type, count(*) n, quantile_cont(price,0.1) q10, quantile_cont(price,0.5) q50, quantile_cont(price,0.9) q90 from rng group by 1,2,3),
l2 as (select market, brand, count(*) n, quantile_cont(price,0.1) q10, quantile_cont(price,0.5) q50, quantile_cont(price,0.9) q90 from rng group by 1,2),
l3 as (select market, count(*) n, quantile_cont(price,0.1) q10, quantile_cont(price,0.5) q50, quantile_cont(price,0.9) q90 from rng group by 1)"""
EST = LEV + "," + LI + """, mk as (select unnest(['HU','US']) market),
est as (select li.*, mk.market, case when l1.n is not null then 1 when l2.n is not null then 2 when l3.n is not null then 3 end as level,
 case when l1.n is not null then l1.n when l2.n is not null then l2.n else l3.n end n,
 case when l1.n is not null then l1.q10 when l2.n is not null then l2.q10 else l3.q10 end q10,
 case when l1.n is not null then l1.q50 when l2.n is not null then l2.q50 else l3.q50 end q50,
 case when l1.n is not null then l1.q90 when l2.n is not null then l2.q90 else l3.q90 end q90
 from li cross join mk left join (select * from l1 where n>=5) l1 on l1.market=mk.market and l1.brand=li.brand and l1.object_type=li.object_type
 left join (select * from l2 where n>=5) l2 on l2.market=mk.market and l2.brand=li.brand left join (select * from l3 where n>=5) l3 on l3.market=mk.market),
e0 as (select *, n/(n+100.0) confidence, market='US' asking, size_cm>=25 as large, q10*case when market='HU' then 1.0 else 345.0 end v10, q50*case when market='HU' then 1.0 else 345.0 end v50 from est),
e1 as (select *, v10*case when asking then 0.85 else 1.0 end r10, v50*case when asking then 0.85 else 1.0 end r50 from e0),
e2 as (select *, case when market='HU' then r10*0.08+2000.0 else r10*0.316+138.0+6000.0+case when large then 45000.0 else 22000.0 end end + r10*0.05+2500.0 c10,
 case when market='HU' then r50*0.08+2000.0 else r50*0.316+138.0+6000.0+case when large then 45000.0 else 22000.0 end end + r50*0.05+2500.0 c50 from e1),
e3 as (select *, r10-price_huf-c10 p10, r50-price_huf-c50 p50 from e2),
e4 as (select *, round_even(p10-greatest(0.0,p10)*0.15,0) profit, round_even(p50-greatest(0.0,p50)*0.15,0) base_profit, round_even(100*(p50-greatest(0.0,p50)*0.15)/(price_huf+c50),1) base_roi,
 round_even(c50,0) costs, round_even(100*(1-price_huf/r50),1) discount, (floor(greatest(0.0,round_even(r10,0)-round_even(c10,0)-5000.0/0.85)/100)*100)::bigint max_bid from e3),
e5 as (select *, array_to_string(list_filter([case when brand is null then 'brand' end, case when level=3 then 'group_median_only' end, case when condition in ('serult','javitott') then 'damaged' end,
 case when status<>'active' then 'status' end, case when coalesce(price_huf,0.0)=0 then 'no_price' end], lambda x: x is not null), ',') hard from e4),
e6 as (select *, case when confidence<0.35 and hard<>'' then 'confidence,'||hard when confidence<0.35 then 'confidence' else hard end reasons from e5),
e7 as (select *, coalesce(discount,0.0)>=15.0 and hard='' below_value, coalesce(profit>=5000.0,false) profitable, reasons='' and coalesce(profit>=5000.0,false) would from e6),
deals as (select *, (not would) and hard='' and below_value and coalesce(base_profit>=5000.0,false) candidate,
 would and not coalesce(sale_type='aukcio' and coalesce(price_huf,0.0)<>0 and max_bid<price_huf,false) recommended,
 round_even(greatest(0.0,coalesce(profit,0.0))*confidence*case when condition in ('serult','javitott') then 0.5 else 1.0 end*case when sale_type='aukcio' then 0.5 else 1.0 end,0) score from e7)"""


def prices(spark, d) -> DataFrame:
    return in_range(native(price_records(spark, d)))


def deals(spark, d) -> DataFrame:
    levels = group_quantiles(prices(spark, d), "price")
    rows = listings(spark, d).withColumn("market", F.explode(F.array(F.lit("HU"), F.lit("US"))))
    est = fallback(rows, levels)
    est = est.withColumns({"confidence": F.col("n") / (F.col("n") + 100.0), "basis": F.when(F.col("market") == "US", "asking").otherwise("realized")})
    return evaluate(est, DEFAULT)


SHOW = ["listing_id", "market", "price_huf", "level", "profit", "base_profit", "base_roi", "discount", "max_bid", "score", "recommended", "candidate", "reasons"]


_RANK = f"with {EST} select {', '.join(SHOW)}, row_number() over (order by score desc, profit desc nulls last, listing_id, market)::integer as rank from deals order by rank limit 500"


@query("deal_rank", _RANK)
def deal_rank(spark, d):
    order = [F.desc("score"), F.desc_nulls_last("profit"), F.asc("listing_id"), F.asc("market")]
    top = deals(spark, d).select(*SHOW).orderBy(*order).limit(500)  # a page: its top-n needs no global sort
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@query("deal_filters", f"with {EST} select listing_id, market, price_huf, discount, profit, confidence from deals where brand='Brand#2' and sale_type in ('fix','aukcio') and coalesce(price_huf,0.0)<=150000.0 and discount>=5.0 and confidence>=0.2")
def deal_filters(spark, d):
    return deals(spark, d).where((F.col("brand") == "Brand#2") & F.col("sale_type").isin("fix", "aukcio") & (F.coalesce("price_huf", F.lit(0.0)) <= 150000) & (F.col("discount") >= 5) & (F.col("confidence") >= 0.2)).select("listing_id", "market", "price_huf", "discount", "profit", "confidence")


SORTS = {"score": ("score", True), "profit": ("profit", True), "discount": ("discount", True), "price": ("price_huf", False), "confidence": ("confidence", True), "max_bid": ("max_bid", True), "roi": ("base_roi", True), "base_profit": ("base_profit", True)}


@query("deal_sort_modes", "with " + EST + ", hu as (select * from deals where market='HU') " + " union all ".join(f"select * from (select '{k}' as mode, listing_id, row_number() over (order by case when {c} is null or {c}=0 then {'-1e12' if desc else '1e12'} else {c} end {'desc' if desc else 'asc'}, listing_id)::integer as place from hu) where place<=50" for k, (c, desc) in SORTS.items()))
def deal_sort_modes(spark, d):
    """A value of 0 sorts like a missing one, last."""
    hu = deals(spark, d).where("market = 'HU'").select("listing_id", *sorted({c for c, _ in SORTS.values()}))
    keys = []
    for k, (c, desc) in SORTS.items():
        v = F.col(c).cast("double")
        v = F.when(v.isNull() | (v == 0), -1e12 if desc else 1e12).otherwise(v)
        keys.append(F.struct(F.lit(k).alias("mode"), (-v if desc else v).alias("v")))
    modes = hu.select("listing_id", F.explode(F.array(*keys)).alias("k")).select("listing_id", "k.mode", "k.v")
    return modes.withColumn("place", F.row_number().over(Window.partitionBy("mode").orderBy("v", "listing_id"))).where("place <= 50").select("mode", "listing_id", "place")


@query("deal_summary", f"with {EST} select market, count(*) total, count(*) filter (recommended) recommended, count(*) filter (candidate) candidates, count(*) filter (reasons<>'') abstained, count(*) filter (below_value) below_value from deals group by market")
def deal_summary(spark, d):
    return deals(spark, d).groupBy("market").agg(F.count("*").alias("total"), F.count_if("recommended").alias("recommended"), F.count_if("candidate").alias("candidates"), F.count_if(F.col("reasons") != "").alias("abstained"), F.count_if("below_value").alias("below_value"))


@query("assess_reasons", f"with {EST} select market, reasons, count(*) n, count(*) filter (discount>=80) as suspicious from deals group by 1,2")
def assess_reasons(spark, d):
    return deals(spark, d).groupBy("market", "reasons").agg(F.count("*").alias("n"), F.count_if(F.col("discount") >= 80).alias("suspicious"))


def _scen(cost: str, rev: str) -> str:
    return f"round_even({rev},0) revenue, round_even({cost},0) costs, round_even(greatest(0.0,{rev}-price-({cost}))*0.15,0) tax, round_even({rev}-price-({cost})-greatest(0.0,{rev}-price-({cost}))*0.15,0) profit"


@query("econ_scenarios", f"""with s as (select p_partkey, p_retailprice*80 price, p_retailprice*150 v, p_size>=25 as large, unnest(['HU','US']) market, p_partkey%2=0 asking from part),
r as (select *, v*case when asking then 0.85 else 1.0 end rev from s), c as (select *, case when market='HU' then rev*0.08+2000.0 else rev*0.316+138.0+6000.0+case when large then 45000.0 else 22000.0 end end + rev*0.05+2500.0 cost from r)
select p_partkey, market, {_scen('cost', 'rev')}, (floor(greatest(0.0,round_even(rev,0)-round_even(cost,0)-5000.0/0.85)/100)*100)::bigint max_bid from c""")
def econ_scenarios(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 80).alias("price"), (F.col("p_retailprice") * 150).alias("v"), (F.col("p_size") >= 25).alias("large"), (F.col("p_partkey") % 2 == 0).alias("asking"), F.explode(F.array(F.lit("HU"), F.lit("US"))).alias("market"))
    s = scenario(F.col("market"), F.col("price"), F.col("v"), F.col("asking"), F.col("large"))
    return p.select("p_partkey", "market", *[s[k].alias(k) for k in ("revenue", "costs", "tax", "profit")], max_bid(F.col("market"), F.col("v"), F.col("asking"), F.col("large")).alias("max_bid"))


@query("econ_unit", """with s as (select p_partkey, p_retailprice*60 buy, p_retailprice*130 sale, p_size n from part),
u as (select *, sale*0.72 proceeds, buy+15000.0 capital, sale*0.6*0.72-buy-15000.0 stress from s), f as (select *, proceeds-capital profit, (proceeds-capital)/capital roi from u)
select p_partkey, round_even(profit,2) profit, round_even(roi,4) roi, floor(proceeds/1.3-15000.0)::bigint ceiling, case when n<5 then 'few_comparables' when stress<=0 then 'stress_loss' when profit<10000 then 'small_profit' when roi<0.3 then 'small_roi' else 'buy' end status from f""")
def econ_unit(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 60).alias("buy"), (F.col("p_retailprice") * 130).alias("sale"), F.col("p_size").alias("n"))
    keep, fixed = 0.72, 15000.0
    p = p.withColumns({"proceeds": F.col("sale") * keep, "capital": F.col("buy") + fixed, "stress": F.col("sale") * 0.6 * keep - F.col("buy") - fixed})
    p = p.withColumns({"gain": F.col("proceeds") - F.col("capital")}).withColumn("r", F.col("gain") / F.col("capital"))
    status = F.when(F.col("n") < 5, "few_comparables").when(F.col("stress") <= 0, "stress_loss").when(F.col("gain") < 10000, "small_profit").when(F.col("r") < 0.3, "small_roi").otherwise("buy")
    return p.select("p_partkey", F.bround("gain", 2).alias("profit"), F.bround("r", 4).alias("roi"), F.floor(F.col("proceeds") / 1.3 - fixed).cast("long").alias("ceiling"), status.alias("status"))


@query("econ_bands", f"""with {PR}, m as (select sku, median(amount) ask from pr where market='HU' group by 1), b as (select sku, ask, ask*0.55/0.85 floor_price from m)
select sku, round_even(ask,1) ask, round_even(floor_price*1.1,2) floor_price, case when ask<10000 then 1 when ask<30000 then 2 when ask<100000 then 3 else 4 end band,
 (case when floor_price<10000 then ceil(floor_price/500)*500 when floor_price<100000 then ceil(floor_price/1000)*1000 else ceil(floor_price/5000)*5000 end)::bigint step_price from b""")
def econ_bands(spark, d):
    m = price_records(spark, d).where("market = 'HU'").groupBy("sku").agg(F.median("amount").alias("a")).withColumn("f", F.col("a") * 0.55 / 0.85)
    up = lambda s: F.ceil(F.col("f") / s) * s
    step = F.when(F.col("f") < 10000, up(500)).when(F.col("f") < 100000, up(1000)).otherwise(up(5000)).cast("long")
    band = F.when(F.col("a") < 10000, 1).when(F.col("a") < 30000, 2).when(F.col("a") < 100000, 3).otherwise(4)
    return m.select("sku", F.bround("a", 1).alias("ask"), F.bround(F.col("f") * 1.1, 2).alias("floor_price"), band.alias("band"), step.alias("step_price"))


@query("econ_overrides", """select p_partkey, p_type, case when p_type in ('PROMO','ECONOMY') then 9000.0::double when p_size>=25 then 6000.0 else 2000.0 end as outbound,
 round_even(p_retailprice*80*0.8 - case when p_type in ('PROMO','ECONOMY') then 9000.0 when p_size>=25 then 6000.0 else 2000.0 end,2) low, round_even(p_retailprice*80*0.6 - case when p_type in ('PROMO','ECONOMY') then 9000.0 when p_size>=25 then 6000.0 else 2000.0 end,2) stress, 0.2::double as tax_rate from part""")
def econ_overrides(spark, d):
    """The last matching rule wins; of the overrides the unknown, negative and non-finite ones are ignored."""
    a = DEFAULT.override({"tax": 0.2, "us_fee": -1, "nothing": 3, "reserve": float("nan"), "hu_packaging": 2000})
    rules = [(F.col("p_size") >= 25, 6000.0), (F.col("p_type").isin("PROMO", "ECONOMY"), 9000.0)]
    cost = F.lit(a.hu_packaging)
    for when, value in rules:
        cost = F.when(when, value).otherwise(cost)
    v = F.col("p_retailprice") * 80
    return table(spark, d, "part").select("p_partkey", "p_type", cost.alias("outbound"), F.bround(v * 0.8 - cost, 2).alias("low"), F.bround(v * 0.6 - cost, 2).alias("stress"), F.lit(a.tax).alias("tax_rate"))


@query("report_order", """select p_partkey, p_name, case when p_size%7=0 then null else round_even(p_retailprice/p_size,3) end roi, (p_size%12)*1.0::double*case when p_size%2=0 then 4.3 else 1.0 end as weeks from part
 order by weeks, roi desc nulls last, p_partkey limit 300""")
def report_order(spark, d):
    """Reports sort by a time text (months count 4.3 weeks), then by ROI with missing ones last."""
    time = F.concat((F.col("p_size") % 12).cast("string"), F.when(F.col("p_size") % 2 == 0, " months").otherwise(" weeks"))
    weeks = F.regexp_extract(time, r"^(\d+)", 1).cast("double") * F.when(time.endswith("months"), 4.3).otherwise(1.0)
    roi = F.when(F.col("p_size") % 7 != 0, F.bround(F.col("p_retailprice") / F.col("p_size"), 3))
    return table(spark, d, "part").select("p_partkey", "p_name", roi.alias("roi"), weeks.alias("weeks")).orderBy("weeks", F.desc_nulls_last("roi"), "p_partkey").limit(300)


@query("report_counts", """select case when grouping(p_brand)=0 then 'brand' else 'type' end as kind, coalesce(p_brand,p_type) label, count(*) n, round_even(avg(case when p_size is not null then 1.0 else 0.0 end),4) recognised, case when count(*)>=100 then 1 else 2 end label_order
 from part group by grouping sets ((p_brand),(p_type))""")
def report_counts(spark, d):
    p = table(spark, d, "part")
    g = p.groupingSets([[F.col("p_brand")], [F.col("p_type")]], "p_brand", "p_type").agg(F.count("*").alias("n"), F.bround(F.avg(F.col("p_size").isNotNull().cast("double")), 4).alias("recognised"), F.grouping("p_brand").alias("g"))
    return g.select(F.when(F.col("g") == 0, "brand").otherwise("type").alias("kind"), F.coalesce("p_brand", "p_type").alias("label"), "n", "recognised", F.when(F.col("n") >= 100, 1).otherwise(2).alias("label_order"))


_FT = "coalesce(replace(format('{{:,}}', round_even({0},0)::bigint),',',' ')||' Ft','–')"
_RATE = "case when market='HU' then 1.0 else 345.0 end"


@query("deal_explain", f"""with {EST} select listing_id, market, concat_ws('; ', concat_ws(' ', brand, case object_type when 'ECONOMY' then 'thrifty piece' when 'PROMO' then 'special piece' else 'item' end)||': '||case market when 'HU' then 'Hungarian' else 'American' end||' value '||{_FT.format('v50')}||' ('||{_FT.format('v10')}||'–'||{_FT.format(f'q90*{_RATE}')}||')',
 'the price is '||round_even(abs(discount),0)::int||case when discount>0 then '% below' else '% above' end||' the expected sale', 'conservative result '||{_FT.format('profit')}, case when sale_type='aukcio' then 'bid at most '||{_FT.format('max_bid')} end, case when reasons<>'' then 'NOT RECOMMENDED: '||replace(reasons,',','; ') end)||'.' explanation from deals where price_huf is not null
union all select listing_id, market, concat_ws('; ', concat_ws(' ', brand, case object_type when 'ECONOMY' then 'thrifty piece' when 'PROMO' then 'special piece' else 'item' end)||': '||case market when 'HU' then 'Hungarian' else 'American' end||' value '||{_FT.format('v50')}||' ('||{_FT.format('v10')}||'–'||{_FT.format(f'q90*{_RATE}')}||')',
 case when sale_type='aukcio' then 'bid at most '||{_FT.format('max_bid')} end, case when reasons<>'' then 'NOT RECOMMENDED: '||replace(reasons,',','; ') end)||'.' from deals where price_huf is null""")
def deal_explain(spark, d):
    """A sentence on every assessed listing and market."""
    text = explanation({"ECONOMY": "thrifty piece", "PROMO": "special piece"}, {"HU": "Hungarian", "US": "American"})
    return deals(spark, d).select("listing_id", "market", text.alias("explanation"))


@query("report_dump", f"with {LI} select sale_type, brand, listing_id, concat_ws(' | ', listing_id, brand, title, coalesce(round_even(price_huf,0)::bigint::varchar,'-'), condition) line, row_number() over (order by brand, sale_type, price_huf desc nulls last, listing_id) as place from li")
def report_dump(spark, d):
    """Compact lines of all listings by brand, kind of sale and falling price."""
    li = listings(spark, d)
    rows = ranked(li, [F.col("brand"), F.col("sale_type"), F.desc_nulls_last("price_huf"), F.col("listing_id")], "place")
    line = F.concat_ws(" | ", "listing_id", "brand", "title", F.coalesce(F.bround("price_huf").cast("long").cast("string"), F.lit("-")), "condition")
    return rows.select("sale_type", "brand", "listing_id", line.alias("line"), "place")


@query("deal_kept", _RANK)
def deal_kept(spark, d):
    """The ranked list from the table kept under the state of its input files and the assumptions; the second call reads no source rows."""
    inputs = [f"{d}/{t}.parquet" for t in ("part", "lineitem")]
    build = lambda: deal_rank(spark, d)
    store.kept(spark, "deals", inputs, build, {"rule": 1, **asdict(DEFAULT)})
    return store.kept(spark, "deals", inputs, build, {"rule": 1, **asdict(DEFAULT)})


@query("deal_page", f"""with {EST}, o as (select listing_id, market, score, row_number() over (order by score desc, profit desc nulls last, listing_id, market) place, count(*) over () total, count(*) filter (recommended) over () recommended from deals)
select listing_id, market, score, place, total, recommended from o where place>40 and place<=60""")
def deal_page(spark, d):
    """Third page of twenty of the ranked list, with the total and the summary of the unpaged set. The page is a range of ranks, so nothing before it is sorted on one task."""
    rows = ranked(deals(spark, d), [F.desc("score"), F.desc_nulls_last("profit"), F.asc("listing_id"), F.asc("market")], "place")
    facts = rows.agg(F.count_if("recommended").alias("recommended"))  # one row
    return rows.where("place > 40 and place <= 60").select("listing_id", "market", "score", "place", "total").join(F.broadcast(facts))


@query("report_sale_types", f"with {LI} select sale_type, brand, count(*) n, count(price_huf) priced, round_even(max(price_huf),2) dearest from li group by grouping sets ((sale_type, brand), (sale_type), ())")
def report_sale_types(spark, d):
    """Counters of a report by kind of sale and brand, by kind of sale, and in all."""
    g = listings(spark, d).groupingSets([[F.col("sale_type"), F.col("brand")], [F.col("sale_type")], []], "sale_type", "brand")
    return g.agg(F.count("*").alias("n"), F.count("price_huf").alias("priced"), F.bround(F.max("price_huf"), 2).alias("dearest"))

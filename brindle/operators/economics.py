"""Costs, scenarios, maximum bids and the assessment of deals, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.config import DEFAULT, LARGE_SIZE_CM, Assumptions


def costs(market: Column, revenue: Column, large: Column, a: Assumptions = DEFAULT) -> Column:
    """Costs of buying and selling at ``revenue`` on a market."""
    hu = revenue * (a.hu_fee + a.hu_payment) + a.hu_packaging + a.hu_outbound + a.hu_listing
    us = revenue * (a.us_fee + a.us_payment + a.us_fx + a.us_duty) + a.us_fixed_usd * a.huf_per_usd + a.us_packaging + F.when(large, a.us_ship_large).otherwise(a.us_ship_small)
    return F.when(market == "HU", hu).otherwise(us) + revenue * a.reserve + a.inbound + a.inspection


def scenario(market: Column, purchase: Column, value: Column, asking: Column, large: Column, a: Assumptions = DEFAULT) -> dict[str, Column]:
    """Revenue, costs, profit (tax on a positive profit only) and ROI; money is rounded half to even."""
    revenue = value * F.when(asking, a.asking_to_sale).otherwise(1.0)
    cost = costs(market, revenue, large, a)
    before = revenue - purchase - cost
    tax = F.greatest(F.lit(0.0), before) * a.tax
    capital = purchase + cost
    return {"revenue": F.bround(revenue), "costs": F.bround(cost), "tax": F.bround(tax), "profit": F.bround(before - tax), "roi": F.when(capital > 0, F.bround(100 * (before - tax) / capital, 1))}


def max_bid(market: Column, value: Column, asking: Column, large: Column, a: Assumptions = DEFAULT) -> Column:
    """Highest price that leaves the least profit, in whole hundreds."""
    revenue = value * F.when(asking, a.asking_to_sale).otherwise(1.0)
    margin = F.bround(revenue) - F.bround(costs(market, revenue, large, a))
    return (F.floor(F.greatest(F.lit(0.0), margin - a.min_profit / (1 - a.tax)) / 100) * 100).cast("long")


def evaluate(df: DataFrame, a: Assumptions = DEFAULT) -> DataFrame:
    """Adds scenarios, discount and assessment to rows with listing columns and market, q10, q50, confidence, basis, level."""
    large = F.col("size_cm") >= LARGE_SIZE_CM
    asking = F.col("basis") == "asking"
    rate = F.when(F.col("market") == "HU", 1.0).otherwise(a.huf_per_usd)
    df = df.withColumns({"v10": F.col("q10") * rate, "v50": F.col("q50") * rate, "large": large, "asking": asking})
    base = scenario(F.col("market"), F.col("price_huf"), F.col("v50"), F.col("asking"), F.col("large"), a)
    low = scenario(F.col("market"), F.col("price_huf"), F.col("v10"), F.col("asking"), F.col("large"), a)
    expected = F.col("v50") * F.when(F.col("asking"), a.asking_to_sale).otherwise(1.0)
    df = df.withColumns({
        "base_profit": base["profit"], "base_roi": base["roi"], "profit": low["profit"], "costs": base["costs"],
        "discount": F.when(F.col("v50") != 0, F.bround(100 * (1 - F.col("price_huf") / expected), 1)),
        "max_bid": max_bid(F.col("market"), F.col("v10"), F.col("asking"), F.col("large"), a),
    })
    damaged = F.col("condition").isin("serult", "javitott")
    auction = F.col("sale_type") == "aukcio"
    hard = F.array_compact(F.array(
        F.when(F.col("brand").isNull(), "brand"), F.when(F.col("level") == 3, "group_median_only"), F.when(damaged, "damaged"),
        F.when(F.col("status") != "active", "status"), F.when(F.coalesce(F.col("price_huf"), F.lit(0.0)) == 0, "no_price"),
    ))
    low_confidence = F.col("confidence") < a.min_confidence
    df = df.withColumn("hard", hard).withColumn("reasons", F.concat_ws(",", F.when(low_confidence, "confidence"), F.col("hard")))
    enough = lambda c: F.coalesce(F.col(c) >= a.min_profit, F.lit(False))
    below = (F.coalesce(F.col("discount"), F.lit(0.0)) >= a.flag_discount) & (F.size("hard") == 0)
    df = df.withColumns({"below_value": below, "profitable": enough("profit"), "would": (F.col("reasons") == "") & enough("profit")})
    penalty = F.when(damaged, a.damage_penalty).otherwise(1.0) * F.when(auction, a.auction_penalty).otherwise(1.0)
    # the bid limit clears the recommendation only after the candidate flag has been derived from it
    too_dear = auction & (F.coalesce(F.col("price_huf"), F.lit(0.0)) != 0) & (F.col("max_bid") < F.col("price_huf"))
    return df.withColumns({
        "candidate": ~F.col("would") & (F.size("hard") == 0) & F.col("below_value") & enough("base_profit"),
        "recommended": F.col("would") & ~F.coalesce(too_dear, F.lit(False)),
        "score": F.bround(F.greatest(F.lit(0.0), F.coalesce("profit", F.lit(0.0))) * F.col("confidence") * penalty),
    }).drop("hard", "would")


def money(c: Column) -> Column:
    """Whole forints with spaces between thousands; a dash where there is none."""
    return F.coalesce(F.concat(F.replace(F.format_number(F.bround(c), 0), F.lit(","), F.lit(" ")), F.lit(" Ft")), F.lit("–"))


def explanation(nouns: dict[str, str], markets: dict[str, str], other: str = "item") -> Column:
    """One sentence on an assessed row (after :func:`evaluate`): what it is, the estimated value and its range, distance of the price from it, the conservative result, the highest bid at an auction, and the reasons against a recommendation.

    ``nouns`` names object types and ``markets`` the markets in the reader's words.
    """
    def word(c: str, table: dict[str, str], default: Column) -> Column:
        out = default
        for code, name in table.items():
            out = F.when(F.col(c) == code, F.lit(name)).otherwise(out)
        return out

    rate = F.when(F.col("market") == "HU", 1.0).otherwise(DEFAULT.huf_per_usd)
    what = F.concat_ws(" ", "brand", word("object_type", nouns, F.lit(other)))
    value = F.concat(what, F.lit(": "), word("market", markets, F.col("market")), F.lit(" value "), money(F.col("v50")), F.lit(" ("), money(F.col("v10")), F.lit("–"), money(F.col("q90") * rate), F.lit(")"))
    off = F.concat(F.lit("the price is "), F.bround(F.abs(F.col("discount"))).cast("int").cast("string"), F.when(F.col("discount") > 0, "% below").otherwise("% above"), F.lit(" the expected sale"))
    result = F.concat(F.lit("conservative result "), money(F.col("profit")))
    bid = F.when(F.col("sale_type") == "aukcio", F.concat(F.lit("bid at most "), money(F.col("max_bid").cast("double"))))
    against = F.when(F.col("reasons") != "", F.concat(F.lit("NOT RECOMMENDED: "), F.replace("reasons", F.lit(","), F.lit("; "))))
    return F.concat(F.concat_ws("; ", value, F.when(F.col("discount").isNotNull(), off), F.when(F.col("profit").isNotNull(), result), bid, against), F.lit("."))

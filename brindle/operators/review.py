"""Replies of an outside reviewer: contract of a structured answer, picks that belong to the input, their ranking and the summaries by kind of sale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.order import ranked

#: Field: (type, admitted values or None). All fields are required and no other is admitted.
PICK: dict[str, tuple[str, Sequence[str] | None]] = {
    "listing_id": ("STRING", None), "url": ("STRING", None), "title": ("STRING", None), "brand": ("STRING", None), "sale_type": ("STRING", None), "price": ("BIGINT", None),
    "category": ("STRING", ("under_priced", "foreign_market", "both")), "value_min": ("BIGINT", None), "value_max": ("BIGINT", None), "confidence": ("STRING", ("high", "medium", "low")), "reason": ("STRING", None), "risks": ("STRING", None),
}
REPLY: dict[str, tuple[str, Sequence[str] | None]] = {"picks": ("ARRAY", None), "summary": ("STRING", None)}
ORDER = ("high", "medium", "low")


def violations(text: Column, contract: Mapping[str, tuple[str, Sequence[str] | None]]) -> Column:
    """What is wrong with a JSON text, in the order of the contract: ``no object``, ``missing: f``, ``type: f``, ``value: f``, then ``extra: f`` by name. Empty if it keeps the contract; a null text is no object."""
    v = F.try_parse_json(text)
    keys = F.map_keys(F.from_json(text, "map<string,string>"))
    out = []
    for name, (kind, values) in contract.items():
        own = F.try_variant_get(v, f"$.{name}", "variant")
        shape = F.coalesce(F.schema_of_variant(own), F.lit("VOID"))
        wrong = F.when(~F.array_contains(keys, name), f"missing: {name}").when(~shape.startswith(kind), f"type: {name}")
        if values:
            wrong = wrong.when(~F.coalesce(F.try_variant_get(v, f"$.{name}", "string").isin(list(values)), F.lit(False)), f"value: {name}")
        out.append(wrong)
    extra = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(n) for n in contract]))), lambda k: F.concat(F.lit("extra: "), k))
    fine = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & keys.isNotNull()
    return F.when(fine, F.concat(F.array_compact(F.array(*out)), extra)).otherwise(F.array(F.lit("no object")))


def checked_picks(replies: DataFrame, listings: DataFrame) -> DataFrame:
    """Every pick of every reply with ``faults``: those of its contract, then ``unknown url`` if it isn't the address of an input listing of the same kind of sale. A reply that isn't one has no picks.

    ``replies``: chunk, sale_type, reply; ``listings``: url, sale_type, price_huf, damage_flags. Known picks carry the listing's own price and damage.
    """
    whole = replies.where(F.size(violations(F.col("reply"), REPLY)) == 0)
    picks = whole.select("chunk", "sale_type", F.explode(F.from_json("reply", "struct<picks:array<string>>")["picks"]).alias("pick"))
    v = F.try_parse_json("pick")
    fields = [F.try_variant_get(v, f"$.{n}", "bigint" if kind == "BIGINT" else "string").alias(n) for n, (kind, _) in PICK.items() if n != "sale_type"]
    picks = picks.select("chunk", "sale_type", violations(F.col("pick"), PICK).alias("faults"), *fields)
    own = listings.groupBy("url", "sale_type").agg(F.max("price_huf").alias("listed_price"), F.max("damage_flags").alias("damage_flags"), F.lit(True).alias("known"))
    met = picks.join(own, ["url", "sale_type"], "left")
    return met.withColumn("faults", F.when(F.col("known"), F.col("faults")).otherwise(F.array_append("faults", F.lit("unknown url")))).drop("known")


def ranked_picks(checked: DataFrame) -> DataFrame:
    """Picks without faults by confidence, then the larger value, then listing and chunk: adds ``rank``. A listing picked more than once keeps its best pick."""
    level = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in ORDER]), F.col("confidence")), F.lit(9))
    good = checked.where(F.size("faults") == 0).withColumn("__level", level)
    best = Window.partitionBy("listing_id").orderBy("__level", F.desc("value_max"), "chunk")
    good = good.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    return ranked(good, [F.col("__level"), F.desc("value_max"), F.col("listing_id")]).drop("__level", "total", "faults")


def summaries(replies: DataFrame) -> DataFrame:
    """``sale_type, replies, failed, summary``: the parts' summaries in the order of the chunks, and how many replies broke the contract."""
    broken = F.size(violations(F.col("reply"), REPLY)) > 0
    rows = replies.select("chunk", "sale_type", broken.alias("broken"), F.when(~broken, F.get_json_object("reply", "$.summary")).alias("s"))
    parts = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("s"), F.lit("")) != "", F.struct("chunk", "s"))))  # one short text a chunk
    return rows.groupBy("sale_type").agg(F.count("*").alias("replies"), F.count_if("broken").alias("failed"), F.array_join(F.transform(parts, lambda p: p["s"]), " ").alias("summary"))

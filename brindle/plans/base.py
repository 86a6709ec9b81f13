"""Query registry, table loading and the marketplace roles of the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed price history: a sale or offer of an article on one of two markets, in the market's own currency."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    hu = F.col("l_linestatus") == "F"
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    kind = F.when(F.col("l_returnflag") == "A", "auction_hammer").when(F.col("l_returnflag") == "R", "realized_sale").otherwise("asking_active")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("sale_group"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("sku"), F.when(hu, "HU").otherwise("US").alias("market"),
        kind.alias("price_type"), F.when(hu, unit * 100).otherwise(unit / 3).alias("amount"), F.when(hu, "HUF").otherwise("USD").alias("currency"),
        F.when(F.col("l_returnflag") == "A", F.col("l_tax") + 0.0).alias("premium"), F.col("l_shipdate").alias("observed_at"), F.col("l_returnflag").alias("condition"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("object_type"), F.col("p_name").alias("title"), F.col("p_size").alias("size_cm"), F.col("l_suppkey").alias("seller"),
    )


#: The same relation for the oracle.
PR = """pr as (select l_orderkey sale_group, l_linenumber line, l_partkey sku, case when l_linestatus='F' then 'HU' else 'US' end market,
 case when l_returnflag='A' then 'auction_hammer' when l_returnflag='R' then 'realized_sale' else 'asking_active' end price_type,
 case when l_linestatus='F' then l_extendedprice/l_quantity*100 else l_extendedprice/l_quantity/3 end amount, case when l_linestatus='F' then 'HUF' else 'USD' end currency,
 case when l_returnflag='A' then l_tax+0.0 end premium, l_shipdate observed_at, l_returnflag condition, p_brand brand, p_type object_type, p_name title, p_size size_cm, l_suppkey seller
 from lineitem join part on l_partkey=p_partkey)"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and ended offers of articles with a price in HUF."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("listing_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("object_type"), F.col("p_name").alias("title"), F.col("p_size").alias("size_cm"),
        F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice") * 100).alias("price_huf"), F.when(F.col("p_size") % 3 == 0, "aukcio").otherwise("fix").alias("sale_type"),
        F.when(F.col("p_size") % 11 == 0, "serult").otherwise("hibatlan").alias("condition"), F.when(F.col("p_partkey") % 17 == 0, "ended").otherwise("active").alias("status"),
    )


LI = """li as (select p_partkey listing_id, p_brand brand, p_type object_type, p_name title, p_size size_cm, case when p_partkey%13<>0 then p_retailprice*100 end price_huf,
 case when p_size%3=0 then 'aukcio' else 'fix' end sale_type, case when p_size%11=0 then 'serult' else 'hibatlan' end condition, case when p_partkey%17=0 then 'ended' else 'active' end status from part)"""

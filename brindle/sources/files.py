"""File sources: price and catalogue CSV with a branch of rejects, legacy CSV, Markdown tables, nested JSON; report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.schema import MARKETS, PRICE_TYPES, conform

PRICE_COLUMNS = ["source", "source_ref", "market", "price_type", "amount", "currency", "observed_at", "title"]


def price_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejects with a reason. A missing required column is an error."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    missing = [c for c in PRICE_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    amount = F.col("amount").try_cast("double")
    reason = F.when(~F.coalesce(F.col("price_type").isin(PRICE_TYPES), F.lit(False)), "price_type").when(~F.coalesce(F.col("market").isin(MARKETS), F.lit(False)), "market").when(amount.isNull() | (amount <= 0), "amount").when(F.col("source_ref").isNull(), "source_ref")
    marked = raw.withColumn("reason", reason).withColumn("amount", amount)
    if "buyer_premium_rate" in raw.columns:
        marked = marked.withColumn("premium", F.col("buyer_premium_rate").try_cast("double"))
    good = marked.where("reason is null").withColumn("observed_at", F.try_to_timestamp("observed_at"))
    return conform(good, "price_records"), marked.where("reason is not null")


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    from brindle.functions.text import sku_key

    raw = spark.read.csv(path, header=True)
    form = F.regexp_replace("form_no", "^0+(?=.)", "")
    return conform(raw.withColumn("form_no", form).withColumn("sku_key", sku_key(F.col("brand"), F.col("form_no"), F.col("pattern_code"))).where("sku_key is not null"), "catalog_items")


def legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    """Listing exports; the observation time comes from a folder named run_YYYYMMDD_HHMMSS, else from the file."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"').withColumns({"__path": F.col("_metadata.file_path"), "__at": F.col("_metadata.file_modification_time")})
    stamp = F.regexp_extract("__path", r"run_(\d{8}_\d{6})", 1)
    at = F.coalesce(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd_HHmmss")), F.col("__at"))
    return raw.withColumn("observed_at", at).where("listing_id is not null and title is not null").drop("__path", "__at")


def markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Markdown tables as a map from header to cell; a linked cell gives title and url. Files are small reports: one row each."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value")).where(F.col("value").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("value", r"^\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.select("file", "line", cells.alias("cells")).where(~F.forall("cells", lambda c: c.rlike("^:?-+:?$")))
    head = rows.groupBy("file").agg(F.min_by("cells", "line").alias("head"), F.min("line").alias("first"))
    out = rows.join(head, "file").where("line > first and size(cells) = size(head)").select("file", "line", F.map_from_arrays("head", "cells").alias("row"))
    link = F.array_max(F.transform(F.map_values("row"), lambda c: F.when(c.rlike(r"\[[^\]]*\]\([^)]*\)"), c)))
    return out.withColumns({"title": F.regexp_extract(link, r"\[([^\]]*)\]", 1), "url": F.regexp_extract(link, r"\]\(([^)]*)\)", 1)}).withColumn("listing_id", F.regexp_extract("url", r"(\d+)(?:\.html)?/?$", 1))


def evidence_json(spark: SparkSession, path: str, arrays: tuple[str, ...] = ("candidates", "rejected")) -> DataFrame:
    """Records of several arrays of one document; those without id or brand are dropped."""
    raw = spark.read.json(path, multiLine=True)
    out = None
    for a in arrays:
        if a in raw.columns:
            part = raw.select(F.explode(a).alias("r")).select("r.*", F.lit(a).alias("part"))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"none of the arrays {arrays} is there")
    return out.where("id is not null and brand is not null")


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_markdown(df: DataFrame, path: str, order: list) -> None:
    """A report of rows as Markdown: text lines in order, one file (reports are pages of a bounded number of rows)."""
    cols = df.columns
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|"))
    body = df.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in cols]), F.lit(" |")).alias("value"))
    head = df.sparkSession.createDataFrame([("| " + " | ".join(cols) + " |",), ("|" + "---|" * len(cols),)], "value string").coalesce(1)
    head.union(body.coalesce(1)).coalesce(1).write.mode("overwrite").text(path)


def get_meta(meta: DataFrame, key: str, schema: str):
    return meta.where(F.col("key") == key).select(F.from_json("value", schema).alias("v")).select("v.*")


def set_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    """The metadata table with one value (JSON text) set; the others stay."""
    own = meta.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return meta.where(F.col("key").isNull() | (F.col("key") != key)).select("key", "value").unionByName(own)


def write_sale_types(df: DataFrame, path: str, columns: list[str]) -> None:
    """Listings as CSV in a folder of each kind of sale, and all together as CSV and JSON; other columns are left out, a missing kind is ``ismeretlen``."""
    rows = df.select(*columns, F.coalesce("sale_type", F.lit("ismeretlen")).alias("__kind"))
    rows.withColumnRenamed("__kind", "kind").write.mode("overwrite").partitionBy("kind").csv(f"{path}/by_type", header=True)
    rows.drop("__kind").write.mode("overwrite").csv(f"{path}/all_csv", header=True)
    rows.drop("__kind").write.mode("overwrite").json(f"{path}/all_json")


def export_training(rows: DataFrame, path: str) -> None:
    """A training set with its parts as compressed CSV."""
    rows.write.mode("overwrite").option("compression", "gzip").csv(path, header=True)

"""Import of a snapshot of files in a fixed order: later files complete and correct earlier ones, whatever order they are found in."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import features as X
from brindle.functions.pages import plain
from brindle.functions.rules import GENERAL, Rules
from brindle.functions.text import dedup_key
from brindle.operators.history import fold
from brindle.sources.schema import KEYS, conform


def comps_json(spark: SparkSession, path: str, observed: str, rules: Rules = GENERAL) -> tuple[DataFrame, DataFrame]:
    """Comparable offers from an object of blocks ``{key: {"cur", "url", "minta": ["price | title", ...]}}``: price records and rejects with a reason.

    A block in USD (or without currency) is of the US market, another of the EU. A sample without a price or a brand is rejected; its reference is key, relisting key and whole price.
    """
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<cur:string,url:string,minta:array<string>>>")).alias("key", "block"))
    rows = blocks.select("key", F.coalesce("block.cur", F.lit("USD")).alias("currency"), F.col("block.url").alias("url"), F.explode("block.minta").alias("sample"))
    rows = rows.select("key", "currency", "url", F.trim(F.substring_index("sample", "|", 1)).try_cast("double").alias("amount"), F.expr("substr(sample, instr(sample || '|', '|') + 1)").alias("title"))
    rows = rows.withColumn("title", F.trim(plain(F.replace("title", F.lit("&#039;"), F.lit("'"))))).withColumn("description", F.lit(""))
    found = X.extract(rows, rules=rules).withColumn("reason", F.when(F.col("amount").isNull(), "amount").when(F.col("brand").isNull(), "brand"))
    found = found.withColumns({
        "source": F.lit("comps"), "market": F.when(F.col("currency") == "USD", "US").otherwise("EU"), "price_type": F.lit("asking_active"), "observed_at": F.to_timestamp(F.lit(observed)), "dedup_key": dedup_key(F.col("title"), F.lit(None).cast("string")),
    })
    found = found.withColumn("source_ref", F.concat_ws(":", "key", "dedup_key", F.col("amount").cast("long").cast("string")))
    return conform(found.where("reason is null"), "price_records"), found.where("reason is not null").select("key", "title", "amount", "reason")


def import_snapshot(spark: SparkSession, root: str, steps: Sequence[tuple[str, str, Callable]], tables: Mapping[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Reads the files of ``steps`` (name below ``root``, table, reader) that are there and folds each table's rows by its key in the order of the steps.

    A reader takes (spark, path) and gives rows, or rows and rejects (with ``reason``). Of several values of a column the last that isn't null stays; rows of ``tables`` come before all files. Rows with a null key are rejected. Returns the
    tables and a report with one row per step and reason: ``step, file, reason`` (null: taken)``, n``. The order in which files are written or found plays no part.
    """
    parts: dict[str, list[DataFrame]] = {name: [conform(df, name).withColumn("__step", F.lit(-1))] for name, df in (tables or {}).items()}
    report = []
    for i, (name, target, reader) in enumerate(steps):
        try:
            got = reader(spark, f"{root}/{name}")
            rows, bad = got if isinstance(got, tuple) else (got, None)
            rows = conform(rows, target).withColumn("__step", F.lit(i))
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            continue
        whole = F.lit(True)
        for k in KEYS[target]:
            whole = whole & F.col(k).isNotNull()
        parts.setdefault(target, []).append(rows.where(whole))
        reasons = [rows.select(F.when(~whole, "key").alias("reason"))] + ([bad.select("reason")] if bad is not None else [])
        for r in reasons:
            report.append(r.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("file"), "reason", "n"))
    out = {}
    for target, frames in parts.items():
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        keys = KEYS[target]
        columns = [c for c in rows.columns if c not in (*keys, "__step")]
        # rows of one file and key: the larger row is the later one, so that no order of lines decides
        out[target] = conform(fold(rows.withColumn("__row", F.to_json(F.struct(*columns))), keys, ["__step", "__row"], columns), target)
    empty = spark.createDataFrame([], "step int, file string, reason string, n long")
    for r in report:
        empty = empty.unionByName(r)
    return out, empty.groupBy("step", "file", "reason").agg(F.sum("n").alias("n"))



"""Session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans, skew handling; anything else stays as the cluster sets it."""
    b = SparkSession.builder.appName("brindle")
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return b.config(map=settings).getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local temporary folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/brindle"


def dealt(df: DataFrame, each: int = 4) -> DataFrame:
    """``df`` over ``each`` tasks a core, before work that takes long for a row: a file of short columns holds a million rows in one row group, which one task reads, however many splits the file has."""
    return df.repartition(each * df.sparkSession.sparkContext.defaultParallelism)

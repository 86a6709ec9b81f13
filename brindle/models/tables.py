"""Intermediate tables of model fitting in the cluster's shared folder."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame

from brindle.session import shared_root


#: Bytes of one packed block of rows, and how its table is written: Parquet closes a group after 16 blocks, however well they compress, and looks at its pages after each fourth instead of after a hundred, so neither writer nor reader holds more.
BLOCK = 1 << 20
PACKED = {"parquet.block.row.count.limit": 16, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4}


def slices(own: np.ndarray, width: int) -> list[np.ndarray]:
    """Row numbers in pieces of at most BLOCK bytes, if a row has ``width`` bytes."""
    step = max(1, BLOCK // max(1, width))
    return [own[lo : lo + step] for lo in range(0, len(own), step)]


def written(df: DataFrame, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, so a lost executor costs a read, not a refit. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Removes the files of a :func:`written` table that no later plan reads."""
    spark = df.sparkSession
    for f in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)

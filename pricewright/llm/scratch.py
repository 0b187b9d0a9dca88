"""Intermediate tables in the folder that the whole cluster shares.

A written table cuts the lineage and survives the loss of any executor, and Parquet
keeps it a good deal smaller than a checkpoint of rows.
"""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder


class Scratch:
    """Tables of one run of one operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = shared_folder(spark, label)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Only for tables that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def release(self) -> None:
        """Let go of the shuffles behind the tables written so far. Spark deletes their files
        when the driver's garbage is collected, which may otherwise be long after."""
        for _ in range(2):  # what the first round frees holds what the second does
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)


#: A table is broadcast up to so many rows, counted first; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; df has narrow rows and is cheap to read."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

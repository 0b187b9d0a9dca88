"""Incremental ingest: new files of observations become facts once, however often they come."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.rows import absent, first_per_key, product_keys
from ..plans.accounting import load_events
from ..plans.standardize import RAW_KEYS, first_order, held_names, product_names, raw_events, staged_rows
from ..sources.listings import PAYLOADS, captured_rows


def ingest_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, target: str, checkpoint: str, keys: list[str], order: list[str], reject: str | None = None, files_per_batch: int = 1) -> None:
    """Append the rows of new files that target lacks, the first of each key; reject is a
    condition on rows to leave out. Runs until all files there are have been read. Facts are
    partitioned by nothing here: a key is looked up in all of target."""

    def load(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = first_per_key(batch.where(f"NOT ({reject})") if reject else batch, keys, [F.col(c) for c in order])
        # the batch number names the rows' folder: a batch that is run again replaces itself
        known = session.read.parquet(target).where(F.col("batch") != number) if number else session.createDataFrame([], schema)
        absent(rows, known, keys).select(*schema.names).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    run = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


#: Folders that rows are dealt to by their run and source.
BUCKETS = 64
_PRODUCTS = "product_id long, name string, category string"


def ingest_listings(spark: SparkSession, folder: str, pattern: str, target: str, checkpoint: str, window: str = "7 days", files_per_batch: int = 1) -> None:
    """Captured payloads of new files through the standardising job, once each: listings and trees
    become product rows, rows repeated within the window are dropped by the stream's state,
    those repeated later by a look into what is staged, and the rest is standardised and
    admitted or rejected. Equal to the batch load of the same files, however they are cut.

    Under target: staging (batch, bucket; a row for each raw event, with its reject_reason and its
    product's id), products (batch) and run_events (batch). The buckets follow run and source,
    which every key begins with, so that a batch looks into those of its own runs only. The
    state's time is the batch's, not the capture's: a watermark on that would lose rows that
    arrive long after they were captured. The batch number names what it writes: a batch that is
    run again replaces itself."""

    def load(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        of = lambda name: f"{target}/{name}/batch={number}"
        before = lambda name, schema: session.read.parquet(f"{target}/{name}").where(F.col("batch") != number) if number else session.createDataFrame([], schema)
        batch = batch.persist()
        try:
            captured = [c for c in batch.columns if c not in ("raw_hash", "raw_payload", "observed_at", "arrived_at")]
            events = batch.withColumn("bucket", F.pmod(F.xxhash64("run_id", "source_name"), F.lit(BUCKETS)).cast("int"))
            touched = [r[0] for r in events.select("bucket").distinct().collect()]  # BUCKETS at most
            known = before("staging", "run_id long, source_name string, raw_hash string, bucket int").where(F.col("bucket").isin(touched)).select(*RAW_KEYS)
            fresh = absent(first_per_key(events, RAW_KEYS, first_order(events, captured)), known, RAW_KEYS)
            held, seen = of("staged"), Observation()
            made = staged_rows(fresh, held_names(batch)).observe(seen, F.count(F.lit(1)).alias("staged"), F.count_if(F.col("reject_reason").isNull()).alias("facts"))
            made.write.mode("overwrite").parquet(held)
            staged = session.read.schema(made.schema).parquet(held)
            old = before("products", _PRODUCTS).select("product_id", "name", "category")
            products = product_keys(product_names(staged), old)
            absent(products, old, ["product_id"]).write.mode("overwrite").parquet(of("products"))
            ids = session.read.schema(_PRODUCTS).parquet(of("products")).unionByName(old).select(F.col("name").alias("standardized_product_name"), "product_id")
            staged.join(ids, "standardized_product_name", "left").write.mode("overwrite").partitionBy("bucket").parquet(of("staging"))
            load_events(batch, staged, seen.get).write.mode("overwrite").parquet(of("run_events"))
        finally:
            batch.unpersist()

    payloads = spark.readStream.schema(PAYLOADS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    events = raw_events(captured_rows(payloads), F.current_timestamp()).withColumn("arrived_at", F.current_timestamp())
    # a digest stands for the payload in the state
    events = events.withColumn("_told", F.unhex(F.md5("raw_payload")))
    once = events.withWatermark("arrived_at", window).dropDuplicatesWithinWatermark([*RAW_KEYS, "_told"]).drop("_told")
    with _state_on_disk(spark):
        run = once.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


#: A window's keys may be more than the heap holds.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A stream takes the settings that the session has when it starts."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingested_facts(spark: SparkSession, target: str) -> DataFrame:
    """The rows that the stream has admitted."""
    return spark.read.parquet(f"{target}/staging").where("reject_reason is null")

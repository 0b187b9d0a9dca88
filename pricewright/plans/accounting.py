"""Runs and their counts, marts that are refreshed one by one, and the health of a data set."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of an error message that are kept.
MESSAGE = 5000


def finished_runs(standardised: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row a run of standardised rows: counts and status; runs that failed (run_id,
    error_message) are failed whatever was counted, their message cut to MESSAGE."""
    counts = standardised.groupBy("run_id", "source_name").agg(F.count(F.lit(1)).alias("records_scraped"), F.count_if("is_suspicious").alias("records_suspicious"), F.count_if(F.col("standardized_product_name").isNull()).alias("records_failed"))
    counts = counts.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set("source_name")), ", ").alias("sources"), *[F.sum(c).alias(c) for c in ("records_scraped", "records_suspicious", "records_failed")])
    if failed is None:
        return counts.withColumn("status", F.lit("success")).withColumn("error_message", F.lit(None).cast("string"))
    told = failed.groupBy("run_id").agg(F.min(F.substring("error_message", 1, MESSAGE)).alias("error_message"))
    met = counts.join(told.withColumn("_failed", F.lit(True)), "run_id", "full_outer")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("records_scraped", "records_suspicious", "records_failed")}
    return met.withColumns(zero).withColumn("status", F.when(F.col("_failed"), "failed").otherwise("success")).drop("_failed")


#: What a run's rows are counted by, and the events of a run in the order that settles a tie.
COUNTS = ["records_scraped", "records_raw", "records_stg", "records_fact", "records_suspicious", "records_failed"]
EVENTS = ["start", "load", "finish", "fail"]
RUN_EVENTS = "run_id long, source_name string, event string, at timestamp, message string, " + ", ".join(f"{c} long" for c in COUNTS)


def run_event(runs: DataFrame, event: str, at: Column, message: Column | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """Rows of runs (run_id, source_name) as events of a log that is only appended to. A failure's
    message is cut to MESSAGE."""
    told = F.lit(None) if message is None else F.substring(message, 1, MESSAGE)
    count = lambda c: (counts or {}).get(c, F.lit(0)).cast("long").alias(c)
    return runs.select(F.col("run_id").cast("long").alias("run_id"), "source_name", F.lit(event).alias("event"), at.cast("timestamp").alias("at"), told.cast("string").alias("message"), *[count(c) for c in COUNTS])


def load_events(batch: DataFrame, staged: DataFrame, observed: dict[str, int]) -> DataFrame:
    """What a load did for each run, as events. batch holds what was captured, staged what of it
    was new; observed, the totals that the write of staged told, must be those of the events."""
    scraped = batch.groupBy("run_id", "source_name").agg(F.count(F.lit(1)).alias("records_scraped"))
    admitted = F.col("reject_reason").isNull()
    new = staged.groupBy("run_id", "source_name").agg(F.count(F.lit(1)).alias("records_raw"), F.count_if(admitted).alias("records_fact"), F.count_if("is_suspicious").alias("records_suspicious"), F.count_if(~admitted).alias("records_failed"))
    totals = new.agg(F.coalesce(F.sum("records_raw"), F.lit(0)), F.coalesce(F.sum("records_fact"), F.lit(0))).first()
    if tuple(totals) != (observed["staged"], observed["facts"]):
        raise RuntimeError(f"staged rows {tuple(totals)} are not those written, {observed}")
    both = scraped.join(new, ["run_id", "source_name"], "left").withColumn("records_stg", F.col("records_raw"))
    return run_event(both, "load", F.current_timestamp(), counts={c: F.coalesce(c, F.lit(0)) for c in COUNTS})


def run_rows(events: DataFrame) -> DataFrame:
    """One row a run from its events, an aggregate: running from its start, success from its
    finish, failed from its failure, whichever came last; counts are the sums of its loads, and
    finished_at and the message are those of its end. A run that was never started is running."""
    place = F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event"))
    status = F.when(F.col("event") == "fail", "failed").when(F.col("event") == "finish", "success").when(F.col("event") == "start", "running")
    last = lambda c: F.max_by(c, F.when(status.isNotNull(), F.struct("at", place)))
    ended = F.col("event").isin("finish", "fail")
    folded = events.groupBy("run_id").agg(
        F.min("source_name").alias("source_name"), F.min(F.when(F.col("event") == "start", F.col("at"))).alias("started_at"), last(F.when(ended, F.col("at"))).alias("finished_at"),
        F.coalesce(last(status), F.lit("running")).alias("status"), *[F.sum(c).alias(c) for c in COUNTS], last(F.col("message")).alias("error_message"),
    )
    return folded


def refresh_marts(spark: SparkSession, marts: dict[str, Callable[[], DataFrame] | None], folder: str) -> DataFrame:
    """Write each mart as a new version, in order, and point to it once it is complete, so that
    one that fails, at any moment, leaves what was there and does not keep the others from it;
    one without a plan is skipped. (name, status, error); ``read_mart`` reads the newest."""
    rows = []
    for name, plan in marts.items():
        if plan is None:
            rows.append((name, "skipped", None))
            continue
        try:
            at = time.time_ns()
            plan().write.parquet(f"{folder}/{name}/version-{at}")
            spark.createDataFrame([(at,)], "version long").coalesce(1).write.mode("append").parquet(f"{folder}/{name}/complete")
            rows.append((name, "refreshed", None))
        except Exception as e:  # noqa: BLE001  the row tells it
            rows.append((name, "failed", str(e)[:MESSAGE]))
    return spark.createDataFrame(rows, "name string, status string, error string")


def read_mart(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The newest complete version of a mart."""
    newest = spark.read.parquet(f"{folder}/{name}/complete").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{folder}/{name}/version-{newest}")


def health_report(spark: SparkSession, tables: dict[str, DataFrame | None], runs: DataFrame, history: DataFrame, smoke: dict[str, DataFrame]) -> DataFrame:
    """(check_name, subject, ok, detail): every table is there, each source's latest success, the
    history has rows, and each query of smoke gives some."""
    present = spark.createDataFrame([("table_present", name, df is not None, None) for name, df in tables.items()], "check_name string, subject string, ok boolean, detail string")
    success = runs.groupBy("source_name").agg(F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("at"))
    latest = success.select(F.lit("latest_success").alias("check_name"), F.col("source_name").alias("subject"), F.col("at").isNotNull().alias("ok"), F.col("at").cast("string").alias("detail"))
    out = present.union(latest)
    for check, name, df in [("history_rows", "history", history), *[("smoke", n, df) for n, df in smoke.items()]]:
        out = out.union(df.limit(1).agg(F.lit(check), F.lit(name), F.count(F.lit(1)) > 0, F.lit(None).cast("string")))
    return out


def filter_like_any(df: DataFrame, column: str, any_of: list[str], none_of: list[str] = ()) -> DataFrame:
    """Rows whose lower-cased column is LIKE one of any_of and none of none_of."""
    fits = lambda patterns: F.exists(F.array(*map(F.lit, patterns)), lambda p: F.like(F.lower(F.col(column)), p))
    kept = df.where(fits(any_of)) if any_of else df.limit(0)
    return kept.where(~fits(none_of)) if none_of else kept


def by_coverage(catalog: DataFrame, key: str) -> DataFrame:
    """Rows of one coverage status: comparable, needs_review or only_<source>."""
    return catalog.where(F.col("coverage_status") == {"needs_review": "comparison_review_required"}.get(key, key))


def top_then_category(top: DataFrame, category: str, k: int, order: list, filter_first: bool = False) -> DataFrame:
    """The k first rows by order that are of a category; filter_first gives k of the category."""
    mine = F.col("category_name") == category
    return top.where(mine).orderBy(*order).limit(k) if filter_first else top.orderBy(*order).limit(k).where(mine)

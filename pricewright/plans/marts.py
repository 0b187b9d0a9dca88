"""Marts over price observations, runs and checks. Averages are taken of exact decimal sums,
so no order of addition shows in a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prices import with_promotion
from ..operators.rows import first_per_key, latest_per_key
from ..sources.bindings import TIE


def exact_avg(c: str) -> Column:
    return F.sum(c).cast("double") / F.count(c)


def price_history(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Facts with their run's status and whether they are a promotion."""
    known = runs.select("run_id", F.col("status").alias("run_status"))
    return with_promotion(facts.join(known, "run_id", "left"))


def daily_prices(facts: DataFrame, by_source: bool = False) -> DataFrame:
    """By day, product, category and unit. Rows without a unit price count, but not by source."""
    keys = [*(["source_name"] if by_source else []), "standardized_product_name", "category_name", "normalized_unit"]
    rows = facts.where(F.col("price_per_unit").isNotNull()) if by_source else facts
    return rows.groupBy(F.to_date("observed_at").alias("date"), *keys).agg(
        exact_avg("price_per_unit").alias("avg_price"), F.min("price_per_unit").cast("double").alias("min_price"), F.max("price_per_unit").cast("double").alias("max_price"), F.count(F.lit(1)).alias("observations")
    )


def daily_product_avg(facts: DataFrame) -> DataFrame:
    rows = facts.where(F.col("price_per_unit").isNotNull())
    return rows.groupBy(F.to_date("observed_at").alias("date"), "standardized_product_name", "category_name").agg(exact_avg("price_per_unit").alias("avg_price"))


def top_movers(daily: DataFrame) -> DataFrame:
    """Each day's average against the one before of the product (by date, then category)."""
    before = F.lag("avg_price").over(W.partitionBy("standardized_product_name").orderBy("date", "category_name"))
    change = F.col("latest_price") - F.col("previous_price")
    return (
        daily.select("standardized_product_name", "category_name", "date", F.col("avg_price").alias("latest_price"), before.alias("previous_price"))
        .where("previous_price is not null")
        .select("*", change.alias("abs_change"), F.when(F.col("previous_price") != 0, change / F.col("previous_price") * 100).alias("pct_change"))
    )


def price_volatility(facts: DataFrame, high: float = 50, medium: float = 20, min_n: int = 2) -> DataFrame:
    p = F.col("price_per_unit").cast("decimal(18,4)")
    n = F.count(F.lit(1))
    s, q = F.sum(p.cast("decimal(12,4)")), F.sum((p * p).cast("decimal(24,8)"))
    # n * q - s * s in decimals: exactly 0 for steady prices
    sums = facts.where(p.isNotNull()).groupBy("standardized_product_name", "category_name").agg(s.alias("s"), q.alias("q"), n.alias("n"))
    apart = F.col("q").cast("decimal(27,8)") * F.col("n").cast("decimal(10,0)") - F.col("s").cast("decimal(18,4)") * F.col("s").cast("decimal(18,4)")
    mean = F.col("s").cast("double") / F.col("n")
    spread = F.sqrt(apart.cast("double")) / F.col("n")
    level = F.when(F.col("volatility") >= high, "high").when(F.col("volatility") >= medium, "medium").otherwise("low")
    return sums.where(F.col("n") >= min_n).select("standardized_product_name", "category_name", mean.alias("avg_price_per_unit"), spread.alias("volatility"), F.col("n").alias("observation_count")).withColumn("volatility_level", level)


def pipeline_health(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Each run with its checks counted, the last failed one and a status. Checks are
    aggregated by run before the join, so no run is multiplied."""
    failed = F.col("check_status") == "fail"
    by_run = checks.groupBy("run_id").agg(
        F.count("quality_id").alias("total_checks"), F.count_if(F.col("check_status") == "pass").alias("passed_checks"), F.count_if(failed).alias("failed_checks"),
        F.max_by(F.when(failed, F.struct("check_name", "details")), F.when(failed, F.struct("created_at", "quality_id"))).alias("last"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    status = F.when(F.col("status").isin("failed", "running"), F.col("status")).when(F.coalesce("failed_checks", F.lit(0)) > 0, "warning").when(F.col("status") == "success", "healthy").otherwise("unknown")
    return runs.join(by_run, "run_id", "left").select(
        "run_id", "source_name", "started_at", "finished_at", "status", "records_raw",
        (F.expr("timestampdiff(MICROSECOND, started_at, finished_at)") / 1e6).alias("run_duration_seconds"),
        zero("total_checks"), zero("passed_checks"), zero("failed_checks"),
        F.col("last.check_name").alias("last_failed_check_name"), F.col("last.details").alias("last_failed_check_details"), status.alias("pipeline_health_status"),
    )


def latest_prices(facts: DataFrame, health: DataFrame) -> DataFrame:
    """The latest observation of each product of a source, from usable runs only."""
    usable = health.where(F.col("pipeline_health_status").isin("healthy", "warning")).select("run_id")
    rows = facts.where(F.col("source_product_id").isNotNull() & F.col("standardized_product_name").isNotNull()).join(usable, "run_id", "left_semi")
    out = ["source_name", "source_product_id", "standardized_product_name", "price", "price_per_unit", "normalized_unit", "observed_at"]
    return latest_per_key(rows.select(*dict.fromkeys([*out, *TIE])), ["source_name", "source_product_id"], "observed_at", TIE).select(*out)


def top_by_price(daily: DataFrame, date, k: int = 10, ascending: bool = False) -> DataFrame:
    """The k cheapest or dearest products of a day."""
    order = F.asc("avg_price") if ascending else F.desc("avg_price")
    return daily.where((F.col("date") == date) & F.col("avg_price").isNotNull()).orderBy(order, "standardized_product_name", "category_name", "normalized_unit").limit(k)


def last_day(daily: DataFrame) -> DataFrame:
    """Rows of the latest day, without asking the driver for it."""
    return daily.join(F.broadcast(daily.agg(F.max("date").alias("_last"))), F.col("date") == F.col("_last")).drop("_last")


def movers(changes: DataFrame, k: int = 10, ascending: bool = False, known_only: bool = False) -> DataFrame:
    """The k largest changes up or down. A missing change comes first going down the list
    and last going up, or is left out with known_only."""
    rows = changes.where("pct_change is not null") if known_only else changes
    order = F.asc_nulls_last("pct_change") if ascending else F.desc_nulls_first("pct_change")
    return rows.orderBy(order, "standardized_product_name", "category_name", "date").limit(k)


def mean_change(up: DataFrame, down: DataFrame) -> DataFrame:
    """(n_changes, mean_abs_change) of two short lists of changes, missing ones left out; those
    of down count by their size. Null without any."""
    every = up.select(F.col("pct_change").alias("x")).union(down.select(F.abs("pct_change").alias("x")))
    exact = F.round("x", 6).cast("decimal(24,6)")
    return every.agg(F.count("x").alias("n_changes"), (F.sum(exact).cast("double") / F.count("x")).alias("mean_abs_change"))


def volatility_summary(volatile: DataFrame) -> DataFrame:
    """(n_products, mean_volatility, n_high) of all rows of price_volatility."""
    exact = F.round("volatility", 6).cast("decimal(24,6)")
    return volatile.agg(
        F.count(F.lit(1)).alias("n_products"), (F.sum(exact).cast("double") / F.count("volatility")).alias("mean_volatility"), F.count_if(F.col("volatility_level") == "high").alias("n_high")
    )


def recent_trends(daily: DataFrame, changes: DataFrame, k: int = 5, distinct_products: bool = True) -> DataFrame:
    """The daily history of the products with the k largest changes either way."""
    top = changes.where("pct_change is not null").orderBy(F.desc(F.abs("pct_change")), "standardized_product_name", "category_name", "date").limit(k).select("standardized_product_name")
    return daily.join(F.broadcast(top.distinct() if distinct_products else top), "standardized_product_name")


def freshness(daily: DataFrame, facts: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: the last day and observation, the last success and the last run."""
    success = runs.where("status = 'success'").agg(F.max("started_at").alias("last_success_at"))
    last_run = runs.agg(F.max("run_id").alias("last_run_id"), F.max_by("status", "run_id").alias("last_run_status"))
    return daily.agg(F.max("date").alias("last_date")).join(facts.agg(F.max("observed_at").alias("last_observed_at"))).join(success).join(last_run)


def quality_checks(facts: DataFrame, daily: DataFrame) -> DataFrame:
    """(check_name, check_status, observed_value, threshold_value): completeness of facts and
    grain of the daily mart."""
    share = lambda c: F.count(c) / F.greatest(F.count(F.lit(1)), F.lit(1))
    row = lambda name, value, least: F.struct(F.lit(name).alias("check_name"), value.cast("double").alias("observed_value"), F.lit(float(least)).alias("threshold_value"))
    of_facts = facts.agg(F.array(row("facts_not_empty", F.count(F.lit(1)), 1), row("unit_price_complete", share("price_per_unit"), 1), row("category_complete", share("category_name"), 1)).alias("c"))
    keys = ["date", "standardized_product_name", "category_name", "normalized_unit"]
    grain = daily.groupBy(*keys).count().agg(F.array(row("mart_grain_unique", F.when(F.coalesce(F.max("count"), F.lit(1)) <= 1, 1).otherwise(0), 1)).alias("c"))
    latest = last_day(daily).agg(F.array(row("latest_average_present", F.when(F.count("avg_price") == F.count(F.lit(1)), 1).otherwise(0), 1)).alias("c"))
    rows = of_facts.union(grain).union(latest).select(F.explode("c").alias("c")).select("c.*")
    return rows.withColumn("check_status", F.when(F.col("observed_value") >= F.col("threshold_value"), "pass").otherwise("fail"))


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def price_span(daily: DataFrame) -> DataFrame:
    """First and last average of each product and category and the change between them."""
    ends = daily.groupBy("standardized_product_name", "category_name").agg(F.min_by("avg_price", "date").alias("first_price"), F.max_by("avg_price", "date").alias("last_price"))
    return ends.withColumn("total_pct_change", F.when(F.col("first_price") != 0, (F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100))


def last_failed_checks(checks: DataFrame) -> DataFrame:
    return first_per_key(checks.where("check_status = 'fail'"), ["run_id"], [F.desc("created_at"), F.desc("quality_id")])

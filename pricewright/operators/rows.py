"""Operators on rows by key: latest, first, absent, repointed, pivoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import shared_folder


def first_per_key(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    ranked = df.withColumn("_row", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_row = 1").drop("_row")


def latest_per_key(df: DataFrame, keys: list, at: str, ties: list[str]) -> DataFrame:
    """The last row of each key by time, then by the tie columns: an aggregate, so each
    task sends one row of a key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *ties)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def of_last_time(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The rows of the last time of each key, of which ``latest_per_key`` takes one. The times are an
    aggregate that needs no row in order, written to the shared folder; df is read twice."""
    last, folder = df.groupBy(*keys).agg(F.max(at).alias("_at")).withColumnsRenamed({k: f"_{k}" for k in keys}), shared_folder(df.sparkSession, "last")
    last.write.parquet(folder)
    last = df.sparkSession.read.schema(last.schema).parquet(folder)
    return df.join(last, [*[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col(at).eqNullSafe(F.col("_at"))], "left_semi")


def absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key existing lacks."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def insert_absent(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """target and the first new row of each key that it lacks."""
    return target.unionByName(absent(first_per_key(new, keys, order), target, keys).select(*target.columns))


def canonical_of(df: DataFrame, keys: list[str], event: str) -> DataFrame:
    """(keys, canonical): the smallest event of each key."""
    return df.groupBy(*keys).agg(F.min(event).alias("canonical"))


def repoint(child: DataFrame, canonical: DataFrame, event: str) -> DataFrame:
    """child with event replaced by the one it stands for, from (event, canonical)."""
    return child.join(canonical.select(event, "canonical"), event, "left").withColumn(event, F.coalesce("canonical", event)).drop("canonical")


def ordered_union(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """All frames; of a key, the row of the earliest frame, then of the first in order."""
    every = None
    for k, df in enumerate(frames):
        df = df.withColumn("_frame", F.lit(k))
        every = df if every is None else every.unionByName(df)
    return first_per_key(every, keys, [F.col("_frame"), *[F.col(c) for c in order]]).drop("_frame")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """On keys that count as equal when both are null; the left side's keys stay."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"_{k}" for k in keys])


def pattern_join(rules: DataFrame, names: DataFrame, pattern: str, name: str) -> DataFrame:
    """Every rule with every name its LIKE pattern fits. Rules are a small fixed table, which
    is broadcast; names stay where they are."""
    return names.join(F.broadcast(rules), F.like(F.col(name), F.col(pattern)))


def pivot_sources(latest: DataFrame, keys: list[str], columns: list[str], sources: list[str]) -> DataFrame:
    """One row a key: each column for each source, and n_sources."""
    picks = [F.max(F.when(F.col("source_name") == s, F.col(c))).alias(f"{s}_{c}") for s in sources for c in columns]
    return latest.groupBy(*keys).agg(*picks, F.count_distinct("source_name").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source_name")), ", ").alias("available_sources"))


def mode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the largest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.max_by(column, F.struct("n", column)).alias(column), F.max("n").alias("n"))


def product_keys(names: DataFrame, existing: DataFrame) -> DataFrame:
    """existing (product_id, name, category) and a new id for each further name of names
    (name, category, seen): ids go on from the largest, by name, and the category is the one
    seen first. New names are dealt by ranges and written to the shared folder; each range
    numbers its own, after those of the ranges before."""
    fresh = absent(names.groupBy("name").agg(F.min_by("category", F.struct("seen", "category")).alias("category")), existing, ["name"])
    spark, path = names.sparkSession, shared_folder(names.sparkSession, "keys")
    dealt = fresh.select("name", "category").repartitionByRange("name").withColumn("part", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    # one row a range, so one task holds them
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    top = existing.agg(F.coalesce(F.max("product_id"), F.lit(0)).cast("long").alias("top"))
    placed = dealt.join(F.broadcast(starts), "part").join(F.broadcast(top))
    numbered = placed.withColumn("product_id", F.col("top") + F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("name")))
    return existing.select("product_id", "name", "category").unionByName(numbered.select("product_id", "name", "category"))

"""Matching products across sources: latest prices side by side, and how safe that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prices import cheaper_source
from ..functions.text import base_name, extra_words, penalty, standardize_name, words
from ..operators.rows import first_per_key, latest_per_key, pattern_join, pivot_sources
from ..sources.bindings import SOURCES, TIE

COLUMNS = ["price", "price_per_unit", "source_product_name", "normalized_unit", "normalized_quantity", "observed_at"]


def same_flag(column: str, sources: list[str]) -> Column:
    """All sources have the column, and alike."""
    first, out = F.col(f"{sources[0]}_{column}"), F.lit(True)
    for s in sources[1:]:
        out = out & F.coalesce(F.col(f"{s}_{column}") == first, F.lit(False))
    return out & first.isNotNull()


def confidence() -> Column:
    return F.when(F.col("same_unit_flag") & F.col("same_quantity_flag"), "high").when(F.col("same_unit_flag"), "medium").otherwise("low")


def compared(pivot: DataFrame, sources: list[str]) -> DataFrame:
    """A pivot with safety flags, difference, cheaper source and confidence."""
    a, b = (F.col(f"{s}_price").cast("double") for s in sources[:2])
    flagged = pivot.withColumn("same_unit_flag", same_flag("normalized_unit", sources)).withColumn("same_quantity_flag", same_flag("normalized_quantity", sources))
    return flagged.select(
        "*", F.round(b - a, 2).alias("price_diff"), F.round(F.when(a != 0, (b - a) / a * 100), 2).alias("price_diff_pct"),
        cheaper_source({s: F.col(f"{s}_price") for s in sources}).alias("cheaper_source"), confidence().alias("comparison_confidence"),
    )


def cross_compare_latest(history: DataFrame, product: str = "source_product_name", sources: list[str] = SOURCES, both: bool = True) -> DataFrame:
    """Latest price of each product and source side by side; with both, of products that all
    sources have."""
    rows = history.where(F.col("price").isNotNull() & F.col(product).isNotNull()).select(*dict.fromkeys([product, "source_name", *COLUMNS, *TIE]))
    latest = latest_per_key(rows, [product, "source_name"], "observed_at", TIE)
    pivot = pivot_sources(latest, [product], [c for c in COLUMNS if c != product], sources)
    return compared(pivot.where(F.col("n_sources") == len(sources)) if both else pivot, sources)


def representatives(history: DataFrame, variants: list[str]) -> DataFrame:
    """Of each standardised product and source the raw product that stands for it: its base
    name is the product's own, then few variant words, few extra words, few words, recent."""
    rows = history.where(F.col("price").isNotNull() & F.col("standardized_product_name").isNotNull())
    rows = rows.select(*dict.fromkeys(["source_name", "standardized_product_name", "canonical_name", *COLUMNS, *TIE]))
    latest = latest_per_key(rows, ["source_name", "source_product_name"], "observed_at", TIE)
    raw, name = F.col("source_product_name"), F.col("standardized_product_name")
    order = [F.when(base_name(raw) == name, 0).otherwise(1), penalty(raw, F.col("canonical_name"), variants), extra_words(raw, name), F.size(words(raw)), F.desc("observed_at"), *[F.desc(c) for c in TIE]]
    return first_per_key(latest, ["standardized_product_name", "source_name"], order)


def cross_compare(history: DataFrame, variants: list[str], sources: list[str] = SOURCES) -> DataFrame:
    chosen = representatives(history, variants)
    pivot = pivot_sources(chosen, ["standardized_product_name"], COLUMNS, sources)
    return compared(pivot.where(F.col("n_sources") == len(sources)), sources)


def coverage_catalog(history: DataFrame, product: str = "source_product_name", sources: list[str] = SOURCES) -> DataFrame:
    """All products, also of one source, with the state of their comparison."""
    rows = cross_compare_latest(history, product, sources, both=False)
    only = F.concat(F.lit("only_"), F.col("available_sources"))
    status = F.when(F.col("n_sources") == 0, "unavailable").when(F.col("n_sources") < len(sources), only).when(F.col("comparison_confidence") == "high", "comparable").otherwise("comparison_review_required")
    return rows.withColumn("coverage_status", status)


def derive_aliases(products: DataFrame, rules: DataFrame) -> DataFrame:
    """(alias, product_id): each name is its own alias; a rule (rule_id, alias, pattern) adds
    its alias for the product that fits best: equal, then prefix, then anywhere, then the
    smallest id. Of an alias the first rule counts."""
    own = products.select(F.col("name").alias("alias"), "product_id")
    fits = pattern_join(rules.where("alias is not null"), products, "pattern", "name")
    order = [F.when(F.col("name") == F.col("alias"), 0).when(F.col("name").startswith(F.col("alias")), 1).otherwise(2), F.col("product_id")]
    best = first_per_key(fits, ["rule_id"], order)
    added = first_per_key(best, ["alias"], [F.col("rule_id")]).select("alias", "product_id")
    return own.union(added.join(own.select("alias"), "alias", "left_anti"))


def match_products(inputs: DataFrame, products: DataFrame, aliases: DataFrame) -> DataFrame:
    """(input, product_id, match_type): by standardised name, else by alias, else none."""
    named = inputs.withColumn("_key", standardize_name(F.col("input"))).withColumn("_raw", F.lower(F.trim("input")))
    exact = products.select(F.col("name").alias("_key"), F.col("product_id").alias("_exact"))
    alias = aliases.select(F.col("alias").alias("_raw"), F.col("product_id").alias("_alias"))
    met = named.join(exact, "_key", "left").join(alias, "_raw", "left")
    kind = F.when(F.col("_exact").isNotNull(), "product_exact").when(F.col("_alias").isNotNull(), "alias_exact").otherwise("no_match")
    return met.select("input", F.coalesce("_exact", "_alias").alias("product_id"), kind.alias("match_type"))


#: Confidence from low to high.
RANKS = {"low": 0, "medium": 1, "high": 2}


def merge_coverage(frames: list[DataFrame], key: str, sources: list[str] = SOURCES) -> DataFrame:
    """Of a key, the row of the highest confidence, then one with all prices, then of the
    earliest frame: what overriding row by row, only by better ones, comes to."""
    every = None
    for k, df in enumerate(frames):
        df = df.withColumn("_frame", F.lit(k))
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[F.col("comparison_confidence")], F.lit(-1))
    whole = F.lit(1)
    for s in sources:
        whole = whole * F.col(f"{s}_price").isNotNull().cast("int")
    best = first_per_key(every, [key], [F.desc(rank), F.desc(whole), F.col("_frame")])
    reason = F.when(whole == 0, F.lit(None).cast("string")).when(~F.col("same_unit_flag"), "unit_mismatch").when(~F.col("same_quantity_flag"), "quantity_mismatch").when(F.col("comparison_confidence") != "high", "comparison_confidence_not_high")
    return best.withColumn("review_reason", reason).drop("_frame")

"""Prices and units as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_unit(unit: Column, quantity: Column) -> Column:
    """(unit, quantity): grams become kilograms, pieces and rolls count one by default."""
    u = F.upper(F.trim(unit))
    one = F.coalesce(quantity.cast("double"), F.lit(1.0))
    row = lambda a, b: F.struct(a.alias("unit"), b.cast("double").alias("quantity"))
    return (
        F.when(unit.isNull(), row(F.lit(None).cast("string"), F.lit(None)))
        .when(u == "GRAM", row(F.lit("kg"), F.round(quantity.cast("double") / 1000, 4)))
        .when(u.isin("PIECE", "ROLL"), row(F.lower(u), one))
        .otherwise(row(F.lower(F.trim(unit)), quantity))
    )


def unit_price(price: Column, quantity: Column) -> Column:
    """To four digits, half up, of decimals; null without a positive quantity."""
    exact = lambda c: c.cast("decimal(18,4)")
    return F.when(exact(quantity) > 0, F.round(exact(price) / exact(quantity), 4)).cast("double")


def with_promotion(df: DataFrame) -> DataFrame:
    """is_promotion: a discount, or a regular price above the price."""
    return df.withColumn("is_promotion", (F.coalesce("discount_rate", F.lit(0)) > 0) | F.coalesce(F.col("regular_price") > F.col("price"), F.lit(False)))


def suspicion(price: Column, name: Column, max_price: float = 500, small_pack_max: float = 200) -> Column:
    """Why a price is doubtful, or null."""
    small = F.lower(name).rlike(r" gr|g paket|paket")
    return (
        F.when(price.isNull(), "price_null").when(price <= 0, "price_invalid").when(price > max_price, "price_too_high").when(small & (price > small_pack_max), "small_package_price_too_high")
    )


#: Needed of a fact row, in the order in which a lack is reported.
REQUIRED = ["price", "normalized_unit", "normalized_quantity", "price_per_unit", "standardized_product_name", "category_name"]


def reject_reason(suspicious: Column) -> Column:
    """The first reason not to admit a row to the facts, or null."""
    out = F.when(suspicious, "suspicious_record")
    for c in REQUIRED:
        out = out.when(F.col(c).isNull(), f"missing_{c}")
    return out.when(F.col("price") <= 0, "invalid_price").when(F.col("normalized_quantity") <= 0, "invalid_normalized_quantity")


def cheaper_source(prices: dict[str, Column]) -> Column:
    """The source with the one smallest price, 'same' if several have it, null without any."""
    least = F.least(*prices.values()) if len(prices) > 1 else next(iter(prices.values()))
    ties = reduce(lambda a, b: a + b, [F.coalesce((p == least).cast("int"), F.lit(0)) for p in prices.values()])
    out = F.when(least.isNull(), F.lit(None).cast("string")).when(ties > 1, "same")
    for name, p in prices.items():
        out = out.when(p == least, name)
    return out


def row_hash(*parts: Column) -> Column:
    """md5 over the parts, a missing one as ''."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))

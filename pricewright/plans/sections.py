"""Sections of a category's results: what is asked for first, the rest after it, and chips by brand.

results: (query_id, place, standardized_product_name, brand, subtype, best_unit and further columns),
as listings order them; queries: (query_id, text). Everything is told by aggregates of a query's
results that are joined back to them, so no query's results meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.intents import asked_subtype
from ..functions.profiles import cleaning_tokens
from ..operators.rows import first_per_key, mode
from ..sources.bindings import SOURCES
from .listings import CATEGORY_LIMIT

#: Chips of brands that a query has at most.
CHIPS = 4
# The unit that a kind of cleaning product is compared by, and the brands that its
# chips name first.
PRIMARY_UNITS = {
    "dishwashing_liquid": "litre", "dishwasher_tablet": "adet", "dishwasher_salt": "kg", "rinse_aid": "litre", "dishwasher_cleaner": "litre",
    "laundry_liquid": "litre", "laundry_powder": "kg", "laundry_capsule": "adet", "bleach": "litre", "surface_cleaner": "litre",
}
FIRST_BRANDS = {"dishwashing_liquid": ["fairy", "pril", "bingo"], "dishwasher_tablet": ["finish", "fairy", "pril"], "laundry_liquid": ["omo", "ariel"], "laundry_powder": ["omo", "ariel"]}


def _of(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def sectioned(results: DataFrame, queries: DataFrame) -> DataFrame:
    """results with primary_subtype, primary_unit and section. The subtype is the one that the text
    names, else the most frequent (of equally frequent ones the largest); the unit is the usual one of
    that subtype if a result of it has it, else the most frequent among them. Results of both
    are primary, all of a query without either."""
    asked = queries.select("query_id", asked_subtype(cleaning_tokens(F.col("text"))).alias("asked"))
    usual = mode(results, ["query_id"], "subtype").select("query_id", F.col("subtype").alias("usual"))
    kind = results.select("query_id").distinct().join(asked, "query_id", "left").join(usual, "query_id", "left").select("query_id", F.coalesce("asked", "usual").alias("primary_subtype"))
    told = results.join(kind, "query_id")
    fits = F.col("primary_subtype").isNull() | F.coalesce(F.col("subtype") == F.col("primary_subtype"), F.lit(False))
    units = told.where(fits & F.col("best_unit").isNotNull()).groupBy("query_id", "primary_subtype", "best_unit").agg(F.count(F.lit(1)).alias("n"))
    preferred = F.coalesce(F.col("best_unit") == _of(PRIMARY_UNITS, F.col("primary_subtype")), F.lit(False))
    unit = units.groupBy("query_id").agg(F.max_by("best_unit", F.struct(preferred, "n", "best_unit")).alias("primary_unit"))
    both = fits & (F.col("primary_unit").isNull() | F.coalesce(F.col("best_unit") == F.col("primary_unit"), F.lit(False)))
    return told.join(unit, "query_id", "left").withColumn("section", F.when(both, "primary").otherwise("secondary"))


def chips(sections: DataFrame, sources: list[str] = SOURCES, limit: int = CHIPS) -> DataFrame:
    """(query_id, chip_no, chip, n_results): all first, then the brands of the primary results: those
    named first for the subtype if any of them is there, else in the order of their first result;
    a source's own name is no brand."""
    primary = sections.where("section = 'primary'")
    whole = primary.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_results")).select("query_id", F.lit(0).alias("chip_no"), F.lit("all").alias("chip"), "n_results")
    named = primary.where(F.col("brand").isNotNull() & ~F.col("brand").isin(sources))
    brands = named.groupBy("query_id", "primary_subtype", "brand").agg(F.count(F.lit(1)).alias("n_results"), F.min("place").alias("first"))
    listed = F.create_map(*[x for k, v in FIRST_BRANDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("primary_subtype")]
    brands = brands.withColumn("rank", F.nullif(F.coalesce(F.array_position(listed, F.col("brand")), F.lit(0)), F.lit(0)))
    some = brands.groupBy("query_id").agg(F.max(F.col("rank").isNotNull()).alias("some"))
    kept = brands.join(some, "query_id").where(F.col("rank").isNotNull() | ~F.col("some"))
    order = W.partitionBy("query_id").orderBy(F.asc_nulls_last("rank"), "first", "brand")
    told = kept.withColumn("chip_no", F.row_number().over(order)).where(F.col("chip_no") <= limit)
    return whole.unionByName(told.select("query_id", "chip_no", F.col("brand").alias("chip"), "n_results"))


def chosen(sections: DataFrame, picked: DataFrame, sources: list[str] = SOURCES, limit: int | None = CATEGORY_LIMIT) -> DataFrame:
    """The results that a query shows under the chip that is picked (query_id, chip; null: all), the
    primary ones first, with a place of their own: a chip that the query has keeps its brand's
    primary results, another one keeps all of them; of the others those of the brand (of the chip
    tablet, all tablets). A product stands once, where it comes first."""
    has = chips(sections, sources).select("query_id", "chip", F.lit(True).alias("has"))
    asked = picked.select("query_id", F.col("chip").alias("picked")).join(has.withColumnRenamed("chip", "picked"), ["query_id", "picked"], "left")
    met = sections.join(asked, "query_id", "left")
    every = F.col("picked").isNull() | (F.col("picked") == "all")
    mine = F.coalesce(F.when(F.col("picked") == "tablet", F.col("subtype") == "dishwasher_tablet").otherwise(F.col("brand") == F.col("picked")), F.lit(False))
    first = every | F.col("has").isNull() | F.coalesce(F.col("brand") == F.col("picked"), F.lit(False))
    shown = met.where(F.when(F.col("section") == "primary", first).otherwise(every | mine))
    once = first_per_key(shown, ["query_id", "standardized_product_name"], [F.col("section"), F.col("place")])
    ranked = once.withColumn("shown", F.row_number().over(W.partitionBy("query_id").orderBy("section", "place", "standardized_product_name")))
    ranked = ranked.where(F.col("shown") <= limit) if limit is not None else ranked
    return ranked.withColumn("is_cheapest", F.col("shown") == 1).drop("picked", "has")

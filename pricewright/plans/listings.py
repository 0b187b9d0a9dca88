"""Listings of search results: the best offer of a product, and results by category or brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.intents import asked_subtype
from ..functions.labels import SHOWN_UNITS, pack_total, shown_unit
from ..functions.profiles import CLEANING_BRANDS, _let, cleaning_profile, cleaning_tokens
from ..functions.text import normalize_text
from ..sources.bindings import SOURCES

#: Results that a listing shows.
CATEGORY_LIMIT, BRAND_LIMIT = 12, 8
SAFE, SINGLE, REVIEW = "safe", "single_market", "review_required"


def normalized_status(status: Column) -> Column:
    return F.when(status == "comparable", SAFE).when(status.startswith("only_"), SINGLE).otherwise(REVIEW)


def best_offer(catalog: DataFrame, sources: list[str] = SOURCES) -> DataFrame:
    """catalog with best_source, best_price, best_unit_price and best_unit: of the sources with a
    price, one with a unit price first, then the least unit price, then the least price. A unit
    price is the price over what the pack holds, else the comparison price. Rows without a
    price are left out. The brand and subtype of a cleaning product are added."""
    offers = []
    for s in sources:
        name = F.coalesce(f"{s}_source_product_name", "standardized_product_name")
        pack = pack_total(name, F.col(f"{s}_normalized_unit"), F.col(f"{s}_normalized_quantity"))
        price = F.col(f"{s}_raw_price").cast("double")
        own = (pack["quantity"] > 0) & pack["unit"].isin(*SHOWN_UNITS)
        compared = F.col("comparison_price_unit").isNotNull() & F.col(f"{s}_comparison_price").isNotNull()
        unit_price = F.when(own, price / pack["quantity"]).when(compared, F.col(f"{s}_comparison_price").cast("double"))
        unit = F.when(own, shown_unit(pack["unit"])).when(compared, shown_unit(F.col("comparison_price_unit")))
        offers.append(F.when(price.isNotNull(), F.struct(unit_price.isNull().alias("none"), unit_price.alias("unit_price"), price.alias("price"), F.lit(s).alias("source"), unit.alias("unit"))))
    best = F.array_min(F.filter(F.array(*offers), lambda x: x.isNotNull()))
    kept = catalog.withColumn("_o", best).where(F.col("_o").isNotNull())
    names = [F.col(f"{s}_source_product_name") for s in sources]
    of = [cleaning_profile(n) for n in names]
    profile = F.when(of[0]["is_cleaning"] & names[0].isNotNull(), of[0]).when(of[1]["is_cleaning"] & names[1].isNotNull(), of[1])
    return kept.withColumn("_p", profile).select(
        *catalog.columns, F.col("_o.source").alias("best_source"), F.col("_o.price").alias("best_price"), F.col("_o.unit_price").alias("best_unit_price"), F.col("_o.unit").alias("best_unit"),
        F.col("_p.brand").alias("brand"), F.col("_p.subtype").alias("subtype"), normalized_status(F.col("coverage_status")).alias("normalized_status"),
    )


def decision_price(status: Column, unit_price: Column) -> Column:
    """A unit price that a safe comparison makes a little better and an open one a little worse."""
    return unit_price * F.when(status == SAFE, 0.99).when(status == REVIEW, 1.01).otherwise(1.0)


def _priority(status: Column) -> Column:
    return F.when(status == SAFE, 0).when(status == SINGLE, 1).otherwise(2)


def category_listing(offers: DataFrame, keys: list[str], limit: int = CATEGORY_LIMIT) -> DataFrame:
    """The offers of each of keys (of a search: query_id) in order: with a unit price, by the
    decision price, unit price, status, price, name; place from 1 and whether it is the cheapest.
    The price to show first is that of a unit where known."""
    decided = decision_price(F.col("normalized_status"), F.col("best_unit_price"))
    order = W.partitionBy(*keys).orderBy(F.col("best_unit_price").isNull(), decided.asc_nulls_last(), F.asc_nulls_last("best_unit_price"), _priority(F.col("normalized_status")), "best_price", F.lower("standardized_product_name"), "standardized_product_name")
    ranked = offers.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    known = F.col("best_unit_price").isNotNull() & F.col("best_unit").isNotNull()
    return ranked.withColumns({"is_cheapest": F.col("place") == 1, "primary_kind": F.when(known, "unit_price").otherwise("shelf_price"), "primary_value": F.when(known, F.col("best_unit_price")).otherwise(F.col("best_price")), "secondary_value": F.when(known, F.col("best_price"))})


def brand_listing(offers: DataFrame, keys: list[str], brand: str, subtypes: list[str] = (), limit: int = BRAND_LIMIT) -> DataFrame:
    """As category_listing, the asked brand (a column) first, then preferred subtypes in order,
    then safe comparisons."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, subtypes)), F.col("subtype")), F.lit(0)) if subtypes else F.lit(0)
    decided = decision_price(F.col("normalized_status"), F.col("best_unit_price"))
    order = W.partitionBy(*keys).orderBy(F.when(F.col("brand") == F.col(brand), 0).otherwise(1), F.when(place > 0, place).otherwise(len(subtypes) + 1), F.when(F.col("normalized_status") == SAFE, 0).otherwise(1), decided.asc_nulls_last(), F.asc_nulls_last("best_unit_price"), F.asc_nulls_last("best_price"), F.lower("standardized_product_name"), "standardized_product_name")
    return offers.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).withColumn("is_cheapest", F.col("place") == 1)


# Words of a query about cleaning that tell no product from another, the words of a
# line of dishwasher tablets, and what a product gains for what it shares with a query.
PLAIN_WORDS = [
    "adet", "banyo", "bulasik", "camasir", "deterjan", "deterjani", "elde", "gel", "kapsul", "kapsulu", "kokulu", "li", "lu", "lt", "makine", "makinesi", "ml",
    "parlatici", "rulo", "sivi", "sprey", "spray", "tablet", "tableti", "temiz", "temizleyici", "toz", "yikama",
]
POWER_WORDS = ["power", "powerball", "quantum", "ultimate", "gel", "max"]
GAIN = {"brand": 30, "subtype": 20, "word": 18, "power": 34, "no_power": -18, SAFE: 6, SINGLE: 3}


def semantic_score(text: Column, names: Column, brand: Column, subtype: Column, status: Column) -> Column:
    """How well a product (the array of its names, its brand, subtype and normalised status) fits a
    search text: its brand, its kind, each further word of the text that a name has, and a safe
    comparison; of the brand finish that is asked for with power, its line as well."""

    def told(tokens: Column) -> Column:
        asked = F.get(F.filter(tokens, lambda t: t.isin(CLEANING_BRANDS)), F.lit(0))
        has = F.split(F.array_join(F.transform(F.filter(names, lambda n: n.isNotNull()), normalize_text), " "), " ")
        words_ = F.array_distinct(F.filter(tokens, lambda t: ~t.eqNullSafe(asked) & ~t.isin(PLAIN_WORDS) & ~t.rlike("^[0-9]+$")))
        gain = lambda k, when: F.when(F.coalesce(when, F.lit(False)), GAIN[k]).otherwise(0)
        power = F.coalesce(asked == "finish", F.lit(False)) & F.array_contains(words_, "power")
        line = F.arrays_overlap(has, F.array(*map(F.lit, POWER_WORDS)))
        return gain("brand", brand == asked) + gain("subtype", subtype == asked_subtype(tokens)) + GAIN["word"] * F.size(F.array_intersect(words_, has)) + gain("power", power & line) + gain("no_power", power & ~line) + gain(SAFE, status == SAFE) + gain(SINGLE, status == SINGLE)

    return _let(cleaning_tokens(text), told)


def specific_listing(offers: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """All offers of each of keys in order of their semantic score for its text, then as in a
    category; score, place and whether it is the cheapest to show are added."""
    names = F.array("standardized_product_name") if "product_names" not in offers.columns else F.concat(F.array("standardized_product_name"), F.coalesce("product_names", F.array().cast("array<string>")))
    scored = offers.withColumn("score", semantic_score(F.col(text), names, F.col("brand"), F.col("subtype"), F.col("normalized_status")))
    decided = decision_price(F.col("normalized_status"), F.col("best_unit_price"))
    order = W.partitionBy(*keys).orderBy(F.desc("score"), decided.asc_nulls_last(), F.asc_nulls_last("best_unit_price"), F.asc_nulls_last("best_price"), F.lower("standardized_product_name"), "standardized_product_name")
    return scored.withColumn("place", F.row_number().over(order)).withColumn("is_cheapest", F.col("place") == 1)


def best_row_per_group(offers: DataFrame, group: list[str]) -> DataFrame:
    """The first offer of each group by status, decision price, price and name."""
    decided = decision_price(F.col("normalized_status"), F.col("best_unit_price"))
    order = W.partitionBy(*group).orderBy(_priority(F.col("normalized_status")), decided.asc_nulls_last(), F.asc_nulls_last("best_price"), "standardized_product_name")
    return offers.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def search_mode(text: Column) -> Column:
    """brand for a lone cleaning brand, category for a kind of cleaning product without brand,
    size, number or variant, else specific."""
    tokens, p = cleaning_tokens(text), cleaning_profile(text)
    has_brand = F.exists(tokens, lambda t: t.isin(CLEANING_BRANDS))
    detail = p["bundle"].isNotNull() | p["variant"].isNotNull() | F.exists(tokens, lambda t: t.rlike(r"^[0-9]+(?:[.,][0-9]+)?(?:ml|l|kg|g|gr)?$"))
    return F.when(has_brand & (F.size(tokens) == 1), "brand").when(~has_brand & ~detail & p["subtype"].isNotNull(), "category").otherwise("specific")

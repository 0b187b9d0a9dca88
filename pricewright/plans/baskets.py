"""Baskets over a table of them: the cheapest source of each item and of the whole.

items: (basket_id, item_no, product); offers: (product, source_name, price, safe)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text, standardize_name
from ..operators.rows import first_per_key
from ..shared import shared_folder
from ..sources.bindings import SOURCES
from .pairs import REVIEW

FAMILY = "product_family"
#: More than an array has places.
PLACES = 2**32


def normalize_requests(baskets: DataFrame) -> DataFrame:
    """Items with a product, each product of a basket once, at its first place."""
    named = baskets.where(F.col("product").isNotNull() & (F.trim("product") != ""))
    return named.groupBy("basket_id", "product").agg(F.min("item_no").alias("item_no")).select("basket_id", "item_no", "product")


def candidate_names(text: Column) -> Column:
    """A text's standardised and its normalised name."""
    return F.array(F.coalesce(standardize_name(text), F.lit("")), normalize_text(text))


def with_candidate_names(rows: DataFrame, text: str, name: str = "names") -> DataFrame:
    """rows with the candidate names of a text, which are computed once for each text, in the shared
    folder, and joined back."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "texts")
    told = rows.select(F.col(text).alias("_text")).distinct().select("_text", candidate_names(F.col("_text")).alias(name))
    told.write.parquet(folder)
    told = spark.read.schema(told.schema).parquet(folder)
    return rows.join(told, F.col(text).eqNullSafe(F.col("_text"))).drop("_text")


def candidate_requests(requests: DataFrame) -> DataFrame:
    """Requests as they are asked (basket_id, item_no, selection_type, text, family_id,
    family_label, options, force_review) with their candidates: of a family its options, else the
    text, each as its standardised and its normalised name, in order and once. A family without
    an id is named by its candidates; requests without candidates, and those of a basket that
    repeat an earlier family or the same candidates, are left out. The names may be there
    before (names, an array for each option, else for the text)."""
    family = F.col("selection_type") == FAMILY
    asked = F.when(family, F.coalesce("options", F.array().cast("array<string>"))).otherwise(F.array("text"))
    names = F.flatten("names" if "names" in requests.columns else F.transform(asked, candidate_names))
    told = requests.withColumn("candidates", F.array_distinct(F.filter(names, lambda n: n != ""))).where(F.size("candidates") > 0)
    named = F.coalesce(F.nullif("family_id", F.lit("")), F.array_join("candidates", "|"))
    told = told.select(
        "basket_id", "item_no", F.when(family, FAMILY).otherwise("product").alias("selection_type"), "candidates", F.when(family, named).alias("family_id"),
        F.when(family, F.coalesce(F.nullif("family_label", F.lit("")), named)).alias("family_label"), (family & F.coalesce("force_review", F.lit(False))).alias("force_review"),
    )
    key = F.when(F.col("selection_type") == FAMILY, F.col("family_id")).otherwise(F.array_join("candidates", "\x00"))
    return first_per_key(told.withColumn("_key", key), ["basket_id", "selection_type", "_key"], [F.col("item_no")]).drop("_key")


def selectable_price(sources: list[str] = SOURCES) -> Column:
    """(price, source) of a price row's cheapest source, then by name; null if the row needs a
    review or has no price."""
    offers = F.filter(F.array(*[F.struct(F.col(f"{s}_price").cast("double").alias("price"), F.lit(s).alias("source_name")) for s in sources]), lambda o: o["price"].isNotNull())
    return F.when(F.coalesce(F.col("coverage_status") != REVIEW, F.lit(True)), F.array_min(offers))


def choose_candidates(requests: DataFrame, rows: DataFrame, name: str = "standardized_product_name", sources: list[str] = SOURCES) -> DataFrame:
    """Each request of ``candidate_requests`` with the candidate that it gets among price rows (one a
    name): a product the one that compares safely, else needs a review, else has a price, else is
    there at all, the first of equals; a family the same among those with a price that may be
    chosen, else its first that is there; else none (unavailable). A family that is to be
    reviewed has no price whatever was chosen."""
    both = F.lit(True)
    for s in sources:
        both = both & F.col(f"{s}_price").isNotNull()
    soft = F.coalesce(F.col("soft_equivalent_match"), F.lit(False)) if "soft_equivalent_match" in rows.columns else F.lit(False)
    safe = F.coalesce(both & F.col("same_unit_flag") & (F.col("same_quantity_flag") | soft) & (F.col("comparison_confidence") == "high"), F.lit(False))
    review = F.coalesce(F.col("coverage_status") == REVIEW, F.lit(False))
    offer = selectable_price(sources)
    reason = F.col("comparison_review_reason") if "comparison_review_reason" in rows.columns else F.lit(None).cast("string")
    priced = rows.select(F.col(name).alias("selected"), offer.alias("offer"), F.when(safe, 0).when(review, 1).when(offer.isNotNull(), 2).otherwise(3).alias("rank"), review.alias("review"), reason.alias("reason"))
    met = requests.select("basket_id", "item_no", "selection_type", F.posexplode("candidates").alias("place", "selected")).join(priced, "selected")
    # of a family, rows without a price come after all others, by place alone; a rank and a place are
    # one number, whose minimum needs no rows in order
    without = (F.col("selection_type") == FAMILY) & F.col("offer").isNull()
    order = F.when(without, F.lit(4)).otherwise(F.col("rank")).cast("long") * PLACES + F.col("place")
    best = met.groupBy("basket_id", "item_no").agg(F.min(order).alias("_best"))
    chosen = requests.join(best, ["basket_id", "item_no"], "left").withColumns({"_selected": F.get("candidates", (F.col("_best") % PLACES).cast("int")), "_rank": F.expr(f"_best div {PLACES}").cast("int")})
    # one row for each name and rank that it may be chosen by
    ranks = F.array_compact(F.array("rank", F.when(F.col("offer").isNull(), 4)))
    told = priced.select(F.col("selected").alias("_selected"), F.explode(ranks).alias("_rank"), F.struct("selected", "offer", "review", "reason").alias("m")).groupBy("_selected", "_rank").agg(F.min("m").alias("m"))
    forced = F.col("force_review")
    status = F.when(F.col("m").isNull(), "unavailable").when(forced | F.col("m.review"), REVIEW).when(F.col("m.offer").isNull(), "no_valid_price").otherwise("ok")
    first = F.when(F.col("selection_type") != FAMILY, F.get("candidates", F.lit(0)))
    return chosen.join(told, ["_selected", "_rank"], "left").select(
        "basket_id", "item_no", "selection_type", "family_id", "family_label", F.when(F.col("selection_type") == FAMILY, F.size("candidates")).alias("family_option_count"), F.coalesce("m.selected", first).alias("product"), status.alias("status"),
        F.when(status == "ok", F.col("m.offer.source_name")).alias("source_name"), F.when(status == "ok", F.col("m.offer.price")).alias("price"),
        F.when(forced & F.col("m").isNotNull(), F.coalesce("m.reason", F.lit("subtype_selection_required"))).otherwise(F.col("m.reason")).alias("review_reason"),
    )


def offers_of(comparison: DataFrame, product: str, sources: list[str]) -> DataFrame:
    """A comparison's prices as rows, with whether they compare safely."""
    safe = F.coalesce(F.col("same_unit_flag") & F.col("same_quantity_flag"), F.lit(False))
    prices = F.array(*[F.struct(F.lit(s).alias("source_name"), F.col(f"{s}_price").alias("price")) for s in sources])
    rows = comparison.select(F.col(product).alias("product"), safe.alias("safe"), F.explode(prices).alias("p"))
    return rows.where("p.price is not null").select("product", "p.source_name", "p.price", "safe")


def recommendations(items: DataFrame, offers: DataFrame) -> DataFrame:
    """Each item with its cheapest source (then by name), unless its prices need a review."""
    best = offers.groupBy("product").agg(F.min(F.struct("price", "source_name")).alias("b"), F.bool_and("safe").alias("safe"), F.count(F.lit(1)).alias("n_offers"))
    status = F.when(F.col("n_offers").isNull(), "no_valid_price").when((F.col("n_offers") > 1) & ~F.col("safe"), "comparison_review_required").otherwise("ok")
    met = items.join(best, "product", "left").withColumn("status", status)
    ok = F.col("status") == "ok"
    return met.select("basket_id", "item_no", "product", "status", F.when(ok, F.col("b.source_name")).alias("source_name"), F.when(ok, F.col("b.price")).alias("price"))


def mixed_baskets(recommended: DataFrame) -> DataFrame:
    """Each basket bought where each item is cheapest."""
    ok = F.col("status") == "ok"
    return recommended.groupBy("basket_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(ok).alias("n_priced"), F.sum("price").cast("double").alias("mixed_total"), F.bool_and(ok).alias("complete")
    )


def single_source_baskets(items: DataFrame, offers: DataFrame) -> DataFrame:
    """(basket_id, source_name, total) of sources that have every item of a basket."""
    sizes = items.groupBy("basket_id").agg(F.count(F.lit(1)).alias("n_items"))
    have = items.join(offers, "product").groupBy("basket_id", "source_name").agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("double").alias("total"))
    return have.join(sizes, "basket_id").where("n = n_items").select("basket_id", "source_name", "total", "n_items")


def savings(mixed: DataFrame, single: DataFrame) -> DataFrame:
    """Cheapest single source against the mixed basket; null without either."""
    best = single.groupBy("basket_id").agg(F.min(F.struct("total", "source_name")).alias("b"), F.max("total").alias("dearest"))
    return mixed.join(best, "basket_id", "left").select(
        "basket_id", "mixed_total", "complete", F.col("b.source_name").alias("single_source"), F.col("b.total").alias("single_total"),
        F.when(F.col("complete"), F.round(F.col("b.total") - F.col("mixed_total"), 2)).alias("savings"), F.round(F.col("dearest") - F.col("b.total"), 2).alias("advantage"),
    )


def shopping_list(recommended: DataFrame) -> DataFrame:
    """What to buy where, by source and item."""
    return recommended.where("status = 'ok'").select("basket_id", "source_name", "item_no", "product", "price").orderBy("basket_id", "source_name", "item_no")


def _selected(prices: DataFrame) -> DataFrame:
    """prices with selected_price: the price of a unit, else the price."""
    return prices.withColumn("selected_price", F.coalesce("price_per_unit", "price"))


def id_items(items: DataFrame, latest: DataFrame) -> DataFrame:
    """Items by product_id, each with its cheapest source (then by name) among the latest prices
    (product_id, source_name, price, price_per_unit). Repeated items are bought as often."""
    offer = F.struct("selected_price", "source_name", "price", "price_per_unit")
    best = _selected(latest).groupBy("product_id").agg(F.min(F.when(F.col("selected_price").isNotNull(), offer)).alias("b"), F.lit(True).alias("found"))
    met = items.select("basket_id", "item_no", "product_id").join(best, "product_id", "left")
    status = F.when(F.col("found").isNull(), "no_prices_found").when(F.col("b").isNull(), "no_valid_price").otherwise("ok")
    return met.select("basket_id", "item_no", "product_id", status.alias("status"), "b.source_name", "b.price", "b.price_per_unit", "b.selected_price")


def id_single_source(items: DataFrame, latest: DataFrame) -> DataFrame:
    """(basket_id, source_name, total, n_items) of sources that sell every item of a basket."""
    each = _selected(latest).where("selected_price is not null").groupBy("product_id", "source_name").agg(F.min("selected_price").alias("price"))
    sizes = items.groupBy("basket_id").agg(F.count(F.lit(1)).alias("n_items"))
    have = items.join(each, "product_id").groupBy("basket_id", "source_name").agg(F.count(F.lit(1)).alias("n"), F.sum("price").cast("double").alias("total"))
    return have.join(sizes, "basket_id").where("n = n_items").select("basket_id", "source_name", "total", "n_items")


def id_split(bought: DataFrame) -> DataFrame:
    """Each basket of id_items bought where each item is cheapest; 0 if nothing has a price."""
    return bought.groupBy("basket_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("status") == "ok").alias("n_priced"), F.coalesce(F.sum("selected_price").cast("double"), F.lit(0.0)).alias("total")
    )

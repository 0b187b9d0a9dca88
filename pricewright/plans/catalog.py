"""The public catalog: products of all sources grouped by canonical name and size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions.labels import advantage, pack_total, shown_unit
from ..functions.prices import cheaper_source
from ..functions.profiles import brand_line, cleaning_profile, paper_profile
from ..functions.text import base_name, extra_words, normalize_text, penalty, words
from ..operators.rows import first_per_key, latest_per_key, null_safe_join, pivot_sources
from ..sources.bindings import SOURCES, TIE
from .search import holding

_MEASURES = ["price", "comparison_price", "source_product_name", "normalized_unit", "normalized_quantity"]


def latest_sources(history: DataFrame, ties: list[str] = TIE) -> DataFrame:
    """The latest row of each source and source product, with the measure to compare by and the
    group that it belongs to (canonical_search_name, grouping_unit, grouping_quantity)."""
    kept = ["source_name", "source_product_name", "standardized_product_name", "price", "normalized_unit", "normalized_quantity", "observed_at"]
    rows = history.where("price is not null and standardized_product_name is not null").select(*dict.fromkeys([*kept, *ties]))
    latest = latest_per_key(rows, ["source_name", "source_product_name"], "observed_at", ties)
    name, raw = F.col("standardized_product_name"), F.col("source_product_name")
    called = C.canonical_search_name(name, raw, F.col("normalized_unit"), F.col("normalized_quantity"))
    told = latest.withColumn("canonical_search_name", called).withColumn("_m", C.comparison_measure(name, raw, F.col("normalized_unit"), F.col("normalized_quantity")))
    unit, quantity = F.col("_m.unit"), F.col("_m.quantity")
    told = told.withColumn("_g", C.grouping_measure(F.col("canonical_search_name"), name, unit, quantity))
    return told.select(
        *[c for c in latest.columns if c not in ("normalized_unit", "normalized_quantity")], "canonical_search_name", unit.alias("normalized_unit"), quantity.alias("normalized_quantity"),
        F.col("_g.unit").alias("grouping_unit"), F.col("_g.quantity").alias("grouping_quantity"), C.comparison_price(F.col("price"), unit, quantity).alias("comparison_price"),
    )


GROUP = ["canonical_search_name", "grouping_unit", "grouping_quantity"]


def display_names(latest: DataFrame) -> DataFrame:
    """(group, display_name): with its size where the kind is told apart by size, the canonical
    name where the group has several products, else its product's own."""
    sized = C.sized_name(F.col("canonical_search_name"), F.col("grouping_unit"), F.col("grouping_quantity"))
    groups = latest.groupBy(*GROUP).agg(F.min("standardized_product_name").alias("_lo"), F.max("standardized_product_name").alias("_hi"))
    return groups.select(*GROUP, F.coalesce(sized, F.when(F.col("_lo") != F.col("_hi"), F.col("canonical_search_name")).otherwise(F.col("_hi"))).alias("display_name"))


def grouped(history: DataFrame, variants: list[str], ties: list[str] = TIE) -> DataFrame:
    """Of each display name and source the row that stands for it, as in ``cross_compare``."""
    latest = latest_sources(history, ties)
    named = null_safe_join(latest, display_names(latest), GROUP)
    raw, name = F.col("source_product_name"), F.col("standardized_product_name")
    order = [F.when(base_name(raw) == F.col("display_name"), 0).otherwise(1), penalty(raw, F.col("canonical_search_name"), variants), extra_words(raw, name), F.size(words(raw)), F.desc("observed_at"), *[F.desc(c) for c in ties]]
    return first_per_key(named, ["display_name", "source_name"], order)


def _same(column: str, sources: list[str]) -> Column:
    a, b = (F.col(f"{s}_{column}") for s in sources[:2])
    return F.coalesce(a == b, F.lit(False))


def build_catalog(history: DataFrame, variants: list[str] = (), sources: list[str] = SOURCES, ties: list[str] = TIE) -> DataFrame:
    """One row a display name (standardized_product_name): source_count, available_sources, of
    each source its name, measure, price and comparison price; comparison_price_unit, the two
    flags, comparison_confidence and coverage_status. Toilet paper of one brand is comparable
    only if its product lines are known and equal."""
    chosen = grouped(history, list(variants), ties).withColumn("standardized_product_name", F.col("display_name"))
    wide = pivot_sources(chosen, ["standardized_product_name"], _MEASURES, sources)
    a, b = sources[:2]
    both = F.col("n_sources") == len(sources)
    mushrooms = (F.col("standardized_product_name") == "mantar") & (F.col(f"{a}_normalized_unit") == "kg") & (F.col(f"{b}_normalized_unit") == "kg")
    known = F.col(f"{a}_normalized_quantity").isNotNull() & F.col(f"{b}_normalized_quantity").isNotNull()
    flagged = wide.withColumns({
        "same_unit_flag": both & _same("normalized_unit", sources),
        "same_quantity_flag": both & known & (_same("normalized_quantity", sources) | F.coalesce(mushrooms, F.lit(False))),
        "_a": brand_line(F.col(f"{a}_source_product_name")), "_b": brand_line(F.col(f"{b}_source_product_name")),
    })
    flags = F.col("same_unit_flag") & F.col("same_quantity_flag")
    paper = F.coalesce(F.col("_a.is_toilet_paper") & F.col("_b.is_toilet_paper"), F.lit(False))
    brand = F.coalesce(F.col("_a.brand") == F.col("_b.brand"), F.lit(False))
    line = F.coalesce(F.col("_a.line") == F.col("_b.line"), F.lit(False))
    unknown = F.col("_a.line").isNull() & F.col("_b.line").isNull()
    confidence = F.when(F.col("n_sources") < 2, "single_source").when(flags & paper & brand & unknown, "medium").when(flags, "high").when(F.col("same_unit_flag"), "medium").otherwise("low")
    status = (
        F.when(F.col("n_sources") == 1, F.concat(F.lit("only_"), F.col("available_sources")))
        .when(flags & (~paper | (brand & line)), "comparable")
        .when(F.col("n_sources") > 1, "comparison_review_required")
        .otherwise("unavailable")
    )
    differing = _same("normalized_unit", sources) & known
    return flagged.select(
        "standardized_product_name", F.col("n_sources").alias("source_count"), "available_sources",
        *[F.col(f"{s}_{c}").alias(f"{s}_raw_price" if c == "price" else f"{s}_{c}") for c in _MEASURES for s in sources],
        F.when(both & (flags | differing), F.col(f"{a}_normalized_unit")).alias("comparison_price_unit"),
        "same_unit_flag", "same_quantity_flag", confidence.alias("comparison_confidence"), status.alias("coverage_status"),
    )


def latest_prices(history: DataFrame, names: DataFrame, variants: list[str] = (), sources: list[str] = SOURCES, ties: list[str] = TIE) -> DataFrame:
    """The catalog's rows for a table of names (name), prices as {source}_price, and the rows
    that the names' cleaning brands and paper towels add."""
    catalog = build_catalog(history, variants, sources, ties)
    rows = catalog.join(names.select(F.col("name").alias("standardized_product_name")).distinct(), "standardized_product_name", "left_semi")
    rows = rows.drop(*[f"{s}_comparison_price" for s in sources], "comparison_price_unit").withColumnsRenamed({f"{s}_raw_price": f"{s}_price" for s in sources})
    rows = rows.withColumn("cheaper_source", cheaper_source({s: F.col(f"{s}_price") for s in sources}))
    return rows.unionByName(supplement_rows(history, names, sources, ties), allowMissingColumns=True)


def supplement_rows(history: DataFrame, names: DataFrame, sources: list[str] = SOURCES, ties: list[str] = TIE) -> DataFrame:
    """Each latest source product, as a row of one source, whose name has the brand of an asked
    cleaning product as a part, or is a paper towel if one is asked for."""
    asked = names.select(cleaning_profile(F.col("name")).alias("p"), (paper_profile(F.col("name"))["kind"] == "paper_towel").alias("towel"))
    # brands are few known words or first words of the asked names; both sides are gathered by name
    brands = asked.where("p.is_cleaning and p.brand is not null").select(F.col("p.brand").alias("brand")).distinct()
    towels = asked.agg(F.coalesce(F.bool_or("towel"), F.lit(False)).alias("towels"))
    kept = ["source_name", "source_product_name", "price", "normalized_unit", "normalized_quantity", "observed_at"]
    latest = latest_per_key(history.where("price is not null").select(*dict.fromkeys([*kept, *ties])), ["source_name", "source_product_name"], "observed_at", ties)
    raw = F.lower("source_product_name")
    # a brand is a part of a word of the name: words and brands meet under pieces that both hold
    tokens = latest.select("source_name", "source_product_name", F.explode(F.array_distinct(words(raw))).alias("word"))
    spoken = tokens.select(F.col("word").alias("product"), F.col("word").alias("name")).distinct()
    vocabulary = holding(spoken, brands.select(F.col("brand").alias("query_id"), F.col("brand").alias("variant"))).select(F.col("product").alias("word")).distinct()
    branded = tokens.join(vocabulary, "word", "left_semi").select("source_name", "source_product_name").distinct()
    towel = raw.contains("havlu") & ~raw.rlike("tuvalet|mendil|pecete|islak")
    of_towels = latest.where(towel).join(F.broadcast(towels)).where("towels").select("source_name", "source_product_name")
    wanted = latest.join(branded.union(of_towels).distinct(), ["source_name", "source_product_name"], "left_semi")
    here = lambda s, c: F.when(F.col("source_name") == s, F.col(c))
    return wanted.select(
        normalize_text(F.col("source_product_name")).alias("standardized_product_name"), F.lit(1).cast("long").alias("source_count"), F.col("source_name").alias("available_sources"),
        *[here(s, c).alias(f"{s}_{c}") for c in ("source_product_name", "normalized_unit", "price") for s in sources],
        *[here(s, "normalized_quantity").cast("double").alias(f"{s}_normalized_quantity") for s in sources],
        F.col("source_name").alias("cheaper_source"), F.lit(False).alias("same_unit_flag"), F.lit(False).alias("same_quantity_flag"), F.lit("single_source").alias("comparison_confidence"),
    )


def safety_list(compared: DataFrame, sources: list[str] = SOURCES) -> DataFrame:
    """Compared products with their confidence, safe ones first; pairs of toilet paper are never
    rated high by their measures alone."""
    a, b = (brand_line(F.col(f"{s}_source_product_name"))["is_toilet_paper"] for s in sources[:2])
    safe = F.col("same_unit_flag") & F.col("same_quantity_flag")
    confidence = F.when(safe & ~F.coalesce(a & b, F.lit(False)), "high").when(F.col("same_unit_flag"), "medium").otherwise("low")
    return compared.withColumn("comparison_confidence", confidence).orderBy(F.when(safe, 0).otherwise(1), "standardized_product_name")


def display_prices(recommended: DataFrame, catalog: DataFrame, sources: list[str] = SOURCES) -> DataFrame:
    """Recommendations (standardized_product_name, {source}_price, recommended_source,
    recommended_price, force_review) with the prices to show: by unit where both sources have
    one unit, or one source has a price only, else the shelf prices; the cheaper of what is shown
    is recommended, and what it saves is the advantage."""
    a, b = sources[:2]
    met = recommended.join(catalog.select("standardized_product_name", "comparison_price_unit", *[F.col(f"{s}_{c}").alias(f"_{s}_{c}") for s in sources for c in ("raw_price", "comparison_price", "normalized_unit", "normalized_quantity", "source_product_name")], F.lit(True).alias("_known")), "standardized_product_name", "left")
    out = met
    for s in sources:
        pack = pack_total(F.col(f"_{s}_source_product_name"), F.col(f"_{s}_normalized_unit"), F.col(f"_{s}_normalized_quantity"))
        shelf = F.coalesce(F.col(f"{s}_price").cast("double"), F.col(f"_{s}_raw_price").cast("double"))
        out = out.withColumn(f"_{s}_pack", pack).withColumn(f"{s}_shelf_price", shelf)
        by_unit = F.when(F.col(f"_{s}_pack.quantity") > 0, F.col(f"{s}_shelf_price") / F.col(f"_{s}_pack.quantity"))
        unit = shown_unit(F.col(f"_{s}_pack.unit"))
        derived = by_unit.isNotNull() & unit.isNotNull()
        fallback = F.col(f"_{s}_comparison_price").isNotNull() & F.col("comparison_price_unit").isNotNull()
        out = out.withColumn(f"_{s}_shown", F.when(derived, by_unit).when(fallback, F.col(f"_{s}_comparison_price").cast("double"))).withColumn(f"_{s}_unit", F.when(derived, unit).when(fallback, shown_unit(F.col("comparison_price_unit"))))
    ua, ub = F.col(f"_{a}_unit"), F.col(f"_{b}_unit")
    unit = F.when(ua == ub, ua).when(ua.isNotNull() & F.col(f"{b}_shelf_price").isNull(), ua).when(ub.isNotNull() & F.col(f"{a}_shelf_price").isNull(), ub)
    usable = F.coalesce(F.col("_known"), F.lit(False)) & ~F.coalesce(F.col("force_review"), F.lit(False))
    out = out.withColumn("price_display_unit", F.when(usable, unit))
    used = F.col("price_display_unit").isNotNull()
    for s in sources:
        shown = F.when(used & (F.col(f"_{s}_unit") == F.col("price_display_unit")), F.col(f"_{s}_shown"))
        out = out.withColumn(f"{s}_display_price", F.coalesce(shown, F.col(f"{s}_price").cast("double")))
    cheaper = cheaper_source({s: F.col(f"{s}_display_price") for s in sources})
    out = out.withColumn("uses_normalized_price", used).withColumn("display_recommended_source", F.when(used, cheaper).otherwise(F.col("recommended_source")))
    price = F.when(F.col("display_recommended_source") == b, F.col(f"{b}_display_price")).otherwise(F.col(f"{a}_display_price"))
    out = out.withColumn("display_recommended_price", F.when(used, price).otherwise(F.col("recommended_price").cast("double")))
    out = out.withColumn("advantage", advantage(F.col(f"{a}_display_price"), F.col(f"{b}_display_price"), F.col("display_recommended_source")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])

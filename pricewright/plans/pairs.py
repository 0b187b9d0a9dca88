"""Rules that rate a pair of paper or cleaning products, and the blocks under which rows pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profiles import brand_line, cleaning_profile, paper_profile
from ..sources.bindings import SOURCES

REVIEW, COMPARABLE = "comparison_review_required", "comparable"


def _rated(confidence: str, reason: str | None) -> Column:
    return F.struct(F.lit(confidence).alias("confidence"), F.lit(reason).cast("string").alias("reason"))


def _with(rows: DataFrame, verdict: Column) -> DataFrame:
    """rows with the verdict's confidence, reason and status; those without a verdict as they were."""
    old = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    has = F.col("_v").isNotNull()
    status = F.when(F.col("_v.confidence") == "high", COMPARABLE).otherwise(REVIEW)
    return rows.withColumn("_v", verdict).withColumns({
        "comparison_confidence": F.when(has, F.col("_v.confidence")).otherwise(old("comparison_confidence")),
        "comparison_review_reason": F.when(has, F.col("_v.reason")).otherwise(old("comparison_review_reason")),
        "coverage_status": F.when(has, status).otherwise(old("coverage_status")),
    }).drop("_v")


def _flags() -> Column:
    return F.coalesce(F.col("same_unit_flag") & F.col("same_quantity_flag"), F.lit(False))


def _priced(sources: list[str]) -> Column:
    return F.col(f"{sources[0]}_price").isNotNull() & F.col(f"{sources[1]}_price").isNotNull()


def apply_paper_rules(rows: DataFrame, sources: list[str] = SOURCES) -> DataFrame:
    """Pairs of paper towels, else of toilet paper, that both have a price and equal measures:
    another brand is low, equal product lines are high, other or unknown ones medium."""
    names = [F.col(f"{s}_source_product_name") for s in sources[:2]]
    made = rows.withColumns({"_p": paper_profile(names[0]), "_q": paper_profile(names[1]), "_x": brand_line(names[0]), "_y": brand_line(names[1])})

    def verdict(brand: Column, both: Column, same: Column) -> Column:
        return F.when(~F.coalesce(brand, F.lit(False)), _rated("low", "brand_mismatch")).when(both & same, _rated("high", None)).when(both, _rated("medium", "product_line_mismatch")).otherwise(_rated("medium", "product_line_unknown"))

    towels = verdict(F.col("_p.brand") == F.col("_q.brand"), (F.size("_p.lines") > 0) & (F.size("_q.lines") > 0), F.col("_p.lines") == F.col("_q.lines"))
    rolls = verdict(F.col("_x.brand") == F.col("_y.brand"), F.col("_x.line").isNotNull() & F.col("_y.line").isNotNull(), F.col("_x.line") == F.col("_y.line"))
    is_towel = F.coalesce((F.col("_p.kind") == "paper_towel") & (F.col("_q.kind") == "paper_towel"), F.lit(False))
    is_paper = F.coalesce(F.col("_x.is_toilet_paper") & F.col("_y.is_toilet_paper"), F.lit(False))
    fit = _priced(sources) & _flags()
    return _with(made, F.when(fit & is_towel, towels).when(fit & is_paper, rolls)).drop("_p", "_q", "_x", "_y")


def apply_cleaning_rules(rows: DataFrame, sources: list[str] = SOURCES, tolerance: float = 0.2) -> DataFrame:
    """Pairs with a cleaning product that both have a price. Dish soap of one brand in litres, of
    ordinary packs, one or no known variant and within tolerance is high (soft_equivalent_match);
    of the rest with equal measures, the first of brand, subtype, variant and package that
    differs lowers it, and nothing makes it high."""
    a, b = sources[:2]
    made = rows.withColumns({"_p": cleaning_profile(F.col(f"{a}_source_product_name")), "_q": cleaning_profile(F.col(f"{b}_source_product_name"))})
    same = lambda c: F.coalesce(F.col(f"_p.{c}") == F.col(f"_q.{c}"), F.lit(False))
    known = lambda c: F.col(f"_p.{c}").isNotNull() & F.col(f"_q.{c}").isNotNull()
    q, r = (F.col(f"{s}_normalized_quantity").cast("double") for s in (a, b))
    near = F.coalesce((q > 0) & (r > 0) & (F.abs(q - r) / F.greatest(q, r) <= tolerance), F.lit(False))
    ordinary = lambda p: F.coalesce(F.col(f"{p}.format"), F.lit("standard_single_pack")) == "standard_single_pack"
    litres = F.coalesce((F.col(f"{a}_normalized_unit") == "liter") & (F.col(f"{b}_normalized_unit") == "liter"), F.lit(False))
    soft = same("brand") & same("subtype") & F.coalesce(F.col("_p.subtype") == "dishwashing_liquid", F.lit(False)) & litres & (same("variant") | ~known("variant")) & ordinary("_p") & ordinary("_q") & near
    told = (
        F.when(~same("brand"), _rated("low", "brand_mismatch"))
        .when(~same("subtype"), F.when(known("subtype"), _rated("medium", "subtype_mismatch")).otherwise(_rated("medium", "subtype_unknown")))
        .when(known("variant") & ~same("variant"), _rated("medium", "variant_mismatch"))
        .when(known("format") & ~same("format"), _rated("medium", "package_format_mismatch"))
        .otherwise(_rated("high", None))
    )
    cleaning = _priced(sources) & F.coalesce(F.col("_p.is_cleaning") | F.col("_q.is_cleaning"), F.lit(False))
    out = _with(made.withColumn("_soft", cleaning & soft), F.when(cleaning & soft, _rated("high", None)).when(cleaning & _flags(), told))
    return out.withColumnRenamed("_soft", "soft_equivalent_match").drop("_p", "_q")


def blocked_pairs(left: DataFrame, right: DataFrame, block: list[str], residual: Column) -> DataFrame:
    """Pairs of rows that agree in block and fit residual, a condition on left.* and right.*."""
    on = residual
    for c in block:
        on = (F.col(f"left.{c}") == F.col(f"right.{c}")) & on
    return left.alias("left").join(right.alias("right"), on)


def replace_then_append(base: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """base without the keys that new has, and new, in order."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True).orderBy(*order)

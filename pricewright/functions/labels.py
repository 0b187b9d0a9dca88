"""Measures and prices as they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units and how they are shown; states of a comparison and how they are shown.
SHOWN_UNITS = {"liter": "litre", "litre": "litre", "kg": "kg", "piece": "adet", "roll": "rulo"}
STATUS_LABELS = {"safe": "Güvenli karşılaştırma", "unit_mismatch": "Ölçü uyumsuz", "quantity_mismatch": "Kontrol gerekli", "review": "Kontrol gerekli", "single_source": "Tek markette var"}
PACKAGE_HINTS = "paket|file|tabak"


def unit_label(unit: Column, currency: str = "TRY") -> Column:
    return F.concat(F.lit(f"{currency}/"), unit)


def number_text(q: Column, digits: int = 3) -> Column:
    """Up to so many decimals, without zeros at their end."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", q.cast("double")), r"\.?0+$", "")


def measure_label(quantity: Column, unit: Column, name: Column) -> Column:
    """A quantity in words: grams below a kilogram, pieces, rolls, litres; '-' without either."""
    u, q = F.lower(F.trim(unit)), F.when(~F.isnan(quantity.cast("double")), quantity.cast("double"))
    pack = F.when(F.lower(F.coalesce(name, F.lit(""))).rlike(PACKAGE_HINTS), " paket").otherwise("")
    said = lambda n, word, *more: F.concat(number_text(n), F.lit(f" {word}"), *more)
    return (
        F.when(q.isNull() | F.coalesce(u.isin("", "nan", "none"), F.lit(True)), "-")
        .when((u == "kg") & (q < 1), said(q * 1000, "g", pack))
        .when(u.isin("g", "gram"), said(q, "g", pack))
        .when(u == "kg", said(q, "kg", pack))
        .when(u.isin("piece", "adet", "ad"), said(q, "adet"))
        .when(u == "roll", said(q, "rulo"))
        .when(u.isin("demet", "bunch"), said(q, "demet"))
        .when(u.isin("l", "lt", "liter", "litre"), said(q, "l"))
        .when(u == "ml", said(q, "ml"))
        .otherwise(F.concat(number_text(q), F.lit(" "), u))
    )


def is_safe(confidence: Column, same_unit: Column, same_quantity: Column) -> Column:
    return F.coalesce((confidence == "high") & same_unit & same_quantity, F.lit(False))


def status_label(confidence: Column, same_unit: Column, same_quantity: Column, force_review: Column | None = None) -> Column:
    """How a comparison stands, in words."""
    forced = F.coalesce(force_review, F.lit(False)) if force_review is not None else F.lit(False)
    return (
        F.when(confidence == "single_source", STATUS_LABELS["single_source"])
        .when(forced, STATUS_LABELS["review"])
        .when(is_safe(confidence, same_unit, same_quantity), STATUS_LABELS["safe"])
        .when(~same_unit, STATUS_LABELS["unit_mismatch"])
        .when(~same_quantity, STATUS_LABELS["quantity_mismatch"])
        .otherwise(STATUS_LABELS["review"])
    )


def mismatch_label(a: Column, b: Column, safe: Column, reason: Column) -> Column:
    """'A vs B (reason)' of two measure labels; null for safe pairs and where both are '-'."""
    why = F.coalesce(F.concat(F.lit(" ("), F.nullif(reason, F.lit("")), F.lit(")")), F.lit(""))
    return F.when(~safe & ~((a == "-") & (b == "-")), F.concat(a, F.lit(" vs "), b, why))


def pack_total(name: Column, unit: Column, quantity: Column) -> Column:
    """(unit, quantity) of what a pack holds in all: 'n x size unit' of its name where that is in
    the listed unit and more than listed, else as listed."""
    text = F.lower(F.coalesce(name, F.lit("")))
    pattern = r"\b([0-9]+)\s*x\s*([0-9]+(?:[.,][0-9]+)?)\s*(ml|l|kg|g)\b"
    part = lambda g: F.regexp_extract(text, pattern, g)
    total = F.nullif(part(1), F.lit("")).try_cast("double") * F.replace(F.nullif(part(2), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    total = F.when(part(3).isin("ml", "g"), total / 1000).otherwise(total)
    kind = F.when(part(3).isin("ml", "l"), "liter").when(part(3).isin("kg", "g"), "kg")
    q = quantity.cast("double")
    more = F.coalesce((kind == unit) & (q.isNull() | (total > q)), F.lit(False))
    return F.struct(unit.alias("unit"), F.when(more, total).otherwise(q).alias("quantity"))


def shown_unit(unit: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SHOWN_UNITS.items() for x in kv])[unit], unit)


def advantage(a: Column, b: Column, recommended: Column) -> Column:
    """What the cheaper of two shown prices saves; 0 below a hundredth, null without both prices
    or a recommendation."""
    apart = F.abs(a - b)
    return F.when(recommended.isNotNull(), F.when(apart < 0.01, 0.0).otherwise(apart))

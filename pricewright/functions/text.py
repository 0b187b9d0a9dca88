"""Names of products as column expressions: normalising, stripping measures, word keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package

# Turkish letters and typographic marks, and what they become.
LETTERS = "ığüşöç‘’`´–—"
PLAIN = "igusoc" + "'" * 4 + "--"
# Words of measure; produce, descriptors that do not tell it apart and another name;
# mushrooms, their kinds in the order in which they count, and what those are called.
UNIT_WORDS = ["kg", "g", "gram", "ml", "l", "lt", "adet", "demet", "paket"]
PRODUCE = ["biber", "domates", "elma", "hiyar", "muz", "patates", "salatalik", "sogan"]
DESCRIPTORS = ["adet", "dokme", "ithal", "kuru", "paket", "salkim", "taze", "yerli"]
PRODUCE_NAMES = {"hiyar": "salatalik"}
MUSHROOMS = ["mantar", "mantari"]
MUSHROOM_KINDS = {"istiridye": "istiridye mantar", "istridye": "istiridye mantar", "kestane": "kestane mantar", "shiitake": "shiitake mantar", "izgaralik": "izgaralik mantar"}

_NUMBER = r"[0-9]+(?:[.,][0-9]+)?"


def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """Characters up to U+024F, of U+1E00 to U+1EFF and the ligatures: their compatibility
    decomposition without marks, where it is one character and where it is more."""
    one, more = {}, {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if plain != chr(code):
            (one if len(plain) == 1 else more)[chr(code)] = plain
    return one, more


_ONE, _MORE = _decomposed()


def normalize_text(c: Column) -> Column:
    """Lower case, compatibility letters without marks, single spaces; null becomes ''. Covers
    Latin letters; see ``normalize_exact`` for other scripts."""
    c = F.translate(F.lower(F.coalesce(c, F.lit(""))), LETTERS + "".join(_ONE), PLAIN + "".join(_ONE.values()))
    some = c
    for mark, plain in _MORE.items():
        some = F.replace(some, F.lit(mark), F.lit(plain))
    c = F.when(c.rlike("[" + "".join(_MORE) + "]"), some).otherwise(c)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\p{M}", ""), r"[\s\x1c-\x1f\x85]+", " "))


def nfkd():
    """Compatibility decomposition without marks, on Arrow batches."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t and "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))

    return plain


def normalize_exact(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with out: ``normalize_text`` of column, and for the rows with letters beyond Latin ones
    of all their characters; only those rows leave the JVM."""
    ship_package(df.sparkSession)
    other = F.coalesce(F.col(column), F.lit("")).rlike(r"[^\x00-\u024F\u1E00-\u1EFF\u2013\u2014\u2018\u2019]")
    return df.where(~other).withColumn(out, normalize_text(F.col(column))).union(df.where(other).withColumn(out, normalize_text(nfkd()(F.lower(F.translate(column, LETTERS, PLAIN))))))


def strip_measures(c: Column) -> Column:
    """Without numbers with a unit, then without bare unit words."""
    units = "|".join(UNIT_WORDS)
    c = F.regexp_replace(c, rf"\b{_NUMBER}\s*(?:{units})\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"\b(?:{units})\b", " "), r"\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def canonicalize_name(c: Column) -> Column:
    """Normalised and without measures. Mushrooms are called by their kind, or mantar; produce
    loses its descriptors, and a lone word its other name. Null if nothing is left."""
    all_words = words(strip_measures(normalize_text(c)))
    fewer = F.filter(all_words, lambda w: ~w.isin(DESCRIPTORS))
    has = lambda listed: F.exists(all_words, lambda w: w.isin(listed))
    kind = F.lit("mantar")
    for word, name in reversed(MUSHROOM_KINDS.items()):
        kind = F.when(has([word]), name).otherwise(kind)
    alone = F.array_join(fewer, " ")
    for word, name in PRODUCE_NAMES.items():
        alone = F.when(alone == word, name).otherwise(alone)
    return F.nullif(F.when(has(MUSHROOMS), kind).when(has(PRODUCE), alone).otherwise(F.array_join(all_words, " ")), F.lit(""))


def standardize_name(c: Column) -> Column:
    """The words of the canonical name in order, as a key; null if none is left."""
    return F.nullif(F.array_join(F.array_sort(words(canonicalize_name(c))), " "), F.lit(""))


def base_name(c: Column) -> Column:
    """The sorted words of a raw name without numbers and units; the lower name if none is left."""
    kept = F.filter(words(F.lower(c)), lambda w: ~w.isin(UNIT_WORDS) & ~w.rlike(rf"^{_NUMBER}$"))
    return F.coalesce(F.nullif(F.array_join(F.array_sort(kept), " "), F.lit("")), F.lower(c))


def extra_words(raw: Column, canonical: Column) -> Column:
    """How many words of the raw name, numbers and units aside, the canonical name lacks."""
    kept = F.filter(words(F.lower(raw)), lambda w: ~w.isin(UNIT_WORDS) & ~w.rlike(rf"^{_NUMBER}$"))
    return F.size(F.array_except(kept, words(F.lower(F.coalesce(canonical, F.lit(""))))))


def penalty(raw: Column, canonical: Column, variants: list[str]) -> Column:
    """Words of the raw name that mark a variant and that the canonical name lacks."""
    known = words(F.lower(F.coalesce(canonical, F.lit(""))))
    return F.size(F.filter(F.array_distinct(words(F.lower(raw))), lambda w: w.isin(variants) & ~F.array_contains(known, w)))


def _number(c: Column, pattern: str, group: int = 1) -> Column:
    """The number in a group of the first match, a comma as its point; else null."""
    return F.replace(F.nullif(F.regexp_extract(c, pattern, group), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def weight_in(c: Column) -> Column:
    """Kilograms that the normalised name gives first, in kg or grams; else null."""
    name, pattern = normalize_text(c), r"([0-9]+(?:[.,][0-9]+)?)\s*(kg|gram|g)\b"
    n = _number(name, pattern)
    return F.when(F.regexp_extract(name, pattern, 2) == "kg", n).otherwise(F.round(n / 1000, 4))


# Units in captured names, in the order in which they count, as they are written.
CAPTURED_UNITS = [("KG", "kg|KG|Kg"), ("GRAM", "g|G|gr|GR"), ("LITER", "l|L|lt|LT"), ("ML", "ml|ML"), ("PIECE", "adet|Adet|ADET"), ("PIECE", "li|LI|'lu|'lü")]
_UNIT = "struct<unit:string,quantity:double>"


def unit_of(c: Column) -> Column:
    """(unit, quantity) that a captured name gives: the first kind of unit in order; else null."""
    out = F.lit(None).cast(_UNIT)
    for unit, written in reversed(CAPTURED_UNITS):
        pattern = rf"([0-9]+(?:[.,][0-9]+)?)\s*(?:{written})(?![\p{{L}}\p{{N}}_])"
        out = F.when(F.coalesce(c, F.lit("")).rlike(pattern), F.struct(F.lit(unit).alias("unit"), _number(c, pattern).alias("quantity"))).otherwise(out)
    return out


def api_unit(name: Column, code: Column, net_weight: Column) -> Column:
    """(unit, quantity) of a listing: by its name, else by its unit code: kilograms and pieces
    count one, grams their net weight, another code one of itself; null without either."""
    kind = F.nullif(F.upper(F.trim(F.coalesce(code, F.lit("")))), F.lit(""))
    row = lambda unit, quantity: F.struct(unit.alias("unit"), quantity.cast("double").alias("quantity"))
    of_code = (
        F.when(kind.isin("KG", "KGM"), row(F.lit("KG"), F.lit(1)))
        .when(kind.isin("G", "GR", "GRAM"), row(F.lit("GRAM"), net_weight))
        .when(kind.isin("AD", "ADET", "PIECE"), row(F.lit("PIECE"), F.lit(1)))
        .when(kind.isNotNull(), row(kind, F.lit(1)))
    )
    return F.coalesce(unit_of(name), of_code)


def repair_dotted_i(c: Column) -> Column:
    """An i that is followed by a separate dot above becomes one letter."""
    return F.replace(c, F.lit("i\u0307"), F.lit("i"))

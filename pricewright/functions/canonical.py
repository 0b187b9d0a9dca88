"""The name under which products of all sources are grouped, and the measure they compare by."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import number_text
from .prices import unit_price
from .text import words


class Rule(NamedTuple):
    """Names that hold all of has, one of each of any_of and none of lacks are called name. raw:
    parts of which the source's own name must hold one; equals: the names themselves."""

    name: str
    has: tuple[str, ...] = ()
    any_of: tuple[tuple[str, ...], ...] = ()
    lacks: tuple[str, ...] = ()
    raw: tuple[str, ...] = ()
    equals: tuple[str, ...] = ()
    pattern: str = ""
    measure: tuple[str, float] | None = None
    prefix: str = ""


# Parts of names, the names they lead to, in the order in which they count.
_NOT_DIET = ("zero", "sekersiz", "light", "diet", "sugar", "free", "lime", "lemon", "vanilla", "cherry")
_NOT_DISH = ("tablet", "kapsul", "parlatici", "temizleyici", "tuz", "sprey")
RULES = [
    Rule("tava ekmek", has=("uno", "bugday", "tava", "ekmeg"), measure=("kg", 0.45)),
    Rule("su", pattern="^su$|^su | su$| suyu", lacks=("sut", "yogurt", "susam", "sos", "maden", "mineral", "soda", "gazli", "aromali", "camasir", "12x", "6x", "4x")),
    Rule("tuz", has=("tuz",), lacks=("tuzlu", "zeytin", "tereyagi", "limon tuzu", "himalaya", "kaya", "salamura", "sarimsakli", "truf", "mantarli")),
    Rule("kola pepsi", has=("kola pepsi",), lacks=("4x", "6x", "kutu", *_NOT_DIET)),
    Rule("kola coca-cola", any_of=(("coca-cola", "coca cola"),), lacks=_NOT_DIET),
    Rule("aycicek yagi", has=("aycicek", "yag"), lacks=("zeytin",)),
    Rule("zeytinyagi", has=("zeytin", "yag"), lacks=("aycicek",)),
    Rule("misir yagi", has=("misirozu",), lacks=("zeytin",)),
    Rule("misir yagi", has=("misir", "yag"), lacks=("zeytin",)),
    Rule("findik yagi", has=("findik", "yag")),
    Rule("bulasik deterjani", has=("bulasik",), any_of=(("deterjan", "elde", "yikama", "sivi"),), lacks=("makine", *_NOT_DISH), prefix="dish"),
    Rule("bulasik deterjani", has=("fairy",), any_of=(("elma", "limon", "aloe", "portakal", "sensitive", "elde", "yikama"),), lacks=_NOT_DISH, prefix="dish"),
    Rule("tuvalet kagidi", has=("tuvalet", "kagid"), lacks=("islak", "mendil", "havlu", "pecete"), prefix="brand"),
    Rule("kagit havlu", has=("havlu",), any_of=(("kagit", "kagidi"),), lacks=("tuvalet", "islak", "mendil", "pecete", "el havlu", "yuz havlu"), prefix="brand"),
    Rule("arpacik sogan", has=("arpacik", "sogan")),
    Rule("sogan taze", has=("sogan",), lacks=("soganli",), raw=("taze", "demet", "frenk")),
    Rule("sogan", has=("sogan",), lacks=("soganli", "arpacik")),
    Rule("bildircin yumurta", has=("bildircin", "yumurta")),
    Rule("yumurta", has=("yumurta",)),
    Rule("ekmek", equals=("ekmek", "ekmek sofra")),
    Rule("salatalik", equals=("salatalik", "hiyar")),
    Rule("shiitake mantar", has=("shiitake",)),
    Rule("istiridye mantar", any_of=(("istiridye", "istridye"),)),
    Rule("kestane mantar", has=("kestane",)),
    Rule("izgaralik mantar", has=("izgaralik",)),
    Rule("mantar", has=("mantar",)),
]
DISH_BRANDS = ["fairy", "pril", "bingo", "asperox"]
DISH_KINDS = ["elma", "limon", "aloe", "portakal", "sensitive", "platinum"]
LEFT_OUT = ["kg", "g", "gram", "ml", "l", "lt", "adet", "demet", "paket", "dokme", "kuru", "taze", "yerli", "ithal", "salkim"]
SIZED = ["su", "tuz", "kola pepsi", "kola coca-cola", "yumurta", "bildircin yumurta", "aycicek yagi", "zeytinyagi", "misir yagi", "findik yagi"]
ONIONS = ["sogan", "sogan taze", "arpacik sogan"]


def _holds(text: Column, listed) -> Column:
    return F.lower(text).rlike("|".join(x.replace("-", "\\-") for x in listed))


def _fits(rule: Rule, name: Column, raw: Column, unit: Column, quantity: Column) -> Column:
    out = name.isin(*rule.equals) if rule.equals else F.lit(True)
    for x in rule.has:
        out = out & F.lower(name).contains(x)
    for listed in rule.any_of:
        out = out & _holds(name, listed)
    if rule.pattern:
        out = out & name.rlike(rule.pattern)
    if rule.lacks:
        out = out & ~_holds(name, rule.lacks)
    if rule.raw:
        out = out & _holds(raw, rule.raw)
    if rule.measure:
        out = out & (unit == rule.measure[0]) & (quantity.cast("double") == rule.measure[1])
    return out


def _first(name: Column, listed: list[str], other: Column) -> Column:
    for x in reversed(listed):
        other = F.when(F.lower(name).contains(x), x).otherwise(other)
    return other


def canonical_search_name(name: Column, raw: Column, unit: Column, quantity: Column, rules: list[Rule] = RULES) -> Column:
    """The name of the first rule that a standardised name fits, with its brand where the rule
    says so; else the name without numbers, measures and descriptors, its words in order."""
    kept = F.array_join(F.filter(words(name), lambda w: ~w.rlike(r"^[0-9]+(?:[.,][0-9]+)?$") & ~w.isin(LEFT_OUT)), " ")
    out = F.coalesce(F.nullif(kept, F.lit("")), name)
    first = lambda c: F.nullif(F.trim(F.lower(F.split_part(c, F.lit(" "), F.lit(1)))), F.lit(""))
    for rule in reversed(rules):
        called = F.lit(rule.name)
        if rule.prefix == "dish":
            called = F.concat_ws(" ", _first(name, DISH_BRANDS, first(name)), _first(name, DISH_KINDS, F.lit(None).cast("string")), called)
        elif rule.prefix == "brand":
            called = F.concat_ws(" ", first(raw), called)
        out = F.when(F.coalesce(_fits(rule, name, raw, unit, quantity), F.lit(False)), called).otherwise(out)
    return out


#: Measures in a source's own name: pattern, unit and divisor, in the order in which they count.
MEASURES = [("kg", "kg", 1), ("g(?:ram)?", "kg", 1000), ("ml", "liter", 1000), ("l", "liter", 1)]


def comparison_measure(name: Column, raw: Column, unit: Column, quantity: Column) -> Column:
    """(unit, quantity) to compare by: eggs by the piece, else the first measure in the source's
    own name, else the normalised one."""
    number = lambda c, pattern: F.replace(F.nullif(F.regexp_extract(F.lower(c), pattern, 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    row = lambda u, q: F.struct(u.alias("unit"), q.cast("double").alias("quantity"))
    out = row(unit, quantity)
    for pattern, kind, by in reversed(MEASURES):
        found = number(raw, rf"([0-9]+(?:[.,][0-9]+)?) *{pattern}")
        out = F.when(found.isNotNull(), row(F.lit(kind), found / by)).otherwise(out)
    eggs = F.coalesce(number(name, r"([1-9][0-9]?)\s*['’]"), number(name, r"([1-9][0-9]?)\s*adet"))
    return F.when(F.lower(name).contains("yumurta") & eggs.isNotNull(), row(F.lit("piece"), eggs)).otherwise(out)


def grouping_measure(canonical: Column, name: Column, unit: Column, quantity: Column) -> Column:
    """(unit, quantity) that products of one group share: none for plain bread, no quantity for
    mushrooms by the kilogram."""
    bread = (canonical == "ekmek") & name.isin("ekmek", "ekmek sofra")
    any_size = bread | ((canonical == "mantar") & (unit == "kg"))
    return F.struct(F.when(~F.coalesce(bread, F.lit(False)), unit).alias("unit"), F.when(~F.coalesce(any_size, F.lit(False)), quantity).alias("quantity"))


def comparison_price(price: Column, unit: Column, quantity: Column) -> Column:
    """Of a kilogram where there is one, else the price."""
    return F.when((unit == "kg") & (quantity > 0), unit_price(price, quantity)).otherwise(price.cast("double"))


def sized_name(canonical: Column, unit: Column, quantity: Column) -> Column:
    """canonical with its size, for kinds that are told apart by size; else null."""
    rolls = F.concat(canonical, F.lit(" "), quantity.cast("int").cast("string"), F.lit(" roll"))
    text = number_text(quantity, 4)
    size = F.when(unit == "kg", F.concat(number_text(quantity * 1000, 4), F.lit(" g"))).when(unit == "liter", F.concat(text, F.lit(" l"))).when(unit == "piece", F.concat(quantity.cast("int").cast("string"), F.lit(" adet"))).otherwise(F.concat(text, F.lit(" "), unit))
    return (
        F.when(canonical.isin(ONIONS), canonical)
        .when((unit == "roll") & (canonical.endswith("tuvalet kagidi") | canonical.endswith("kagit havlu")), rolls)
        .when((unit == "liter") & canonical.endswith("bulasik deterjani"), F.concat(canonical, F.lit(" "), text, F.lit(" l")))
        .when(canonical.isin(SIZED), F.concat(canonical, F.lit(" "), size))
    )

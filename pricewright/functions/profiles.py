"""What a product's name tells of paper and cleaning products, as struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_text, words

# Words of names of product lines and what the lines are called.
PAPER_LINES = {"platinum": "platinum", "egzotik": "egzotik", "biocare": "biocare", "deluxe": "deluxe", "bamboo": "bambu", "bambu": "bambu", "natural": "natural", "inova": "inova", "klasik": "klasik", "plus": "plus", "soft": "soft"}
TOILET_LINES = {"platinum": "platinum", "egzotik": "egzotik", "bamboo": "bambu", "bambu": "bambu", "deluxe": "deluxe", "natural": "natural", "soft": "soft"}
# Brands of cleaning products, all and by what they make, words of their context, and
# words of their scents and kinds.
CLEANING_BRANDS = ["abc", "ace", "ariel", "asperox", "bingo", "cif", "domestos", "fairy", "finish", "omo", "pril", "renax", "rinso", "sleepy", "tursil", "tursilmatik", "yumos"]
DISHWASHING, DISHWASHER, LAUNDRY, BLEACH = ["fairy", "pril"], ["finish"], ["omo", "ariel"], ["domestos"]
CLEANING_WORDS = [
    "banyo", "bulasik", "camasir", "deterjan", "deterjani", "hepsi1arada", "hepsi", "jel", "kapsul", "kapsulu", "kopuk", "makine", "makinesi", "parlatici",
    "parlaticisi", "pods", "spray", "sivi", "sprey", "tablet", "tableti", "temizleyici", "toz", "yikama", "yuzey",
]
CLEANING_VARIANTS = {"elma": "elma", "apple": "elma", "limon": "limon", "lemon": "limon", "aloe": "aloe", "portakal": "portakal", "orange": "portakal", "sirke": "sirke", "vinegar": "sirke", "sensitive": "sensitive", "platinum": "platinum"}
# Families of products and the terms that tell them, in the order in which they count.
FAMILIES = {
    "salatalik": ["salatalik", "hiyar", "badem hiyar", "cengelkoy salatalik"],
    "muz": ["muz", "muz yerli", "ithal muz"],
    "elma": ["elma", "starking", "granny smith"],
    "oil_aycicek": ["aycicek yagi"],
    "oil_zeytinyagi": ["zeytinyagi", "zeytin yagi"],
    "oil_misir": ["misir yagi", "misirozu yagi"],
    "oil_findik": ["findik yagi"],
    "coffee_turk": ["turk kahvesi", "turk kahve"],
    "coffee_filter": ["filtre kahve"],
    "coffee_instant": ["instant kahve", "granul kahve", "gold kahve", "classic kahve", "cozunebilir kahve", "2'si arada kahve", "3'u arada kahve", "3u arada kahve"],
    "coffee_capsule": ["kapsul kahve"],
}
PRODUCE_FAMILIES = ["salatalik", "muz", "elma"]


def _any(tokens: Column, *listed: str) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, listed)))


def _all(tokens: Column, *listed: str) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, listed)), tokens)) == 0


def _named(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])


def _let(value: Column, body) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(c: Column, pattern: str, group: int = 1) -> Column:
    return F.replace(F.nullif(F.regexp_extract(c, pattern, group), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def paper_profile(name: Column, category: Column | None = None) -> Column:
    """struct<kind, brand, lines, rolls, standard, special>: toilet_paper, paper_towel or null;
    the first word; the sorted product lines; the rolls of the pack; whether it is an ordinary
    pack of rolls; whether it is of a special format."""
    kept = normalize_text(category) if category is not None else F.lit("")
    split = lambda text: F.regexp_extract_all(F.translate(text, "-", " "), F.lit("([a-z0-9]+)"), F.lit(1))
    return _let(normalize_text(name), lambda text: _let(kept, lambda c: _let(split(text), lambda tokens: _paper_profile(text, tokens, c))))


def _paper_profile(text: Column, tokens: Column, kept: Column) -> Column:
    of_category = lambda *listed: _every_in(kept, listed)
    toilet = (_any(tokens, "tuvalet") & _any(tokens, "kagidi", "kagit") & ~_any(tokens, "islak", "mendil", "havlu", "pecete")) | of_category("tuvalet", "kagit")
    tissue = _any(tokens, "islak", "mendil", "pecete")
    towel = ~toilet & (_any(tokens, "havlu") | of_category("kagit", "havlu")) & ~tissue
    hand = (_any(tokens, "havlu") & _any(tokens, "el", "yuz")) | _any(tokens, "elhavlusu", "yuzhavlusu")
    hanging, giant, sheets = _any(tokens, "asilabilir", "asmali", "cekmeli"), _any(tokens, "dev", "jumbo"), _any(tokens, "yaprak")
    packs, equals, rolls, pieces = r"\b([0-9]+)\s*x\s*([0-9]+)\b", r"\b1\s*=\s*([0-9]+)\b", r"\b([0-9]+)\s*(?:rulo|roll)\b", r"\b([0-9]+)\s*'?\s*(?:li|lu)\b"
    product = _number(text, packs) * _number(text, packs, 2)
    count = (
        F.when(text.rlike(packs), F.when(product > 0, product))
        .when(text.rlike(equals), _number(text, equals))
        .when(text.rlike(rolls), _number(text, rolls))
        .when(~hand & ~tissue & ~hanging & ~sheets & (_number(text, pieces) < 50), _number(text, pieces))
    )
    kind = F.when(toilet, "toilet_paper").when(towel, "paper_towel")
    held = F.when(kind.isNotNull(), count)
    special = giant | hanging | hand | sheets | text.rlike(equals)
    lines = F.array_sort(F.array_distinct(F.filter(F.transform(tokens, lambda t: _named(PAPER_LINES)[t]), lambda x: x.isNotNull())))
    return F.struct(
        kind.alias("kind"), F.get(tokens, F.lit(0)).alias("brand"), lines.alias("lines"), held.alias("rolls"),
        (kind.isNotNull() & held.isNotNull() & ~special).alias("standard"), special.alias("special"),
    )


def _every_in(text: Column, listed: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for x in listed:
        out = out & text.contains(x)
    return out


def rolls_in(name: Column, category: Column | None = None) -> Column:
    """The rolls that a paper product's name gives; null for other products."""
    return paper_profile(name, category)["rolls"]


def cleaning_tokens(name: Column) -> Column:
    return words(F.translate(normalize_text(name), "-&", "  "))


def bundle_in(name: Column) -> Column:
    """A bundle as 2x1500 or 2x1.5, else null."""
    return _let(normalize_text(name), _bundle)


def _bundle(text: Column) -> Column:
    pattern = r"\b([0-9]+)\s*x\s*([0-9]+(?:[.,][0-9]+)?(?:\s*\+\s*[0-9]+(?:[.,][0-9]+)?)?)\b"
    size = F.replace(F.regexp_replace(F.regexp_extract(text, pattern, 2), r"\s+", ""), F.lit(","), F.lit("."))
    return F.when(text.rlike(pattern), F.concat(F.regexp_extract(text, pattern, 1), F.lit("x"), size))


def cleaning_profile(name: Column) -> Column:
    """struct<brand, variant, subtype, format, bundle, is_cleaning> of a name. The first known
    brand counts, else the first word; of the subtypes the first whose words are there."""
    split = lambda text: words(F.translate(text, "-&", "  "))
    brand = lambda tokens: F.coalesce(F.get(F.filter(tokens, lambda t: t.isin(CLEANING_BRANDS)), F.lit(0)), F.get(tokens, F.lit(0)))
    return _let(normalize_text(name), lambda text: _let(split(text), lambda tokens: _let(brand(tokens), lambda b: _cleaning_profile(text, tokens, b))))


def _cleaning_profile(text: Column, tokens: Column, brand: Column) -> Column:
    variant = F.get(F.filter(F.transform(tokens, lambda t: _named(CLEANING_VARIANTS)[t]), lambda x: x.isNotNull()), F.lit(0))
    of = lambda brands: F.coalesce(brand.isin(brands), F.lit(False))
    machine = _any(tokens, "makinesi", "makine")
    dishwasher = (_any(tokens, "bulasik") & machine) | (_any(tokens, "bulasik") & of(DISHWASHER))
    tablet = _any(tokens, "tablet", "tableti", "kapsul", "kapsulu", "pods")
    # a pack by pieces and weight without a volume, of a brand of dish soap, holds tablets
    counted = of(DISHWASHING) & ~text.rlike(r"\b[0-9]+(?:[.,][0-9]+)?\s*(?:ml|l)\b") & text.rlike(r"\b[0-9]+\s*'?(?:li|lu)\b") & text.rlike(r"\b[0-9]+(?:[.,][0-9]+)?\s*(?:g|gr|kg)\b")
    spray, soap = _any(tokens, "spray", "sprey"), _any(tokens, "deterjan", "deterjani")
    rinse = _any(tokens, "parlatici", "parlaticisi")
    by_hand = (_any(tokens, "bulasik") & soap) | (
        of(DISHWASHING)
        & (_any(tokens, "limon", "elma", "aloe", "portakal", "sensitive") | spray | _all(tokens, "elde", "yikama") | ~(dishwasher | tablet | _any(tokens, "parlatici", "parlaticisi", "temizleyici", "tuz", "tuzu")))
    )
    laundry = (_any(tokens, "camasir") | of(LAUNDRY)) & soap
    rooms = _any(tokens, "banyo", "mutfak", "kopuk", "sprey")
    subtype = (
        F.when(_all(tokens, "camasir", "suyu"), "bleach")
        .when(rinse, "rinse_aid")
        .when(_any(tokens, "tuz", "tuzu") & (dishwasher | of(DISHWASHER)), "dishwasher_salt")
        .when((tablet | counted) & (dishwasher | of(DISHWASHER + DISHWASHING) | _all(tokens, "bulasik", "tableti")), "dishwasher_tablet")
        .when(_any(tokens, "temizleyici") & (dishwasher | of(DISHWASHER)), "dishwasher_cleaner")
        .when(by_hand, F.when(~machine, "dishwashing_liquid"))
        .when(laundry, F.when(tablet, "laundry_capsule").when(_any(tokens, "sivi", "jel"), "laundry_liquid").when(_any(tokens, "toz"), "laundry_powder"))
        .when(_any(tokens, "yuzey") | (_any(tokens, "temizleyici") & rooms), "surface_cleaner")
        .when(of(BLEACH), F.when(rooms, "surface_cleaner").otherwise("bleach"))
    )
    bundle = _bundle(text)
    package = (
        F.when(spray, "spray").when(tablet | counted, "tablet_capsule").when(bundle.isNotNull(), "multipack_bundle")
        .when(F.coalesce(subtype.isin("dishwashing_liquid", "laundry_liquid"), F.lit(False)), "standard_single_pack")
    )
    is_cleaning = subtype.isNotNull() | _any(tokens, *CLEANING_WORDS) | _any(tokens, *CLEANING_BRANDS)
    return F.struct(brand.alias("brand"), variant.alias("variant"), subtype.alias("subtype"), package.alias("format"), bundle.alias("bundle"), is_cleaning.alias("is_cleaning"))


def liters_in(name: Column, millilitres_first: bool = False) -> Column:
    """Litres that a name gives: in litres, then in millilitres, or the other way round."""

    def found(text: Column) -> Column:
        litres, small = _number(text, r"([0-9]+(?:[.,][0-9]+)?)\s*l\b"), _number(text, r"([0-9]+(?:[.,][0-9]+)?)\s*ml\b") / 1000
        return F.coalesce(small, litres) if millilitres_first else F.coalesce(litres, small)

    return _let(normalize_text(name), found)


def liters(name: Column, unit: Column, quantity: Column) -> Column:
    """(unit, quantity): as given if in litres, else the litres of the name, else as given."""
    found = liters_in(name)
    row = lambda u, q: F.struct(u.alias("unit"), q.cast("double").alias("quantity"))
    return F.when((unit == "liter") & quantity.isNotNull(), row(unit, quantity)).when(found.isNotNull(), row(F.lit("liter"), found)).otherwise(row(unit, quantity))


def brand_line(name: Column) -> Column:
    """struct<is_toilet_paper, brand, line> of a name: its first word and first product line."""

    def told(tokens: Column) -> Column:
        line = F.lit(None).cast("string")
        for word, called in reversed(TOILET_LINES.items()):
            line = F.when(F.array_contains(tokens, word), called).otherwise(line)
        return F.struct(_all(tokens, "tuvalet", "kagidi").alias("is_toilet_paper"), F.get(tokens, F.lit(0)).alias("brand"), line.alias("line"))

    return _let(words(F.translate(normalize_text(name), "-", " ")), told)


def counts_in(name: Column) -> Column:
    """struct<pieces, rolls, liters> that a name gives, each null without."""
    pieces = _number(normalize_text(name), r"\b([0-9]+)\s*'?\s*(?:adet|li|lu)\b")
    return F.struct(pieces.alias("pieces"), rolls_in(name).alias("rolls"), liters_in(name, millilitres_first=True).alias("liters"))


def family_id(name: Column, cleaning_context: Column | None = None) -> Column:
    """The first family one of whose terms' words are all among the name's; produce families do
    not count in the context of cleaning. Null if there is none."""
    return _let(words(normalize_text(name)), lambda tokens: _family(tokens, cleaning_context))


def _family(tokens: Column, cleaning_context: Column | None) -> Column:
    out = F.lit(None).cast("string")
    for family, terms in reversed(FAMILIES.items()):
        fits = F.lit(False)
        for term in terms:
            fits = fits | _all(tokens, *term.split())
        if cleaning_context is not None and family in PRODUCE_FAMILIES:
            fits = fits & ~F.coalesce(cleaning_context, F.lit(False))
        out = F.when(fits, family).otherwise(out)
    return out

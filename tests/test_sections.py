"""Sections and chips of a category's results against plain Python."""

from collections import Counter

import pytest

from pricewright.plans import listings, sections

RESULTS = "query_id long, place int, standardized_product_name string, brand string, subtype string, best_unit string"
TEXTS = {1: "bulaşık deterjanı", 2: "temizlik", 3: "parlatıcı", 4: None}
ROWS = [
    (1, 1, "a", "fairy", "dishwashing_liquid", "litre"), (1, 2, "b", "pril", "dishwashing_liquid", "litre"), (1, 3, "c", "fairy", "dishwashing_liquid", "adet"), (1, 4, "d", "finish", "dishwasher_tablet", "adet"), (1, 5, "e", "abc", "dishwashing_liquid", "litre"), (1, 6, "a", "fairy", "dishwashing_liquid", "litre"),
    (2, 1, "f", "abc", "bleach", "kg"), (2, 2, "g", "ace", "bleach", "kg"), (2, 3, "h", "src_a", "bleach", "adet"), (2, 4, "i", None, "bleach", "kg"), (2, 5, "j", "cif", "surface_cleaner", "litre"), (2, 6, "k", "x1", "bleach", "kg"), (2, 7, "l", "x2", "bleach", "kg"), (2, 8, "m", "x3", "bleach", "kg"),
    (3, 1, "n", "finish", "dishwasher_tablet", "adet"), (3, 2, "o", "finish", "dishwasher_tablet", "adet"), (4, 1, "p", None, None, None), (4, 2, "q", "abc", None, "kg"),
]
ASKED = {1: "dishwashing_liquid", 3: "rinse_aid"}


def brute(query):
    rows = [r for r in ROWS if r[0] == query]
    often = lambda values: max(Counter(values).items(), key=lambda kv: (kv[1], kv[0]))[0] if values else None
    kind = ASKED.get(query) or often([r[4] for r in rows if r[4]])
    fits = [r for r in rows if not kind or r[4] == kind]
    unit = sections.PRIMARY_UNITS.get(kind)
    unit = unit if any(r[5] == unit for r in fits) and unit else often([r[5] for r in fits if r[5]])
    primary = [r for r in fits if not unit or r[5] == unit]
    brands = list(dict.fromkeys(r[3] for r in primary if r[3] and r[3] not in ("src_a", "src_b")))
    first = [b for b in sections.FIRST_BRANDS.get(kind, []) if b in brands]
    return kind, unit, primary, [r for r in rows if r not in primary], (["all"] if primary else []) + (first or brands)[: sections.CHIPS]


@pytest.fixture(scope="module")
def made(spark):
    queries = spark.createDataFrame(list(TEXTS.items()), "query_id long, text string")
    return sections.sectioned(spark.createDataFrame(ROWS, RESULTS), queries).cache()


def test_sections_equal_plain_python(made):
    for query in TEXTS:
        kind, unit, primary, _, _ = brute(query)
        rows = made.where(f"query_id = {query}").collect()
        assert {(r.primary_subtype, r.primary_unit) for r in rows} == {(kind, unit)}
        assert sorted(r.place for r in rows if r.section == "primary") == sorted(r[1] for r in primary)


def test_chips_equal_plain_python(made):
    got = {}
    for r in sections.chips(made).orderBy("query_id", "chip_no").collect():
        got.setdefault(r.query_id, []).append(r.chip)
    assert got == {q: brute(q)[4] for q in TEXTS if brute(q)[4]}
    assert got[1] == ["all", "fairy", "pril"] and len(got[2]) == 5 and "src_a" not in got[2]


@pytest.mark.parametrize("chip", [None, "all", "fairy", "abc", "tablet", "nothing"])
def test_a_chip_keeps_its_brand(spark, made, chip):
    picked = spark.createDataFrame([(q, chip) for q in TEXTS], "query_id long, chip string")
    got = {}
    for r in sections.chosen(made, picked, limit=6).orderBy("query_id", "shown").collect():
        assert r.is_cheapest == (r.shown == 1)
        got.setdefault(r.query_id, []).append((r.standardized_product_name, r.section))
    for query in TEXTS:
        _, _, primary, rest, has = brute(query)
        every = chip in (None, "all")
        first = [r for r in primary if every or chip not in has or r[3] == chip]
        after = [r for r in rest if every or (r[4] == "dishwasher_tablet" if chip == "tablet" else r[3] == chip)]
        want, seen = [], set()
        for r, section in [(r, "primary") for r in first] + [(r, "secondary") for r in after]:
            if r[2] not in seen:
                want.append((r[2], section))
                seen.add(r[2])
        assert got.get(query, []) == want[:6]


def test_no_results_no_sections(made):
    assert sections.chips(made.limit(0)).count() == 0


def test_specific_results_are_ordered_by_what_they_share_with_the_text(spark):
    rows = [
        (1, "finish power tablet", "Finish Quantum Tablet 60", "finish", "dishwasher_tablet", "single_market", 2.0, 120.0), (1, "finish power tablet", "Finish Tablet 40", "finish", "dishwasher_tablet", "safe", 1.0, 40.0), (1, "finish power tablet", "Fairy Power Tablet 30", "fairy", "dishwasher_tablet", "safe", None, 30.0),
        (2, "fairy limon 650 ml", "Fairy Limon 650 ml", "fairy", "dishwashing_liquid", "review_required", 90.0, 60.0), (2, "fairy limon 650 ml", "Fairy Elma 650 ml", "fairy", "dishwashing_liquid", "safe", 10.0, 6.0), (2, "fairy limon 650 ml", "Limon Kg", None, None, "safe", 1.0, 1.0), (3, None, "x", None, None, "safe", None, None),
    ]
    offers = spark.createDataFrame(rows, "query_id long, text string, standardized_product_name string, brand string, subtype string, normalized_status string, best_unit_price double, best_price double")
    got = {}
    for r in listings.specific_listing(offers, ["query_id"]).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.standardized_product_name, r.score))
    assert got == {
        1: [("Finish Quantum Tablet 60", 30 + 20 + 34 + 3), ("Fairy Power Tablet 30", 20 + 18 + 34 + 6), ("Finish Tablet 40", 30 + 20 - 18 + 6)],
        2: [("Fairy Limon 650 ml", 30 + 18), ("Fairy Elma 650 ml", 30 + 6), ("Limon Kg", 18 + 6)], 3: [("x", 6)],
    }

import random
from difflib import SequenceMatcher

from pricewright.plans import search

CATALOG = ["kirmizi biber", "kirmzi biber", "kirmizi bibr", "kirmizi biber aci", "yesil elma", "yesil elmalar", "sut"]
QUERIES = ["kirmizi biber", "yesil elma", "sutt"]


def test_products_without_a_match_are_fuzzy_beside_those_with_one(spark):
    queries = spark.createDataFrame([(q, q) for q in QUERIES], "query_id string, text string")
    rows = search.search_rank(queries, spark.createDataFrame([(p,) for p in CATALOG], "product string")).collect()
    got = {(r.query_id, r.product): (r.match_rank, round(r.score, 6)) for r in rows}
    assert len(rows) == len(got)
    fuzzy = {}
    for q in QUERIES:
        for p in CATALOG:
            variants = {q, " ".join(sorted(q.split()))}
            earlier = any(set(v.split()) <= set(p.split()) or v in p for v in variants)
            ratio = max(SequenceMatcher(None, v, p).ratio() for v in variants)
            if not earlier and ratio >= search.FUZZY:
                fuzzy[q, p] = (3, round(ratio, 6))
    assert {k: v for k, v in got.items() if v[0] == 3} == fuzzy
    assert got["kirmizi biber", "kirmizi biber"][0] == 0 and ("kirmizi biber", "kirmzi biber") in fuzzy
    places = [r.match_rank for r in sorted(rows, key=lambda r: (r.query_id, r.place)) if r.query_id == "kirmizi biber"]
    assert places == sorted(places)


def test_pieces_find_every_match(spark):
    """Random short and long texts, a small alphabet for repeated pairs: no match is lost."""
    draw = random.Random(3)
    text = lambda n: "".join(draw.choice("aabcd ") for _ in range(n)).strip() or "a"
    names = {text(draw.randint(1, 24)) for _ in range(150)} | {"aaaa", "ab", "acb", "a"}
    asked = {text(draw.randint(1, 24)) for _ in range(60)} | {"aaaaa", "ab", "cc"}
    asked |= {n[:k] + n[k + 1 :] for n in sorted(names)[::3] for k in [draw.randrange(len(n))] if n[:k] + n[k + 1 :]}
    variants = spark.createDataFrame([(v, v) for v in sorted(asked)], "query_id string, variant string")
    products = spark.createDataFrame([(n, n) for n in sorted(names)], "product string, name string")
    inside = {(r.variant, r.name) for r in search.holding(products, variants).collect()}
    assert inside == {(v, n) for v in asked for n in names if v in n}
    near = {(r.variant, r.name) for r in search.fuzzy_candidates(variants, products, search.FUZZY).collect()}
    true = {(v, n) for v in asked for n in names if SequenceMatcher(None, v, n).ratio() >= search.FUZZY}
    assert len(true) > 50 and true <= near


def test_search_makes_no_nested_loop(spark):
    queries = spark.createDataFrame([(q, q) for q in QUERIES], "query_id string, text string")
    ranked = search.search_rank(queries, spark.createDataFrame([(p,) for p in CATALOG], "product string"))
    assert "NestedLoop" not in ranked._jdf.queryExecution().toString()

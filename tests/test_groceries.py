"""Golden rows for paper and cleaning products, labels, canonical names, pairs and listings."""

import datetime as dt

import pytest
from conftest import SF
from pyspark.sql import functions as F

from pricewright import catalogue
from pricewright.functions import canonical as C
from pricewright.functions import labels as L
from pricewright.functions import profiles as PR
from pricewright.plans import accounting, catalog, listings, pairs, standardize, synthesis
from pricewright.sources import groceries as G


def values(spark, rows, schema, made):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [r.x for r in df.select("_i", made.alias("x")).orderBy("_i").collect()]


def test_paper_profiles(spark):
    names = ["Solo Tuvalet Kağıdı 16'lı", "Papia Platinum Havlu Kağıt 2x6", "Familia Plus Kağıt Havlu 1=3", "Selpak Jumbo Kağıt Havlu 4 rulo", "El Havlusu 100'lü", "Islak Mendil 90'lı", "Havlu Kağıt Yaprak 60 lı", None, "Solo Bamboo Soft Tuvalet Kağıdı 60'lı"]
    got = values(spark, [(n,) for n in names], "n string", PR.paper_profile(F.col("n")))
    assert [(r.kind, r.rolls, r.standard, r.special) for r in got] == [
        ("toilet_paper", 16.0, True, False), ("paper_towel", 12.0, True, False), ("paper_towel", 3.0, False, True), ("paper_towel", 4.0, False, True), (None, None, False, False),
        (None, None, False, False), ("paper_towel", None, False, True), (None, None, False, False), ("toilet_paper", None, False, False),
    ]
    assert [r.lines for r in got][1:3] == [["platinum"], ["plus"]] and got[8].lines == ["bambu", "soft"] and got[0].brand == "solo"


def test_cleaning_profiles(spark):
    names = ["Fairy Limon 650 ml", "Fairy Platinum 60'lı 1 kg", "Finish Tuz 1,5 kg", "Bulaşık Makinesi Parlatıcısı", "Omo Toz Çamaşır Deterjanı 6 kg", "Ariel Kapsül Çamaşır Deterjanı", "Domestos Banyo Sprey", "Domestos Ultra 810 ml", "Cif Yüzey Temizleyici", "Elma Kg", "Pril Sprey 2x750 ml"]
    got = values(spark, [(n,) for n in names], "n string", PR.cleaning_profile(F.col("n")))
    assert [r.subtype for r in got] == ["dishwashing_liquid", "dishwasher_tablet", "dishwasher_salt", "rinse_aid", "laundry_powder", "laundry_capsule", "surface_cleaner", "bleach", "surface_cleaner", None, "dishwashing_liquid"]
    assert [r.format for r in got] == ["standard_single_pack", "tablet_capsule", None, None, None, "tablet_capsule", "spray", None, None, None, "spray"]
    assert got[0].variant == "limon" and got[10].bundle == "2x750" and not got[9].is_cleaning and got[9].brand == "elma"


def test_counts_families_and_litres(spark):
    got = values(spark, [("Yumurta 15'li",), ("Süt 500 ml",), ("Solo Tuvalet Kağıdı 2x6",)], "n string", PR.counts_in(F.col("n")))
    assert [tuple(r) for r in got] == [(15.0, None, None), (None, None, 0.5), (None, 12.0, None)]
    names = ["Hıyar Badem", "Türk Kahvesi 100 g", "Zeytin Yağı Sızma", "Elma Sabunu", "Ekmek", "Nescafe Gold Kahve"]
    assert values(spark, [(n,) for n in names], "n string", PR.family_id(F.col("n"), F.col("n").contains("Sabun"))) == ["salatalik", "coffee_turk", "oil_zeytinyagi", None, None, "coffee_instant"]
    rows = [("Su 5 l", None, None), ("Su 500 ml", "piece", 1.0), ("Su", "liter", 2.0), ("Tuz", "kg", 1.0)]
    assert [tuple(r) for r in values(spark, rows, "n string, u string, q double", PR.liters(F.col("n"), F.col("u"), F.col("q")))] == [("liter", 5.0), ("liter", 0.5), ("liter", 2.0), ("kg", 1.0)]


def test_measure_labels(spark):
    rows = [(0.75, "kg", "Tuz Paket"), (1.5, "kg", "x"), (15.0, "piece", "Yumurta paket"), (12.0, "roll", None), (0.333, "liter", None), (None, "kg", "x"), (2.0, None, "x"), (500.0, "ml", None), (1.0, "demet", None), (3.0, "koli", None)]
    got = values(spark, rows, "q double, u string, n string", L.measure_label(F.col("q"), F.col("u"), F.col("n")))
    assert got == ["750 g paket", "1.5 kg", "15 adet", "12 rulo", "0.333 l", "-", "-", "500 ml", "1 demet", "3 koli"]


def test_status_and_mismatch_labels(spark):
    rows = [("single_source", None, None, False), ("high", True, True, True), ("high", True, True, False), ("low", False, False, False), ("medium", True, False, False), ("medium", True, True, False)]
    got = values(spark, rows, "c string, u boolean, q boolean, f boolean", L.status_label(F.col("c"), F.col("u"), F.col("q"), F.col("f")))
    want = ["single_source", "review", "safe", "unit_mismatch", "quantity_mismatch", "review"]
    assert got == [L.STATUS_LABELS[w] for w in want]
    rows = [("1 kg", "500 g", False, "quantity_mismatch"), ("1 kg", "1 kg", True, None), ("-", "-", False, None), ("1 l", "-", False, None)]
    assert values(spark, rows, "a string, b string, s boolean, r string", L.mismatch_label(F.col("a"), F.col("b"), F.col("s"), F.col("r"))) == ["1 kg vs 500 g (quantity_mismatch)", None, None, "1 l vs -"]


def test_pack_totals(spark):
    rows = [("Su 6x1,5 l", "liter", 1.5), ("Su 6x1,5 l", "kg", 1.0), ("Soda 6 X 200 ML", "liter", None), ("Süt 1 l", "liter", 1.0), ("Un 2x500 g", "kg", 2.0)]
    assert [r.quantity for r in values(spark, rows, "n string, u string, q double", L.pack_total(F.col("n"), F.col("u"), F.col("q")))] == [9.0, 1.0, 1.2, 1.0, 2.0]


@pytest.mark.parametrize(("name", "raw", "want"), [
    ("bugday ekmegi tava uno", "Uno", "tava ekmek"), ("dogal kaynak suyu", "x", "su"), ("sut su", "x", "sut su"), ("camasir suyu", "x", "camasir suyu"), ("iyotlu tuz", "x", "tuz"), ("tuzlu fistik", "x", "tuzlu fistik"),
    ("kola pepsi", "x", "kola pepsi"), ("kola pepsi zero", "x", "kola pepsi zero"), ("coca-cola", "x", "kola coca-cola"), ("aycicek yagi", "x", "aycicek yagi"), ("sizma yagi zeytin", "x", "zeytinyagi"), ("misirozu yagi", "x", "misir yagi"),
    ("bulasik deterjani fairy limon", "x", "fairy limon bulasik deterjani"), ("bulasik makinesi tableti", "x", "bulasik makinesi tableti"), ("kagidi solo tuvalet", "Solo Ultra", "solo tuvalet kagidi"), ("havlu kagit papia", "Papia", "papia kagit havlu"),
    ("sogan", "Taze Soğan", "sogan taze"), ("sogan", "Soğan", "sogan"), ("arpacik sogan", "x", "arpacik sogan"), ("bildircin yumurta", "x", "bildircin yumurta"), ("hiyar", "x", "salatalik"), ("istridye mantar", "x", "istiridye mantar"), ("elma 5 kg yesil", "x", "elma yesil"),
])
def test_canonical_names(spark, name, raw, want):
    got = values(spark, [(name, raw, "kg", 0.45)], "n string, r string, u string, q double", C.canonical_search_name(F.col("n"), F.col("r"), F.col("u"), F.col("q")))
    assert got == [want]


def test_sizes_keep_their_zeros(spark):
    rows = [("su", "liter", 10.0), ("tuz", "kg", 0.75), ("yumurta", "piece", 30.0), ("solo tuvalet kagidi", "roll", 16.0), ("elma", "kg", 1.0), ("sogan", "kg", 2.0)]
    got = values(spark, rows, "c string, u string, q double", C.sized_name(F.col("c"), F.col("u"), F.col("q")))
    assert got == ["su 10 l", "tuz 750 g", "yumurta 30 adet", "solo tuvalet kagidi 16 roll", None, "sogan"]
    rows = [("yumurta 15'li", "Yumurta 15'li", "piece", 1.0), ("tuz", "Tuz 750 g", "piece", 1.0), ("su", "Su 500 ML", None, None), ("ekmek", "Ekmek", "piece", 1.0)]
    assert [tuple(r) for r in values(spark, rows, "n string, r string, u string, q double", C.comparison_measure(F.col("n"), F.col("r"), F.col("u"), F.col("q")))] == [("piece", 15.0), ("kg", 0.75), ("liter", 0.5), ("piece", 1.0)]


PAIR = "standardized_product_name string, src_a_source_product_name string, src_b_source_product_name string, src_a_price double, src_b_price double, src_a_normalized_unit string, src_b_normalized_unit string, src_a_normalized_quantity double, src_b_normalized_quantity double, same_unit_flag boolean, same_quantity_flag boolean, comparison_confidence string"


def pair(name, a, b, unit, qa, qb, price_b=2.0):
    return (name, a, b, 1.0, price_b, unit, unit, qa, qb, True, qa == qb, "high")


def test_paper_pair_rules(spark):
    rows = [
        pair("1", "Solo Tuvalet Kağıdı 16'lı", "Selpak Tuvalet Kağıdı 16'lı", "roll", 16.0, 16.0), pair("2", "Solo Bambu Tuvalet Kağıdı 16'lı", "Solo Bamboo Tuvalet Kağıdı 16'lı", "roll", 16.0, 16.0),
        pair("3", "Solo Bambu Tuvalet Kağıdı 16'lı", "Solo Deluxe Tuvalet Kağıdı 16'lı", "roll", 16.0, 16.0), pair("4", "Papia Kağıt Havlu 6'lı", "Papia Kağıt Havlu 6'lı", "roll", 6.0, 6.0),
        pair("5", "Solo Tuvalet Kağıdı 16'lı", "Solo Tuvalet Kağıdı 24'lü", "roll", 16.0, 24.0), pair("6", "Elma", "Elma", "kg", 1.0, 1.0),
    ]
    got = {r.standardized_product_name: (r.comparison_confidence, r.comparison_review_reason) for r in pairs.apply_paper_rules(spark.createDataFrame(rows, PAIR)).collect()}
    assert got == {"1": ("low", "brand_mismatch"), "2": ("high", None), "3": ("medium", "product_line_mismatch"), "4": ("medium", "product_line_unknown"), "5": ("high", None), "6": ("high", None)}


def test_cleaning_pair_rules(spark):
    rows = [
        pair("1", "Fairy Limon 650 ml", "Fairy Limon 750 ml", "liter", 0.65, 0.75), pair("2", "Fairy Limon 650 ml", "Pril Limon 650 ml", "liter", 0.65, 0.65), pair("3", "Fairy Limon 650 ml", "Fairy Elma 650 ml", "liter", 0.65, 0.65),
        pair("4", "Fairy Limon 650 ml", "Fairy Limon 1,5 l", "liter", 0.65, 1.5), pair("5", "Domestos Banyo Sprey 1 l", "Domestos 1 l", "liter", 1.0, 1.0), pair("6", "Elma", "Elma", "kg", 1.0, 1.0), pair("7", "Fairy Sprey 500 ml", "Fairy 500 ml", "liter", 0.5, 0.5),
    ]
    got = {r.standardized_product_name: (r.comparison_confidence, r.comparison_review_reason, r.soft_equivalent_match) for r in pairs.apply_cleaning_rules(spark.createDataFrame(rows, PAIR)).collect()}
    assert got["1"] == ("high", None, True) and got["2"][:2] == ("low", "brand_mismatch") and got["3"][:2] == ("medium", "variant_mismatch")
    assert got["4"] == ("high", None, False) and got["5"][:2] == ("medium", "subtype_mismatch") and got["6"][:2] == ("high", None) and got["7"][:2] == ("medium", "package_format_mismatch")


def test_pairs_are_made_across_sources(spark):
    rows = [("x", "Fairy Limon 650 ml", None, 10.0, None, "liter", None, 0.65, None, False, False, "single_source"), ("y", None, "Fairy Limon Bulaşık Deterjanı 653 ml", None, 12.0, None, "liter", None, 0.653, False, False, "single_source"), ("z", None, "Pril Elma 653 ml", None, 9.0, None, "liter", None, 0.653, False, False, "single_source")]
    made = synthesis.liquid_prices(spark.createDataFrame(rows, PAIR)).collect()
    assert [(r.standardized_product_name, r.src_a_price, r.src_b_price, r.cheaper_source) for r in made] == [("fairy limon bulasik deterjani 0.65 l", 10.0, 12.0, "src_a")]
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    out = pairs.replace_then_append(base, spark.createDataFrame([("b", 5), ("c", 6)], "k string, v int"), "k", [F.col("k")])
    assert [tuple(r) for r in out.collect()] == [("a", 1), ("b", 5), ("c", 6)]


def test_shown_prices(spark):
    columns = "standardized_product_name string, available_sources string, comparison_price_unit string, coverage_status string, src_a_raw_price double, src_b_raw_price double, src_a_comparison_price double, src_b_comparison_price double, src_a_normalized_unit string, src_b_normalized_unit string, src_a_normalized_quantity double, src_b_normalized_quantity double, src_a_source_product_name string, src_b_source_product_name string"
    rows = [("su", "", "liter", "comparable", 30.0, 12.0, None, None, "liter", "liter", 1.5, 1.5, "Su 6x1,5 l", "Su 1,5 l"), ("un", "", None, "comparison_review_required", 20.0, 15.0, None, None, "kg", "piece", 1.0, 1.0, "Un 1 kg", "Un")]
    made = spark.createDataFrame(rows, columns)
    asked = spark.createDataFrame([("su", 30.0, 12.0, "src_b", 12.0, False), ("un", 20.0, 15.0, "src_b", 15.0, False)], "standardized_product_name string, src_a_price double, src_b_price double, recommended_source string, recommended_price double, force_review boolean")
    got = {r.standardized_product_name: r for r in catalog.display_prices(asked, made).collect()}
    assert (got["su"].display_recommended_source, got["su"].price_display_unit, round(got["su"].advantage, 4)) == ("src_a", "litre", round(8 - 30 / 9, 4))
    assert (got["un"].display_recommended_source, got["un"].price_display_unit, got["un"].src_a_display_price) == ("src_b", None, 20.0)
    best = {r.standardized_product_name: r for r in listings.best_offer(made).collect()}
    assert (best["su"].best_source, round(best["su"].best_unit_price, 4)) == ("src_a", round(30 / 9, 4)) and best["un"].best_source == "src_b"
    listed = listings.category_listing(listings.best_offer(made).withColumn("query_id", F.lit(1)), ["query_id"]).collect()
    assert [(r.standardized_product_name, r.place, r.is_cheapest) for r in sorted(listed, key=lambda r: r.place)] == [("su", 1, True), ("un", 2, False)]
    assert values(spark, [("Fairy",), ("bulaşık deterjanı",), ("fairy limon 650 ml",), ("elma",)], "t string", listings.search_mode(F.col("t"))) == ["brand", "category", "specific", "specific"]


def test_loading_twice_adds_nothing(spark):
    columns = "run_id long, source_name string, product_id string, sku string, product_name string, category_name string, category_slug string, unit string, unit_amount double, shown_price_tl double, regular_price_tl double, scraped_at timestamp_ntz"
    row = lambda i, name, price, unit="PIECE": (1, "a", i, i, name, "Sebze", "sebze", unit, None, price, None, None)
    rows = spark.createDataFrame([row("1", "Domates Kg", 20.0), row("1", "Domates Kg", 20.0), row("2", "Elma", None), row("3", "Ceviz 250 g", 90.0), row("4", None, 5.0)], columns)
    products = spark.createDataFrame([], "product_id long, name string, category string")
    facts = spark.createDataFrame([], "event_id string, run_id long, source_name string, source_product_id string, product_id long, standardized_product_name string, price double, normalized_unit string, normalized_quantity double, price_per_unit double, observed_at timestamp_ntz")
    once = standardize.load(rows, standardize.raw_events(rows).limit(0), products, facts)
    assert sorted((r.standardized_product_name, r.normalized_unit, r.price_per_unit) for r in once["facts"].collect()) == [("ceviz", "kg", 360.0), ("domates", "piece", 20.0)]
    assert {r.reject_reason: r.n for r in once["rejected"].collect()} == {"suspicious_record": 1, "missing_standardized_product_name": 1}
    again = standardize.load(rows, once["raw"], once["products"], once["facts"])
    assert again["facts"].count() == 2 and again["raw"].count() == once["raw"].count() == 4


def test_refresh_goes_on_after_a_failure(spark, tmp_path):
    df = spark.range(3)
    got = accounting.refresh_marts(spark, {"good": lambda: df, "bad": lambda: df.select("nothing"), "absent": None, "last": lambda: df}, str(tmp_path)).collect()
    assert [(r.name, r.status) for r in got] == [("good", "refreshed"), ("bad", "failed"), ("absent", "skipped"), ("last", "refreshed")]
    accounting.refresh_marts(spark, {"good": lambda: df.select("nothing"), "last": lambda: spark.range(5)}, str(tmp_path))
    assert accounting.read_mart(spark, str(tmp_path), "good").count() == 3 and accounting.read_mart(spark, str(tmp_path), "last").count() == 5
    runs = spark.createDataFrame([("a", "success", "2024-01-01"), ("b", "failed", "2024-01-02")], "source_name string, status string, started_at string")
    report = {(r.check_name, r.subject): r.ok for r in accounting.health_report(spark, {"facts": df, "dim": None}, runs, df, {"search": df.limit(0)}).collect()}
    assert report == {("table_present", "facts"): True, ("table_present", "dim"): False, ("latest_success", "a"): True, ("latest_success", "b"): False, ("history_rows", "history"): True, ("smoke", "search"): False}
    names = spark.createDataFrame([("Kağıt Havlu",), ("Islak Havlu",), ("Elma",)], "n string")
    assert [r.n for r in accounting.filter_like_any(names, "n", ["%havlu%"], ["%islak%"]).collect()] == ["Kağıt Havlu"]


def test_the_latest_rows_are_those_of_the_whole_history(spark, tmp_path):
    at = lambda day: None if day is None else dt.datetime(2024, 1, day)
    lines = [(o, p, s, n, x, at(day)) for o, (p, s, n, x, day) in enumerate([
        (0, 2, 1, 900.0, 3), (0, 2, 2, 900.0, 3), (0, 4, 2, 800.0, 3), (28, 6, 1, 700.0, 3), (0, 2, 1, None, 9), (0, 3, 1, 500.0, 1), (0, 3, 1, 400.0, None), (1, 2, 1, 300.0, None), (1, 2, 2, 200.0, None),
        (2, 2, 1, 100.0, 2), (99, 2, 1, 100.0, 8), (None, 2, 1, 100.0, 8), (3, None, 1, 100.0, 4), (3, 5, 1, 100.0, 4), (13, 2, 1, 900.0, 5), (13, 3, 1, 900.0, 5),
    ])]
    spark.createDataFrame([(o, p, s, n, 1.0, x, 0.1, day) for o, p, s, n, x, day in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, "n", "Brand#1", "PROMO") for p in (0, 1, 2, 3, 13, 28, 50)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    told = lambda history: sorted(map(str, catalog.latest_sources(history, G.TIE).collect()))
    got = told(G.latest_history(spark, str(tmp_path)))
    assert got == told(G.history(spark, str(tmp_path))) and len(got) == 7
    assert G.latest_history(spark, str(tmp_path)).count() == 7


@pytest.mark.parametrize("name", ["canonical_names", "display_names", "public_catalog", "latest_canonical_prices", "display_prices", "cleaning_rules", "paper_rules", "best_offers", "safety_list"])
def test_a_catalog_does_not_read_the_order_lines_again(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "l_shipdate" not in plan


def load_rows(spark, listed):
    columns = "run_id long, line_number int, source_name string, product_id string, sku string, product_name string, category_name string, category_slug string, unit string, unit_amount double, shown_price_tl double, regular_price_tl double, scraped_at timestamp_ntz"
    return spark.createDataFrame([(run, n, source, i, i, name, "Sebze", "sebze", "PIECE", 1.0, price, None, None if day is None else dt.datetime(2024, 1, day)) for run, n, source, i, name, price, day in listed], columns)


def loaded(spark, rows):
    products = spark.createDataFrame([], "product_id long, name string, category string")
    facts = spark.createDataFrame([], "event_id string, run_id long, source_name string, source_product_id string, product_id long, standardized_product_name string, price double, observed_at timestamp_ntz")
    return standardize.load(rows, standardize.raw_events(rows).limit(0), products.limit(0), facts.limit(0), F.lit(dt.datetime(2024, 2, 1)))


def test_a_load_keeps_the_first_of_equal_rows_and_sends_no_payload(spark):
    rows = load_rows(spark, [(1, 10, "a", "1", "Domates Kg", 20.0, 3), (1, 9, "a", "1", "Domates Kg", 20.0, 3), (1, 2, "a", "1", "Domates Kg", 20.0, 4), (2, 1, "a", "2", "Elma", None, 3), (2, 2, "b", "3", "Elma Kg", 5.0, None)])
    got = loaded(spark, rows)
    staged = {(r.run_id, r.source_name, r.source_product_id): r for r in got["staging"].collect()}
    assert sorted(staged) == [(1, "a", "1"), (2, "a", "2"), (2, "b", "3")] and staged[1, "a", "1"].line_number == 9
    assert '"line_number":9' in staged[1, "a", "1"].raw_payload and staged[2, "b", "3"].observed_at == dt.datetime(2024, 2, 1)
    raw = {(r.run_id, r.raw_hash, r.raw_payload) for r in standardize.raw_events(rows).collect()}
    assert {(r.run_id, r.raw_hash, r.raw_payload) for r in got["raw"].collect()} < raw
    # payloads are made when they are asked for: neither they nor hashes lie on disk, and facts need no exchange
    files = {f for f in got["staging"].inputFiles() if "/load-" in f}
    assert files and not {"raw_payload", "raw_hash", "event_id"} & set(spark.read.parquet(*files).columns)
    assert "Exchange hashpartitioning" not in got["facts"]._jdf.queryExecution().executedPlan().toString()
    assert loaded(spark, rows.limit(0))["facts"].count() == 0


def test_events_of_rows_without_a_run_enter_the_facts_once(spark):
    rows = load_rows(spark, [(None, 1, "1|a", "1", "Elma Kg", 2.0, 3), (1, 1, "a", "1", "Elma Kg", 2.0, 4), (1, 1, "b", "1", "Elma Kg", 2.0, 4)])
    facts = loaded(spark, rows)["facts"].collect()
    assert sorted((r.run_id is None, r.source_name) for r in facts) == [(False, "b"), (True, "1|a")]

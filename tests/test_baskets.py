from pricewright.operators import rows as R
from pricewright.plans import baskets


def test_golden_totals(spark):
    items = spark.createDataFrame([(1, 1, "p"), (1, 2, "q")], "basket_id long, item_no int, product string")
    offers = spark.createDataFrame([("p", "x", 100.0, True), ("p", "y", 120.0, True), ("q", "x", 40.0, True), ("q", "y", 35.0, True)], "product string, source_name string, price double, safe boolean")
    recommended = baskets.recommendations(items, offers)
    mixed, single = baskets.mixed_baskets(recommended), baskets.single_source_baskets(items, offers)
    row = baskets.savings(mixed, single).first()
    assert (row.mixed_total, row.single_source, row.single_total, row.savings) == (135.0, "x", 140.0, 5.0)


def test_unsafe_and_missing_offers_leave_a_basket_incomplete(spark):
    items = baskets.normalize_requests(spark.createDataFrame([(1, 1, "p"), (1, 3, "p"), (1, 2, "z"), (1, 4, None)], "basket_id long, item_no int, product string"))
    offers = spark.createDataFrame([("p", "x", 1.0, False), ("p", "y", 2.0, False)], "product string, source_name string, price double, safe boolean")
    got = {r["product"]: r.status for r in baskets.recommendations(items, offers).collect()}
    assert got == {"p": "comparison_review_required", "z": "no_valid_price"}
    assert not baskets.mixed_baskets(baskets.recommendations(items, offers)).first().complete


def test_baskets_of_ids(spark):
    latest = spark.createDataFrame([(1, "a", 9.0, 3.0), (1, "b", 2.0, None), (2, "a", 5.0, 4.0), (2, "b", None, None), (3, "b", None, None), (4, "a", 1.0, 1.0), (4, "b", 1.0, 1.0)], "product_id long, source_name string, price double, price_per_unit double")
    rows = [(10, 1, 1), (10, 2, 2), (11, 1, 3), (11, 2, 99), (12, 1, 4), (12, 2, 4), (12, 3, 1), (13, 1, None)]
    items = spark.createDataFrame(rows, "basket_id long, item_no int, product_id long")
    bought = baskets.id_items(items, latest)
    got = {(r.basket_id, r.item_no): (r.status, r.source_name, r.selected_price) for r in bought.collect()}
    assert got[10, 1] == ("ok", "b", 2.0) and got[10, 2] == ("ok", "a", 4.0) and got[12, 1] == got[12, 2] == ("ok", "a", 1.0)
    assert got[11, 1] == ("no_valid_price", None, None) and got[11, 2] == got[13, 1] == ("no_prices_found", None, None)
    assert {r.basket_id: (r.n_items, r.n_priced, r.total) for r in baskets.id_split(bought).collect()} == {10: (2, 2, 6.0), 11: (2, 0, 0.0), 12: (3, 3, 4.0), 13: (1, 0, 0.0)}
    assert {(r.basket_id, r.source_name): r.total for r in baskets.id_single_source(items, latest).collect()} == {(10, "a"): 7.0, (12, "a"): 5.0, (12, "b"): 4.0}


PRICED = "standardized_product_name string, src_a_price double, src_b_price double, same_unit_flag boolean, same_quantity_flag boolean, comparison_confidence string, coverage_status string, comparison_review_reason string"
ASKED = "basket_id long, item_no int, selection_type string, text string, family_id string, family_label string, options array<string>, force_review boolean"


def test_candidates_are_chosen_by_safety_price_and_place(spark):
    rows = spark.createDataFrame([
        ("domates", 10.0, 12.0, True, True, "high", "comparable", None), ("salatalik", 9.0, None, False, False, "single_source", "only_src_a", None), ("mersini yaban", 5.0, 4.0, False, False, "low", "comparison_review_required", "unit_mismatch"),
        ("elma", None, None, False, False, "single_source", "unavailable", None), ("muz yerli", 7.0, 7.0, True, True, "high", "comparable", None), ("badem hiyar", 3.0, 2.0, True, True, "high", "comparable", None),
    ], PRICED)
    asked = spark.createDataFrame([
        (1, 1, "product", "Domates Kg", None, None, None, None), (1, 2, "product", "domates", None, None, None, None), (1, 3, "product", " ", None, None, None, None), (1, 4, "product", "Yaban Mersini", None, None, None, None), (1, 5, "product", "nothing", None, None, None, None),
        (1, 6, "product_family", None, "salatalik", "Salatalık", ["Hıyar", "Badem Hıyar", "nothing"], False), (1, 7, "product_family", None, "salatalik", None, ["other"], False), (1, 8, "product_family", None, None, None, ["Elma", "Yaban Mersini"], False),
        (1, 9, "product_family", None, "f", None, ["Muz Yerli"], True), (1, 10, "product_family", None, "g", None, ["nothing"], False), (1, 11, "product_family", None, "h", None, [], False), (1, 12, "product", "Elma", None, None, None, None),
    ], ASKED)
    requests = baskets.candidate_requests(asked)
    assert {r.item_no: r.candidates for r in requests.collect()} == {
        1: ["domates", "domates kg"], 2: ["domates"], 4: ["mersini yaban", "yaban mersini"], 5: ["nothing"], 6: ["salatalik", "hiyar", "badem hiyar", "nothing"], 8: ["elma", "mersini yaban", "yaban mersini"], 9: ["muz", "muz yerli"], 10: ["nothing"], 12: ["elma"]
    }
    got = {r.item_no: r for r in baskets.choose_candidates(requests, rows).collect()}
    assert {n: (r.product, r.status, r.source_name, r.price) for n, r in got.items()} == {
        1: ("domates", "ok", "src_a", 10.0), 2: ("domates", "ok", "src_a", 10.0), 4: ("mersini yaban", "comparison_review_required", None, None), 5: ("nothing", "unavailable", None, None), 6: ("badem hiyar", "ok", "src_b", 2.0),
        8: ("elma", "no_valid_price", None, None), 9: ("muz yerli", "comparison_review_required", None, None), 10: (None, "unavailable", None, None), 12: ("elma", "no_valid_price", None, None),
    }
    assert (got[6].family_label, got[6].family_option_count, got[8].family_id, got[9].review_reason, got[4].review_reason) == ("Salatalık", 4, "elma|mersini yaban|yaban mersini", "subtype_selection_required", "unit_mismatch")
    assert baskets.choose_candidates(baskets.candidate_requests(asked.limit(0)), rows).count() == 0


def test_names_of_a_text_are_computed_once_and_choose_as_before(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    texts = [None, "", "Domates Kg", "Yaban Mersini", "Hıyar Kg"]
    rows = spark.createDataFrame([(i, texts[i % 5]) for i in range(100)], "basket_id long, text string")
    named = baskets.with_candidate_names(rows.mapInArrow(seen, rows.schema), "text")
    assert calls.value == 100
    # the five texts stand in the folder with their names; no row computes them again
    assert "regexp_replace" not in named._jdf.queryExecution().optimizedPlan().toString()
    got = {r.basket_id: r.names for r in named.collect()}
    assert len(got) == 100 and got[2] == ["domates", "domates kg"] and got[3] == ["mersini yaban", "yaban mersini"] and got[0] == got[1] == ["", ""]
    asked = spark.createDataFrame([(1, 1, "product", "Domates Kg", None, None, None, None), (1, 2, "product_family", None, "f", None, ["Hıyar", "Badem"], None), (1, 3, "product", None, None, None, None, None)], ASKED)
    names = spark.createDataFrame([(1, [["domates", "domates kg"]]), (2, [["salatalik", "hiyar"], ["badem", "badem"]]), (3, [["", ""]])], "item_no int, names array<array<string>>")
    candidates = lambda df: sorted((r.item_no, r.candidates) for r in baskets.candidate_requests(df).collect())
    assert candidates(asked.join(names, "item_no")) == candidates(asked) == [(1, ["domates", "domates kg"]), (2, ["salatalik", "hiyar", "badem"])]


def test_equal_names_of_price_rows_give_a_request_one_row(spark):
    review = ("x", 5.0, 4.0, False, False, "low", "comparison_review_required", "unit_mismatch")
    rows = spark.createDataFrame([review, ("x", 3.0, None, False, False, "single_source", "only_src_a", None), ("x", 9.0, None, False, False, "single_source", "only_src_a", None)], PRICED)
    asked = spark.createDataFrame([(1, 1, "product", "x", None, None, None, None), (1, 2, "product_family", None, "f", None, ["x"], None)], ASKED)
    got = {r.item_no: (r.status, r.price) for r in baskets.choose_candidates(baskets.candidate_requests(asked), rows).collect()}
    assert got == {1: ("comparison_review_required", None), 2: ("ok", 3.0)} and baskets.choose_candidates(baskets.candidate_requests(asked), rows).count() == 2


def test_rows_of_the_last_time_have_what_is_latest(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", 1, 3), ("b", 2, 4), ("b", 2, 5), (None, 1, 6), (None, None, 7)], "k string, at int, n int")
    assert sorted(r.n for r in R.of_last_time(rows, ["k"], "at").collect()) == [1, 2, 4, 5, 6]
    latest = lambda df: sorted(map(str, R.latest_per_key(df, ["k"], "at", ["n"]).collect()))
    assert latest(R.of_last_time(rows, ["k"], "at")) == latest(rows)

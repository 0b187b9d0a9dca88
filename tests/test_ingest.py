"""Payloads through the stream against the load at once, and the log of runs."""

import datetime as dt
import json

import pyarrow as pa
from pyspark.sql import functions as F

from pricewright.plans import accounting, standardize
from pricewright.sources import listings
from pricewright.streaming import ingest

AT = dt.datetime(2024, 3, 1, 8)


def item(i, name, cents, **more):
    return {"id": i, "name": name, "shownPrice": cents, "unit": "PIECE", "unitAmount": 1, "category": {"name": "Sebze"}, **more}


def leaf(i, name, cents, code="AD"):
    return {"id": i, "attributes": {"name": name, "salesUnitOfMeasure": code, "netWeight": 300}, "price": {"discounted": cents}}


def payload(run, source, body, slug="sebze", at=AT):
    return (run, source, slug, "tree" if "children" in body or "products" in body else "list", json.dumps(body), at)


FILES = [
    [payload(1, "a", {"data": [item("1", "Domates Kg", 3000), item("2", "Ceviz 500 g", 9000), item("1", "Domates Kg", 3000)]}), payload(1, "b", {"id": "c", "name": "Sebze", "products": [leaf("7", "Biber", 2500, "GR")], "children": []})],
    [payload(1, "a", {"data": [item("1", "Domates Kg", 3000)]}), payload(2, "a", {"data": [item("1", "Domates Kg", 3100), item("3", None, 1), item("4", "Elma Kg", 90_000), item("5", "Elma Kg", 0)]})],
    [payload(2, "b", {"id": "c", "name": "Sebze", "products": [], "children": [{"id": "d", "name": "Kök", "products": [leaf("8", "Havuç 2 kg", 4000)]}]}, at=None), payload(3, "a", {"data": []}), (4, "a", "x", "list", "no json", AT)],
]


def captured(spark, files):
    return spark.createDataFrame([p for f in files for p in f], listings.PAYLOADS)


def staged(rows):
    return sorted((tuple(r) for r in rows.select("run_id", "source_name", "source_product_id", "standardized_product_name", "price", "normalized_unit", "normalized_quantity", "price_per_unit", "reject_reason").collect()), key=str)


def run(spark, tmp_path, window="7 days"):
    ingest.ingest_listings(spark, str(tmp_path / "in"), "*.parquet", str(tmp_path / "out"), str(tmp_path / "check"), window=window)
    return spark.read.parquet(str(tmp_path / "out" / "staging"))


def at_once(spark, files):
    rows = listings.captured_rows(captured(spark, files))
    products = spark.createDataFrame([], "product_id long, name string, category string")
    facts = spark.createDataFrame([], "event_id string, run_id long, source_name string, source_product_id string, product_id long, price double, observed_at timestamp_ntz")
    return standardize.load(rows, standardize.raw_events(rows).limit(0), products, facts, F.lit(AT))


def test_stream_equals_the_load_at_once_with_late_repeats(spark, tmp_path):
    for f in FILES:
        captured(spark, [f]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(spark, tmp_path, "0 seconds")
    want = at_once(spark, FILES)
    assert staged(got) == staged(want["staging"]) and len(staged(got)) == 8
    facts = ingest.ingested_facts(spark, str(tmp_path / "out"))
    assert sorted((r.run_id, r.event_id) for r in facts.collect()) == sorted((r.run_id, r.event_id) for r in want["facts"].collect())
    # the state has forgotten everything by now: only the look into the target finds the repeats
    captured(spark, FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    captured(spark, [[payload(5, "a", {"data": [item("9", "Domates Kg", 3200), item("9", "Patates Kg", 1000)]})]]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = run(spark, tmp_path, "0 seconds")
    assert len(staged(again)) == 10
    names = {(r.name, r.product_id) for r in spark.read.parquet(str(tmp_path / "out" / "products")).collect()}
    assert len(names) == len({n for n, _ in names}) == len({i for _, i in names})
    admitted = ingest.ingested_facts(spark, str(tmp_path / "out"))
    assert {(r.standardized_product_name, r.product_id) for r in admitted.collect()} <= names
    events = spark.read.parquet(str(tmp_path / "out" / "run_events"))
    rows = {r.run_id: r for r in accounting.run_rows(events).collect()}
    assert [(rows[k].records_raw, rows[k].records_fact, rows[k].records_suspicious, rows[k].records_failed) for k in (1, 2, 5)] == [(3, 3, 0, 0), (5, 2, 2, 3), (2, 2, 0, 0)]
    assert rows[1].records_scraped > rows[1].records_raw and 3 not in rows


def test_runs_are_folded_from_their_events(spark):
    runs = spark.createDataFrame([(i, "a") for i in range(5)], "run_id long, source_name string")
    at = lambda h: F.lit(dt.datetime(2024, 3, 1, h)).cast("timestamp")
    counts = {c: F.lit(k) for k, c in enumerate(accounting.COUNTS)}
    log = accounting.run_event(runs.where("run_id < 4"), "start", at(1))
    for part in (
        accounting.run_event(runs.where("run_id in (1, 2)"), "load", at(2), counts=counts), accounting.run_event(runs.where("run_id = 1"), "load", at(3), counts=counts),
        accounting.run_event(runs.where("run_id in (1, 3)"), "finish", at(4)), accounting.run_event(runs.where("run_id = 2"), "fail", at(4), F.lit("e" * 6000)),
        accounting.run_event(runs.where("run_id = 3"), "start", at(5)), accounting.run_event(runs.where("run_id = 4"), "load", at(6), counts=counts),
    ):
        log = log.unionByName(part)
    rows = {r.run_id: r for r in accounting.run_rows(log).collect()}
    assert [rows[i].status for i in range(5)] == ["running", "success", "failed", "running", "running"]
    assert [rows[1][c] for c in accounting.COUNTS] == [0, 2, 4, 6, 8, 10] and rows[0].records_raw == 0
    assert rows[1].started_at.hour == 1 and rows[1].finished_at.hour == 4 and rows[0].finished_at is None
    assert rows[2].error_message == "e" * accounting.MESSAGE and rows[1].error_message is None
    assert accounting.run_rows(log.limit(0)).count() == 0


def test_subtree_is_picked_from_a_tree(spark):
    tree = {"id": "top", "products": [leaf("0", "Up", 100)], "children": [{"id": "c1", "products": [leaf("1", "A", 100)], "children": [{"id": "c2", "name": "in", "products": [leaf("2", "B", 200), leaf("2", "Again", 300)]}]}, {"id": "c3", "products": [leaf("3", "C", "n/a"), "no product"]}, 7]}
    rows = spark.createDataFrame([(1, json.dumps(tree)), (2, "[1]"), (3, None), (4, "[" * 100_000)], "k long, payload string")
    found = lambda pick: sorted((r.k, r.product_id, r.product_name) for r in listings.flatten_tree(rows, carry=("k",), subtree=pick).collect())
    assert found(None) == [(1, "0", "Up"), (1, "1", "A"), (1, "2", "B")]
    assert found("c1") == [(1, "1", "A"), (1, "2", "B")] and found("c2") == [(1, "2", "B")] and found("none") == []


def test_rows_of_many_trees_are_one_batch():
    trees = [json.dumps({"id": str(k), "products": [leaf(str(j), f"N{k}", 100) for j in range(k % 4)]}) for k in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(trees)], names=["k", "payload"])
    out = list(listings.tree_batches(iter([batch]), ["k"], None))
    assert len(out) == 1 and [(r["k"], r["product_id"]) for r in out[0].to_pylist()] == [(k, str(j)) for k in range(1000) for j in range(k % 4)]


def test_names_are_told_once_and_stand_for_the_rows_own(spark):
    rows = listings.captured_rows(captured(spark, FILES))
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    told = standardize.held_names(rows.mapInArrow(seen, rows.schema))
    made = calls.value
    got = standardize.standardize_observations(rows, told)
    assert sorted(map(str, got.collect())) == sorted(map(str, standardize.standardize_observations(rows).collect())) and calls.value == made > 0


def test_a_stream_leaves_the_settings_of_the_session(spark, tmp_path):
    captured(spark, [FILES[0]]).coalesce(1).write.parquet(str(tmp_path / "in"))
    before = {k: spark.conf.get(k, None) for k in ingest._STATE}
    assert run(spark, tmp_path).count() == 3
    assert {k: spark.conf.get(k, None) for k in ingest._STATE} == before

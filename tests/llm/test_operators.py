"""Each corpus operator against plain Python on small tables with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from pricewright.llm import chat, licenses, minhash, mixing, neighbours, packing, pii, quality, queries, repeats, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _hash int"
AWKWARD = [None, "", " \n\t", "a", "a b", "word " * 30_000, "é😀 ñ" * 50, "x" * 5000, "one two three\none two three\n\none two three", "4111 1111 1111 1111 a@b.co.uk 1.2.3.4"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows and clashing names."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None, "x", 1) for i, t in enumerate(AWKWARD)]
    return spark.createDataFrame([*rows, rows[4], rows[4], (None, "no id at all", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


OPERATORS = {
    "quality": quality.judge,
    "pii": pii.with_spans,
    "masked": pii.masked,
    "mixing": mixing.mix,
    "mixed": lambda d: mixing.mixed_rows(d),
    "packing": packing.packed,
    "minhash": minhash.near_duplicates,
    "one_of_each": minhash.one_of_each,
    "licenses": licenses.scan,
    "repeats": repeats.without_repeats,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_are_all_answered(awkward, empty, name):
    assert OPERATORS[name](empty).count() == 0
    n = OPERATORS[name](awkward).count()
    if name in ("mixed", "packing", "one_of_each"):
        assert n > 0
    else:
        assert n == awkward.count()


# 1 -----------------------------------------------------------------------------------------


def test_toxicity_is_learned_from_document_labels(spark):
    clean = ["the cat sat on the mat", "rain fell all day", "bread and butter", "a long walk home"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        said = [clean[(i + k) % 4] for k in range(5)]
        if toxic:
            said[i % 5] = f"you utter {['blarg', 'snorf'][i // 4 % 2]} again"
        rows.append((i, ". ".join(said) + "."))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for (i, y), (_, text) in zip(labels, rows, strict=True):
        if zlib.crc32(str(i).encode()) % 5 == 0:  # never seen in training
            assert (got[i].score >= 0.5) == bool(y)
            if y:
                place = text[got[i].worst_start :].lstrip(". ")
                assert place.startswith("you utter")
    assert got[1000].score == got[1001].score < 0.5


def test_toxic_strings_are_counted_over_all_labelled_rows(spark, monkeypatch):
    rows = [(i, "the cat sat on the mat. " + ("you blarg again." if i % 50 == 0 else "rain fell.") + (f" {'x' * 300}snorf" if i % 50 == 1 else ""), int(i % 50 < 2)) for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "MAX_TRAIN", 10)
    strings = set(toxicity.train(table, table).strings)
    assert {" blarg ", "blar", "xsnorf ", "snor"} <= strings


def test_toxicity_without_labels(spark, docs):
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}


def noisy_or_brute(text, model):
    norm = re.sub(r"[\W_]", " ", f" {(text or '').lower()} ")
    begins = [0, *(m.end() for m in re.finditer(r"[.!?\n]+", text or ""))]
    held = {}
    for s, w in zip(model.strings, model.weights, strict=True):
        for i in range(len(norm) - len(s) + 1):
            if norm[i : i + len(s)] == s:
                held.setdefault(sum(b <= max(0, i + len(s) - 3) for b in begins), {})[s] = w
    clean = 1 - model.leak
    for strings in held.values():
        clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(strings.values()))))
    return 1 - clean


def test_scores_are_the_noisy_or_of_the_sentences(spark, awkward, empty):
    model = toxicity.Model([" two ", "thre", "word", "é", " a@", "one two"], [3.0, -0.5, 0.2, 1.0, 2.0, 0.7], -2.0, 0.05)
    texts = ["One two. THREE three!\nOne-two", "two", "a.b? two. two two", "x_two"]
    rows = awkward.select("doc_id", "text", "kept").where("length(text) < 9999 or text is null").union(spark.createDataFrame([(50 + i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, kept string"))
    given = rows.collect()
    got = toxicity.score(rows, model).collect()
    assert sorted((r.doc_id or -1, round(r.score, 9)) for r in got) == sorted((r.doc_id or -1, round(noisy_or_brute(r.text, model), 9)) for r in given)
    assert toxicity.score(empty, model).count() == 0


def test_repeated_labelled_rows_are_one_document_of_the_sample(spark, monkeypatch):
    rows = [(i, ("you blarg. " if i % 4 == 0 else "rain fell. ") * 2, int(i % 4 == 0)) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.select("doc_id", "toxic")
    hot = table.where("doc_id = 4").selectExpr("*", "explode(sequence(1, 500)) AS kept").drop("kept")
    once, often = toxicity.train(table, labels), toxicity.train(table.union(hot.selectExpr("doc_id", "text", "toxic")), labels.union(labels))
    assert set(once.strings) <= set(often.strings) and abs(once.bias - often.bias) < 1
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda y, *a: (seen.append(len(y)), (np.zeros(a[-1]), 0.0, 0.1))[1])
    toxicity.train(table.union(hot.selectExpr("doc_id", "text", "toxic")), labels.union(labels))
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))]


@pytest.mark.parametrize("most", [5, 40, 3000])
def test_most_telling_strings_are_those_of_a_whole_sort(spark, docs, most):
    known = toxicity.labelled(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "toxic")
    rows = toxicity.training_rows(docs, known, "doc_id", "text")
    every = sorted(((-r.z, r.string) for r in toxicity.telling_strings(rows, 10**6).collect()))
    assert [(-r.z, r.string) for r in toxicity.telling_strings(rows, most).collect()] == every[:most]


# 2 -----------------------------------------------------------------------------------------


def repeats_brute(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p : p + n] for t in texts for p in range(len(t) - n + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - n + 1):
            if seen[t[p : p + n]] > 1:
                gone[p : p + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [250, 1])
def test_repeats_equal_brute_force(spark, docs, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_PARTS", most)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 5000)
    rng = np.random.default_rng(6)
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id < 60").collect()]
    rows += [(500, "x" * 700), (501, "ab" * 250), (502, "ab" * 250), (503, "é" * 130), (504, "q" * 199 + "é" * 130), (None, "z" * 199), (505, "x" * 700), (506, "")]
    passage = "".join(rng.choice(list("abcdef"), 190))  # too short alone, so that its surroundings decide
    for i in range(60):
        left, right = ("".join(rng.choice(list("gh"), 12)) for _ in range(2))
        rows.append((600 + i, f"{i}{'-' * 40}{left}{passage}{right}{'+' * (i % 7)}{i}" + passage[i:]))
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == repeats_brute(rows, 200)


def test_what_stays_is_the_text_without_the_removed_runs(awkward):
    got = repeats.without_repeats(awkward, keep_text=True).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_refine_keeps_equal_starts_only():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 2500).astype(np.uint8)
    data[1400:1900] = data[50:550]
    starts = np.arange(len(data) - 199)
    seen = Counter(bytes(data[i : i + 200]) for i in starts)
    ids = repeats.refine(data, starts, 200, 25)
    assert starts[ids >= 0].tolist() == [i for i in starts if seen[bytes(data[i : i + 200])] > 1]
    assert (ids[50:351] == ids[1400:1701]).all() and len(set(ids[50:351].tolist())) == 301


def test_first_buckets_do_not_trust_hashes(monkeypatch):
    data = np.frombuffer(b"abcabcabd", np.uint8)
    for hashes in (repeats.gram_hashes, lambda data, n: np.zeros(len(data) - n + 1, np.uint64)):
        monkeypatch.setattr(repeats, "gram_hashes", hashes)
        ids = repeats.first_buckets(data, np.array([0, 3, 6, 1, 4]), 3).tolist()
        assert ids[0] == ids[1] and ids[3] == ids[4] and len(set(ids)) == 3


def test_anchors_of_equal_strings_stand_at_equal_places():
    rng = np.random.default_rng(9)
    texts = [rng.integers(97, 100, int(n)).astype(np.uint8) for n in rng.integers(100, 900, 20)]
    texts[7][100:400] = texts[3][:300] if len(texts[3]) >= 300 and len(texts[7]) >= 400 else texts[7][100:400]
    texts.append(np.tile(np.frombuffer(b"word ", np.uint8), 100))
    together = repeats.anchors(np.concatenate(texts), np.array(list(map(len, texts))))
    for k, t in enumerate(texts):
        text, at, lo, hi, g = (c[together[0] == k] for c in together)
        assert np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)] or [[]]).tolist() == list(range(max(0, len(t) - 199)))
        h = repeats.gram_hashes(t, 50) >> np.uint64(31)
        for i in range(0, len(t) - 199, 7):
            r = int(np.flatnonzero((lo <= i) & (hi >= i))[0])
            assert at[r] == i + int(np.argmin(h[i : i + 151]))


# 3 -----------------------------------------------------------------------------------------


def test_license_base_and_fuzzy(spark, docs):
    more = [(9001, "Permision is hereby granted, free of charge to any persn obtaining a copie"), (9002, "MIT  License; mit-license\nmit\nlicense"), (9003, "permission is granted")]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r for r in licenses.scan(every).collect()}
    for r in every.collect():
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        at = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert g.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(","))
    assert got[9001].labels == "mit" and 0.9 < got[9001].score < 1 and got[9001].n_base == 0
    assert got[9002].n_base == 3 and got[9003].labels == ""


# 4 -----------------------------------------------------------------------------------------


def targets_brute(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in rest) for s in names}
        over = {s for s in rest if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_reaches_its_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), s) for i, s in enumerate(["a"] * 30 + ["b"] * 600 + ["c"] * 50 + [None] * 20 + ["d"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes: Counter = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = targets_brute(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)
    for s in sizes:  # whole epochs first
        assert {r.times - int(want[s] / sizes[s] + 1e-9) for r in got if r.source == s} <= {0, 1}
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    assert mixing.mixed_rows(df).count() == sum(r.times for r in got)


def test_repeated_rows_and_capped_sources_keep_their_promises(spark, monkeypatch):
    """Equal rows come as near to a target as others; empty texts of a capped source are taken
    three times at most; many sources are put in order in parts."""
    rows = [(1, "one two three four five six seven eight nine ten", "a")] * 500 + [(2, "w " * 10, "b")] * 500
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == 1000 and all(abs(taken[s] - target[s]) <= 5 for s in "ab")
    small = spark.createDataFrame([(i, "w " * 50, "z") for i in range(50)] + [(100, "x y", "a"), (101, "", "a"), (102, None, "a")], "doc_id long, text string, source string")
    assert max(r.times for r in mixing.mix(small).collect()) == 3
    assert mixing.mixed_rows(small).where("doc_id = 101").count() == 3
    monkeypatch.setattr(mixing, "SOURCES_A_TASK", 3)
    many = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 23}" if i % 23 else None) for i in range(400)], "doc_id long, text string, source string")
    sizes = {r.source: r.source_size for r in mixing.mix(many).collect()}
    want = targets_brute(sizes)
    assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9) for r in mixing.mix(many).collect())


# 5 -----------------------------------------------------------------------------------------


def counts_brute(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark, docs, awkward):
    for df in (docs, awkward):
        for r in quality.judge(df).collect():
            n = counts_brute(r.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
            assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in quality.judge(docs).where("not base_failed").collect() if r.doc_id in labels]
    assert np.mean([kept for q, kept in judged if q]) > 0.9 and not any(kept for q, kept in judged if not q)


def test_sketches_merge_to_the_same_fences(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}{k}" for k in range(50 + i % 90)), "en", f"s{i % 3}") for i in range(600)], "text string, lang string, source string")
    whole = quality.sketches(quality.with_counts(df))
    parts = [quality.sketches(quality.with_counts(df.where(f"length(text) % 3 = {k}"))) for k in range(3)]
    merged = parts[0].union(parts[1]).union(parts[2])
    for keys in (["lang", "source"], ["lang"], []):
        fences = sorted(map(tuple, quality.fences(whole, keys).collect()))
        assert fences == sorted(map(tuple, quality.fences(merged, keys).collect())) and len({f[-4] for f in fences}) == len(quality.RATES)
        assert {f[-1] for f in fences if f[-4] == "dup_line_rate"} == {None} and {f[-2] for f in fences if f[-4] == "dup_line_rate"} == {0}


def test_buckets_hold_a_value_to_one_part_in_128(spark):
    n = [0, 1, 100, 255, 256, 257, 999, 12_345, 999_999, 6_543_210]
    rows = [(0, x, 0, 0, 0, 1, 0, 0) for x in n]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in quality.COUNTS)).selectExpr("*", "'l' AS lang", "string(word_chars) AS source").withColumn("n_words", F.lit(1_000_000))
    got = {int(r.source): r.bucket for r in quality.sketches(df).where("rate = 'word_length'").collect()}
    assert all(got[x] <= x <= got[x] + got[x] / 128 for x in n)


def test_thresholds_are_those_of_the_group(spark):
    """A text of long words is ordinary where all are, and not kept in a source of short ones."""
    rng = np.random.default_rng(1)
    say = lambda size: " ".join("".join(rng.choice(list("abcdefgh"), max(1, int(rng.normal(size, 1))))) for _ in range(80))
    rows = [(i, say(5), "en", "short") for i in range(1200)] + [(2000 + i, say(9), "en", "long") for i in range(1200)]
    rows += [(4000, rows[1500][1], "en", "short"), (4001, rows[1500][1], "en", "long"), (4002, rows[1500][1], "en", None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[4000].kept and got[4001].kept and got[4000].max_word_length < 8e6 < 9e6 < got[4001].max_word_length
    assert got[4000].max_word_length < got[4002].max_word_length  # few documents: near the whole corpus
    assert np.mean([got[i].kept for i in range(1200)]) > 0.97 and np.mean([got[2000 + i].kept for i in range(1200)]) > 0.97


def test_thresholds_of_all_rates_differ_between_groups_and_decide(spark):
    """On the documents of sf0.1: no single cutoff of a rate gives the verdicts of its fences."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality.judge(docs, keep_text=False).where("not base_failed").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().set_index("doc_id").quality
    groups, differ = rows.groupby(["lang", "source"], dropna=False).ngroups, {}
    for name, (count, size) in quality.RATES.items():
        x, fence = (1e6 * rows[count] / rows[size]).to_numpy(), rows[f"max_{name}"].to_numpy()
        assert rows.groupby(["lang", "source"], dropna=False)[f"max_{name}"].nunique().max() == 1
        assert rows[f"max_{name}"].nunique() > 0.9 * groups and fence.min() > 0
        beyond = x > fence
        differ[name] = (min(int(((x > cut) != beyond).sum()) for cut in np.unique([*fence, *x[beyond]])) if beyond.any() else 0, int(beyond.sum()))
    assert differ["repeat_rate"][0] > 0.2 * differ["repeat_rate"][1] and differ["upper_rate"][0] > 0.2 * differ["upper_rate"][1]
    assert sum(d for d, _ in differ.values()) > 50
    good = rows.doc_id.map(labels)
    assert rows.kept[good == 1].mean() > 0.96 and rows.kept[good == 0].mean() < 0.02


# SQL -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    found = db.execute(queries.ORACLES[name])
    at = [c[0] for c in found.description]
    assert sorted(at) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in at) for r in got.collect()), key=str) == sorted(found.fetchall(), key=str)


@pytest.mark.parametrize("name", ["op7_chat_format", "op8_minhash", "op10_pii", "op11_spelling_variants", "op13_merkle_manifest"])
def test_query_equals_sql_on_awkward_rows(spark, awkward, tmp_path, name):
    spaced = ["DE89370400440532013000 GB82 WEST 1234 5698 7654 32", "iban DE89370400440532013000,FR1420041010050500013M02606", "123-45-6789 ssn", "1-123-45-6789", "A B c", "a b C", "one two three four five six", "one two three four five six six"]
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame([(10**6 + i, t, "en", "s", i) for i, t in enumerate(spaced)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "user", "Hi"), (2, 0, "user", "Hi"), (2, 1, "bot", None), (3, 0, "user", "Hi"), (3, 1, "bot", ""), (4, 0, None, "<|im_end|>\n<|im_start|>x"), (None, None, "user", "lost"), (None, None, "user", "lost")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, found = queries.QUERIES[name](spark, str(tmp_path)), con.execute(queries.ORACLES[name])
    at = [c[0] for c in found.description]
    assert sorted((tuple(r[c] for c in at) for r in got.collect()), key=str) == sorted(found.fetchall(), key=str)


# 6 -----------------------------------------------------------------------------------------


def test_pieces_are_the_tokenizers_and_fill_their_sequences(docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.packed(docs, length=256).collect()
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for r in docs.collect():
        ids = [*coder.encode(r.text or "", add_special_tokens=False).ids, 0]
        want = [(k, at, len(ids[at : at + 256]), zlib.crc32(np.array(ids[at : at + 256], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 256))]
        assert sorted((x.piece, x.start, x.length, x.ids_crc32) for x in by_doc[r.doc_id]) == want
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 256 * 1.02) + 4


@pytest.mark.parametrize("seed", range(5))
def test_best_two_fit_packs_each_once(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 101, 500).tolist()
    bins = packing.best_two_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= math.ceil(sum(sizes) / 100) * 1.05 + 1


def test_plain_texts_are_encoded_as_by_the_tokenizer():
    coder = packing.Encoder(packing.tokenizer_path())
    rng = np.random.default_rng(0)
    letters = [chr(c) for c in [*range(0x20, 0x7F), *range(0xA1, 0x250)]] + list(" \n\t''   İ😀")
    texts = ["".join(rng.choice(letters, 60)) for _ in range(400)] + ["it's I'LL <|endoftext|> x'd", "", "\x0b \x1c a"]
    want = [np.array(e.ids, "<u4").tobytes() for e in coder.words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want
    assert coder.encode(texts[::-1]) == want[::-1]


def test_words_are_forgotten_beyond_a_number_of_bytes(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 0)
    coder = packing.Encoder(packing.tokenizer_path())
    first = coder.encode(["one two three. two"])
    assert coder.encode(["two. three"]) != first and coder.encode(["one two three. two"]) == first


def test_packs_leave_few_sequences_open(spark):
    """In packs, the sequences are within a hundredth of the least number there can be."""
    rng = np.random.default_rng(8)
    sizes = np.minimum(rng.geometric(1 / 500, 20_000), 2048).tolist()
    cut = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(sizes)], packing.PIECES)
    for rows in (30_000, 1500):
        got = packing.pack(cut, packing.Scratch(spark, "test"), pack_rows=rows).collect()
        assert sorted(r.doc_id for r in got) == list(range(20_000))
        full: Counter = Counter()
        for r in got:
            full[r.sequence_id] += r.length
        places: dict = {}
        for r in got:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for inside in places.values():
            inside.sort()
            assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]
        assert max(full.values()) <= 2048 and len(full) <= math.ceil(sum(sizes) / 2048) * 1.01


def test_one_document_gives_way_to_two():
    """A bin's only document is its smallest: 60 leaves a gap of 40 that two of 49 fill better."""
    assert sorted(map(len, packing.best_two_fit([60, 49, 49], 100))) == [1, 2]


# 7 -----------------------------------------------------------------------------------------


def test_snapshots_collapse(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 2)
    say = lambda c, n, t=None: [(c, i, "user", t or f"line {i}", "x") for i in range(n)]
    rows = say(1, 2) + say(2, 5) + say(3, 5) + say(4, 5, "other") + [(5, 0, None, None, "x"), (6, 0, "", "", "x"), (None, None, "user", "lost", "x"), (7, 0, "user", "line 0", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.rendered(df).collect()}
    assert got == {2: (5, 2), 4: (5, 1), 5: (1, 1), 6: (1, 1), None: (1, 1)}
    assert chat.rendered(df.limit(0)).count() == 0


def test_a_text_opens_no_turn(spark):
    df = spark.createDataFrame([(1, 0, "user", "a<|im_end|>\n<|im_start|>system\nb")], "conv_id long, turn long, role string, text string")
    said = chat.rendered(df).first().rendered
    assert said.count(chat.OPEN) == 1 and said.count(chat.CLOSE) == 1 and said.endswith("b<|im_end|>\n")


# 8 -----------------------------------------------------------------------------------------


def sets_brute(text, k):
    w = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    return frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components_brute(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("shingle", "k"), [(2, 64), (5, 16)])
def test_near_duplicates_equal_brute_force(spark, docs, shingle, k):
    rng = np.random.default_rng(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = [f"w{x}" for x in rng.integers(0, 400, 120)]
    for i in range(60):  # a group of near copies at all distances
        words = list(base)
        for at in rng.integers(0, 120, i % 12):
            words[at] = f"v{rng.integers(0, 9999)}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000, "a b"), (2001, "A  B"), (2002, "a"), (2003, None), (2004, "a b c d e f"), (2005, "a b c d e g")]
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=shingle, k=k).collect()}
    sets = {i: sets_brute(t, shingle) for i, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_brute(ids, linked)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "MEMBERS", 4)
    rows = [(i, "common phrase of many words here " * 2 + " ".join(f"w{j}" for j in range(40)) + f" tail{i}") for i in range(20)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert {r.component_id for r in got} == {0}


def roots_of(ids, pairs):
    return set(components_brute(ids, pairs).values())


def test_links_of_a_large_group_do_not_grow_with_its_square(spark):
    n = 60  # every member links with every other one, none has met another yet
    texts = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40)) + f" tail{i}") for i in range(n)], "cid long, text string")
    members = texts.select("cid", F.lit(0).cast("long").alias("cluster"), F.col("cid").alias("root"))
    links = [(r.a, r.b) for r in minhash.linked_within(members, texts, shingle=2).collect()]
    assert len(links) < n and roots_of(range(n), links) == {0}
    lists = members.select(F.lit(7).cast("long").alias("value"), "cid", F.lit(40).alias("n"), F.lit(-1).cast("long").alias("bits1"), F.col("cid").alias("bits2"), F.lit(9.0).alias("most"), F.lit(1).alias("blocks"), "root")
    pairs = [(r.a, r.b) for r in minhash.crossing_pairs(lists).collect()]
    assert len(pairs) < n and roots_of(range(n), pairs) == {0}


def test_crossing_pairs_join_what_all_pairs_join(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng = np.random.default_rng(8)
    rows = [(i % 3, i, int(rng.integers(30, 45)), -int(rng.integers(1, 32)), int(rng.integers(0, 512)), float(rng.integers(3, 4)), i - i % 2) for i in range(80)]
    lists = spark.createDataFrame(rows, "value long, cid long, n int, bits1 long, bits2 long, most double, root long")
    may = [(x[1], y[1]) for k, x in enumerate(rows) for y in rows[:k] if x[0] == y[0] and x[6] != y[6] and min(x[2], y[2]) >= 0.8 * max(x[2], y[2]) - 1e-9 and ((x[3] ^ y[3]) % 2**64).bit_count() + (x[4] ^ y[4]).bit_count() <= max(x[5], y[5])]
    own = [(x[1], x[6]) for x in rows]
    pairs = [(r.a, r.b) for r in minhash.crossing_pairs(lists).collect()]
    assert {tuple(sorted(p)) for p in pairs} <= {tuple(sorted(p)) for p in may}
    want = components_brute(range(80), own + may)
    assert components_brute(range(80), own + pairs) == want
    assert 1 < len(set(want.values())) < 30


def test_large_groups_of_near_copies_equal_brute_force(spark, monkeypatch):
    for name, size in (("BLOCK", 8), ("MEMBERS", 8), ("CENTRES", 3)):
        monkeypatch.setattr(minhash, name, size)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in range(80)]
    rows = [(5000, " ".join(base))]
    for i in range(150):
        words = list(base)
        for at in rng.integers(0, 80, 4 + i % 4):
            words[at] = f"v{rng.integers(0, 9999)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    sets = {i: sets_brute(t, 2) for i, t in rows}
    linked = [(a, b) for n, a in enumerate(sets) for b in list(sets)[:n] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert got == components_brute(sorted(sets), linked)
    grouped = spark.range(30).select(F.col("id").alias("cid"), F.when(F.col("id") < 22, 0).otherwise(22).cast("long").alias("cluster"))
    pairs = minhash.centre_pairs(grouped).collect()
    assert {r.a for r in pairs} == set(range(22)) and len({r.b for r in pairs}) == 3 and len(pairs) == 22 * 3 - 3


def test_one_of_each_keeps_one_row_of_repeated_ones(spark):
    text = " ".join(f"w{j}" for j in range(50))
    rows = [(1, text), (1, text), (2, text + " x"), (3, None), (3, None), (4, "")]
    got = sorted(r.doc_id for r in minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got.count(1) == 1 and 2 not in got and 4 in got and 3 in got


# 9 -----------------------------------------------------------------------------------------


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    x[100:160] = x[0] + 0.05 * rng.standard_normal((60, 16))
    x[160:170] = x[1]
    label = [int(i % 3 == 2) if i < 100 else 0 for i in range(300)]
    label[0] = label[1] = 0
    rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(300)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, rows[0][1], None), (904, rows[0][1][:8], 0), (905, [None] * 16, 0)]
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    want = components_brute(range(300), [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    found = sum(min(got[i].n_links, int(near[i].sum())) for i in range(300))
    assert found >= 0.95 * near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(300))
    assert sum(got[i].component_id == want[i] for i in range(300)) >= 295
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906))
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_of_any_scale_and_repeated_rows(spark):
    rows = [(1, [3e200, 4e200], 0, 1), (2, [3e-200, 4e-200], 0, 1), (3, [3.0, 4.0], 0, 1), (3, [3.0, 4.0], 0, 1), (4, [-4.0, 3.0], 0, None), (None, [3.0, 4.0], 0, 1)]
    got = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, root int")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == [("1", 4, 1), ("2", 4, 1), ("3", 4, 1), ("3", 4, 1), ("4", 0, 4), ("None", 4, 1)]


def test_every_pair_is_compared_where_no_audit_is_passed(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    x = [centres[i % 12] + rng.normal(size=6) * 0.18 for i in range(150)]
    rows = [(i, v.tolist(), i % 3 if i % 17 else None) for i, v in enumerate(x)] + [(500, x[1].tolist(), 1), (501, x[1].tolist(), 1), (None, x[3].tolist(), 0)]
    monkeypatch.setattr(neighbours, "AUDITS", 1)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "audited", lambda *a: 0.5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect() if r.vec_id is not None}
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v, _ in rows}
    pairs = [(a, b) for n, (a, _, s) in enumerate(rows) for b, _, t in rows[:n] if s is not None and s == t and unit[a] @ unit[b] >= neighbours.SIMILARITY]
    links = Counter(k for p in pairs for k in p)
    inside = [p for p in pairs if None not in p]
    roots = components_brute([r[0] for r in rows if r[0] is not None], inside)
    assert got == {k: (links[k], roots[k]) for k, _, _ in rows if k is not None} and len(set(roots.values())) > 12


def test_neighbour_signs_grow_with_a_label(spark):
    sizes = spark.range(400_000).selectExpr("id AS node", "struct(int(id < 1000) AS label, 4 AS length) AS space")
    assert {r.space.label: r.n_signs for r in neighbours.signs_of(sizes).collect()} == {1: 10, 0: 14}


def test_neighbours_keep_the_one_link_between_dense_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)

    def turned(degrees, n):  # noisy copies of a direction in the plane of the first two axes
        x = 0.004 * rng.standard_normal((n, 16))
        x[:, 0] += np.cos(np.radians(degrees))
        x[:, 1] += np.sin(np.radians(degrees))
        return x

    x = np.concatenate([turned(0, 150), turned(30, 150), turned(12, 1), turned(33 - 0.5, 1)])
    x[300, :2], x[301, :2] = (np.cos(np.radians(5)), np.sin(np.radians(5))), (np.cos(np.radians(25)), np.sin(np.radians(25)))
    x[300:, 2:] = 0
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    np.fill_diagonal(near, False)
    first = np.r_[0:150, 300]
    assert near[np.ix_(first, np.r_[150:300, 301])].sum() == 1  # 300 with 301 alone
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    got = {r.vec_id: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {r.component_id for r in got.values()} == {0}
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()


def test_forests_join_what_the_links_join():
    rng = np.random.default_rng(1)
    near = rng.random((60, 60)) < 0.02
    near |= near.T
    np.fill_diagonal(near, False)
    a, b = neighbours.forest(near)
    pairs = list(zip(*np.nonzero(near), strict=True))
    assert len(a) < 60 and near[a, b].all()
    assert components_brute(range(60), list(zip(a, b, strict=True))) == components_brute(range(60), pairs)


# 10 ----------------------------------------------------------------------------------------


def luhn_brute(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def pii_brute(t):
    t, out = t or "", []
    for kind, p in [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]:
        for m in re.finditer(p, t):
            n = sum(c in "0123456789" for c in m[0])
            fine = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= n <= 19 and luhn_brute(m[0]), "phone": 8 <= n <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] * fine
    return out


def test_pii_equals_brute_force(spark, docs, awkward, monkeypatch):
    monkeypatch.setattr(pii, "RUN", 4)
    more = ["a@b.c.@d.e x@y.zz", "1 " * 3000, "+1" + " " * 300 + "(555) 555-5555", "1.2.3.4.5.6.7.8 " * 40, "a." * 3000 + "@x." + "y." * 3000, "😀 a@b.co DE89370400440532013000 ssn 123-45-6789 987-65-4321", "00001.2.3.0255 1.2.3.256"]
    every = docs.select("doc_id", "text").union(awkward.select("doc_id", "text")).union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    got = pii.with_spans(every).select("doc_id", "text", pii._listed(pii.BASE).alias("base"), pii._listed([*pii.BASE, *pii.MORE]).alias("every")).collect()
    for r in got:
        assert r.base == ",".join(pii_brute(r.text))
    last = {r.doc_id: r.every for r in got}[10**6 + 5]
    assert "iban:9:31" in last and last.count("ssn:") == 2


def mod97_brute(v):
    v = v.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def further_brute(t):
    t, out = t or "", []
    for kind in pii.MORE:
        for m in re.finditer(pii.MORE[kind], t):
            near = re.search(pii.CONTEXT[kind], t[max(0, m.start() - pii.NEAR) : m.end() + pii.NEAR].lower())
            score = pii.PRIOR[kind] + (pii.LIFT if near else 0)
            if (kind == "ssn" or mod97_brute(m[0])) and score >= pii.LEAST:
                out.append((kind, m.start(), m.end(), round(score, 2)))
    return out


def test_further_spans_and_scores_equal_brute_force(spark, docs):
    more = ["DE89370400440532013000 then GB82 WEST 1234 5698 7654 32.", "DE88370400440532013000", "order 123-45-6789", "taxpayer" + " " * 31 + "123-45-6789", "taxpayer" + " " * 33 + "123-45-6789"]
    every = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    rows = pii.with_spans(every).select("doc_id", "text", *[f"pii_{k}" for k in pii.MORE]).collect()
    for r in rows:
        got = [(x.kind, x.start, x.stop, round(x.score, 2)) for k in pii.MORE for x in r[f"pii_{k}"]]
        assert got == further_brute(r.text)
    assert [len(further_brute(t)) for t in more] == [2, 0, 0, 1, 0]


def test_masking_leaves_no_span(spark, awkward):
    out = pii.masked(awkward)
    assert out.columns == awkward.columns
    assert not any(pii_brute(r.text) for r in out.collect())


# the pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = stage(spark, docs, SF).cache()
    kept = {r.doc_id for r in quality.judge(seen["quality"]).where("kept").collect()}
    assert {r.doc_id for r in seen["near_dedup"].collect()} == kept
    sets = {r.doc_id: sets_brute(r.text, 2) for r in seen["near_dedup"].collect()}
    ids = sorted(sets)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in seen["pii"].collect()} == {i for i, root in components_brute(ids, linked).items() if i == root}
    masked = seen["mix"].collect()
    assert len(masked) == seen["pii"].count() and not any(pii_brute(r.text) for r in masked)
    taken = Counter(r.doc_id for r in seen["pack"].collect())
    assert max(taken.values()) <= 3
    packed = Counter(r.doc_id for r in docs.where("piece = 0").collect())
    assert packed == taken
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_queries_are_registered():
    assert len(queries.QUERIES) == 13 and set(queries.ORACLES) <= set(queries.QUERIES)

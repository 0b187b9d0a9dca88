"""Spelling variants, main text of pages and the Merkle manifest against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricewright.llm import extraction, merkle, spelling
from pricewright.llm.page_examples import PAGES
from pricewright.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, tree int, node string, pos long"


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 11 ----------------------------------------------------------------------------------------


def near_brute(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_brute(counts):
    words = {w: n for w, n in counts.items() if n >= 5}
    others = {w: [x for x in words if near_brute(w, x)] for w in words}
    form = {}
    for w, near in others.items():
        best = min(near, key=lambda x: (-words[x], x.encode()), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(others[w]), words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("part", [1 << 20, 1])
def test_variants_equal_brute_force(spark, monkeypatch, part):
    """Also with a filter that is sent block by block."""
    monkeypatch.setattr(spelling, "PART_BLOCKS", part)
    rng = np.random.default_rng(5)
    counts = {}
    for _ in range(60):
        w = "".join(rng.choice(list("abcéÿ"), int(rng.integers(6, 9))))
        counts[w] = int(rng.choice([4, 5, 30, 200, 1000]))
        for _ in range(3):
            i = int(rng.integers(0, len(w)))
            edited = [w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "é" + w[i + 1 :]][int(rng.integers(0, 3))]
            counts[edited] = int(rng.choice([5, 6, 40]))
    counts |= {"x" * 3000: 5, "x" * 2999: 25, "aaaaaab": 7, "aaaaab": 50}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").selectExpr("explode(array_repeat(word, int(n))) AS word")
    got = spelling.variants(rows.unionByName(spark.createDataFrame([(None,)] * 9, "word string"))).collect()
    assert len(got) == len({r.word for r in got}) and {tuple(r) for r in got} == variants_brute(counts)


def test_runs_lose_a_letter_by_their_hash(spark, docs):
    import re

    def brute(doc_id, text):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            if len(word) >= 6:
                yield word

    more = [(7000 + i, "ÀÉÎ×÷ÿ Straße naïve-Ächzen x\U0001d400yzabcd " + "word" * 30 * (i % 2)) for i in range(300)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([*more, (8000, None), (8001, "")], "doc_id long, text string"))
    got = sorted(r.word for r in spelling.runs(rows).collect())
    assert got == sorted(w for r in rows.collect() for w in brute(r.doc_id, r.text))


def test_filter_never_loses_a_word_and_seldom_adds_one(spark, tmp_path):
    words = [(f"{chr(97 + i % 26)}{i:07d}".translate(str.maketrans("0123456789", "abcdefghij")), 5) for i in range(20_000)]
    vocabulary = spark.createDataFrame(words, "word string, n long")
    shards = spelling.Shards({8: len(words)})
    masks = np.zeros(8 * shards.first[-1], np.uint64)
    part = spelling._built(vocabulary, shards, Scratch(spark, "test")).toArrow()
    masks[part["slot"].to_numpy()] = part["mask"].to_numpy().view(np.uint64)
    prober = spelling.Prober(shards, [97], masks, 0, shards.first[-1])

    def hashes(texts):
        return np.concatenate([(codes * spelling._powers(n)[:n]).sum(axis=1, dtype=np.uint64) for n, _, codes in spelling._by_length(texts)])

    assert len(prober.maybe(8, hashes([w for w, _ in words]))) == len(words)
    other = [f"zz{i:06d}".translate(str.maketrans("0123456789", "klmnopqrst")) for i in range(100_000)]
    assert len(prober.maybe(8, hashes(other))) < 30


def test_no_words_no_variants(empty):
    assert spelling.variants(spelling.runs(empty)).count() == 0


@pytest.fixture(scope="module")
def docs(spark):
    from conftest import SF

    return spark.read.parquet(f"{SF}/documents.parquet")


# 12 ----------------------------------------------------------------------------------------


def main_text(page, tree):
    blocks = extraction.Blocks(page)
    return "\n".join(t for t, m in zip(blocks.text, tree.predict(blocks.features()), strict=True) if m)


@pytest.fixture(scope="module")
def tree(spark):
    return extraction.train(extraction.labelled_pages(spark))


def test_tree_learns_its_table_and_pages_that_it_has_not_seen(tree):
    pages = [extraction.Blocks(p) for p in PAGES]
    for p in pages:
        assert tree.predict(p.features()).tolist() == p.labels
    wrong = blocks = 0
    for i, p in enumerate(pages):
        rest = [q for j, q in enumerate(pages) if j != i]
        other = extraction.Tree.fit(np.vstack([q.features() for q in rest]), np.concatenate([np.array(q.labels) for q in rest]))
        wrong += int((other.predict(p.features()) != np.array(p.labels)).sum())
        blocks += len(p.labels)
    assert wrong <= 0.1 * blocks


def test_trees_are_those_of_plain_search():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (80, 3)).astype(float)
    y = (x[:, 0] > 2) & (x[:, 2] < 4)
    assert (extraction.Tree.fit(x, y).predict(x) == y).all()
    one = extraction.Tree.fit(x, y, depth=1)
    best = min(np.sum(((x[:, f] <= c) == side) != y) for f in range(3) for c in range(6) for side in (True, False))
    assert np.sum(one.predict(x) != y) <= best + 8  # impurity, not errors, picks the cut


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<article><h1>A</h1><p>b &lt;i&gt; &eacute;&nbsp;\n c<br>d</p></article>", "A\nb <i> é c d"),
        ("<article><p>one<form>no</form><p>two<script>var x='</p>'</script> three</article>", "one\ntwo three"),
        ('<nav>no no</nav><div class="content"><h2>Head</h2><p>x.</p><aside>no</aside></div><footer>no', "Head\nx."),
        ("<article><!-- <p>no</p> --><p>yes <b>bold<p>more</article><!-- open <p>no", "yes bold\nmore"),
        ('<article><p title="a > b">t</p><STYLE>p{}</STYLE></article><div id=comments><p>A comment of many words that reads just like the text above it does.</p></div>', "t"),
        ('<body class="no-sidebar"><main><ul><li>1 < 2</li><li><a href="x">a link</a></li></ul></main>', "1 < 2\na link"),
        ("<article><p>last", "last"),
    ],
)
def test_main_text(tree, page, want):
    assert main_text(page, tree) == want


def test_articles_of_the_pages_are_found_whole(spark, tree):
    """The generated pages put the main text into one article."""
    import html
    import re

    from conftest import SF

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in extraction.op12_html_extraction(spark, SF).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:h1|p)>", article))
        assert got[r.page_id].text == "\n".join(filter(None, parts)) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_pages_of_any_kind_get_a_row(spark, tree):
    rows = [(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2), (2, None, "<article>" + "<p>x</p>" * 50_000, 3), (3, "u", "<" * 5000 + "<a '\">" * 5000, 4)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extraction.extract(table, tree).collect()
    assert [(r.page_id, r.url) for r in got] == [r[:2] for r in rows] and [r.n_chars for r in got][:4] == [0, 0, 0, 99_999]
    assert extraction.extract(table.limit(0), tree).count() == 0
    none = extraction.train(table.limit(0))
    assert {r.text for r in extraction.extract(table, none).collect()} == {""}


def test_very_long_pages_take_time_in_proportion():
    import time

    took = []
    for n in (20_000, 40_000):
        page = "".join(f"<p title='x\" {i}'>a {i}<b>" for i in range(n))
        began = time.perf_counter()
        extraction.Blocks(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0]


# 13 ----------------------------------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def levels_brute(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path_brute(levels, i):
    path = []
    for nodes in levels[:-1]:
        other = i ^ 1
        path.append("-" if other >= len(nodes) else ("L" if other < i else "R") + nodes[other])
        i >>= 1
    return path


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(0, 3))
def test_appended_trees_are_those_of_whole_levels(n, more):
    nodes = [sha(str(i)) for i in range(n)]
    levels, tree = levels_brute(nodes), merkle.Witnesses()
    for k, node in enumerate(nodes):
        tree.append(node)
        # the open subtrees are aligned: their sizes are the binary digits of the leaves so far
        assert [1 << level for level, _, _ in tree.open] == [1 << b for b in reversed(range(8)) if (k + 1) >> b & 1]
    height = len(levels) - 1 + more
    tree.close(height)
    root = levels[-1][0]
    for _ in range(more):
        root = sha(root)
    assert tree.open == [(height, 0, root)]
    assert tree.paths == [path_brute(levels, i) + ["-"] * more for i in range(n)]


def leaf_brute(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_brute_force(spark, monkeypatch, levels):
    """Also with blocks so small that roots of blocks are appended several times."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [dict(doc_id=i * 7 % 41, text=f"text é {i}" if i % 5 else None, lang=[None, "en", "de", "é", "en"][i % 5], source="s" if i % 3 else "", n_chars=None if i % 4 else i) for i in range(41)]
    rows += [rows[1], rows[1], rows[3], dict(doc_id=None, text="", lang="en", source=None, n_chars=1), dict(doc_id=99, text="alone", lang="fr", source="s", n_chars=5)]
    table = spark.createDataFrame([(*[r[c] for c in merkle.COLUMNS], 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree int, node string")
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    of = {n: sorted(trees[n], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_brute(r))) for n in names}
    low = {n: levels_brute([leaf_brute(r) for r in of[n]]) for n in names}
    top = levels_brute([low[n][-1][0] for n in names])
    want = sorted(str((n, r["doc_id"], leaf_brute(r), low[n][-1][0], top[-1][0], path_brute(low[n], i) + path_brute(top, k))) for k, n in enumerate(names) for i, r in enumerate(of[n]))
    assert sorted(str(tuple(r)) for r in merkle.manifest(table).collect()) == want


def test_witness_shows_what_was_changed(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) == (r.folded_root == r.root)


def test_empty_manifest(empty):
    assert merkle.manifest(empty).count() == 0

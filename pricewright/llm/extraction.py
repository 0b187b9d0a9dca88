"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is read once as a flat run of tags and text. Every element that starts a new line ends a
block, so there is no tree of elements, only blocks and the containers that are open around
them. A block is described by its words and its link density (the share of its characters that
stand in links), by those of the block before and the block after, and by its containers: how
many name it as something beside the main text (menus, notices, adverts, comments ..), whether
one names it as main text, and whether it is a heading. A decision tree (CART, Gini impurity)
is fitted to the blocks of a small labelled table of pages and sent with the task: pages
are independent, so there is no shuffle, and a worker holds one page at a time.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .page_examples import PAGES

#: Labelled pages read at most, and how deep the tree grows.
MAX_LABELLED, MAX_DEPTH = 1000, 6

#: Fixed values of HTML: elements without text to show; elements that do not end a block.
UNSEEN = "script style noscript template iframe object svg math title textarea select button audio video canvas datalist"
INLINE = "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
CONTAINERS = "article aside body center details dialog div dl fieldset figure footer form header main menu nav ol section table ul"
BESIDE = "aside dialog fieldset footer form menu nav"
HEADINGS = "h1 h2 h3 h4 h5 h6"
#: Words in class, id and role that name what stands beside a main text, and the main text.
BESIDE_WORDS = "ad ads advert advertisement adverts aside alert banner breadcrumb breadcrumbs comment comments commentlist contentinfo cookie cookies consent disqus disclaimer dialog footer form header masthead menu nav navbar navigation newsletter notice notification pager pagination popup promo promoted related recommended reply replies respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar topbar widget complementary"
MAIN_WORDS = "article body content entry main post story text"
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "beside", "main", "heading"]

_sets = {k: frozenset(v.split()) for k, v in {"inline": INLINE, "containers": CONTAINERS, "beside": BESIDE, "headings": HEADINGS, "beside_words": BESIDE_WORDS, "main_words": MAIN_WORDS}.items()}
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    rf"|<(?P<unseen>{UNSEEN.replace(' ', '|')})(?=[\s/>])[^>]*+(?:>.*?(?:</(?P=unseen)(?=[\s/>])[^>]*+>?|\Z)|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?>[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<[/!?a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_WORD = re.compile(r"[a-z]+")
_LABEL = re.compile(r"\bdata-main\b", re.I)


def _named(rest: str) -> set[str]:
    """The words of a tag's class, id and role."""
    out = set()
    for m in _NAMES.finditer(rest):
        for name in "".join(x or "" for x in m.groups()).lower().split():
            words = set(_WORD.findall(name))
            if not words & {"has", "no", "with", "without"}:
                out |= words
    return out


class Blocks:
    """The blocks of a page in page order: text, and for each its features and label."""

    def __init__(self, page: str):
        self.text: list[str] = []
        self.rows: list[list[float]] = []
        self.labels: list[bool] = []
        self._parts: list[str] = []
        self._linked: list[str] = []
        self._open: list[tuple[str, int, int]] = []  # containers: name, beside, main
        self._in_link = self._heading = self._label = False
        last = 0
        for token in _TOKEN.finditer(page):
            self._add(page[last : token.start()])
            last = token.end()
            name = token["name"]
            if name is None:
                if token["unseen"] is None:
                    continue
                name = token["unseen"].lower()
                if name in ("title", "textarea", "select", "button"):
                    self._end()
                continue
            self._tag(name.lower(), bool(token["close"]), token["rest"])
        self._add(page[last:])
        self._end()

    def _tag(self, name: str, close: bool, rest: str) -> None:
        if name == "a":
            self._in_link = not close
            return
        if name in _sets["inline"]:
            if name == "br":
                self._add(" ")
            return
        self._end()
        self._in_link = False
        self._heading = name in _sets["headings"] and not close
        self._label = not close and bool(_LABEL.search(rest))
        if name not in _sets["containers"]:
            return
        if close:
            at = next((i for i in range(len(self._open) - 1, -1, -1) if self._open[i][0] == name), None)
            if at is not None:
                del self._open[at:]
            return
        # a whole page may be named after what it has: has-sidebar, with-comments
        said = _named(rest) if rest and name != "body" else set()
        beside, main = (self._open[-1][1:]) if self._open else (0, 0)
        # the head of an article belongs to it, its foot does not; the head of a page does not
        inside = main or bool(said & _sets["main_words"])
        beside += name in _sets["beside"] or (name == "header" and not main) or bool(said & (_sets["beside_words"] - {"header"} if inside else _sets["beside_words"]))
        main += name in ("article", "main") or bool(said & _sets["main_words"])
        self._open.append((name, beside, main))

    def _add(self, text: str) -> None:
        if text:
            self._parts.append(text)
            if self._in_link:
                self._linked.append(text)

    def _end(self) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                linked = len("".join(html.unescape("".join(self._linked)).split()))
                beside, main = self._open[-1][1:] if self._open else (0, 0)
                self.text.append(text)
                self.rows.append([text.count(" ") + 1, linked / (len(text) - text.count(" ")), beside > 0, main > 0, self._heading])
                self.labels.append(self._label)
        self._parts, self._linked = [], []

    def features(self) -> np.ndarray:
        """One row for each block, columns FEATURES; beyond the ends of a page stand zeros."""
        own = np.array(self.rows, float).reshape(-1, 5)
        near = np.zeros((len(own) + 2, 2))
        near[1:-1] = own[:, :2]
        return np.column_stack([own[:, :2], near[:-2], near[2:], own[:, 2:]])


Node = tuple[int, float, int, int, bool]


class Tree:
    """A decision tree: nodes (feature, most that goes left, left, right, verdict); a leaf has
    feature -1."""

    def __init__(self, nodes: list[Node]):
        self.nodes = nodes

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH) -> Tree:
        nodes: list[Node] = []

        def gini(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            """Impurity of two sides, from counts of (all, labelled)."""
            return sum(2 * s[..., 1] * (s[..., 0] - s[..., 1]) / np.maximum(s[..., 0], 1) for s in (left, right))

        def grow(at: np.ndarray, left: int) -> int:
            here, me = y[at], len(nodes)
            nodes.append((-1, 0.0, -1, -1, bool(2 * here.sum() > len(here))))
            best = (gini(np.array([len(here), here.sum()]), np.zeros(2)) - 1e-9, None)
            for f in range(x.shape[1] if left else 0):
                order = np.argsort(x[at, f], kind="stable")
                values, labels = x[at, f][order], here[order]
                cuts = np.flatnonzero(values[1:] > values[:-1])
                if len(cuts):
                    low = np.column_stack([cuts + 1, np.cumsum(labels)[cuts]])
                    scores = gini(low, np.array([len(here), here.sum()]) - low)
                    k = int(np.argmin(scores))
                    if scores[k] < best[0]:
                        best = (scores[k], (f, (values[cuts[k]] + values[cuts[k] + 1]) / 2))
            if best[1] is not None:
                f, most = best[1]
                goes = x[at, f] <= most
                nodes[me] = (f, float(most), grow(at[goes], left - 1), grow(at[~goes], left - 1), nodes[me][4])
            return me

        if len(y):
            grow(np.arange(len(y)), depth)
        return cls(nodes)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)

        def walk(k: int, at: np.ndarray) -> None:
            feature, most, left, right, verdict = self.nodes[k]
            if feature < 0:
                out[at] = verdict
                return
            goes = x[at, feature] <= most
            walk(left, at[goes])
            walk(right, at[~goes])

        if self.nodes:
            walk(0, np.arange(len(x)))
        return out


def labelled_pages(spark) -> DataFrame:
    """The library's own labelled table: (html), main blocks marked by ``data-main``."""
    return spark.createDataFrame([(p,) for p in PAGES], "html string")


def train(labelled: DataFrame, html: str = "html", max_labelled: int = MAX_LABELLED, depth: int = MAX_DEPTH) -> Tree:
    """A tree from labelled pages, at most max_labelled of them (the first by their text);
    null pages are left out, and without any block no block is main text."""
    pages = [Blocks(r[0]) for r in labelled.select(html).where(F.col(html).isNotNull()).orderBy(html).limit(max_labelled).collect()]
    if not pages:
        return Tree([])
    return Tree.fit(np.vstack([p.features() for p in pages]), np.concatenate([np.array(p.labels, bool) for p in pages]), depth)


def extract(pages: DataFrame, tree: Tree, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text (its main blocks in page order, one a
    line; empty if there is none) and n_chars.

    Null and empty pages give an empty text; unclosed elements end with the container around
    them, an unclosed comment or script with the page; repeated rows give equal results,
    other columns are not read, an empty table gives an empty one.
    """
    ship_package(pages.sparkSession)
    cols = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols.schema.fields[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one page at a time: a batch may hold very long ones
            texts = []
            for page in batch.column(2):
                blocks = Blocks(page.as_py() or "")
                main = tree.predict(blocks.features())
                texts.append("\n".join(t for t, m in zip(blocks.text, main, strict=True) if m))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return cols.mapInArrow(run, f"{kinds}, text string").withColumn("n_chars", F.length("text").cast("long"))


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page, by a tree trained on the library's labelled pages; nulls,
    empty pages, repeats and empty tables as in ``extract``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), train(labelled_pages(spark)))

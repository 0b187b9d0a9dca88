"""Toxicity by multiple-instance learning.

Only documents carry labels, but what makes one toxic is a sentence. Each sentence gets a
score from the telling strings in it, and a document is toxic if any sentence is: the
sentence scores are combined by a noisy-or with a small leak, 1 - (1 - leak) * prod(1 - p).
The weights are fitted through that combination, from document labels alone, so the
sentence scores locate what is offending.

Telling strings (words and parts of words) are counted over all labelled documents outside the
held-out fold by Spark; the fit itself is over a bounded sample of labelled documents, reduced to the few
strings that their sentences hold.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .scratch import Scratch, bounded_broadcast

#: Labelled documents that the fit sees at most (those with the smallest hashes of their ids),
#: telling strings kept at most, and how telling (standard deviations) one must be.
MAX_TRAIN, MAX_STRINGS, LEAST_TELLING, LEAST_DOCS = 20_000, 3000, 4.0, 4
PART_LENGTHS = (4, 5, 6, 7, 8, 9, 10)
#: Levels that a deviation is divided into when the most telling strings are sought.
LEVELS = 16
HELD_OUT_FOLDS, SEED = 5, 11
STEPS, RATE, RIDGE = 400, 0.1, 2e-3
#: The parts of longer words are taken from pieces of so many letters, which overlap.
LONGEST = 200

_SENTENCE = re.compile(r"[.!?\n]+")
_OTHER = re.compile(r"[\W_]")


class Model(NamedTuple):
    strings: list[str]
    weights: list[float]
    bias: float
    leak: float


def fold(doc_id):
    """crc32 of the id as text, modulo the number of folds; 0 is held out."""
    return F.crc32(doc_id.cast("string")) % HELD_OUT_FOLDS


def labelled(labels: DataFrame, doc_id: str, toxic: str) -> DataFrame:
    """(_id, y) of all labelled documents outside fold 0. An id with several labels is toxic if
    one of them says so."""
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & (fold(F.col(doc_id)) != 0))
    return known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(toxic).cast("int")).alias("y"))


def training_rows(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(text, y, id) of the chosen documents; a label is two numbers."""
    chosen = bounded_broadcast(chosen, 500_000)
    return docs.join(chosen, F.col(doc_id) == F.col("_id")).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), "y", F.col("_id").alias("id"))


def telling_strings(train: DataFrame, most: int = MAX_STRINGS) -> DataFrame:
    """(string, z): words and parts of words that toxic documents hold more often than chance.
    A space in a string stands for the beginning or the end of a word."""
    word = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    words = train.select("y", F.explode(word).alias("w")).where(F.length("w") >= 3).groupBy("w").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    words = words.select("pos", "n", F.concat(F.lit(" "), F.col("w"), F.lit(" ")).alias("w"))

    def parts(c: str):
        def cut(k: int):
            every = F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(F.col(c), i, F.lit(k)))
            return F.when(F.length(c) >= k, every).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.concat(*map(cut, PART_LENGTHS)))

    whole = F.array_distinct(F.concat(F.array("w"), parts("w")))
    short = words.where(F.length("w") <= LONGEST).select("pos", "n", F.explode(whole).alias("string"))
    runs = words.where(F.length("w") > LONGEST).withColumn("run", F.xxhash64("w"))
    starts = F.sequence(F.lit(1), F.length("w"), F.lit(LONGEST))
    pieces = runs.select("run", "pos", "n", F.explode(F.transform(starts, lambda i: F.substring(F.col("w"), i, F.lit(LONGEST + max(PART_LENGTHS) - 1)))).alias("piece"))
    long = pieces.select("run", "pos", "n", F.explode(parts("piece")).alias("string")).union(runs.select("run", "pos", "n", "w")).dropDuplicates(["run", "string"])
    counted = short.union(long.select("pos", "n", "string")).groupBy("string").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    total = train.agg(F.avg(F.col("y").cast("double")).alias("rate"))
    expected = F.col("n") * F.col("rate")
    z = (F.col("pos") - expected) / F.sqrt(expected * (1 - F.col("rate")) + 1e-9)
    # one row crosses: the overall rate
    told = counted.where(F.col("pos") >= LEAST_DOCS).join(F.broadcast(total)).select("string", z.alias("z")).where(F.col("z") >= LEAST_TELLING)
    told = Scratch(train.sparkSession, "toxicity").save(told, "telling")
    # the level of z above which the strings wanted lie, so that no task sends its own best ones
    level = F.floor(F.col("z") * LEVELS)
    above, least = 0, 0
    for r in told.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
        above, least = above + r["n"], r["level"]
        if above >= most:
            break
    return told.where(level >= least).orderBy(F.desc("z"), "string").limit(most)


class Finder:
    """Telling strings of a text by sentence."""

    def __init__(self, strings: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton() if strings else None
        for k, s in enumerate(strings):
            self.automaton.add_word(s, k)
        if strings:
            self.automaton.make_automaton()

    def find(self, text: str) -> tuple[dict[int, set[int]], list[int]]:
        """sentence -> strings in it, and where the sentences begin."""
        if self.automaton is None or not text:
            return {}, [0]
        # one character for one; the space in front moves every place by one
        hits = list(self.automaton.iter(_OTHER.sub(" ", f" {text.lower()} ")))
        if not hits:
            return {}, [0]
        begins = [0, *(m.end() for m in _SENTENCE.finditer(text))]
        found: dict[int, set[int]] = {}
        for end, k in hits:
            found.setdefault(bisect_right(begins, max(0, end - 2)) - 1, set()).add(k)
        return found, begins


def fit(y: np.ndarray, sentence_doc: np.ndarray, item_sentence: np.ndarray, item_string: np.ndarray, n_strings: int) -> tuple[np.ndarray, float, float]:
    """From labels, the document of each sentence that holds any string, and the sentence of
    each string held: weights, bias, leak. Gradient ascent (Adam) on the likelihood of the
    labels under the noisy-or."""
    theta = np.concatenate([np.zeros(n_strings), [-1.0, math.log(max(y.mean(), 1e-3) / 10)]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        z = np.bincount(item_sentence, theta[item_string], len(sentence_doc)) + theta[-2]
        total = np.bincount(sentence_doc, np.logaddexp(0, z), len(y)) + np.exp(theta[-1])
        outer = y / np.expm1(np.clip(total, 1e-6, 50)) - (1 - y)
        inner = outer[sentence_doc] / (1 + np.exp(-z))
        grad = np.concatenate([np.bincount(item_string, inner[item_sentence], n_strings), [inner.sum(), (outer * np.exp(theta[-1])).sum()]]) / len(y)
        grad[:n_strings] -= RIDGE * theta[:n_strings] / max(1, n_strings) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n_strings], float(theta[-2]), float(1 - math.exp(-math.exp(theta[-1])))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Without labelled rows, or with one kind of label only, the model knows no strings and
    scores every document alike."""
    ship_package(docs.sparkSession)
    known = labelled(labels, doc_id, toxic)
    strings = [r.string for r in telling_strings(training_rows(docs, known, doc_id, text)).collect()]  # MAX_STRINGS at most
    rows = training_rows(docs, known.orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(MAX_TRAIN), doc_id, text)
    # rows of one id are one document of the sample: the text with the smallest hash
    rows = rows.groupBy("y", "id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "y", "id")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(strings)
        for batch in batches:
            out = [[sorted(x) for x in finder.find(t)[0].values()] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["y", "id", "sentences"])

    # MAX_TRAIN documents at most, each a few numbers, as Arrow columns; in the order of their ids
    held = rows.mapInArrow(reduce, "y int, id long, sentences array<array<int>>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    y = held.column("y").to_numpy().astype(float)
    if not len(y) or not strings:
        return Model([], [], 0.0, min(float(y.mean()) if len(y) else 0.0, 0.49))
    sentences = held.column("sentences").combine_chunks()
    of_doc, of_sentence = sentences.value_lengths().to_numpy(), sentences.flatten().value_lengths().to_numpy()
    parts = (np.repeat(np.arange(len(of_doc)), of_doc), np.repeat(np.arange(len(of_sentence)), of_sentence), sentences.flatten().flatten().to_numpy())
    weights, bias, leak = fit(y, *parts, len(strings))
    return Model(strings, [round(float(w), 6) for w in weights], bias, leak)


SCORES = "doc_id long, score double, n_offending long, worst_start long, worst_score double"


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, score (0 to 1), n_offending (sentences with a
    score of one half or more), worst_start and worst_score (of the sentence with the highest
    score: its first code point and its score; null where no sentence holds a telling string).
    Empty and null texts get the leak alone; equal rows equal scores; an empty table gives an
    empty one."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, weights = Finder(model.strings), model.weights
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                found, begins = finder.find(t or "")
                clean, worst, offending = 1 - model.leak, None, 0
                for sentence, strings in sorted(found.items()):
                    p = 1 / (1 + math.exp(-min(30.0, max(-30.0, model.bias + sum(weights[k] for k in strings)))))
                    clean *= 1 - p
                    offending += p >= 0.5
                    if worst is None or p > worst[1]:
                        worst = (begins[sentence], p)
                rows.append((min(1.0, max(0.0, 1 - clean)), offending, *(worst or (None, None))))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.float64(), pa.int64(), pa.int64(), pa.float64()], strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[c.split()[0] for c in SCORES.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCORES)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score by a model of the labelled ones outside fold 0. Null and empty texts
    have the leak's score, a null doc_id is in no fold, repeated rows are scored alike, and of
    repeated labelled rows one is in the sample; without labels all scores are equal."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = score(docs, train(docs, labels))
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_score")

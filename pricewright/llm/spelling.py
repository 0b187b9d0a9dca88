"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary.

Every word generates its edits (each code point deleted, each replaced by a later letter; what
is inserted into one word is deleted from the other) and asks a filter whether the vocabulary
may hold them. Only edits that the filter lets through leave the task: they are joined with the
vocabulary itself, which removes the few that the filter let through wrongly. The filter never
says no to a word that it holds, so no pair is lost.

The filter has a shard for each length of words, of blocks of 512 bits: eight bits of a word's
hash in one block, eight words of 64 bits side by side. It is built by a group-by over the
vocabulary and broadcast in parts of PART_BLOCKS blocks (64 MB), one part after the other, so
that what is broadcast has a bound however many words there are. The hash is a polynomial in the
code points, so that an edit's hash follows from its word's by one multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .scratch import Scratch, bounded_broadcast

MIN_LENGTH, MIN_COUNT, FORM_RATIO = 6, 5, 5
#: One run in so many loses a code point.
FAULT = 199
#: Words that a block of 512 bits holds on average: about one wrong yes in 10**5 edits.
BLOCK_WORDS, PART_BLOCKS = 16, 1 << 20
#: Edits that a task holds at a time.
CHUNK = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): every run of letters with MIN_LENGTH code points at least, after the faults."""
    lowered = F.translate(F.col(text), UPPER, LOWER)
    run = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.split(lowered, "[^a-zÀ-ÿ]+")).alias("run")).where(F.length("run") >= MIN_LENGTH)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return run.select(F.when(h % FAULT == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= MIN_LENGTH)


class Shards:
    """Where the blocks of each length begin; the blocks of a word of m equals m / BLOCK_WORDS."""

    def __init__(self, counts: dict[int, int]):
        self.lengths = sorted(counts)
        self.blocks = [-(-counts[k] // BLOCK_WORDS) for k in self.lengths]
        self.first = [0, *np.cumsum(self.blocks, dtype=np.int64).tolist()]
        self.of = {k: (self.first[i], self.blocks[i]) for i, k in enumerate(self.lengths)}

    def block(self, length: int, h: np.ndarray) -> np.ndarray:
        first, blocks = self.of[length]
        return _U(first) + (((h >> _U(32)) * _U(blocks)) >> _U(32))

    def within(self, length: int, lo: int, hi: int) -> bool:
        """Whether blocks of a length lie from lo up to hi."""
        first, blocks = self.of.get(length, (0, 0))
        return blocks > 0 and first < hi and first + blocks > lo


def _bit(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th bit of a hash in its block; the block is chosen by other digits."""
    return _U(1) << ((_mix(h) >> _U(6 * k)) & _U(63))


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, dtype=_U)
    out[0] = 1
    return np.cumprod(out)


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """Words of one length, their places in the list and their code points."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, at in groups.items():
        step = max(1, CHUNK // (100 * length))
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            codes = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), np.uint32).astype(_U)
            yield length, some, codes.reshape(len(some), length)


def _built(vocabulary: DataFrame, shards: Shards, scratch: Scratch) -> DataFrame:
    """(slot, mask): the 64-bit words of all blocks, eight to a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, codes in _by_length(batch.column(0).to_pylist()):
                h = _mix((codes * _powers(length)[:length]).sum(axis=1, dtype=_U))
                block = shards.block(length, h)
                slots = np.concatenate([block * _U(8) + _U(k) for k in range(8)])
                masks = np.concatenate([_bit(h, k) for k in range(8)])
                yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(masks.view(np.int64))], names=["slot", "mask"])

    made = vocabulary.select("word").mapInArrow(run, "slot long, mask long")
    return scratch.save(made.groupBy("slot").agg(F.bit_or("mask").alias("mask")), "filter")


class Prober:
    """Asks one part of the filter, the blocks from lo on."""

    def __init__(self, shards: Shards, letters: list[int], masks: np.ndarray, lo: int, hi: int):
        self.shards, self.letters, self.masks, self.lo, self.hi = shards, np.array(letters, _U), masks, lo, hi

    def maybe(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that the filter may hold."""
        h = _mix(h)
        block = self.shards.block(length, h)
        at = np.arange(len(h)) if self.shards.within(length, 0, self.lo) or self.shards.within(length, self.hi, 1 << 62) else None
        if at is not None:
            at = np.flatnonzero((block >= self.lo) & (block < self.hi))
            h, block = h[at], block[at]
        slot = (block - _U(self.lo)).astype(np.int64) * 8
        found = np.arange(len(h))
        for k in range(8):
            bit = _bit(h[found], k)
            found = found[(self.masks[slot[found] + k] & bit) != 0]
            if not len(found):
                break
        return found if at is None else at[found]

    def edits(self, words: list[str]) -> Iterator[tuple[int, str]]:
        """(place of a word, an edit of it that the filter may hold), each edit once."""
        for length, some, codes in _by_length(words):
            power = _powers(length)
            terms = codes * power[:length]
            h = terms.sum(axis=1, dtype=_U)
            if self.shards.within(length, self.lo, self.hi):
                for i in range(length):
                    who, what = np.nonzero(self.letters[None, :] > codes[:, i, None])
                    if len(who):
                        edited = h[who] + (self.letters[what] - codes[who, i]) * power[i]
                        for j in self.maybe(length, edited).tolist():
                            word = words[some[who[j]]]
                            yield some[who[j]], f"{word[:i]}{chr(int(self.letters[what[j]]))}{word[i + 1:]}"
            if self.shards.within(length - 1, self.lo, self.hi):
                before = np.cumsum(terms, axis=1, dtype=_U) - terms
                moved = codes[:, 1:] * power[: length - 1]
                after = np.zeros_like(codes)
                after[:, :-1] = np.cumsum(moved[:, ::-1], axis=1, dtype=_U)[:, ::-1]
                new = np.ones(codes.shape, bool)
                new[:, 1:] = codes[:, 1:] != codes[:, :-1]  # of equal neighbours any may go, with one result
                who, where = np.nonzero(new)
                for j in self.maybe(length - 1, (before + after)[who, where]).tolist():
                    word, i = words[some[who[j]]], int(where[j])
                    yield some[who[j]], word[:i] + word[i + 1 :]


def near(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """From (word, n) to (word, n, other, other_n), each pair one edit apart in both directions."""
    spark = vocabulary.sparkSession
    counts = {r["k"]: r["m"] for r in vocabulary.groupBy(F.length("word").alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()}
    letters = [ord(r[0]) for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().where("c != ''").collect()]
    shards = Shards(counts)
    blocks = _built(vocabulary, shards, scratch)
    found = []
    for lo in range(0, shards.first[-1], PART_BLOCKS):
        hi = min(lo + PART_BLOCKS, shards.first[-1])
        masks = np.zeros(8 * (hi - lo), _U)
        part = blocks.where((F.col("slot") >= 8 * lo) & (F.col("slot") < 8 * hi)).toArrow()
        masks[part["slot"].to_numpy() - 8 * lo] = part["mask"].to_numpy().view(_U)
        sent = spark.sparkContext.broadcast((shards, sorted(letters), masks, lo, hi))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            prober = Prober(*sent.value)
            for batch in batches:
                words, n = batch.column(0).to_pylist(), batch.column(1)
                who, what, size = [], [], 0
                for i, edit in prober.edits(words):
                    who.append(i)
                    what.append(edit)
                    size += len(edit)
                    if size > CHUNK:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), n.take(pa.array(who)), pa.array(what)], names=["word", "n", "other"])
                        who, what, size = [], [], 0
                if who:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), n.take(pa.array(who)), pa.array(what)], names=["word", "n", "other"])

        # words are dealt anew: those of a file may be few and long, or very many
        maybe = vocabulary.select("word", "n").repartition(spark.sparkContext.defaultParallelism * (1 + int(vocabulary.count() // 100_000)), "word").mapInArrow(run, "word string, n long, other string")
        found.append(scratch.save(maybe, f"maybe-{lo}"))
    if not found:
        return vocabulary.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    maybe = found[0]
    for more in found[1:]:
        maybe = maybe.union(more)
    pairs = scratch.save(maybe.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n"), "pairs")
    return pairs.union(pairs.select("other", "other_n", "word", "n"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """From (word, form) to (word, root), the end of its chain of forms. Each round doubles
    what is followed, and counts grow along a chain, so the rounds are few and end."""
    up, k = scratch.save(forms.select("word", F.col("form").alias("root")), "up-0"), 0
    while True:
        k += 1
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.save(up.join(bounded_broadcast(above), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"up-{k}")
        up = after.select("word", "root")
        if after.where("moved").isEmpty():
            return up


def variants(words: DataFrame, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """From (word), a row for each occurrence, to one row for each word with min_count
    occurrences at least: word, form, root, n, n_near, form_n.

    form is the word one edit away with the largest n (ties: smallest in code-point order), if
    that is ratio times the word's n at least, else null; root is the end of the forms,
    the word itself if it has none. Null words are left out; an empty table gives an empty one.
    """
    ship_package(words.sparkSession)
    scratch = Scratch(words.sparkSession, "spelling")
    vocabulary = words.where("word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    vocabulary = scratch.save(vocabulary, "vocabulary")
    links = near(vocabulary, scratch)
    rows = vocabulary.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n")).union(links)
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), "other")))
    grouped = rows.groupBy("word", "n").agg(F.count("other").alias("n_near"), best.alias("best"))
    fits: Column = -F.col("best.less") >= ratio * F.col("n")
    formed = scratch.save(grouped.select("word", "n", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "formed")
    ends = roots(formed.where("form IS NOT NULL"), scratch)
    return formed.join(bounded_broadcast(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The words of all documents, their near words and forms. Null and empty texts have no
    words, a null doc_id is an empty one in the hash, repeated rows count each time, a row
    for each word and none for an empty table."""
    return variants(runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


#: The table of crc32 is computed from its polynomial; pairs meet by what is left without a code point.
OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)
), found AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END)) AS b FROM found
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM bytes, steps
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), holes AS (
  SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM words, range(length(word)) r(i)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at WHERE e.form IS NULL
"""

"""Exact repeats of long byte strings across a corpus: bucket-pointer refinement.

To find every byte that lies in a string of LENGTH bytes which also starts elsewhere, the
starts have to be compared by their next LENGTH bytes. Equal strings share the place of
their smallest gram hash, so each text is first cut at such places (anchors), about one for
75 bytes, and only starts whose anchor's gram occurs elsewhere go on.

The starts of an anchor are dealt into parts of WIDTH neighbours. All strings of a part share
their middle, the core, so equal strings meet under the digest of their core, and what tells
them apart is the few bytes before and after it, the flanks. Equal parts, in one text or in
many, become one row with a count; where it is over one, all its starts repeat. Only different
parts of one core are refined: buckets of equal short grams are split by the bucket of the
start that lies one gram further on, as in suffix sorting, which doubles the compared length;
the new buckets serve the next round, and starts that stand alone in a bucket leave. The parts
of a core that has very many are refined by the same pointers in a table instead, so no task
holds a group that grows with the data. Copies of whole texts are counted before and stand for
themselves once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .minhash import _mix
from .scratch import Scratch, bounded_broadcast

#: Bytes of a repeat and of an anchor's gram.
LENGTH, GRAM = 200, 50
#: Neighbouring starts of a part, and bytes of the digest that stands for a core: a start is then
#: told by WIDTH - 1 bytes of flanks and the digest, in all TOLD = FIRST * 2 ** n of them.
WIDTH, DIGEST, FIRST = 25, 16, 10
TOLD = WIDTH - 1 + DIGEST
#: Different parts of a core that one task refines, more are refined in a table; parts that a
#: task refines at a time; bytes of texts whose anchors are found at a time.
MOST_PARTS, CHUNK_PARTS, CHUNK_BYTES = 250, 4000, 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = _mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _BASE and of its inverse (modulo 2 ** 64)."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up = np.full(size, _U(_BASE))
        down = np.full(size, _U(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    up, down = _POWERS[size]
    return up[:n], down[:n]


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n bytes in a row: differences of running sums."""
    if len(data) < n:
        return np.zeros(0, _U)
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_TABLE[data] * up, out=sums[1:])
    return _mix((sums[n:] - sums[:-n]) * down[: len(data) - n + 1])


def anchors(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: (text, anchor, first start, last start, gram hash), places
    within the text. Every start of length bytes has the leftmost smallest gram inside as its
    anchor; starts with the same one are a run."""
    h = gram_hashes(data, gram)
    w = length - gram + 1
    n = len(h) - w + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty, np.zeros(0, _U)
    # 33 bits of the hash and the place: the smallest of these is the leftmost smallest
    places = _U((1 << 31) - 1)
    key = (h & ~places) | np.arange(len(h), dtype=_U)
    # sliding minimum: of blocks, the minima from the left and from the right
    grid = np.concatenate([key, np.full(-len(key) % w, np.iinfo(np.uint64).max, _U)]).reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & places).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    # starts whose string ends in their own text
    whole = np.zeros(n + 1, np.int64)
    long = sizes >= length
    np.add.at(whole, begin[long], 1)
    np.add.at(whole, (begin + sizes - length + 1)[long], -1)
    inside = np.cumsum(whole[:n]) > 0
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    new[begin[long]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    first, last = first[inside[first]], last[inside[first]]
    text = np.searchsorted(begin, first, "right") - 1
    here = begin[text]
    return text, at[first] - here, first - here, last - here, h[at[first]]


def first_buckets(data: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """A number for each place, equal where the next n bytes are: ordered by a hash, and told
    apart by the bytes themselves where a hash is shared."""
    hashes = gram_hashes(data, n)[places]
    order = np.argsort(hashes, kind="stable")
    grams = np.lib.stride_tricks.sliding_window_view(data, n)[places[order]]
    same_hash = hashes[order][1:] == hashes[order][:-1]
    same = same_hash & (grams[1:] == grams[:-1]).all(axis=1)
    if (same_hash & ~same).any():  # two grams share a hash
        return np.unique(grams, axis=0, return_inverse=True)[1].ravel()[np.argsort(order, kind="stable")]
    out = np.empty(len(places), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(~same)])
    return out


def refine(data: np.ndarray, starts: np.ndarray, length: int = TOLD, first: int = FIRST) -> np.ndarray:
    """A number for each of starts in data (each followed by length bytes), equal where the
    strings are, and -1 where a string stands alone."""
    if not len(starts):
        return np.zeros(0, np.int64)
    have = first
    # only places that a start's comparison still leads to keep an identifier
    needed = np.unique((starts[:, None] + np.arange(0, length - first + 1, first)[None, :]).ravel())
    ids = np.zeros(len(data), np.int64)
    ids[needed] = first_buckets(data, needed, first)
    alive = starts
    while len(alive):
        size = np.bincount(ids[alive])
        alive = alive[size[ids[alive]] > 1]
        if have >= length or not len(alive):
            break
        step = min(have, length - have)
        # one sort on (bucket, bucket of the start further on); its ranks are the new buckets
        reach = np.unique((alive[:, None] + np.arange(0, length - have - step + 1, max(1, step))[None, :]).ravel())
        key = ids[reach] * np.int64(len(ids) + 1) + ids[reach + step]
        fresh = np.unique(key, return_inverse=True)[1]
        ids[reach] = fresh
        have += step
    out = np.full(len(starts), -1, np.int64)
    out[np.isin(starts, alive)] = ids[alive]
    return out


#: place: the first start, and from it to the anchor and to the last start, see packed().
ANCHORS = "text_hash binary, place long, gram long"
#: Of a text: a part (the digest of all that tells it), its core (a digest), left and right
#: flank, how often they stand together, and the runs of starts that they stand for (first and
#: last of each); near and far: the least and most bytes of left flank that a start has.
PARTS = "part binary, core binary, before binary, after binary, near int, far int, n int, text_hash binary, runs array<int>"
#: Of the starts of a part, by their bytes of left flank, those that repeat.
MARKS = "part binary, back int"


def _hash(text) -> F.Column:
    return F.unhex(F.md5(text))


def packed(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(anchor, first start, last start) as one number: both distances are under 2 ** 16."""
    return lo << 32 | (at - lo) << 16 | (hi - lo)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, ...]:
    lo = place >> 32
    return lo + (place >> 16 & 65535), lo, lo + (place & 65535)


def parts_of(data: bytes, hits: list, length: int = LENGTH, width: int = WIDTH) -> dict[tuple, list]:
    """(core, before, after, near, far) -> runs of starts, for a text and its anchors (anchor,
    lo, hi): a part holds the starts with (anchor - start) // width = part."""
    found: dict[tuple, list] = {}
    for at, lo, hi in hits:
        for part in range((at - hi) // width, (at - lo) // width + 1):
            begin, end = at - part * width, at - (part + 1) * width + 1 + length  # of the core
            first, last = max(lo, begin - width + 1), min(hi, begin)
            core = hashlib.blake2b(data[begin:end], digest_size=DIGEST, salt=part.to_bytes(2, "little")).digest()
            key = (core, data[first:begin], data[end : last + length], begin - last, begin - first)
            runs = found.setdefault(key, [])
            if runs and runs[-1][1] + 1 == first:
                runs[-1][1] = last
            else:
                runs.append([first, last])
    return found


def repeated_starts(texts: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """From distinct texts (text_hash, data): (text_hash, lo, hi), runs of starts whose next
    length bytes also start elsewhere."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw, lo = np.frombuffer(column.buffers()[2], np.uint8), 0
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + CHUNK_BYTES, "right")) - 1)
                text, at, first, last, g = anchors(raw[bounds[lo] : bounds[hi]], np.diff(bounds[lo : hi + 1]), length, gram)
                keys = batch.column(0).take(pa.array(lo + text))
                yield pa.RecordBatch.from_arrays([keys.cast(pa.binary()), pa.array(packed(at, first, last)), pa.array(g.view(np.int64))], names=["text_hash", "place", "gram"])
                lo = hi

    long = texts.where(F.length("data") >= length)
    found = scratch.save(long.mapInArrow(cut, ANCHORS), "anchors")
    again = scratch.save(found.groupBy("gram").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("gram"), "again")
    scratch.release()
    hits = found.join(again, "gram").groupBy("text_hash").agg(F.sort_array(F.collect_list("place")).alias("hits"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
        names = [c.split()[0] for c in PARTS.split(", ")]
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                rows = []
                few = batch.slice(lo, 200)
                for h, d, hits_ in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), few.column(2), strict=True):
                    columns = [c.tolist() for c in unpacked(hits_.values.to_numpy())]
                    for key, runs in parts_of(d, zip(*columns, strict=True), length).items():
                        told = b"".join([key[0], *(n.to_bytes(1) for n in key[3:]), key[1], key[2]])
                        rows.append((hashlib.md5(told).digest(), *key, sum(b - a + 1 for a, b in runs) // (key[4] - key[3] + 1), h, [x for run in runs for x in run]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    parts = scratch.save(long.join(hits, "text_hash").select("text_hash", "data", "hits").mapInArrow(part, PARTS), "parts")
    scratch.drop("anchors")
    scratch.release()
    told = ["core", "before", "after", "near", "far"]
    # the digest of a part, as the workers take it
    part_of = F.unhex(F.md5(F.concat("core", F.unhex(F.lpad(F.hex(F.col("near") * 256 + F.col("far")), 4, "0")), "before", "after")))
    distinct = scratch.save(parts.groupBy(*told).agg(F.sum("n").alias("n")).withColumn("part", part_of), "distinct")
    # a part that is there once, under a core that others have too, is still to be told
    shared = distinct.groupBy("core").agg(F.count(F.lit(1)).alias("many"), F.min("n").alias("least")).where("many > 1 and least = 1").select("core", "many")
    open_ = distinct.join(scratch.save(shared, "shared"), "core")
    marks = refined(open_.where(F.col("many") <= MOST_PARTS)).union(refined_in_tables(open_.where(F.col("many") > MOST_PARTS), scratch))
    marks = marks.groupBy("part").agg(F.sort_array(F.collect_list("back")).alias("backs"))  # WIDTH at most
    marks = scratch.save(distinct.where("n > 1").select("part", F.lit(None).cast("array<int>").alias("backs")).union(marks), "marks")
    for name in ("distinct", "starts"):
        scratch.drop(name)
    scratch.release()
    # without backs all starts of a part repeat; with them it stands once, and its core begins
    # far bytes after its first start
    at = F.col("runs")[0] + F.col("far")
    some = F.transform("backs", lambda x: F.struct((at - x).alias("lo"), (at - x).alias("hi")))
    every = F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda i: F.struct(F.get("runs", i).alias("lo"), F.get("runs", i + 1).alias("hi")))
    repeated = parts.select("part", "far", "text_hash", "runs").join(marks, "part")
    return repeated.select("text_hash", F.explode(F.coalesce(some, every)).alias("r")).select("text_hash", "r.lo", "r.hi")


def refined(open_: DataFrame) -> DataFrame:
    """MARKS of parts (with n) whose core has few enough others: each core in one task."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> Iterator[pa.RecordBatch]:
            part, core, before, after, near, far, n = zip(*held, strict=True)
            data = np.frombuffer(b"".join(x for row in zip(before, core, after, strict=True) for x in row), np.uint8)
            lead, size = np.array(list(map(len, before))), np.array([len(a) + DIGEST + len(b) for a, b in zip(before, after, strict=True)])
            begin = np.cumsum(size) - size + lead  # of the digest
            each = np.array(far) - near + 1
            row = np.repeat(np.arange(len(held)), each)
            back = np.array(near)[row] + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            ids = refine(data, begin[row] - back)
            # parts that are there more than once are marked as a whole elsewhere
            keep = np.flatnonzero((ids >= 0) & (np.array(n)[row] == 1))
            yield pa.RecordBatch.from_arrays([pa.array([part[i] for i in row[keep]], pa.binary()), pa.array(back[keep], pa.int32())], names=["part", "back"])

        last = None
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(7)], strict=True):
                # whole groups only: a chunk ends where a group does
                if row[1] != last and len(held) >= CHUNK_PARTS:
                    yield from done()
                    held.clear()
                last = row[1]
                held.append(row)
        if held:
            yield from done()

    columns = ["part", "core", "before", "after", "near", "far", "n"]
    return open_.select(*columns).repartition("core").sortWithinPartitions("core").mapInArrow(meet, MARKS)


def refined_in_tables(open_: DataFrame, scratch: Scratch) -> DataFrame:
    """MARKS of parts whose core has very many others. Each start is a row with its bucket, that
    of its core and left flank, and the pointer to what follows, its right flank; the digest of
    both is the bucket that it is refined to. Buckets are counted, so no task holds a core."""
    left = F.expr("substring(before, length(before) - back + 1, back)")
    right = F.expr(f"substring(after, 1, {WIDTH - 1} - back)")
    starts = open_.select("part", "core", "before", "after", "n", F.explode(F.sequence("near", "far")).alias("back"))
    # the length of the left flank is told by back, so the join of bytes is not ambiguous
    bucket = F.unhex(F.md5(F.concat(F.col("core"), F.encode(F.col("back").cast("string"), "UTF-8"), left, right)))
    starts = scratch.save(starts.select("part", "n", "back", bucket.alias("bucket")), "starts")
    equal = scratch.save(starts.groupBy("bucket").agg(F.sum("n").alias("many")).where("many > 1").select("bucket"), "equal")
    return starts.where("n = 1").join(equal, "bucket", "left_semi").select("part", "back")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and
    with keep_text the bytes that stay (kept binary).

    A byte goes if it lies in a string of length bytes that also starts elsewhere, in any
    row. Null texts count as empty; texts shorter than length stay whole; of equal long
    texts, repeated rows among them, nothing stays. Null ids stay null. An empty table gives
    an empty one. Only doc_id and text are read, whatever other columns are called.
    """
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "repeats")
    data = F.coalesce(F.encode(F.col(text).cast("string"), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), data.alias("data")).withColumn("text_hash", _hash(F.col("data")))
    long = rows.where(F.length("data") >= length)
    same = long.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
    same = scratch.save(same, "same")
    marked = long.join(bounded_broadcast(same), "text_hash", "left")
    alone = marked.where("copies is null").select("doc_id", "text_hash", "data")
    # one row stands for a text that occurs more than once
    copied = marked.where("copies is not null")
    once = copied.where(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("text_hash").agg(F.first("data").alias("data"))
    found = repeated_starts(alone.select("text_hash", "data").union(once), scratch, length)
    spans = found.groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    columns = RESULT + (", kept binary" if keep_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, d, spans_ in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                ranges: list[list[int]] = []
                for s in spans_ or []:
                    lo, hi = s["lo"], s["hi"] + length
                    if ranges and lo <= ranges[-1][1]:
                        ranges[-1][1] = max(hi, ranges[-1][1])
                    else:
                        ranges.append([lo, hi])
                kept, at = [], 0
                for lo, hi in ranges:
                    kept.append(d[at:lo])
                    at = hi
                kept = b"".join([*kept, d[at:]])
                row = (key, len(d), len(d) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept) if keep_text else row)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 6 if keep_text else 5]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in columns.split(", ")])

    def plain(df: DataFrame, gone: bool) -> DataFrame:
        """Rows that go or stay as a whole."""
        n, kept = F.length("data").cast("long"), F.lit(b"") if gone else F.col("data")
        zero = F.lit(0).cast("long")
        made = [n.alias("n_bytes"), (n if gone else zero).alias("n_removed"), F.lit(int(gone)).cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256")]
        return df.select("doc_id", *made, *([kept.alias("kept")] if keep_text else []))

    # only texts that are there once are joined with spans, so no text's copies meet in a task
    told = alone.join(spans, "text_hash", "left").select("doc_id", "data", "spans").mapInArrow(cut, columns)
    return told.union(plain(copied, True)).union(plain(rows.where(F.length("data") < length), False))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, null and short texts, ties and repeats as ``without_repeats`` treats them."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

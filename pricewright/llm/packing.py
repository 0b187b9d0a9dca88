"""Pack documents into sequences of a fixed length: best-two-fit.

Tokens are counted where the text is read, and only (document, piece, start, length,
checksum) goes on. The pieces are dealt into packs of bounded size and each is packed for
itself: a sequence is filled greedily with the longest pieces that fit; where a gap stays that
no piece fits, its smallest piece gives way to two unpacked pieces that fill the widened gap
more tightly. Sequences that a pack could not fill are packed again with those of the others.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .scratch import Scratch
from .workers import handing_back

LENGTH, END_ID, VOCABULARY = 2048, 0, "word_bpe_49k.json"
#: Pieces that are packed together in one task, bytes of words and ids that a task remembers
#: (with the overhead of a Python object each), and the gap, as a share of a sequence, from which
#: on a sequence of a pack counts as left over.
PACK_ROWS, REMEMBERED_BYTES, ENTRY_BYTES, LEFT_OVER = 100_000, 192 << 20, 170, 0.01
#: Bytes of texts that are encoded together; only these are Python strings at a time.
CHUNK_BYTES = 2 << 20

#: A text made of these characters only is split at white space first and its
#: parts are encoded once each; its tokens are the same as the tokenizer's for the whole text.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u012f\\u0132-\\u024f]*")
#: A word of letters and what follows them: the tokenizer never joins the two.
_STEM = re.compile(r"([^\W\d_]+)([^\w'\s]*)")


class Words(dict):
    """Word -> its ids as little-endian 32-bit bytes. Words that were not seen before wait and
    are encoded together; the ids of a word of letters end with the first end-of-word token."""

    def __init__(self, tokenizer):
        super().__init__()
        import numpy as np

        self.tokenizer, self.held = tokenizer, 0
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def exact(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[str], ids: list[bytes]) -> None:
        self.update(zip(words, ids, strict=True))
        self.held += len(words) * ENTRY_BYTES + sum(map(len, words)) + sum(map(len, ids))

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        import numpy as np

        joined, other, stems = [], [], set()
        for w in words:
            m = _STEM.fullmatch(w)
            if m is None:
                other.append(w)
            else:
                stems.add(m[1])
                if m[2]:
                    stems.add(m[2])
                    joined.append((w, m[1], m[2]))
        fresh = [x for x in stems if x not in self]
        letters = [x for x in fresh if x[0].isalpha()]
        other += [x for x in fresh if not x[0].isalpha()]
        for i in range(0, len(letters), 4096):
            part = letters[i : i + 4096]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(part):  # a word that is not one run of letters to the tokenizer
                other += part
                continue
            raw, at = ids.tobytes(), 0
            out = []
            for cut in cuts:
                out.append(raw[4 * at : 4 * cut])
                at = cut
            self._keep(part, out)
        for i in range(0, len(other), 4096):
            self._keep(other[i : i + 4096], self.exact(other[i : i + 4096]))
        self._keep([w for w, _, _ in joined], [self[a] + self[b] for _, a, b in joined])


class Encoder:
    """Texts to token ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.words = Words(Tokenizer.from_file(path))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit bytes. The words of all plain texts are
        looked up once each; places of words in the texts then select their ids."""
        import numpy as np
        import pyarrow.compute as pc

        words = self.words
        if words.held > REMEMBERED_BYTES:
            words.forget()
        plain = [k for k, text in enumerate(texts) if "<|" not in text and PLAIN.fullmatch(text)]
        known = set(plain)
        rest = [k for k in range(len(texts)) if k not in known]
        out: list[bytes] = [b""] * len(texts)
        for k, ids in zip(rest, words.exact([texts[k] for k in rest]) if rest else [], strict=True):
            out[k] = ids
        if not plain:
            return out
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([texts[k] for k in plain], pa.large_string())))
        coded = split.flatten().dictionary_encode()
        here = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        words[""] = b""
        ids_of = list(map(words.get, here))
        fresh = [k for k, ids in enumerate(ids_of) if ids is None]
        words.learn([here[k] for k in fresh])
        for k in fresh:
            ids_of[k] = words[here[k]]
        sizes = np.array(list(map(len, ids_of)), np.int64) // 4
        flat, begin = np.frombuffer(b"".join(ids_of), "<u4"), np.cumsum(sizes) - sizes
        place = coded.indices.to_numpy()
        n = sizes[place]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[place] - upto[:-1], n) + np.arange(upto[-1])]
        ends = upto[np.concatenate([[0], np.cumsum(np.asarray(split.value_lengths()))])].tolist()
        for k, lo, hi in zip(plain, ends, ends[1:], strict=False):
            out[k] = ids[lo:hi].tobytes()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process; a process serves many tasks, so what it remembers is
    forgotten at the end of each."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32.
    A document is its ids and then END_ID; an empty or null one is END_ID alone."""
    path = path or tokenizer_path()
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        coder = encoder(path)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < batch.num_rows:
                hi = min(batch.num_rows, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK_BYTES)) + 1)
                part = batch.slice(lo, hi - lo)
                keys, texts = part.column(0).to_pylist(), part.column(1).fill_null("").to_pylist()
                rows = []
                for key, ids in zip(keys, coder.encode(texts), strict=True):
                    ids += END_ID.to_bytes(4, "little")
                    for k, at in enumerate(range(0, len(ids), 4 * length)):
                        piece = ids[at : at + 4 * length]
                        rows.append((key, k, k * length, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECE_TYPES, strict=True)], names=PIECE_NAMES)
                lo = hi
        coder.words.forget()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(handing_back(cut), PIECES)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in lengths, each 1 to capacity. A bit mask holds the lengths that are
    still there and another the same backwards, so the longest piece that fits a gap and
    a pair that fills one are a few operations on whole numbers."""
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    for place, n in enumerate(lengths):
        held[n].append(place)
    mask = sum(1 << n for n in range(1, capacity + 1) if held[n])
    back = sum(1 << (capacity - n) for n in range(1, capacity + 1) if held[n])
    bins = []

    def take(n: int) -> int:
        nonlocal mask, back
        place = held[n].pop()
        if not held[n]:
            mask ^= 1 << n
            back ^= 1 << (capacity - n)
        return place

    def give(n: int, place: int) -> None:
        nonlocal mask, back
        if not held[n]:
            mask |= 1 << n
            back |= 1 << (capacity - n)
        held[n].append(place)

    def pair(total: int) -> tuple[int, int] | None:
        # bit a of this: lengths a and total - a are both there
        both = mask & (back >> (capacity - total)) if total <= capacity else 0
        while both:
            a = both.bit_length() - 1
            if 2 * a != total or len(held[a]) > 1:
                return a, total - a
            both ^= 1 << a
        return None

    while mask:
        gap, inside = capacity, []
        while fits := mask & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            inside.append((n, take(n)))
            gap -= n
        if gap and mask:
            smallest = inside[-1][0]
            for total in range(gap + smallest, smallest, -1):
                if found := pair(total):
                    give(*inside.pop())
                    inside += [(n, take(n)) for n in found]
                    break
        bins.append([place for _, place in inside])
    return bins


PACKED = PIECES + ", sequence_id long, offset long"


def _packs(rows: DataFrame, packs: int, length: int, level: int) -> DataFrame:
    """Each of so many packs in a task: PACKED and whether the sequence is left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept = list(batches)
        if not kept:
            return
        part = pa.Table.from_batches(kept)
        sizes = part.column("length").to_pylist()
        # the place in the pack decides between equal lengths, so it must not depend on the shuffle
        by = part.append_column("at", pa.array(range(len(sizes)), pa.int64())).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).column("at").to_pylist()
        next_id = (level << 56) + (TaskContext.get().partitionId() << 32)
        order, sequence, offset, over = [], [], [], []
        for inside in best_two_fit([sizes[i] for i in by], length):
            at = 0
            for place in (by[i] for i in inside):
                order.append(place)
                sequence.append(next_id)
                offset.append(at)
                at += sizes[place]
            over += [length - at > LEFT_OVER * length] * len(inside)
            next_id += 1
        out = part.take(pa.array(order, pa.int64()))
        for name, values, kind in (("sequence_id", sequence, pa.int64()), ("offset", offset, pa.int64()), ("over", over, pa.bool_())):
            out = out.append_column(name, pa.array(values, kind))
        yield from out.to_batches(max_chunksize=10_000)

    return rows.repartition(packs).mapInArrow(handing_back(run), PACKED + ", over boolean")


def pack(cut: DataFrame, scratch: Scratch, length: int = LENGTH, pack_rows: int = PACK_ROWS) -> DataFrame:
    """Pieces with sequence_id and offset. Full pieces are sequences already. The others are
    dealt evenly, whatever their keys, into packs of pack_rows; what the packs leave over, the
    sequences that are not full to within LEFT_OVER, is packed again, until it is one pack."""
    rows, done, level = scratch.save(cut, "pieces"), None, 0
    n = rows.count()
    while True:
        packs = max(1, -(-n // pack_rows))
        out = scratch.save(_packs(rows, packs, length, level), f"packed{level}")
        left = out.where("over")
        m = left.count() if packs > 1 else 0
        again = 0 < m < n / 2  # else the last packs are as good as more would be
        here = out.where("not over") if again else out
        here = here.select(*[c.split()[0] for c in PACKED.split(", ")])
        done = here if done is None else done.union(here)
        if not again:
            return done
        rows, n, level = left.select(*PIECE_NAMES), m, level + 1


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than length are cut. Null and empty texts are one token; null ids
    stay null; equal rows are packed each for itself; an empty table gives an empty one.
    """
    return pack(pieces(docs, doc_id, text, length, path), Scratch(docs.sparkSession, "packing"), length)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, null and empty texts, ties and repeats as ``packed`` treats them."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

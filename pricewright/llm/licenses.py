"""License notices in documents: exact phrases, and longer notices with a few edits.

A notice that may hold k edits is cut into k + 1 pieces; wherever it stands with at most k
edits, one piece at least stands unchanged (pigeonhole). Exact searches for the pieces find
the places, and only there does the regex library's bounded-error matching decide, count
the edits and give the span. Texts are handled many at a time as one run of bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package

#: Base phrase -> label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notice, in lower-case words -> label.
NOTICES = {
    "all rights reserved": "reserved",
    "creative commons attribution share alike": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "gnu lesser general public license": "lgpl",
    "licensed under the apache license version 2 0": "apache",
    "mozilla public license version 2 0": "mpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "released under the mit license": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under the gnu general public license": "gpl",
}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 12
CHUNK_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


class Scanner:
    def __init__(self, notices: dict[str, str], chars_per_edit: int):
        import regex

        self.base = [(re.compile(rb"(?<![^ \n])" + phrase.encode() + rb"(?![^ \n])"), label) for phrase, label in BASE.items()]
        self.notices = []
        for phrase, label in notices.items():
            text, edits = phrase.encode(), len(phrase) // chars_per_edit
            cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
            seeds = [(lo, text[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
            fuzzy = regex.compile(b"(?e)(?:" + regex.escape(text) + b"){e<=%d}" % edits)
            self.notices.append((text, label, edits, seeds, fuzzy))

    def windows(self, run: bytes, text: bytes, edits: int, seeds: list[tuple[int, bytes]]) -> list[tuple[int, int]]:
        found = []
        for offset, seed in seeds:
            at = run.find(seed)
            while at >= 0:
                found.append((at - offset - edits, at - offset + len(text) + edits))
                at = run.find(seed, at + 1)
        merged: list[tuple[int, int]] = []
        for lo, hi in sorted(found):
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((max(lo, 0), hi))
        return merged

    def scan(self, texts: list[bytes]) -> list[tuple]:
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        word = _WORD[raw]
        keep = word.copy()
        keep[1:] |= word[:-1]
        keep[ends] = True
        out = np.where(word, _LOWER[raw], np.uint8(32))
        out[ends] = 10
        norm, is_word = out[keep], word[keep]
        run = norm.tobytes()
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        starts = np.flatnonzero(first)
        doc_ends = np.flatnonzero(norm == 10)
        upto = np.concatenate([[0], np.searchsorted(starts, doc_ends)])
        edges, words, before = doc_ends.tolist(), starts.tolist(), upto.tolist()
        base: dict[int, list] = {}
        spans: dict[int, dict] = {}
        if b"license" in run:
            for pattern, label in self.base:
                for m in pattern.finditer(run):
                    doc = bisect_right(edges, m.start())
                    base.setdefault(doc, []).append((bisect_right(words, m.start()) - 1 - before[doc], label))
        for text, label, edits, seeds, fuzzy in self.notices:
            for lo, hi in self.windows(run, text, edits, seeds):
                doc = bisect_right(edges, min(max(lo + edits, 0), len(run) - 1))
                last = bisect_right(edges, max(0, min(hi - edits, len(run)) - 1))
                for d in range(doc, min(last, len(texts) - 1) + 1):
                    left, right = max(lo, edges[d - 1] + 1 if d else 0), min(hi, edges[d])
                    for m in fuzzy.finditer(run, left, right):
                        start, stop = bisect_right(words, m.start()) - 1, bisect_right(words, max(m.start(), m.end() - 1)) - 1
                        key = (label, start - before[d], stop + 1 - before[d])
                        wrong = sum(m.fuzzy_counts)
                        old = spans.setdefault(d, {}).get(key)
                        if old is None or wrong / len(text) < old[0]:
                            spans[d][key] = (wrong / len(text), wrong)
        rows = []
        for d in range(len(texts)):
            places, more = base.get(d, []), _best(spans.get(d, {}))
            labels = {label for _, label in places}
            at = [p for p, _ in places]
            score = 1.0 if places else max((1 - share for share, _ in more.values()), default=0.0)
            listed = ",".join(f"{k[0]}:{k[1]}:{k[2]}:{v[1]}" for k, v in sorted(more.items()))
            rows.append((before[d + 1] - before[d], len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {k[0] for k in more})), score, listed))
        return rows


def _best(spans: dict) -> dict:
    """Notices differ in a word or two: of spans that overlap, the better match stays."""
    kept: dict = {}
    for key, found in sorted(spans.items(), key=lambda x: (x[1], x[0])):
        if all(key[2] <= k[1] or k[2] <= key[1] or v == found for k, v in kept.items()):
            kept[key] = found
    return kept


COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: dict[str, str] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans.

    spans lists the notices as label:first word:word after the last:edits. score is 1 with
    a base phrase, else the share of a notice that is unchanged in its best match, else 0.
    Null and empty texts have no words: counts and score 0, places null, labels empty.
    Equal rows give equal results; an empty table gives an empty one.
    """
    ship_package(docs.sparkSession)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, chars_per_edit)

        def done(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            columns = [ids, *zip(*scanner.scan(texts), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=names)

        for batch in batches:
            ids, texts, held = [], [], 0
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(key)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= CHUNK_BYTES:
                    yield done(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield done(ids, texts)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(F.col(text).cast("string"), "UTF-8").alias("text")).mapInArrow(run, COLUMNS)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's words, base places and labels. Null and empty texts, ties, repeats and an
    empty table as in ``scan``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

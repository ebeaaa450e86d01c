"""License scan: fuzzy search for short notices.

A text's words (runs of ASCII letters and digits, A-Z lower-cased, and non-ASCII characters) are joined by
single spaces. Each notice may differ by a number of edits, counted in UTF-8 bytes. It is cut into one piece more than that:
by the pigeonhole principle any match has one piece unchanged, so the exact places of pieces (seeds) give all
candidates. In the window around each candidate, the regex library's bounded-error matching finds the span of fewest edits that
starts and ends at word boundaries, which lie outside the part that may have errors. Phrases without allowed edits are
sought the same way, with one seed, and give all places where their words stand consecutively.

Overlapping spans of one fuzzy notice are thinned to that with the fewest edits; of equal ones the first stays. Null texts count
as empty: no words, no spans, no labels. Repeated rows are scanned alike, an empty table gives an empty result, and other
columns are left alone. Memory is a few times one text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Phrases without edits, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Notices with edits (up to one in ten characters), and their labels.
NOTICES = [
    ("licensed under the apache license", "apache"),
    ("apache license version 2 0", "apache"),
    ("permission is hereby granted free of charge", "mit"),
    ("released under the mit license", "mit"),
    ("spdx license identifier mit", "mit"),
    ("spdx license identifier apache 2 0", "apache"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("bsd 3 clause license", "bsd"),
    ("mozilla public license", "mpl"),
    ("licensed under cc by", "cc-by"),
    ("creative commons attribution", "cc-by"),
    ("this work is licensed under a creative commons", "cc-by"),
    ("all rights reserved", "proprietary"),
]
SPAN = "struct<label:string,notice:string,first_word:bigint,last_word:bigint,edits:int>"
RESULT = f"struct<n_words:bigint,spans:array<{SPAN}>>"

_WORDS = bytearray(b" " * 256)
_WORDS[48:58], _WORDS[97:123], _WORDS[128:] = range(48, 58), range(97, 123), range(128, 256)
_WORDS[65:91] = range(97, 123)


@dataclass(frozen=True)
class Notice:
    """Words to find, the label they give, and the edits that are allowed."""

    words: str
    label: str
    edits: int = 0

    @property
    def seeds(self) -> tuple[tuple[int, bytes], ...]:
        """edits + 1 pieces with their offsets; a whole phrase is sought as such."""
        raw, n = self.words.encode(), self.edits + 1
        cuts = [len(raw) * k // n for k in range(n + 1)]
        return tuple((a, raw[a:b]) for a, b in zip(cuts, cuts[1:]))


def notices(phrases=PHRASES, fuzzy=NOTICES, per: int = 10) -> tuple[Notice, ...]:
    """Phrases as they are; fuzzy ones with an edit for each ``per`` characters."""
    return tuple(Notice(w, label) for w, label in phrases) + tuple(Notice(w, label, max(1, len(w) // per)) for w, label in fuzzy)


@lru_cache(maxsize=1024)
def _pattern(notice: Notice):
    import regex

    words = regex.escape(notice.words.encode(), special_only=True)
    return regex.compile(b"(?b)(?<=\x20)(?:%b){e<=%d}(?=\x20)" % (words, notice.edits))


@lru_cache(maxsize=8)
def _seeds(sought: tuple[Notice, ...]) -> dict[bytes, list[tuple[Notice, int]]]:
    out: dict[bytes, list[tuple[Notice, int]]] = {}
    for notice in sought:
        for at, piece in notice.seeds:
            out.setdefault(piece, []).append((notice, at))
    return out


def _places(text: bytes, piece: bytes):
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def scan(text: bytes, sought: tuple[Notice, ...]) -> tuple[int, list[tuple[str, str, int, int, int]]]:
    """Number of words, and spans (label, notice, first and last word, edits) in order."""
    words = text.translate(bytes(_WORDS)).split()
    joined = b" " + b" ".join(words) + b" "
    windows: dict[Notice, set[int]] = {}
    for piece, uses in _seeds(sought).items():
        for place in _places(joined, piece):
            for notice, at in uses:
                windows.setdefault(notice, set()).add(place - at)
    blanks = [m.start() for m in re.finditer(b" ", joined)] if windows else []
    spans = []
    for notice, starts in windows.items():
        size, k, found = len(notice.words.encode()), notice.edits, set()
        if not k:
            found = {(a, a + size, 0) for a in starts if joined[a - 1 : a] == b" " and joined[a + size : a + size + 1] == b" "}
        else:
            pattern = _pattern(notice)
            for a in starts:
                m = pattern.search(joined, max(0, a - k - 1), min(len(joined), a + size + k + 1))
                if m:
                    found.add((m.start(), m.end(), sum(m.fuzzy_counts)))
        kept: list[tuple[int, int, int]] = []
        for i, j, edits in sorted(found):
            if k and kept and i < kept[-1][1]:
                if edits < kept[-1][2]:
                    kept[-1] = (i, j, edits)
            else:
                kept.append((i, j, edits))
        for i, j, edits in kept:
            first = bisect_left(blanks, i) - 1
            spans.append((notice.label, notice.words, first, first + bisect_left(blanks, j) - bisect_left(blanks, i), edits))
    return len(words), sorted(spans, key=lambda s: (s[2], s[3], s[1]))


def license_spans(text: Column, sought: tuple[Notice, ...] | None = None) -> Column:
    """Struct of the number of words and the spans found."""
    sought = sought or notices()

    @F.arrow_udf(RESULT)
    def find(texts: pa.Array) -> pa.Array:
        sizes, spans = [], []
        for t in texts:
            n, found = scan(t.as_buffer().to_pybytes() if t.is_valid else b"", sought)
            sizes.append(n)
            spans.append([dict(zip(("label", "notice", "first_word", "last_word", "edits"), s)) for s in found])
        span = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span))], ["n_words", "spans"])

    return find(text)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``: base phrase places, labels of base phrases and of fuzzy notices, and a score
    (1 less the edits of the best span against its notice's length, 0 without spans)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", license_spans(F.col("text")).alias("found"))
    base_words = F.array(*(F.lit(w) for w, _ in PHRASES))
    base = F.filter("found.spans", lambda s: F.array_contains(base_words, s["notice"]))
    score = F.array_max(F.transform("found.spans", lambda s: 1 - s["edits"] / F.length(s["notice"]).cast("double")))
    labels = lambda spans: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))))
    out = docs.withColumn("base", base).withColumn("starts", F.transform("base", lambda s: s["first_word"]))
    return out.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("found.spans")).alias("labels"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
        F.to_json("found.spans").alias("spans"),
    )

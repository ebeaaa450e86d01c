"""Periodic runs of words by longest previous factors.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word extends, and that
is at least ``least`` words and ``times`` periods long. Words are runs of characters other than ASCII white space. All runs of a
text are found in time n log n:

1. Suffix array by prefix doubling. The ranks of all stretches of 1, 2, 4 .. words are kept, so the common length ahead
   of two places or behind them is a descent over the ranks.
2. Longest previous factors: nearest suffixes of earlier places on both sides in the suffix array, by one pass with a stack; the longer common length (LCP) counts.
3. Blocks of the Lempel-Ziv factorisation: from each place, the longest previous factor is the next block.
4. Main's boundary extensions: a run whose last word lies in a block touches the block's begin, or ends where the block ends, or lies
   within it. For the first two, each boundary is compared with the places p words ahead, for p up to the length of the block that
   begins, and p words back, for p up to the lengths of both blocks; the common lengths ahead and behind are the run's ends.
5. Bucketed copying: what lies within a block lies as well in its earlier occurrence, so runs are copied in the order of their starts.

A text in which no stretch of ``least`` (1 - 1 / ``times``) words repeats has no run, as a run without its first period does; only the others
go through the steps. Texts are taken together in groups of bounded size; one longer text is a group of its own, whose memory is
4 log2(longest repeat) bytes a word. Null and empty texts have no runs; repeated rows are treated alike; an empty table gives an
empty result; other columns are left alone. Text of any length is taken whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, mix64, spread, table, tidy

#: Words and periods of a run at least.
LEAST, TIMES = 24, 3
#: Words of texts that are solved together, and pairs of places that are compared at once.
GROUP, PAIRS = 1 << 16, 1 << 20
RESULT = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


class Suffixes:
    """Ranks of all stretches of 2^k words of some sequences, laid end to end; ``owner`` ascends with the sequence."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray):
        n = len(codes)
        rank, count = self._dense(owner * (int(codes.max(initial=0)) + 1) + codes)
        ranks, step = [rank], 1
        while count < n:
            after = np.zeros(n, np.int64)
            if step < n:
                after[:-step] = np.where(owner[step:] == owner[:-step], rank[step:] + 1, 0)
            rank, count = self._dense(rank * (n + 1) + after)
            ranks.append(rank)
            step *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.ranks = [np.append(r, -1).astype(np.int32) for r in ranks]  # what follows the last word equals nothing
        self.n = n

    @staticmethod
    def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.cumsum(new)
        return rank, int(new.sum()) + 1

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from i and from j on (i < j)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r = self.ranks[k]
            out += (r[np.minimum(i + out, self.n)] == r[np.minimum(j + out, self.n)]).astype(np.int64) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray, low: np.ndarray) -> np.ndarray:
        """How many words are equal before i and before j (i < j), from ``low`` on."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r, a = self.ranks[k], i - out - (1 << k)
            out += ((a >= low) & (r[np.maximum(a, 0)] == r[np.maximum(j - out - (1 << k), 0)])).astype(np.int64) << k
        return out

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the longest previous factor's length, and an earlier place where it occurs."""
        order = self.order.tolist()
        left, right, stack = [-1] * self.n, [-1] * self.n, []
        for at in order:
            while stack and stack[-1] > at:
                right[stack.pop()] = at
            if stack:
                left[at] = stack[-1]
            stack.append(at)
        place = np.arange(self.n)
        best, where = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for side in (np.array(left, np.int64), np.array(right, np.int64)):
            some = np.flatnonzero(side >= 0)
            common = self.ahead(side[some], place[some])
            longer = common > best[some]
            best[some[longer]], where[some[longer]] = common[longer], side[some[longer]]
        return best, where


def lz_blocks(lengths: list[int], start: int, end: int) -> list[int]:
    """Where the blocks of a sequence begin, and its end."""
    out, at = [], start
    while at < end:
        out.append(at)
        at += lengths[at] or 1
    return [*out, end]


def boundary_runs(s: Suffixes, at: np.ndarray, low: np.ndarray, back: np.ndarray, on: np.ndarray, least: int, times: int, half: int) -> np.ndarray:
    """Rows (start, end, period) of the runs that touch boundaries ``at`` (``low``: where their sequence starts), with periods up to ``on``
    that have a whole period ahead, and up to ``back`` that have one behind."""
    ends = np.cumsum(np.concatenate([on, back]))
    found = []
    both, lows = np.concatenate([at, at]), np.concatenate([low, low])
    r, stretch = s.ranks[half], 1 << half
    for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        pair = np.arange(first, min(first + PAIRS, int(ends[-1])))
        own = np.searchsorted(ends, pair, side="right")
        p = pair - np.where(own > 0, ends[own - 1], 0) + 1
        i = np.where(own < len(at), both[own], both[own] - p)
        j, start = i + p, lows[own]
        # a run is so long that one of the common lengths is ``stretch`` at least
        before = i - stretch
        some = np.flatnonzero((r[i] == r[j]) | (before >= start) & (r[np.maximum(before, 0)] == r[np.maximum(j - stretch, 0)]))
        i, j, p = i[some], j[some], p[some]
        a, b = i - s.behind(i, j, start[some]), j + s.ahead(i, j)
        good = b - a >= np.maximum(least, times * p)
        found.append(np.stack([a[good], b[good], p[good]], axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):  # several multiples of a period give the same stretch: the smallest counts
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
    return rows


def copy_runs(runs: list[tuple[int, int, int]], blocks: list[int], where: list[int], least: int) -> list[tuple[int, int, int]]:
    """``runs`` (sorted) and those that lie within blocks, copied from the blocks' earlier occurrences."""
    for b, c in zip(blocks, blocks[1:]):
        if c - b < least + 2 or not runs:
            continue
        shift = b - where[b]
        at = bisect_left(runs, (b + 1 - shift,))
        while at < len(runs) and runs[at][0] + shift < c:
            start, end, p = runs[at]
            if end + shift < c:
                insort(runs, (start + shift, end + shift, p))
            at += 1
    return runs


def solve(sequences: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each sequence of codes, by start and period."""
    if times < 2 or least < 2:
        raise ValueError("runs have at least two periods and two words")
    gram = max(1, 1 << (-(-least * (times - 1) // times)).bit_length() - 1)
    out: list[list] = [[] for _ in sequences]
    sizes = np.array([len(x) for x in sequences], np.int64)
    kept = np.flatnonzero(sizes)
    if len(kept):
        kept = kept[repeats(np.concatenate([sequences[k] for k in kept]), sizes[kept], gram)]
    if not len(kept):
        return out
    codes, owner = np.concatenate([sequences[k] for k in kept]).astype(np.int64), spread(sizes[kept])
    s = Suffixes(codes, owner)
    lengths, where = s.previous()
    starts = np.concatenate([[0], np.cumsum(sizes[kept])]).tolist()
    cut = [lz_blocks(lens, a, b) for lens in [lengths.tolist()] for a, b in zip(starts, starts[1:])]
    at = np.concatenate([np.array(x[1:], np.int64) for x in cut])
    before = np.concatenate([np.diff(x) for x in cut])
    on = np.concatenate([np.append(np.diff(x[1:]), 0) for x in cut])
    low = np.repeat(np.array(starts[:-1], np.int64), [len(x) - 1 for x in cut])
    half = max(gram.bit_length() - 2, 0)
    if half >= len(s.ranks):
        return out
    rows = boundary_runs(s, at, low, np.minimum(before + on, at - low), on, least, times, half)
    where, firsts = where.tolist(), np.searchsorted(rows[:, 0], starts)
    for k, a, blocks, i, j in zip(kept.tolist(), starts, cut, firsts, firsts[1:]):
        runs = copy_runs(list(map(tuple, rows[i:j].tolist())), blocks, where, least)
        out[k] = sorted((start - a, end - start, p) for start, end, p in runs)
    return [sorted(x, key=lambda run: (run[0], run[2])) for x in out]


def repeats(codes: np.ndarray, sizes: np.ndarray, gram: int) -> np.ndarray:
    """Sequences (laid end to end) in which some stretch of ``gram`` codes may occur twice; those in which one does are among them."""
    h, step = mix64(codes), 1
    while step < gram:
        h = mix64(h[: max(len(h) - step, 0)] * np.uint64(3) + h[step:])
        step *= 2
    owner, place = spread(sizes), np.arange(len(codes))
    ends = np.cumsum(sizes)
    whole = np.flatnonzero(place + gram <= ends[owner])
    keys = h[whole] ^ mix64(owner[whole])
    order = np.argsort(keys)
    twice = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    return np.unique(owner[whole[order[twice]]])


def codes_of(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers; ``known`` gets new words."""
    number = known.setdefault
    return np.fromiter((number(w, len(known)) for w in text.split()), np.int64)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: none that a run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def planted(codes: np.ndarray, key: str | None) -> np.ndarray:
    """The words of a tenth of the documents with a tail repeated: where h = crc32(key) leaves 0 modulo 10, word i >= a becomes word
    a + (i - a) % p, with g = h div 10, a = g % n, p = 1 + (n - a) div (3 + g % 8). A null key plants nothing."""
    n = len(codes)
    g, rest = divmod(zlib.crc32(key.encode()), 10) if key is not None else (0, 1)
    if rest or not n:
        return codes
    a = g % n
    return np.concatenate([codes[:a], codes[a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))]])


def find(texts: pa.Array, plant: list[str | None] | None = None, least: int = LEAST, times: int = TIMES) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Runs of each text, and its words without repeated periods; with ``plant``, keys by which words are repeated first."""
    body, offsets = flat(texts)
    raw, bounds = body.tobytes(), offsets.tolist()
    runs: list[list] = []
    collapsed: list[bytes] = []
    known: dict[bytes, int] = {}
    group: list[np.ndarray] = []

    def close() -> None:
        words = list(known)
        for codes, own in zip(group, solve(group, least, times)):
            kept = codes[kept_words(len(codes), own)] if own else codes
            runs.append(own)
            collapsed.append(b" ".join([words[c] for c in kept.tolist()]))
        group.clear()
        known.clear()

    size = 0
    for row, (a, b) in enumerate(zip(bounds, bounds[1:])):
        codes = codes_of(raw[a:b], known)
        group.append(planted(codes, plant[row]) if plant else codes)
        size += len(codes)
        if size >= GROUP:
            close()
            size = 0
    close()
    return runs, collapsed


def periodic_runs(text: Column, plant: Column | None = None, least: int = LEAST, times: int = TIMES) -> Column:
    """Struct of a text's runs (start, length, period, by start and period) and of its words without repeated periods; with
    ``plant``, a key by which words of some texts are repeated first (``planted``)."""

    def made(texts: pa.Array, keys: list | None) -> pa.Array:
        runs, collapsed = find(texts, keys, least, times)
        ends = np.cumsum([0, *map(len, runs)])
        rows = np.array([x for own in runs for x in own], np.int64).reshape(-1, 3)
        each = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), pa.array(collapsed, pa.string())], ["runs", "collapsed"])

    @F.arrow_udf(RESULT)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield made(texts, None)
        tidy()

    @F.arrow_udf(RESULT)
    def search_planted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, keys in batches:
            yield made(texts, keys.to_pylist())
        tidy()

    # so that it is computed once
    return search.asNondeterministic()(text) if plant is None else search_planted.asNondeterministic()(text, plant.cast("string"))


def longest(runs: Column) -> Column:
    """The run of greatest exact length/period (ties: smallest start, then period) of a list ordered by start and period; null of none."""
    better = lambda best, run: best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.reduce(runs, none, lambda best, run: F.when(better(best, run), run).otherwise(best))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text of ``documents`` with planted repeats, and digests of the runs and of what is left without repeats."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", periodic_runs(F.col("text"), F.col("doc_id")).alias("found")).select("doc_id", "found.*")
    found = found.withColumn("best", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

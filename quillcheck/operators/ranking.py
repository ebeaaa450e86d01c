"""Free-text search of records: the best BM25 score of each query over an inverted index, exactly.

Scores are sums of whole numbers (millionths), so they do not depend on the order of addition. Rows with the same words are one bag, and queries with the
same indexed words are one query, so copies never multiply.

The index is four tables: tokens (token, t), postings (token, t, part, at, weight), lists (the postings of a token and part as two arrays, by ``at``) and
bags (at, and the least place of a record). ``at`` numbers bags in the order of their places; a part is the bags of one hash, ``PART`` about.

A search meets every block of queries with every part, so no pair of a query and a bag is ever written or shuffled: what is moved are the lists, once
for each block, and the queries, once for each part. Within such a cell, the lists of a query are taken from the shortest to the longest. Some bags of the
shortest are scored in full, which gives a score to beat. Lists are added up until what the others could give together is less; the others are only
looked up for the bags that can still win. What lists can give is known for each kind of bag (by its number of words), as long bags have low weights. The
longest lists, of which most queries have some, are also kept by bag (``DENSE``), so that they are looked up at once. The result is that of scoring all records.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Saturation of repeated tokens, and how much a record's length counts.
K1, B = 1.2, 0.75
#: What a score of 1 is in sums.
UNIT = 1_000_000
#: Bags of a part about, and postings of a query's shortest lists whose bags are scored before the others.
PART, FIRST = 500_000, 32
#: Cells at least, and queries of a block at most, about.
CELLS, ASKED = 24, 250_000
#: Kinds of bags, lists that are kept by bag, queries that are prepared together, and bags of a query that are scored one by one rather than list by list.
KINDS, DENSE, TOGETHER, FEW = 16, 64, 64, 16


@dataclass
class Index:
    postings: DataFrame
    tokens: DataFrame
    lists: DataFrame
    bags: DataFrame
    parts: int


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def build(rows: DataFrame, text: str = "text", place: str = "place") -> Index:
    """Index of ``rows`` with a text and an orderable place. Rows without words are in no result."""
    each = rows.select(F.col(place).alias("place"), F.array_sort(words(F.col(text))).alias("words")).where("size(words) > 0")
    own = each.groupBy(F.unhex(F.md5(F.array_join("words", " "))).alias("bag")).agg(F.min("place").alias("place"), F.count("*").alias("n"), F.first("words").alias("words"))
    own = cut(own.orderBy("place").withColumn("at", F.monotonically_increasing_id()))
    total = own.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.size("words")).alias("words"), F.count("*").alias("bags")).head()
    count, mean = float(total["n"] or 0), float(total["words"] or 0) / float(total["n"] or 1)
    parts = max(1, -(-total["bags"] // PART))
    terms = own.select("bag", "at", "n", F.size("words").alias("length"), F.explode("words").alias("token")).groupBy("bag", "at", "n", "length", "token").agg(F.count("*").alias("tf"))
    idf = F.log(1 + (F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    often = cut(terms.groupBy("token").agg(F.sum("n").alias("df")).select("token", idf.alias("idf"), F.monotonically_increasing_id().alias("t")))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    weight = F.round(UNIT * F.col("idf") * share).cast("long")
    part = F.pmod(F.xxhash64("bag"), F.lit(parts)).cast("int")
    postings = cut(terms.join(often, "token").select("token", "t", part.alias("part"), "at", weight.alias("weight")))
    lists = postings.groupBy("part", "t").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("l"))
    lists = lists.select("part", "t", F.transform("l", lambda x: x["at"]).alias("ats"), F.transform("l", lambda x: x["weight"].cast("int")).alias("weights"))
    return Index(postings, often.select("token", "t"), cut(lists), own.select("at", "place"), parts)


def _ranges(starts, sizes):
    """The numbers of all ranges, one after the other."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Part:
    """The lists of a part from the shortest to the longest, their bags numbered by ``at``."""

    def __init__(self, lists: pa.Table):
        import numpy as np
        import pyarrow.compute as pc

        size = pc.list_value_length(lists["ats"]).to_numpy().astype(np.int64)
        order = np.argsort(size, kind="stable")
        lists, self.size = lists.take(order), size[order]
        self.t = lists["t"].to_numpy()
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size
        ats, self.weights = (pc.list_flatten(lists[c]).to_numpy() for c in ("ats", "weights"))
        own = np.repeat(np.arange(len(size), dtype=np.int32), self.size)
        # the same postings by bag
        order = np.argsort(ats, kind="stable")
        new = np.append(True, np.diff(ats[order]) != 0)
        self.first = np.flatnonzero(new)
        self.names = ats[order[self.first]]
        self.at = np.empty(len(ats), np.int64)
        self.at[order] = np.cumsum(new) - 1
        self.count = np.diff(np.append(self.first, len(ats)))
        self.has, self.gives = own[order], self.weights[order]
        self.kind = np.minimum(np.ceil(2 * np.log2(self.count)), KINDS - 1).astype(np.uint8)
        most = np.zeros(len(size) * KINDS, np.int64)
        np.maximum.at(most, own.astype(np.int64) * KINDS + self.kind[self.at], self.weights.astype(np.int64))
        self.most = most.reshape(-1, KINDS)
        self.long = max(0, len(size) - DENSE)
        self.dense = np.zeros((len(size) - self.long, len(self.names)), np.int32)
        a = self.starts[self.long]
        self.dense[own[a:] - self.long, self.at[a:]] = self.weights[a:]

    def known(self, ts: pa.ChunkedArray):
        """The lists of each query, from the shortest to the longest: all of them, and how many each query has."""
        import numpy as np
        import pyarrow.compute as pc

        sizes, t = pc.list_value_length(ts).to_numpy(), pc.list_flatten(ts).to_numpy()
        query, by = np.repeat(np.arange(len(sizes)), sizes), np.argsort(self.t)
        own = by[np.minimum(np.searchsorted(self.t, t, sorter=by), len(by) - 1)]
        there = self.t[own] == t
        own, query = own[there], query[there]
        return own[np.lexsort((own, query))], np.bincount(query, minlength=len(sizes))


def _best_of(floor: int, first: int):
    """For the queries (set, ts) of a cell, the best bag of its lists: set, at, score. Sums are of whole numbers."""
    schema = pa.schema([("set", pa.int64()), ("at", pa.int64()), ("score", pa.int64())])

    def best(sets: pa.Table, lists: pa.Table) -> pa.Table:
        import numpy as np

        if not sets.num_rows or not lists.num_rows:
            return schema.empty_table()
        part = _Part(lists)
        own, sizes = part.known(sets["ts"])
        wide = np.int64 if int(sizes.max()) * int(part.most.max()) >= 1 << 31 else np.int32
        total, weights = np.zeros(len(part.names), wide), part.weights.astype(wide, copy=False)
        member = np.zeros((TOGETHER, len(part.t)), bool)
        out, offsets = [], np.append(0, np.cumsum(sizes))
        for k in range(0, len(sizes), TOGETHER):
            n = sizes[k : k + TOGETHER]
            found = _together(part, own[offsets[k] : offsets[k + len(n)]], n, floor, first, total, weights, member)
            out += [(sets["set"].to_numpy()[k + found[0]], part.names[found[1]], found[2])] if found else []
        return pa.Table.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (zip(*out) if out else ([[]], [[]], [[]]))], schema=schema)

    return best


def _together(part: _Part, own, n, floor: int, first: int, total, weights, member):
    """Of the next queries, with ``n`` of the lists ``own`` each: those that have a best bag, that bag and its score. ``total`` and ``member`` are
    zeros, and are left so."""
    import numpy as np

    if not len(own):
        return None
    queries, end = np.arange(len(n)), np.cumsum(n)
    begin, q, i = end - n, np.repeat(queries, n), np.arange(len(own))
    member[q, own] = True

    def scores(q, at):
        count = part.count[at]
        k = _ranges(part.first[at], count)
        return np.add.reduceat(part.gives[k] * member[np.repeat(q, count), part.has[k]], np.cumsum(count) - count, dtype=np.int64)

    # what the lists from one on could give, for each kind
    sums = np.append(part.most[own][::-1].cumsum(0)[::-1], np.zeros((1, KINDS), np.int64), 0)
    rest = lambda i, q: sums[i] - sums[end[q]]
    most = rest(i, q).max(1)
    # a score to beat: that of some bags of the shortest lists
    low, size = np.full(len(n), floor), part.size[own]
    before = np.cumsum(size) - size
    some = np.clip(first - (before - before[np.minimum(begin, len(own) - 1)][q]), 0, size)
    if some.any():
        asked = np.repeat(q, some)
        np.maximum.at(low, asked, scores(asked, part.at[_ranges(part.starts[own], some)]))
    # lists up to ``cut`` are added up; of the others, those from ``long`` on are looked up by bag
    cut = begin + np.bincount(q, most >= low[q], len(n)).astype(np.int64)
    long = np.maximum(cut, begin + np.bincount(q, own < part.long, len(n)).astype(np.int64))
    left = rest(cut, queries)
    between = left - rest(long, queries)
    after = rest(i + 1, q) + between[q]
    lists, held = own.tolist(), []
    starts, ends = part.starts[own].tolist(), part.ends[own].tolist()
    for query, (a, b, c, d) in enumerate(zip(begin.tolist(), cut.tolist(), long.tolist(), end.tolist())):
        if a == b:
            continue
        at = np.concatenate([part.at[starts[k] : ends[k]] for k in range(a, b)])
        np.add.at(total, at, np.concatenate([weights[starts[k] : ends[k]] for k in range(a, b)]))
        score = total.take(at)
        total[at] = 0
        least = max(int(low[query]), int(score.max()))
        keep = np.flatnonzero(score >= least - int(left[query].max()))
        at, score = at.take(keep), score.take(keep)
        kind = part.kind.take(at)
        keep = np.flatnonzero(score >= (least - left[query]).take(kind))
        while True:
            at, score, kind = at.take(keep), score.take(keep), kind.take(keep)
            if c == d or len(at) <= FEW:
                break
            score = score + part.dense[lists[c] - part.long].take(at)
            least = max(least, int(score.max()))
            keep = np.flatnonzero(score >= (least - after[c]).take(kind))
            c += 1
        if c == d and long[query] == b and len(at):  # no list is left
            at = at[score == score.max()].min(keepdims=True)
        held.append((query, at))
    asked, at = np.repeat([x[0] for x in held], [len(x[1]) for x in held]), np.concatenate([x[1] for x in held] or [i[:0]])
    if len(at):
        score = scores(asked, at)
        order = np.lexsort((at, -score, asked))  # of equal scores the first place
        order = order[np.append(True, np.diff(asked[order]) != 0)]
        order = order[score[order] >= floor]
        found = asked[order], at[order], score[order]
    member[q, own] = False
    return found if len(at) else None


def search(index: Index, queries: DataFrame, least: float, key: str = "id", text: str = "text") -> DataFrame:
    """For each row of ``queries`` whose best record scores ``least`` or more: key, place (of equal scores the least) and score."""
    asked = cut(queries.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(words(F.col(text)))).alias("words")).withColumn("query", F.unhex(F.md5(F.array_join("words", " ")))))
    each = asked.groupBy("query").agg(F.first("words").alias("words")).select("query", F.explode("words").alias("token")).join(index.tokens, "token")
    known = cut(each.groupBy("query").agg(F.array_sort(F.collect_list("t")).alias("ts")))
    sets = cut(known.select("ts").distinct().withColumn("set", F.monotonically_increasing_id()))
    blocks = max(-(-CELLS // index.parts), -(-sets.count() // ASKED))
    cell = (F.col("block") * index.parts + F.col("part")).alias("cell")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sets.select("set", "ts", F.pmod(F.xxhash64("set"), F.lit(blocks)).cast("int").alias("block"), spread(index.parts).alias("part"))
    right = index.lists.select("part", "t", "ats", "weights", spread(blocks).alias("block"))
    # many more tasks than cells, so that few cells share one
    left, right = (side.select(cell, *rest).repartition(4 * blocks * index.parts, "cell") for side, rest in ((left, ("set", "ts")), (right, ("t", "ats", "weights"))))
    cells = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_best_of(round(least * UNIT), FIRST), "set long, at long, score long")
    best = cells.groupBy("set").agg(F.min(F.struct((-F.col("score")).alias("score"), "at")).alias("best"))
    best = sets.join(best, "set").select("ts", "best.at", (-F.col("best.score") / UNIT).alias("score")).join(index.bags, "at")
    hits = known.join(best, "ts").select("query", "place", "score")
    return asked.select("id", "query").join(hits, "query").select(F.col("id").alias(key), "place", "score")

"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of variable order (0 to ``ORDER``) with escape probabilities (method C):
in a context seen N times with T distinct next bytes, a byte seen n times has probability n/(N+T), and the
escape to the next shorter context T/(N+T); below order 0 all 256 bytes are alike. Statistics are frozen after
training, so the code length of a byte depends on it and the ``ORDER`` bytes before it alone, and a text's code
length is a sum over its windows of ``ORDER`` + 1 bytes. Code lengths are whole multiples of 2^-16 bit, so sums
are exact and do not depend on batches. The language with the shortest code wins; ties go to the first name.

Training takes a bounded sample of the labelled rows: the ``max_docs`` texts of least hash in each language
(all of them where there are fewer), whole, as long as those before come to less than ``max_bytes``. More than ``max_langs``
languages are an error. So the model that is sent to all tasks is bounded by these parameters. Scoring takes every whole
text, long ones in blocks.

Null texts and texts without a letter get ``und`` and score 0, and so does every text where there is no
labelled row. A null id is not held out. Repeated rows are scored alike; an empty table gives an empty result; other columns
are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLOCK_BYTES, flat, blocks, id_remainder, table, tidy

ORDER = 4
#: Training texts of a language at most.
MAX_DOCS = 500
#: Bytes of a language's training texts from which no further text is taken, and languages at most.
MAX_BYTES, MAX_LANGS = 8 << 20, 200
UNIT = 1 << 16
#: Bytes of text that are scored at once; a byte takes about 100 bytes of memory meanwhile.
SCORE_BYTES = BLOCK_BYTES // 4
RESULT = "struct<lang:string,score:double,bits:double,bytes:bigint>"


def windows(body: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte, it and the ``ORDER`` bytes before it in its text (0 before the start) as one number."""
    code = body.astype(np.int64)
    for k in range(1, ORDER + 1):
        code[k:] |= body[:-k].astype(np.int64) << 8 * k
    for k in range(ORDER):  # no bytes of the text before
        at = starts + k
        at = at[at < len(body)]
        code[at] &= (1 << 8 * (k + 1)) - 1
    # a text shorter than ORDER bytes ends before its mask does: the next text's own mask comes later
    for k in range(ORDER - 1, -1, -1):
        at = starts + k
        at = at[at < len(body)]
        code[at] &= (1 << 8 * (k + 1)) - 1
    return code


@dataclass
class Tree:
    """One language: for each order, the seen grams with counts and the contexts with their totals."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray) -> Tree:
        out = cls([], [], [], [], [])
        for k in range(ORDER + 1):
            grams, back = np.unique(codes & (1 << 8 * (k + 1)) - 1, return_inverse=True)
            n = np.bincount(back, counts, len(grams)).astype(np.int64)
            contexts, first = np.unique(grams >> 8, return_inverse=True)
            out.grams.append(grams)
            out.counts.append(n)
            out.contexts.append(contexts)
            out.totals.append(np.bincount(first, n, len(contexts)).astype(np.int64))
            out.distinct.append(np.bincount(first, minlength=len(contexts)))
        return out

    def cost(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each window."""
        bits = np.full(len(codes), 8.0)
        for k in range(ORDER + 1):
            grams = codes & (1 << 8 * (k + 1)) - 1
            contexts = grams >> 8
            c = np.minimum(np.searchsorted(self.contexts[k], contexts), len(self.contexts[k]) - 1)
            known = self.contexts[k][c] == contexts
            g = np.minimum(np.searchsorted(self.grams[k], grams), len(self.grams[k]) - 1)
            seen = self.grams[k][g] == grams
            whole = self.totals[k][c] + self.distinct[k][c]
            bits = np.where(seen, np.log2(whole / self.counts[k][g]), np.where(known, bits + np.log2(whole / self.distinct[k][c]), bits))
        return np.rint(bits * UNIT).astype(np.int64)


class Model:
    """Trees of all languages, and the costs of every window seen in training."""

    def __init__(self, trees: dict[str, Tree]):
        self.langs = sorted(trees)
        self.trees = [trees[x] for x in self.langs]
        self.known = np.unique(np.concatenate([t.grams[ORDER] for t in self.trees])) if trees else np.zeros(0, np.int64)
        self.costs = self._costs(self.known)

    def _costs(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([t.cost(codes) for t in self.trees], axis=1).astype(np.int32) if self.trees else np.zeros((len(codes), 0), np.int32)

    def window_costs(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        out = self.costs[at]
        new = np.flatnonzero(self.known[at] != codes)
        out[new] = self._costs(codes[new])
        return out

    def lengths(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths (in 2^-16 bit) of texts, by language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)), np.int64)
        for i, j in blocks(offsets, SCORE_BYTES):
            if offsets[j] - offsets[i] <= 2 * SCORE_BYTES:
                own = offsets[i : j + 1] - offsets[i]
                out[i:j] = self._sums(body[offsets[i] : offsets[j]], own[:-1], own)
            else:  # one long text, in blocks that know the bytes before them
                for a in range(offsets[i], offsets[j], SCORE_BYTES):
                    b = min(a + SCORE_BYTES, offsets[j])
                    lead = min(ORDER, a - offsets[i])
                    out[i] += self._sums(body[a - lead : b], np.array([0] if not lead else [], np.int64), np.array([lead, b - a + lead]))[0]
        return out

    def _sums(self, body: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        coded = pc.dictionary_encode(pa.array(windows(body, starts)))
        costs = self.window_costs(coded.dictionary.to_numpy())
        sums = np.zeros((len(body) + 1, len(self.langs)), np.int64)
        np.cumsum(costs[coded.indices.to_numpy()], axis=0, dtype=np.int64, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]


def _has_letter(body: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    import regex

    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    out = np.zeros(len(offsets) - 1, bool)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        out[some] = np.logical_or.reduceat(letter[body], offsets[:-1][some])
    pattern = regex.compile(r"\p{L}")
    for i in np.flatnonzero(~out & (np.diff(offsets) > 1)):
        out[i] = pattern.search(texts[int(i)].as_py()) is not None
    return out


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, max_langs: int = MAX_LANGS) -> Model:
    """Fit on labelled rows: at most ``max_docs`` of each language, those of least ``xxhash64(key)``.

    A first pass counts the rows of each language; a second reads the texts below the hash that so many rows
    should have, and a window keeps exactly the first ``max_docs`` of them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return Model({})
    share = spark.createDataFrame([(x, min(1.0, (1.5 * max_docs + 100) / n)) for x, n in counts.items()], "l string, share double")
    draw = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    few = rows.join(F.broadcast(share), "l").withColumn("u", draw).where("u < share")
    order = Window.partitionBy("l").orderBy("u", "k", F.xxhash64("t"))
    first = few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_docs)
    before = F.sum(F.octet_length("t").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    sample = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < max_bytes).select("l", "t")

    def count(batches):
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            body, offsets = flat(batch.column(1))
            for i, j in blocks(offsets):
                codes = windows(body[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
                owner = np.repeat(names[i:j], np.diff(offsets[i : j + 1]))
                for name in {*names[i:j]}:
                    grams, n = np.unique(codes[owner == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n, pa.int64())], ["l", "gram", "n"])

    grams = sample.mapInArrow(count, "l string, gram bigint, n bigint").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    found = grams.toArrow()
    names = found.column("l").to_numpy()
    codes, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    return Model({x: Tree.of(codes[names == x], n[names == x]) for x in {*names.tolist()}})


def language(spark: SparkSession, text: Column, model: Model) -> Column:
    """Struct of the predicted language, a score (its posterior under equal priors), the code's bits and the bytes."""
    sent = spark.sparkContext.broadcast(model)

    def identify(m: Model, texts: pa.Array) -> pa.Array:
        body, offsets = flat(texts)
        n = len(texts)
        lengths = m.lengths(body, offsets)
        if not m.langs or not n:
            best, score, bits, ok = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n, bool)
        else:
            best = lengths.argmin(axis=1)
            least = lengths[np.arange(n), best]
            score = 1 / np.exp2(-np.minimum((lengths - least[:, None]) / UNIT, 1000)).sum(axis=1)
            bits, ok = least / UNIT, _has_letter(body, offsets, texts)
        langs = [m.langs[k] if y else "und" for k, y in zip(best, ok)]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(bits), pa.array(np.diff(offsets))], ["lang", "score", "bits", "bytes"])

    @F.arrow_udf(RESULT)
    def identify_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield identify(sent.value, texts)
        tidy()

    return identify_all.asNondeterministic()(text)  # so that it is computed once, before any filter on it


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model of the rows that are not held out (crc32(doc_id) mod 3 is not 1)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    model = train(docs.where(~held))
    out = docs.select("doc_id", held.alias("held_out"), language(spark, F.col("text"), model).alias("found"))
    return out.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.bits").alias("code_bits"), F.col("found.bytes").alias("n_bytes"))

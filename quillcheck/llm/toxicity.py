"""Toxicity after noisy-channel deobfuscation.

Restoring: a token that mixes letters with digits or signs, consists of signs and digits that stand for letters, stretches
a letter, doubles one where the letter model does not expect it, or comes letter by letter is a noisy copy of what was
meant. Its characters make a lattice: a sign or digit may stand for a letter (leetspeak), for nothing, or for a break; a
repeated letter may be one; a space or dot between single letters may be nothing. A character trigram model, counted over
all documents, and the costs of the channel score every path, and Viterbi's algorithm finds the best, with back-pointers,
in time and memory linear in the token. Signs at the ends of a token that may stand for letters are steps of the
lattice, too; where they may be decoration around a plain word, that word counts beside what was restored. Three of a sign that may
be any vowel are none. Tokens without a letter are read as letters and breaks throughout, as a whole and between other marks; of
their words, those count that are likelier than letters at random. Tokens of any length and with any number of signs are taken whole.

Scoring: restored texts become sets of words and word beginnings; a logistic regression on the features that go most with
the label gives the score. It is fitted on at most ``max_docs`` labelled documents of each class (those of least hash, one text of each id), on whole
texts, and its intercept is then moved to the share of the label among all labelled rows.

A null text counts as empty; a null id is not held out. Where there are no labels, every score is 0; where all labels are
alike, their share. A document with several label rows has the largest of them. Repeated rows are scored alike, ties between
paths go to the one found first (states in the order of their making, options in that of the tables), an empty table gives an
empty result, and other columns are left alone. Texts of any length are taken whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, flat, id_remainder, shared_dir, table, tidy

#: Labelled rows of each class, and features, that the fit takes at most.
MAX_DOCS, FEATURES = 3000, 400
RESULT = "struct<score:double,restored:array<string>>"

# Letters that a sign or digit may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou", "%": "aeiou", "&": "aeiou"}
# Costs of the channel, in nats.
SWAP, GUESS, DROP, BREAK, JOIN, SHRINK = 0.5, 3.0, 3.5, 1.5, 0.2, 0.3

# Cost from which a doubled letter is unexpected, and of a letter at random.
ODD, RANDOM = 5.0, float(np.log(28))
#: Characters of a token up to which its words are remembered.
REMEMBERED = 64

LETTERS = 28  # 0: no letter, 1-26: a-z, 27: bytes of other letters
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27


def trigram_counts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of letter trigrams, with a break before and after each text."""
    n = len(offsets) - 1
    row = np.zeros(len(body) + 2 * n + 1, np.int64)
    row[np.arange(len(body)) + 2 * np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _CLASS[body]
    code = row[:-2] * LETTERS * LETTERS + row[1:-1] * LETTERS + row[2:]
    return np.bincount(code, minlength=LETTERS**3)


def count_letters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of all texts; each task sends one row for a trigram at most."""

    def count(batches):
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            body, offsets = flat(batch.column(0))
            for i, j in blocks(offsets):
                total += trigram_counts(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["code", "n"])

    rows = docs.select(F.col(text).alias("t")).mapInArrow(count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LETTERS**3, np.int64)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out


def letter_costs(counts: np.ndarray) -> list:
    """-log P(letter | two before), smoothed by the shorter contexts."""
    c = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
    one = (c.sum(axis=(0, 1)) + 1) / (c.sum() + LETTERS)
    two = (c.sum(axis=0) + 20 * one) / (c.sum(axis=(0, 2))[:, None] + 20)
    three = (c + 20 * two[None]) / (c.sum(axis=2)[:, :, None] + 20)
    return (-np.log(three)).tolist()


_INDEX = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz", 1)}


def odd(token: str, at: int, costs: list) -> bool:
    """Whether the letter at ``at`` repeats the one before in a run of three, or where the letter model does not expect it."""
    c = token[at]
    if not at or token[at - 1] != c:
        return False
    if token[at + 1 : at + 2] == c or at > 1 and token[at - 2] == c:
        return True
    k = _INDEX.get(c, 27)
    before = token[at - 2] if at > 1 else ""
    return costs[_INDEX.get(before, 27 if before.isalpha() else 0)][k][k] > ODD


def options(noisy: str, at: int, letters: bool, costs: list) -> list[tuple[int, str, float]]:
    """What the character at ``at`` may stand for: class (-1: nothing, 0: a break), character, cost."""
    c = noisy[at]
    if c.isalpha():
        own = (_INDEX.get(c, 27), c, 0.0)
        return [own, (-1, "", SHRINK)] if odd(noisy, at, costs) else [own]
    if c.isspace() or c in "._-~'":
        return [(-1, "", JOIN), (0, " ", BREAK)]
    known = LEET.get(c, "")
    if len(known) > 2 and c * 3 in noisy[max(at - 2, 0) : at + 3]:  # three of a sign for any vowel are no vowels
        known = ""
    out = [(_INDEX[x], x, SWAP if len(known) < 3 else GUESS) for x in known]
    if letters:
        out.append((-1, "", DROP))
    if 0 < at < len(noisy) - 1:  # between others
        out.append((0, " ", BREAK))
    return out


def decode(noisy: str, costs: list) -> tuple[float, str]:
    """The most likely text behind a noisy one (lower case), letters with spaces where it breaks, and its cost.

    A state is the last two classes put out. For each character and state, the state before and the option taken are kept; wherever
    a single state is left, what came before is settled. Where there is no letter at all, signs and digits are not dropped.
    """
    letters = any(c.isalpha() for c in noisy)
    codes, totals = [0], [0.0]
    out: list[str] = []
    back, used, rows, first = bytearray(), bytearray(), array("Q"), 0  # of the characters from ``first`` on

    def settle(slot: int, stop: int) -> None:
        """Put out the path that ends in ``slot`` before the character ``stop``."""
        path = []
        for at in range(stop - 1, first - 1, -1):
            k = rows[at - first] + slot
            if used[k]:
                path.append(options(noisy, at, letters, costs)[used[k] - 1][1])
            slot = back[k]
        out.extend(reversed(path))

    for at in range(len(noisy)):
        may = options(noisy, at, letters, costs) or [(-1, "", 0.0)]
        slots: dict[int, int] = {}
        new_codes: list[int] = []
        new_totals: list[float] = []
        came, took = bytearray(), bytearray()
        for i, code in enumerate(codes):
            a, b = divmod(code, LETTERS)
            total, row = totals[i], costs[a][b]
            for o, (k, _, extra) in enumerate(may, 1):
                if k < 0 or not k and not b:  # nothing is put out
                    key, cost, o = code, total + extra, 0
                else:
                    key, cost = b * LETTERS + k, total + extra + row[k]
                slot = slots.get(key)
                if slot is None:
                    slots[key] = len(new_codes)
                    new_codes.append(key)
                    new_totals.append(cost)
                    came.append(i)
                    took.append(o)
                elif cost < new_totals[slot]:
                    new_totals[slot], came[slot], took[slot] = cost, i, o
        rows.append(len(back))
        back += came
        used += took
        codes, totals = new_codes, new_totals
        if len(codes) == 1:
            settle(0, at + 1)
            back, used, rows, first = bytearray(), bytearray(), array("Q"), at + 1
    ends = [t + (costs[c // LETTERS][c % LETTERS][0] if c % LETTERS else 0.0) for c, t in zip(codes, totals)]
    best = min(range(len(ends)), key=ends.__getitem__)
    settle(best, len(noisy))
    return ends[best], "".join(out)


def restore(noisy: str, costs: list) -> str:
    """The most likely text behind a noisy one."""
    return decode(noisy, costs)[1].strip()


_PLAIN = re.compile(r"[^\W\d_]+")
_STRETCH = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_SIGNS = re.compile("[%s]+" % re.escape("".join(LEET)))
_SEGMENT = re.compile("[%s._~'-]+" % re.escape("".join(LEET)))
_NUMBER = re.compile(r"\+?\d[\d.,:/-]*")  # dates, times and numbers with marks are no words
_EMPTY = re.compile(r"\A([*#%&])\1\1+|(?<![*#%&])([*#%&])\2\2+\Z")  # signs that stand for no letter, at the ends
# Punctuation around words; at the beginning and at the end it may be decoration.
_MARKS, _AROUND, _BEFORE, _AFTER = ".,;:?", "\"'[{.,;:?)]}>~_-", "\"'([{<.,;:?-", "\"')]}>.,;:?!-"
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\s]\s+){2,}[^\s](?=\s|$)")


def undecorated(token: str) -> str:
    """A token without punctuation and repeated signs at its ends."""
    low, high = 0, len(token)
    sign = lambda c: not (c.isalnum() or c == "_" or c.isspace())
    while low < high:
        c, stop = token[low], low + 1
        while stop < high and token[stop] == c:
            stop += 1
        if not (sign(c) and stop - low > 1 or c in _BEFORE):
            break
        low = stop
    while low < high:
        c, stop = token[high - 1], high - 1
        while stop > low and token[stop - 1] == c:
            stop -= 1
        if not (sign(c) and high - stop > 1 or c in _AFTER):
            break
        high = stop
    return token[low:high]


class Restorer:
    """Words of texts, noisy ones restored. Tokens met of late are remembered (bounded; results do not depend on it)."""

    def __init__(self, costs: list):
        self.costs, self.memory, self.known = costs, {}, set()

    def plain(self, word: str) -> bool:
        """Only letters, none of them repeated where that is unexpected."""
        return bool(_PLAIN.fullmatch(word)) and not (_DOUBLE.search(word) and any(odd(word, at, self.costs) for at in range(1, len(word))))

    def token(self, token: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Words as they are written, and restored ones."""
        found = self.memory.get(token)
        if found is None:
            found = self._token(token)
            if len(token) <= REMEMBERED:
                if len(self.memory) > 30_000:
                    self.memory.clear()
                self.memory[token] = found
        return found

    def _token(self, token: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        core, inner = _EMPTY.sub("", token.strip(_AROUND)).strip(_AROUND), undecorated(token)
        own = (inner,) if _PLAIN.fullmatch(inner) and not _STRETCH.search(inner) else ()
        if core == inner and self.plain(core):
            return own, ()
        return own, tuple(w for w in self._read(core) if w not in own)

    def _read(self, core: str) -> list[str]:
        if any(map(str.isalpha, core)):
            return restore(core, self.costs).split()
        if _NUMBER.fullmatch(core) and not core.isdigit():
            return []
        # marks that no step of the lattice joins part segments; within one, what joins may part as well
        out = []
        for segment in _SEGMENT.findall(core):
            runs = _SIGNS.findall(segment)
            for part in [segment, *runs] if len(runs) > 1 else runs:
                out += [w for w in restore(part, self.costs).split() if self.likely(w)]
        return out

    def likely(self, word: str) -> bool:
        """Whether a word of letters is likelier than as many letters at random."""
        a = b = 0
        total = 0.0
        for k in [*(_INDEX.get(c, 27) for c in word), 0]:
            total += self.costs[a][b][k]
            a, b = b, k
        return total < RANDOM * (len(word) + 1)

    def words(self, text: str) -> tuple[set[str], set[str]]:
        """Distinct words of a text, and those that come from noisy tokens."""
        low = text.lower()
        tokens = {*low.split()}
        out, restored = tokens & self.known, set()
        for token in tokens - out:
            t = token.rstrip(_MARKS)  # no step of the lattice, so the same words
            if t in self.known:
                out.add(t)
            elif self.plain(t):
                out.add(t)
                if len(t) <= REMEMBERED:
                    self.known.add(t)
            else:
                own, found = self.token(t)
                out.update(own)
                out.update(found)
                if len(found) != 1 or found[0] not in t:
                    restored.update(found)
        if len(self.known) > 60_000:
            self.known.clear()
        for m in _SPACED.finditer(low):
            if sum(c.isalpha() for c in m[0]) >= 3:
                found = restore(m[0], self.costs).split()
                out.update(found)
                restored.update(found)
        return out, restored


def features(words: set[str]) -> set[str]:
    """Words, and their first four and five letters."""
    return {f"w:{w}" for w in words} | {f"4:{w[:4]}" for w in words if len(w) > 4} | {f"5:{w[:5]}" for w in words if len(w) > 5}


@dataclass
class Model:
    costs: list
    weights: dict[str, float]
    base: float | None  # log odds without features; None: no labels

    def __post_init__(self):
        cut = lambda kind: {k[2:]: v for k, v in self.weights.items() if k[0] == kind}
        self.whole, self.four, self.five = cut("w"), cut("4"), cut("5")

    def score(self, words: set[str]) -> float:
        if self.base is None:
            return 0.0
        z = self.base + sum(self.whole[w] for w in sorted(words & self.whole.keys()))
        for n, known in ((4, self.four), (5, self.five)):
            if known:
                z += sum(known[p] for p in sorted({w[:n] for w in words if len(w) > n} & known.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, costs: list, key: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = MAX_DOCS) -> Model:
    """Fit on the rows of ``labels`` whose documents are in ``docs``."""
    spark = docs.sparkSession
    shared_dir(spark)
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(costs, {}, None)
    if len(counts) < 2:
        return Model(costs, {}, 40.0 if 1 in counts else -40.0)
    share = F.when(F.col("y") == 1, min(1.0, (1.5 * max_docs + 100) / counts[1])).otherwise(min(1.0, (1.5 * max_docs + 100) / counts[0]))
    draw = F.pmod(F.xxhash64("k", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    place = F.row_number().over(Window.partitionBy("y").orderBy("u", "k"))
    few = marks.withColumn("u", draw).where(F.col("u") < share).withColumn("place", place).where(F.col("place") <= max_docs).select("k", "y")
    # at most 2 * max_docs ids: small by the parameter; of several rows of one id the text of least hash
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(few), "k")
    sample = sample.groupBy("k").agg(F.max("y").alias("y"), F.min_by("t", F.struct(F.xxhash64("t"), F.col("t"))).alias("t"))
    sent = spark.sparkContext.broadcast(costs)

    def extract(batches):
        restorer = Restorer(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                found = [sorted(features(restorer.words(t or "")[0])) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string()))], ["y", "f"])

    rows = sample.select("y", "t").mapInArrow(extract, "y int, f array<string>").checkpoint()
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(costs, {}, float(np.log((counts[1] + 0.5) / (counts[0] + 0.5))))
    each = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a + b >= 4")
    # z of the difference between the shares with the feature
    p, q = F.col("a") / float(sizes[1]), F.col("b") / float(sizes[0])
    mean = (F.col("a") + F.col("b")) / float(sizes[0] + sizes[1])
    z = F.abs(p - q) / F.sqrt(mean * (1.0 + 1e-9 - mean) * (1 / sizes[1] + 1 / sizes[0]))
    best = [r["f"] for r in each.withColumn("z", z).where("z >= 3.5").orderBy(F.desc("z"), "f").limit(FEATURES).collect()]
    prior = float(np.log((counts[1] + 0.5) / (counts[0] + 0.5)))
    if not best:
        return Model(costs, {}, prior)
    at = {f: i for i, f in enumerate(best)}
    chosen = rows.select("y", F.array_intersect("f", F.array(*map(F.lit, best))).alias("f")).toArrow()
    y = chosen.column("y").to_numpy().astype(float)
    x = np.zeros((len(y), len(best)))
    for i, own in enumerate(chosen.column("f").to_pylist()):
        x[i, [at[f] for f in own]] = 1
    order = np.lexsort((*x.T[: min(8, len(best))], y))  # sums do not depend on the order in which rows arrive
    w = _fit(x[order], y[order])
    return Model(costs, {f: round(float(v), 6) for f, v in zip(best, w)}, round(float(w[-1]) + prior - float(np.log(sizes[1] / sizes[0])), 6))


def toxicity(spark: SparkSession, text: Column, model: Model) -> Column:
    """Struct of the score and the words restored from noisy tokens."""
    sent = spark.sparkContext.broadcast(model)

    def judge(m: Model, restorer: Restorer, texts: pa.Array) -> pa.Array:
        scores, found = [], []
        for i in range(len(texts)):
            words, restored = restorer.words(texts[i].as_py() or "")
            scores.append(m.score(words))
            found.append(sorted(restored & m.whole.keys()))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))], ["score", "restored"])

    @F.arrow_udf(RESULT)
    def judge_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer = Restorer(sent.value.costs)
        for texts in batches:
            yield judge(sent.value, restorer, texts)
        del restorer
        tidy()

    return judge_all.asNondeterministic()(text)  # so that it is computed once, before any filter on it


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model of the labelled rows that are not held out (crc32(doc_id) mod 5 is not 0)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held)
    model = train(docs.where(~held), labels, letter_costs(count_letters(docs)))
    out = docs.select("doc_id", held.alias("held_out"), toxicity(spark, F.col("text"), model).alias("t"))
    return out.select("doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.concat_ws(",", "t.restored").alias("restored"))

"""Near duplicates by ProbMinHash.

A text's shingles are runs of five words (all words where there are fewer), weighted by how often they occur.
Each shingle is a Poisson process whose rate is its weight: its arrivals hit registers drawn at random, and every
register keeps the shingle of its earliest arrival. A text's processes stop as soon as their next arrival is
later than all its registers' (early termination). Two texts agree in a register with the probability Jaccard
similarity of their weights, J = sum over common x of 1 / sum over y of max(a[y]/a[x], b[y]/b[x]), which for
equal weights is the Jaccard similarity of the sets.

1. Texts with the same words are one representative (the least id) with a group of copies.
2. ``BANDS`` bands of ``ROWS`` registers put representatives into buckets. A pair of similarity 0.8 shares none with
   probability (1 - 0.8^5)^24 = 7e-5.
3. Each bucket links its members to a pivot: that member which is in the fullest buckets, as an original is among
   its edited copies. The links are verified on the whole texts (exact J >= 0.8).
4. Connected components of what holds. Where a bucket still holds several components, members outside its largest
   one are compared with every member of another component, so no link that could join two classes is left
   out; what is in one component already needs no further link. Such buckets are cut into blocks of at most ``CHUNK``
   by ``CHUNK`` members. J is at most the sum of sqrt(a b) over shares a and b of common shingles, so one matrix product
   rules most pairs of a block out; the others are computed exactly, and a block returns its spanning links.
5. Components again: the class of a document is the least id in it.

A pair that shares several buckets is compared in the first of them only. Nothing is capped or sampled. A bucket's size is known
before its members meet, so large ones are dealt in parts, by members and by bytes, and a pivot's text goes to each part.
Null texts and texts without words are similar to nothing and are classes of their own. Rows of one id are one document, with
the text of one of them, one with words if there is any; rows without an id are left out. An empty table has no classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, flat, mix64, shared_dir, spread, stash, table, tidy, unstash, word_hashes

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Members of a bucket that are compared at once.
CHUNK = 1000
#: Bytes of text of a bucket that are compared at once, about.
CHUNK_BYTES = 16 << 20
SKETCH = "struct<hi:bigint,lo:bigint,bands:array<bigint>>"
#: Rounding of weighted sums; a ratio of two sizes that is not 0.8 is further from it.
ROUNDING = 1e-9
_UNIT = 1.0 / (1 << 53)


def shingles(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of some texts, their counts, their texts (ascending), and a 128-bit digest of each text's words."""
    h, starts = word_hashes(body, offsets)
    n = np.diff(starts)
    digest = np.zeros((len(n), 2), np.uint64)
    owner = spread(n)
    place = (np.arange(len(h)) - starts[:-1][owner]).astype(np.uint64)
    for k in range(2):  # sums of place-dependent hashes
        salted = mix64(mix64(h ^ np.uint64(0x51 + k)) + place * np.uint64(0x9E3779B97F4A7C15))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salted, dtype=np.uint64)])
        digest[:, k] = mix64((sums[starts[1:]] - sums[starts[:-1]]) ^ n.astype(np.uint64))
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), digest
    code = np.zeros(len(h), np.uint64)
    for k in range(WORDS):
        ahead = np.zeros(len(h), np.uint64)
        ahead[: max(len(h) - k, 0)] = h[k:]
        inside = place.astype(np.int64) + k < n[owner]
        code = mix64(code * np.uint64(0x100000001B3) + np.where(inside, ahead, np.uint64(k)))
    whole = np.maximum(n - WORDS + 1, 1)
    keep = place.astype(np.int64) < whole[owner]
    code, owner = code[keep], owner[keep]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    first = np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])])
    at = np.flatnonzero(first)
    return code[at], np.diff(np.append(at, len(code))), owner[at], digest


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT


def registers(code: np.ndarray, weight: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """For each text the shingle that each register keeps (0 where there is none).

    All processes go on in step: each round draws the next arrival of every process that is still open.
    """
    times = np.full(texts * REGISTERS, np.inf)
    kept = np.zeros(texts * REGISTERS, np.uint64)
    now = np.zeros(len(code))
    rate, state, rounds = weight.astype(np.float64), mix64(code), 0
    while len(code):
        rounds += 1
        state = mix64(state)
        now = now - np.log(_uniform(state)) / rate
        slot = owner * REGISTERS + (mix64(state ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(REGISTERS)).astype(np.int64)
        early = np.flatnonzero(now < times[slot])
        s, t, c = slot[early], now[early], code[early]
        order = np.lexsort((c, t, s))  # the earliest arrival at each register
        s, t, c = s[order], t[order], c[order]
        first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        times[s[first]], kept[s[first]] = t[first], c[first]
        if rounds > 4 and rounds % 8:  # arrivals that are too late change nothing, so looking now and then is enough
            continue
        latest = times.reshape(texts, REGISTERS).max(axis=1)
        open_ = now < latest[owner]
        code, rate, owner, now, state = code[open_], rate[open_], owner[open_], now[open_], state[open_]
    return kept.reshape(texts, REGISTERS)


def sketches(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, band keys and whether there are words, for each text."""
    body, offsets = flat(texts)
    digests, bands, some = np.zeros((len(texts), 2), np.uint64), np.zeros((len(texts), BANDS), np.uint64), np.zeros(len(texts), bool)
    for i, j in blocks(offsets, BLOCK_BYTES // 2):
        code, weight, owner, digests[i:j] = shingles(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        some[i:j][owner] = True
        kept = registers(code, weight, owner, j - i).reshape(j - i, BANDS, ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (j - i, BANDS)).copy()
        for k in range(ROWS):
            key = mix64(key * np.uint64(0x100000001B3) ^ kept[:, :, k])
        bands[i:j] = key
    return digests, bands, some


def sketch(text: Column) -> Column:
    """Digest of the words and band keys of a text (null without words)."""

    def make(texts: pa.Array) -> pa.Array:
        digests, bands, some = sketches(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(digests[:, 0].view(np.int64)), pa.array(digests[:, 1].view(np.int64)), lists], ["hi", "lo", "bands"], mask=pa.array(~some))

    @F.arrow_udf(SKETCH)
    def make_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield make(texts)
        tidy()

    return make_all(text)


def probability_jaccard(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> float:
    """Exact J of two texts by their sorted shingles and counts.

    sum over z of max(a[z]/a[x], b[z]/b[x]) depends on x by a[x]/b[x] alone: with z sorted by the ratio a/b, those above take
    the first term and the others the second, so suffix and prefix sums give all of them.
    """
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if a.max() == 1 and b.max() == 1:  # sets: exact
        return len(common) / (len(x) + len(y) - len(common))
    p, q = a[i].astype(float), b[j].astype(float)
    ratio = p / q
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    alone_a, alone_b = a.sum() - p.sum(), b.sum() - q.sum()
    above = np.concatenate([np.cumsum(p[::-1])[::-1], [0.0]])
    below = np.concatenate([[0.0], np.cumsum(q)])
    cut = np.searchsorted(ratio, ratio, side="left")
    whole = (above[cut] + alone_a) / p + (below[cut] + alone_b) / q
    return float((1 / whole).sum())


def similarity(left: Column, right: Column) -> Column:
    """Exact probability Jaccard similarity of two texts."""

    @F.arrow_udf("double")
    def compare(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        out = np.zeros(len(lefts))
        sides = []
        for texts in (lefts, rights):
            body, offsets = flat(texts)
            own = []
            for i, j in blocks(offsets, BLOCK_BYTES):
                code, weight, owner, _ = shingles(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                own += [(code[s:e], weight[s:e]) for s, e in zip(cut, cut[1:])]
            sides.append(own)
        for k, ((x, a), (y, b)) in enumerate(zip(*sides)):
            out[k] = probability_jaccard(x, a, y, b)
        return pa.array(out)

    return compare.asNondeterministic()(left, right)


def components(edges: DataFrame) -> DataFrame:
    """The least id (``label``) that each id of the edges (a, b) is linked to.

    Least labels spread along edges, and labels follow their own label (pointer jumping), until none changes. Each round's
    table replaces the one before.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both, both_at = stash(both)
    labels, labels_at = stash(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        far = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(far, "a").select("a", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("up"))
        new, new_at = stash(stepped.join(jump, "label").select("a", "old", F.least("label", "up").alias("label")))
        unstash(spark, labels_at)
        if new.where("label <> old").isEmpty():
            unstash(spark, both_at)
            return new.select(F.col("a").alias("id"), "label")
        labels, labels_at = new.select("a", "label"), new_at


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, parts: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) whose texts have the similarity; ``texts`` has id and text.

    Where an id is in very many pairs as ``a``, ``parts`` has id and parts, and ``pairs`` has the ``part`` that a pair belongs to: the
    text of ``a`` goes to each part.
    """
    known, on = texts.select(F.col("id").alias("a"), F.col("text").alias("left")), ["a"]
    if parts is not None:
        own = parts.select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        known, on = known.join(own, "a"), ["a", "part"]
    both = pairs.join(known, on).join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    scored = both.select("a", "b", similarity(F.col("left"), F.col("right")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold - ROUNDING)


def block_links(ids, labels, asks, answers, bands, band, texts: pa.Array, threshold: float) -> list[tuple[int, int]]:
    """Spanning links between the components (``labels``) of a block of one bucket.

    Members that ask are compared with those that answer and have another label, where ``band`` is the first band they share.
    """
    body, offsets = flat(texts)
    parts = []
    for i, j in blocks(offsets, BLOCK_BYTES):
        code, weight, owner, _ = shingles(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append((code, weight, owner + i))
    code, weight, owner = (np.concatenate(x) for x in zip(*parts))
    n = len(ids)
    total = np.bincount(owner, weight, n)
    plain = np.bincount(owner, weight > 1, n) == 0  # all shingles occur once
    size = np.bincount(owner, minlength=n)
    _, term, often = np.unique(code, return_inverse=True, return_counts=True)
    shared = often[term] > 1
    _, term = np.unique(term[shared], return_inverse=True)
    x, y = np.flatnonzero(asks), np.flatnonzero(answers)
    width = int(term.max()) + 1 if len(term) else 0
    root = np.sqrt(weight[shared] / total[owner[shared]]).astype(np.float32)
    row_x, row_y = np.full(n, -1), np.full(n, -1)
    row_x[x], row_y[y] = np.arange(len(x)), np.arange(len(y))
    bound, both = np.zeros((len(x), len(y)), np.float32), np.zeros((len(x), len(y)), np.float32)
    step = 4096  # terms at once: 16 MB for 1000 members
    for a in range(0, width, step):
        own = (term >= a) & (term < a + step)
        mats = []
        for rows, k in ((row_x, len(x)), (row_y, len(y))):
            at = own & (rows[owner[shared]] >= 0)
            for values in (root, None):
                m = np.zeros((k, min(step, width - a)), np.float32)
                m[rows[owner[shared][at]], term[at] - a] = 1 if values is None else values[at]
                mats.append(m)
        bound += mats[0] @ mats[2].T
        both += mats[1] @ mats[3].T
    near = (bound >= threshold - 1e-4) & (labels[x][:, None] != labels[y][None, :])
    i, j = np.nonzero(near)
    first = (bands[x[i]] == bands[y[j]]).argmax(axis=1) == band
    i, j = i[first], j[first]
    common = both[i, j].astype(np.float64)
    score = common / (size[x[i]] + size[y[j]] - common)
    cut = np.searchsorted(owner, np.arange(n + 1))
    parent: dict[int, int] = {}

    def find(k: int) -> int:
        while parent.get(k, k) != k:
            parent[k] = k = parent.get(parent[k], parent[k])
        return k

    out = []
    even = plain[x[i]] & plain[y[j]]
    hopeful = ~even | (score >= threshold - ROUNDING)
    for p, q, known, s in zip(x[i[hopeful]].tolist(), y[j[hopeful]].tolist(), even[hopeful].tolist(), score[hopeful].tolist()):
        u, v = find(int(labels[p])), find(int(labels[q]))
        if u == v:
            continue
        if not known:
            a, b = slice(cut[p], cut[p + 1]), slice(cut[q], cut[q + 1])
            s = probability_jaccard(code[a], weight[a], code[b], weight[b])
        if s >= threshold - ROUNDING:
            parent[max(u, v)] = min(u, v)
            out.append((int(ids[p]), int(ids[q])))
    return out


def open_links(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components within the same bucket.

    ``members`` has bucket, band, id, label, minor (outside the bucket's largest component), parts (of the bucket) and
    bands. A bucket is cut into parts^2 blocks of members that ask (the minor ones) and members that answer.
    """
    parts = F.col("parts")
    own_ask, own_answer = (F.pmod(F.xxhash64("id", F.lit(k)), parts) for k in (1, 2))
    every = F.sequence(F.lit(0).cast("long"), parts - 1)
    answers = F.transform(every, lambda i: F.struct(i.alias("i"), own_answer.alias("j"), (F.col("minor") & (i == own_ask)).alias("ask"), F.lit(True).alias("answer")))
    asks = F.filter(F.transform(every, lambda j: F.struct(own_ask.alias("i"), j.alias("j"), F.col("minor").alias("ask"), F.lit(False).alias("answer"))), lambda s: s["ask"] & (s["j"] != own_answer))
    dealt = members.select("bucket", "band", "id", "label", "bands", F.explode(F.concat(answers, asks)).alias("at")).select("bucket", "band", "id", "label", "bands", "at.*")
    dealt = dealt.join(texts, "id")
    groups = dealt.groupBy("bucket", "band", "i", "j").agg(F.collect_list(F.struct("id", "label", "ask", "answer", "bands", "text")).alias("rows"))

    @F.arrow_udf("array<struct<a:bigint,b:bigint>>")
    def link(band: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for own, r in zip(band.to_pylist(), rows):
            v = r.values
            numbers = {k: v.field(k).to_numpy(zero_copy_only=False) for k in ("id", "label", "ask", "answer")}
            bands = v.field("bands").flatten().to_numpy().reshape(len(v), -1)
            found = block_links(numbers["id"], numbers["label"], numbers["ask"], numbers["answer"], bands, own, v.field("text"), threshold)
            out.append([{"a": min(p), "b": max(p)} for p in found])
        return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    return groups.select(F.explode(link("band", "rows")).alias("l")).select("l.*").distinct()


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each id: id, class_id (the least id of its class), representative (the least id with the same words)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    made = rows.select("id", F.xxhash64("text").alias("own"), F.octet_length("text").cast("long").alias("bytes"), sketch(F.col("text")).alias("s")).select("id", "own", "bytes", "s.*")
    one = F.min(F.struct(F.col("bands").isNull().alias("none"), "hi", "lo", "own", "bytes", "bands"))  # a row with words first
    sketched, _ = stash(made.groupBy("id").agg(one.alias("s")).select("id", "s.*"))
    groups, _ = stash(sketched.where("bands is not null").groupBy("hi", "lo").agg(F.min(F.struct("id", "own", "bytes", "bands")).alias("r")).select("hi", "lo", "r.*"))
    members = groups.select("id", "bytes", F.posexplode("bands").alias("band", "bucket"))
    parts = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("bytes") / CHUNK_BYTES)).cast("long")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 1")
    filled, filled_at = stash(members.drop("bytes").join(sizes, "bucket"))  # only buckets with several members
    # from here on a bucket's parts are keys of their own
    dealt = filled.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    fullness = filled.groupBy("id").agg(F.sum("n").alias("fullness"))
    wanted = groups.select("id", "own").join(fullness.select("id"), "id", "left_semi")
    texts = rows.withColumn("own", F.xxhash64("text")).join(wanted, ["id", "own"], "left_semi")
    texts, texts_at = stash(texts.groupBy("id", "own").agg(F.min("text").alias("text")).select("id", "text"))
    pivots = filled.join(fullness, "id").groupBy("bucket").agg(F.max_by("id", F.struct("fullness", -F.col("id"))).alias("pivot"), F.max("parts").alias("parts"))
    pivots, pivots_at = stash(pivots)
    star = dealt.drop("parts").join(pivots.select("bucket", "pivot", every), ["bucket", "part"]).where("id <> pivot")
    star = star.groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.min("part").alias("part"))
    near = verified(star, texts, threshold, pivots.groupBy(F.col("pivot").alias("id")).agg(F.max("parts").alias("parts")))
    links, _ = stash(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = components(links)
    at = dealt.where("n > 2").join(labels, "id", "left").select("bucket", "band", "parts", "part", "id", F.coalesce("label", "id").alias("label"))
    counted = at.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.max("parts").alias("parts"))
    split = counted.groupBy("bucket").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("k", "label")).alias("main"), F.max("parts").alias("parts")).where("labels > 1")
    still = at.join(split.select("bucket", "main", every), ["bucket", "part"]).select("bucket", "band", "parts", "id", "label", (F.col("label") != F.col("main")).alias("minor"))
    still = still.join(groups.select("id", "bands"), "id")
    more, _ = stash(open_links(still, texts, threshold))
    for path in (texts_at, filled_at, pivots_at):
        unstash(spark, path)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    classes = groups.select("hi", "lo", F.col("id").alias("representative")).join(labels.select(F.col("id").alias("representative"), "label"), "representative", "left")
    classes = classes.select("hi", "lo", "representative", F.coalesce("label", "representative").alias("class_id"))
    with_words = sketched.where("bands is not null").select("id", "hi", "lo").join(classes, ["hi", "lo"]).select("id", "class_id", "representative")
    without = sketched.where("bands is null").select("id", F.col("id").alias("class_id"), F.col("id").alias("representative"))
    return with_words.unionByName(without)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its class of near duplicates."""
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("id").alias("doc_id"), "class_id", "representative")

"""Document fingerprints by SimHash.

Terms are words and pairs of neighbouring words; each occurrence counts, a pair twice as much as a word. A
term's hash votes on every bit of the fingerprint with its weight as a sign; a bit is set where the votes are
positive. Likeness is the share of equal bits. Votes of parts of a text add up, so long texts are taken in
pieces cut at word boundaries, and memory stays bounded.

``near_pairs`` finds all fingerprints within a Hamming radius by block tables: the bits are cut into so many blocks that,
by the pigeonhole principle, two fingerprints within the radius differ by one bit at most in some block. Every
fingerprint enters each table under its own block, and one that asks looks there under its block and under each
block of one other bit. Rows of a table are compared in bounded chunks that are spread over tasks, and no pair is
dropped. Equal fingerprints are one entry, a class, with its least id as representative and its number of documents.

A text without words (or a null) has the fingerprint 0; equal texts have equal fingerprints. Rows of one id are
rows of their own, in the order of their texts; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLOCK_BYTES, WORD_BYTE, flat, blocks, mix64, stash, table, word_hashes

BITS = 128
_PAIR_WEIGHT = 2


def _votes(hashes: np.ndarray, weight: int) -> np.ndarray:
    """Per term, a row of +-weight for each bit."""
    h = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    g = mix64(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)).astype(">u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(np.concatenate([h, g], axis=1), axis=1).astype(np.int8)
    bits *= 2 * weight
    bits -= weight
    return bits


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows between each start and the next."""
    out = np.zeros((len(starts) - 1, rows.shape[1]), np.int64)
    some = np.flatnonzero(np.diff(starts) > 0)
    if len(some):
        out[some] = np.add.reduceat(rows, starts[:-1][some], axis=0, dtype=np.int32)
    return out


def _text_votes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Votes of texts given by the hashes of their words."""
    out = _sums(_votes(hashes, 1), starts)
    if len(hashes) > 1:
        pairs = mix64(hashes[:-1] * np.uint64(3) + np.uint64(1)) ^ hashes[1:]
        pairs = np.concatenate([mix64(pairs), np.zeros(1, np.uint64)])
        votes = _votes(pairs, _PAIR_WEIGHT)
        ends = starts[1:][np.diff(starts) > 0] - 1  # a text's last word has no next
        votes[ends] = 0
        out += _sums(votes, starts)
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One row of BITS / 8 bytes for each text."""
    body, offsets = flat(texts)
    out = np.zeros((len(texts), BITS), np.int64)
    limit = BLOCK_BYTES // 4  # a vote takes about 100 bytes for each byte of text
    for i, j in blocks(offsets, limit):
        if offsets[j] - offsets[i] <= 2 * limit:
            h, starts = word_hashes(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out[i:j] = _text_votes(h, starts)
            continue
        at, end, last = offsets[i], offsets[j], None
        while at < end:  # one long text, cut between words
            stop = min(at + limit, end)
            while stop < end and WORD_BYTE[body[stop]] and WORD_BYTE[body[stop - 1]]:
                stop += 1
            h, _ = word_hashes(body[at:stop], np.array([0, stop - at]))
            if len(h):
                both = h if last is None else np.concatenate([last, h])
                out[i] += _text_votes(both, np.array([0, len(both)]))[0]
                if last is not None:
                    out[i] -= _votes(last, 1)[0]
                last = h[-1:]
            at = stop
    return np.packbits(out > 0, axis=1)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column as hexadecimal digits."""

    @F.arrow_udf("string")
    def simhash(texts: pa.Array) -> pa.Array:
        raw = fingerprints(texts).tobytes().hex()
        step = BITS // 4
        return pa.array([raw[k : k + step] for k in range(0, len(raw), step)], pa.string())

    return simhash(text)


def _words(hex_digits: Column) -> list[Column]:
    """32-bit words of a fingerprint."""
    return [F.conv(F.substring(hex_digits, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(BITS // 32)]


def distance(a: Column, b: Column) -> Column:
    """Number of bits in which two fingerprints differ."""
    parts = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_words(a), _words(b))]
    out = parts[0]
    for x in parts[1:]:
        out = out + x
    return out


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - distance(a, b) / float(BITS)


def near_pairs(classes: DataFrame, radius: int, chunk: int = 20_000) -> DataFrame:
    """For each class that asks, every other class within ``radius``: fp, and the other's representative, docs and distance.

    ``classes`` has distinct ``fp``, ``asks``, ``representative`` and ``docs``. Rows of a table are cut by hash into blocks of
    about ``chunk`` entries and ``chunk`` that ask; each entry goes to every block of its part of the entries, and each that asks to every
    block of its own. A pair that meets in several tables counts in the first of them only.
    """
    half = radius // 4 + 1  # blocks of each 64 bits, so that radius < 2 * blocks
    cuts = [64 * k // half for k in range(half + 1)]
    spans = [(word, 64 - cuts[k + 1], cuts[k + 1] - cuts[k]) for word in ("hi", "lo") for k in range(half)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    w = _words(F.col("fp"))
    both = classes.select("asks", "representative", "docs", F.shiftleft(w[0], 32).bitwiseOR(w[1]).alias("hi"), F.shiftleft(w[2], 32).bitwiseOR(w[3]).alias("lo"))
    own = [F.shiftrightunsigned(F.col(word), shift).bitwiseAND(F.lit(signed((1 << width) - 1))) for word, shift, width in spans]
    row = lambda t, block, ask: F.struct(F.lit(t).alias("table"), block.alias("block"), F.lit(ask).alias("ask"))
    flips = lambda width: F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << k)).cast("long") for k in range(width)))
    look = lambda t: F.transform(flips(spans[t][2]), lambda m: row(t, own[t].bitwiseXOR(m), True))
    entries = F.array(*(row(t, block, False) for t, block in enumerate(own)))
    near = [look(t) for t in range(len(spans))]
    dealt = both.select("representative", "docs", "hi", "lo", F.explode(F.when(F.col("asks"), F.concat(entries, *near)).otherwise(entries)).alias("at")).select("representative", "docs", "hi", "lo", "at.*")
    large = dealt.groupBy("table", "block").agg(F.count_if(~F.col("ask")).alias("n"), F.count_if(F.col("ask")).alias("m")).where((F.col("n") > chunk) | (F.col("m") > chunk))
    cut = lambda c: F.greatest(F.ceil(F.col(c) / chunk), F.lit(1)).cast("long")
    large = large.select("table", "block", cut("n").alias("entry_parts"), cut("m").alias("ask_parts"))
    parts = {k: F.coalesce(k, F.lit(1).cast("long")) for k in ("entry_parts", "ask_parts")}
    own_part = lambda k: F.array(F.pmod(F.xxhash64("hi", "lo"), parts[k]))
    every = lambda k: F.sequence(F.lit(0).cast("long"), parts[k] - 1)
    dealt = dealt.join(large, ["table", "block"], "left")
    dealt = dealt.withColumn("entry_part", F.explode(F.when(F.col("ask"), every("entry_parts")).otherwise(own_part("entry_parts"))))
    dealt = dealt.withColumn("ask_part", F.explode(F.when(F.col("ask"), own_part("ask_parts")).otherwise(every("ask_parts")))).drop("entry_parts", "ask_parts")
    at = ["table", "block", "entry_part", "ask_part"]
    groups = dealt.repartition(*at).groupBy(*at).agg(F.collect_list(F.struct("hi", "lo", "ask", "representative", "docs")).alias("rows"), F.max("ask").alias("asked")).where("asked")

    kind = pa.struct([("hi", pa.int64()), ("lo", pa.int64()), ("representative", pa.int64()), ("docs", pa.int64()), ("distance", pa.int32())])

    @F.arrow_udf("array<struct<hi:bigint,lo:bigint,representative:bigint,docs:bigint,distance:int>>")
    def compare(tables: pa.Array, lists: pa.Array) -> pa.Array:
        out, ends, total = [], [0], 0
        for table_, rows_ in zip(tables.to_pylist(), lists):
            values = rows_.values
            hi, lo = (values.field(k).to_numpy().view(np.uint64) for k in ("hi", "lo"))
            ask = values.field("ask").to_numpy(zero_copy_only=False)
            own, asking = np.flatnonzero(~ask), np.flatnonzero(ask)
            step = max(1, (1 << 18) // max(1, len(own)))
            for start in range(0, len(asking), step):
                q = asking[start : start + step]
                distance = np.bitwise_count(hi[q][:, None] ^ hi[own]) + np.bitwise_count(lo[q][:, None] ^ lo[own])
                i, j = np.nonzero((distance <= radius) & (distance > 0))
                distance, i, j = distance[i, j], q[i], own[j]
                first = np.ones(len(i), bool)
                for word, shift, width in spans[:table_]:
                    x = hi[i] ^ hi[j] if word == "hi" else lo[i] ^ lo[j]
                    first &= np.bitwise_count(x >> np.uint64(shift) & np.uint64((1 << width) - 1)) > 1
                i, j, distance = i[first], j[first], distance[first]
                other = values.take(pa.array(j))
                out.append(pa.StructArray.from_arrays([pa.array(hi[i].view(np.int64)), pa.array(lo[i].view(np.int64)), other.field("representative"), other.field("docs"), pa.array(distance.astype(np.int32))], ["hi", "lo", "representative", "docs", "distance"]))
                total += len(i)
            ends.append(total)
        rows = pa.concat_arrays(out) if out else pa.array([], kind)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    found = groups.select(F.explode(compare("table", "rows")).alias("c")).select("c.*")
    digits = F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (F.col("hi"), F.col("lo")))))
    return found.select(digits.alias("fp"), "representative", "docs", "distance")


def neighbours(fps: DataFrame, fp: str = "fp", asks: str = "asks", radius: int = 3, chunk: int = 20_000) -> DataFrame:
    """For each distinct fingerprint with a true ``asks``: its number ``n`` of other distinct fingerprints within ``radius``, where there are any."""
    distinct = fps.groupBy(F.col(fp).alias("fp")).agg(F.max(F.col(asks)).alias("asks"), F.lit(None).cast("long").alias("representative"), F.lit(1).cast("long").alias("docs"))
    return near_pairs(distinct, radius, chunk).groupBy(F.col("fp").alias(fp)).agg(F.sum("docs").alias("n"))


def with_next(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Columns ``key`` and ``value`` of ``df``, and the value of the next row in ascending order of key and value (of the
    first row after the last). Null keys and values come first.

    Rows are dealt by ranges of keys between approximate quantiles, as many as there are shuffle partitions; the
    first row of a range also goes to the range before, so that each range knows what follows its last row.
    Rows of one key stay in one range.
    """
    spark = df.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v"))
    cuts = sorted({int(x) for x in rows.select(F.col("k").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n)})
    known = F.array(*(F.lit(x).cast("long") for x in cuts))
    bucket = F.when(F.col("k").isNull(), 0).otherwise(F.size(F.filter(known, lambda c: c <= F.col("k"))))
    rows = rows.withColumn("bucket", bucket).withColumn("rank", F.coalesce(F.col("k").cast("long"), F.lit(-(2**63))))
    least = {r["bucket"]: r["first"] for r in rows.groupBy("bucket").agg(F.min("rank").alias("first")).collect()}
    order = sorted(least)
    if not order:
        return rows.select(F.col("k").alias(key), F.col("v").alias(value), F.lit(None).cast(df.schema[value].dataType).alias(out))
    before = dict(zip(order, [order[-1], *order]))
    look = lambda known: F.array(*(F.lit(known.get(b, 0)).cast("long") for b in range(len(cuts) + 1)))[F.col("bucket")]
    places = F.array(F.struct(F.col("bucket").cast("long").alias("to"), F.lit(0).alias("guest")), F.when(F.col("rank") == look(least), F.struct(look(before).alias("to"), F.lit(1).alias("guest"))))
    dealt = rows.select("k", "v", F.explode(F.array_compact(places)).alias("place")).select("k", "v", "place.*")
    window = Window.partitionBy("to").orderBy("guest", F.col("k").asc_nulls_first(), F.col("v").asc_nulls_first())
    following = dealt.withColumn("next", F.lead("v").over(window)).where("guest = 0")
    return following.select(F.col("k").alias(key), F.col("v").alias(value), F.col("next").alias(out))


#: One in so many documents is searched for near fingerprints by the registered query.
ASK = 20
#: Differing bits up to which the registered query takes fingerprints as near: a text of 100 words differs by about 8 when a word
#: is replaced, and copies of shingle likeness 0.8 by about 12.
RADIUS = 15


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of ``documents`` and of its edited text, and their likenesses.

    ``representative`` is the least id with the same fingerprint: the document's class. A class asks if one of its
    ids is divisible by 20; then the row of its representative lists all other classes within ``RADIUS`` bits in ``near`` (JSON:
    distance, representative), nearest first. ``n_near`` of a document that asks is the number of other documents in
    its own class (distance 0) and in those. Other rows have null there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.struct("text", fingerprint(F.col("text")).alias("fp")).alias("own"))
    pairs = with_next(docs, "doc_id", "own", "following")
    pairs = pairs.select("doc_id", "own.text", F.col("own.fp").alias("fingerprint"), F.col("following.text").alias("next_text"), F.col("following.fp").alias("next_fingerprint"))
    half = "cast(length(text) div 2 as int)"
    edited = F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(next_text, 1, {half}))")
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), "fingerprint", fingerprint(edited).alias("edited_fingerprint"), "next_fingerprint")
    pairs = pairs.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint")))
    pairs, _ = stash(pairs.drop("next_fingerprint"))  # two branches read it
    asks = F.coalesce(F.col("doc_id") % ASK == 0, F.lit(False))
    classes = pairs.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").cast("long").alias("representative"), F.count("*").alias("docs"), F.max(asks).alias("asks"))
    classes, _ = stash(classes)
    found = near_pairs(classes, RADIUS).groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("distance", "representative"))).alias("near"), F.sum("docs").alias("others"))
    known = classes.join(found, "fp", "left").select(F.col("fp").alias("fingerprint"), "representative", F.col("docs") - 1 + F.coalesce("others", F.lit(0)), F.when(F.col("asks"), F.coalesce(F.to_json("near"), F.lit("[]")))).toDF("fingerprint", "representative", "n", "near")
    out = pairs.join(known, "fingerprint")
    listed = F.when(F.col("doc_id") == F.col("representative"), F.col("near"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.when(asks, F.col("n")).alias("n_near"), "representative", listed.alias("near"))

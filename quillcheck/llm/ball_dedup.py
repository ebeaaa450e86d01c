"""Near duplicates of SimHash fingerprints by meet-in-the-middle ball hashing.

A fingerprint has 64 bits: bit k is set where it is set in over half the 64-bit hashes (XXH64, seed 42) of a text's shingles. Shingles are
runs of three words, repeats included, joined by one space; words are runs of characters other than ASCII white space, with A-Z as
a-z. Fewer words are one shingle; a text without words (or a null) has the fingerprint 0.

Two fingerprints link at ``radius`` differing bits or fewer. Each distinct fingerprint emits all variants within half the radius;
two link exactly if they have a variant in common, halfway between them. Rows are shuffled by variant. Those of one variant lie
within half the radius of it, so they link to each other, and there are no more of them than the ball has points (65 at
radius 2), however large a group of near copies is. So the least of a variant's fingerprints links to the others, and all of them are
connected without emitting all pairs; links are made distinct and verified. Connected components follow.

Rows of one id are rows of their own; rows without an id get the least id that they reach, null where there is none. Equal texts are one fingerprint, a node, with
its least id. An empty table gives an empty result; other columns are not looked at. Texts of any length are taken
whole, in pieces that are cut between words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import flat, stash, table, tidy, unstash
from .probminhash import components

BITS, SHINGLE, SEED, RADIUS = 64, 3, 42, 2
#: Bytes of a text that are split into words at once, and shingles whose votes are counted at once.
PIECE, VOTES = 1 << 19, 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes) -> Iterator[list[int]]:
    """Hashes of a text's shingles, piece by piece."""
    at, kept, some = 0, [], False
    while at < len(text):
        gap = _SPACE.search(text, at + PIECE)
        stop = gap.start() if gap else len(text)
        words = kept + text[at:stop].split()
        at = stop
        if len(words) >= SHINGLE:
            some, joined = True, b" ".join(words)
            starts = [0, *accumulate(len(w) + 1 for w in words)]
            yield [xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:])]
        kept = words[1 - SHINGLE :]
    if kept and not some:
        yield [xxhash.xxh64_intdigest(b" ".join(kept), SEED)]


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One unsigned fingerprint for each text."""
    body, offsets = flat(texts)
    raw = body.tobytes().lower()
    ones, total = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    hashes, rows, starts = [], [], []

    def count() -> None:
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        np.add.at(ones, rows, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
        np.add.at(total, rows, np.diff([*starts, len(hashes)]))
        hashes.clear(), rows.clear(), starts.clear()

    for row, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        for found in shingle_hashes(raw[a:b]):
            rows.append(row)
            starts.append(len(hashes))
            hashes += found
            if len(hashes) >= VOTES:
                count()
    if hashes:
        count()
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").astype(np.uint64).reshape(-1)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text as a long (the bits of the unsigned number)."""

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(fingerprints(texts).view(np.int64))
        tidy()

    return simhash(text)


def digits(fp: Column) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def ball(radius: int) -> list[int]:
    """Differences to all variants within half of an even radius, as signed 64-bit numbers."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("the radius must be 0, 2 or 4")
    found = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(BITS), k)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in found]


def ball_links(fps: DataFrame, fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of a column that connect all within the radius."""
    masks = F.array(*(F.lit(x).cast("long") for x in ball(radius)))
    each = fps.select(F.col(fp).alias("b")).distinct().select("b", F.explode(masks).alias("mask"))
    each = each.select("b", F.col("b").bitwiseXOR(F.col("mask")).alias("variant"))
    least = F.min("b").over(Window.partitionBy("variant"))  # at most one row for each point of the ball
    links = each.withColumn("a", least).where("a <> b").select("a", "b").distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs``: key, fp, component_id (the least key reachable), copies (rows of the same fingerprint) and
    component_fps (distinct fingerprints of the component)."""
    spark = docs.sparkSession
    rows, _ = stash(docs.select(F.col(key).alias("id"), fingerprint(F.col(text)).alias("fp")))
    fps, fps_at = stash(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    labels = components(ball_links(fps, "fp", radius))
    linked = fps.join(labels.select(F.col("id").alias("fp"), "label"), "fp")
    ids = linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("component_fps"))
    known, _ = stash(fps.join(linked.select("fp", "label").join(ids, "label").drop("label"), "fp", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component_fps", F.lit(1).cast("long")).alias("component_fps")))
    unstash(spark, fps_at)
    return rows.join(known, "fp").select(F.col("id").alias(key), "fp", "component_id", "copies", "component_fps")


def op11_ball_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text of ``documents``."""
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", digits(F.col("fp")).alias("fingerprint"), "component_id", "copies", "component_fps")

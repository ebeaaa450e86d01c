"""Merkle fixity audit of WARC replicas.

Records lie in WARC files one after another; a manifest has each record's file, ordinal, offset and length. Leaves
are SHA-256 digests of records with their offset range. An inner node covers ``FANOUT`` neighbouring ranges and is
the digest of its children's digests in order, so a file has one root. Each replica's levels are built once and written.
An audit compares the roots of two replicas and then, level by level, only the children of nodes that differ. It ends at the
ranges that differ, whose records are then aligned within their file by key and content, so that a record that is gone or has
grown does not make those after it look damaged: these are found ``moved``.

Files hold at most ``FANOUT`` ** ``LEVELS`` records, so a tree has a fixed height, a node has at most ``FANOUT``
children, and no group grows with the table. Everything is DataFrame functions; the bytes of real WARC files
are read by ``read_warc``.

Null contents are records with empty contents. Repeated rows are records of their own, counted before they meet; among equal
ones the first in order is paired with the first. Records without a key are dealt to ``NULL_FILES`` files by a hash of their
URI. An empty table has no files; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

FANOUT, LEVELS = 16, 3
#: Records of a file at most.
FILE_RECORDS = FANOUT**LEVELS
#: Files that records without a key go to: -1 and below.
NULL_FILES = 4096


def record_bytes(uri: Column, content: Column) -> Column:
    """A WARC/1.1 resource record, as text."""
    size = F.octet_length(content).cast("string")
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size, F.lit("\r\n\r\n"), content, F.lit("\r\n\r\n"))


def leaves(rows: DataFrame, key: str, uri: str, content: str, file: Column | None = None) -> DataFrame:
    """One leaf a record: key, file, part, place (ordinal), start, length, record (digest of its bytes), digest (of these with the range).

    Records go to files by ranges of ``FILE_RECORDS`` / 2 keys (or as ``file`` says) and lie in them in the order of key and
    digest. A file of more than ``FILE_RECORDS`` records (many rows of one key) goes on in parts, each with a tree of its own.
    """
    record = record_bytes(F.coalesce(F.col(uri), F.lit("")), F.coalesce(F.col(content), F.lit("")))
    lost = -1 - F.conv(F.substring(F.md5(F.coalesce(F.col(uri), F.lit(""))), 1, 3), 16, 10).cast("long")
    file = F.coalesce(F.floor(F.col(key) / (FILE_RECORDS // 2)), lost).cast("long") if file is None else file
    r = rows.select(F.col(key).alias("key"), file.alias("file"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("record"))
    r = r.groupBy("file", "key", "record", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("key", "record").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("records", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("bytes", F.coalesce(F.sum(F.col("n") * F.col("length")).over(before), F.lit(0)))
    r = r.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    place = F.col("records") + F.col("i")
    r = r.select("key", "file", F.floor(place / FILE_RECORDS).cast("int").alias("part"), (place % FILE_RECORDS).cast("int").alias("place"), (F.col("bytes") + F.col("i") * F.col("length")).alias("start"), "length", "record")
    return r.withColumn("digest", F.sha2(F.concat_ws(":", "start", "length", "record"), 256))


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: file, part, place, digest over the children in order."""
    up = F.floor(F.col("place") / FANOUT).cast("int")
    grouped = nodes.groupBy("file", "part", up.alias("place")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("children"))
    child = F.transform("children", lambda c: F.concat_ws("=", c["place"], c["digest"]))
    return grouped.select("file", "part", "place", F.sha2(F.concat_ws(";", child), 256).alias("digest"))


def trees(leaf: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to the root; the inner ones are written once."""
    out = [leaf]
    for _ in range(LEVELS):
        out.append(stash(parents(out[-1]))[0])
    return out


def differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Leaves of both replicas at places where they differ, found by descent from the roots: side (0: ours), and a leaf's columns."""
    a, b = trees(ours), trees(theirs)
    at = ["file", "part", "place"]
    suspects = None
    for k in range(LEVELS, -1, -1):
        x, y = a[k], b[k]
        if suspects is not None:  # only children of nodes that differ
            x, y = (z.withColumn("up", F.floor(F.col("place") / FANOUT).cast("int")).join(suspects, ["file", "part", "up"], "left_semi").drop("up") for z in (x, y))
        if k:
            both = x.select(*at, F.col("digest").alias("ours")).join(y.select(*at, F.col("digest").alias("theirs")), at, "full_outer")
            suspects, _ = stash(both.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("file", "part", F.col("place").alias("up")))
    sides = x.withColumn("side", F.lit(0)).unionByName(y.withColumn("side", F.lit(1)))
    same = Window.partitionBy(*at)
    least, most = F.min("digest").over(same), F.max("digest").over(same)
    return sides.withColumn("differs", (F.count("*").over(same) < 2) | (least != most)).where("differs").drop("differs")


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Records in which two replicas differ: file, part, place, key, start and length as we have them, a finding, and where they have
    it (``their_start``). Both sides are leaves by ``leaves``.

    ``moved``: the same bytes in another range; ``corrupt``: a record of the same key with other bytes; ``missing`` and ``added``:
    a record that only we, or only they, have in the file.
    """
    rows = differing(ours, theirs)
    order = ["part", "place"]
    nth = lambda *c: F.row_number().over(Window.partitionBy("file", "key", *c, "side").orderBy(*order))
    rows = rows.withColumn("n", nth("record"))
    pair = Window.partitionBy("file", "key", "record", "n")
    found = rows.withColumn("kept", F.count("*").over(pair) == 2).withColumn("kept_at", F.max(F.when(F.col("side") == 1, F.col("start"))).over(pair))
    found = found.withColumn("m", nth("kept"))
    pair = Window.partitionBy("file", "key", "kept", "m")
    found = found.withColumn("paired", F.count("*").over(pair) == 2).withColumn("paired_at", F.max(F.when(F.col("side") == 1, F.col("start"))).over(pair))
    finding = F.when(F.col("kept"), "moved").when(F.col("paired"), "corrupt").when(F.col("side") == 0, "missing").otherwise("added")
    theirs_at = F.when(F.col("kept"), F.col("kept_at")).when(F.col("paired") | (F.col("side") == 1), F.col("paired_at"))
    return found.where(F.col("kept") & (F.col("side") == 0) | ~F.col("kept") & ((F.col("side") == 0) | ~F.col("paired"))).select("file", *order, "key", "start", "length", finding.alias("finding"), theirs_at.alias("their_start"))


def audited(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every record of either replica with its finding (``intact`` where the audit has none)."""
    at = ["file", "part", "place"]
    found, _ = stash(audit(ours, theirs))
    whole = ours.join(found.where("finding <> 'added'").select(*at, "finding", "their_start"), at, "left").withColumn("finding", F.coalesce("finding", F.lit("intact")))
    added = found.where("finding = 'added'").select("key", *at, "start", "length", F.lit(None).cast("string").alias("digest"), "finding", "their_start")
    return whole.select("key", *at, "start", "length", "digest", "finding", "their_start").unionByName(added)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of uncompressed WARC files: file, place, start, length, record (SHA-256 of the whole record), uri, content.

    Each file is read by one task; files are the unit of distribution.
    """

    def parse(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, rows = 0, []
                while at < len(body) and (end := body.find(b"\r\n\r\n", at)) >= 0:
                    head = dict(line.split(b": ", 1) for line in body[at:end].split(b"\r\n")[1:] if b": " in line)
                    size = int(head.get(b"Content-Length", b"0"))
                    stop = min(end + 4 + size + 4, len(body))
                    rows.append((name, len(rows), at, stop - at, hashlib.sha256(body[at:stop]).hexdigest(), head.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), body[end + 4 : end + 4 + size]))
                    at = stop
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["file", "place", "start", "length", "record", "uri", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "file string, place int, start bigint, length bigint, record string, uri string, content binary")


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of ``pages`` as WARC files against a replica with planted damage.

    The replica has the first byte changed in pages whose id leaves 3 modulo 101 (an empty page gains one), and lacks those whose id
    leaves 500 modulo 997. Returns every record: page_id, file, part, place, start, length, digest, finding, their_start.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    damaged = pages.where(~F.coalesce(F.col("page_id") % 997 == 500, F.lit(False)))
    damaged = damaged.withColumn("html", F.when(F.col("page_id") % 101 == 3, F.concat(F.lit("#"), F.expr("substring(coalesce(html, ''), 2)"))).otherwise(html))
    ours, _ = stash(leaves(pages, "page_id", "url", "html"))
    theirs, _ = stash(leaves(damaged, "page_id", "url", "html"))
    return audited(ours, theirs).withColumnRenamed("key", "page_id")


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, coalesce(floor(page_id / 2048.0), -1 - CAST('0x' || substr(md5(coalesce(url, '')), 1, 3) AS INTEGER))::BIGINT AS file FROM pages),
both_ AS (SELECT 0 AS side, * FROM p UNION ALL SELECT 1, page_id, url, CASE WHEN page_id % 101 = 3 THEN '#' || substr(html, 2) ELSE html END, file FROM p WHERE coalesce(page_id % 997, 0) <> 500),
rec AS (SELECT side, page_id, file, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM both_),
d AS (SELECT side, page_id, file, strlen(record)::BIGINT AS length, sha256(record) AS record FROM rec),
o AS (SELECT *, row_number() OVER w - 1 AS n, coalesce(sum(length) OVER (PARTITION BY side, file ORDER BY page_id NULLS FIRST, record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d WINDOW w AS (PARTITION BY side, file ORDER BY page_id NULLS FIRST, record)),
l AS (SELECT side, page_id, file, record, (n // 4096)::INTEGER AS part, (n % 4096)::INTEGER AS place, start, length, sha256(start || ':' || length || ':' || record) AS digest FROM o),
f AS (SELECT l.* FROM l LEFT JOIN l AS x ON x.side = 1 - l.side AND x.file = l.file AND x.part = l.part AND x.place = l.place AND x.digest = l.digest WHERE x.digest IS NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY side, file, page_id, record ORDER BY part, place) AS n FROM f),
moved AS (SELECT x.file, x.part, x.place, y.part AS p2, y.place AS l2, y.start AS their_start FROM g x JOIN g y ON x.side = 0 AND y.side = 1 AND x.file = y.file AND x.page_id IS NOT DISTINCT FROM y.page_id AND x.record = y.record AND x.n = y.n),
r AS (SELECT *, row_number() OVER (PARTITION BY side, file, page_id ORDER BY part, place) AS m FROM g WHERE CASE side WHEN 0 THEN (file, part, place) NOT IN (SELECT (file, part, place) FROM moved) ELSE (file, part, place) NOT IN (SELECT (file, p2, l2) FROM moved) END),
q AS (SELECT x.file, x.part, x.place, y.start AS their_start, y.side IS NOT NULL AS paired FROM (SELECT * FROM r WHERE side = 0) x LEFT JOIN (SELECT * FROM r WHERE side = 1) y ON x.file = y.file AND x.page_id IS NOT DISTINCT FROM y.page_id AND x.m = y.m),
a AS (SELECT y.* FROM (SELECT * FROM r WHERE side = 1) y LEFT JOIN (SELECT * FROM r WHERE side = 0) x ON x.file = y.file AND x.page_id IS NOT DISTINCT FROM y.page_id AND x.m = y.m WHERE x.side IS NULL)
SELECT page_id, l.file, l.part, l.place, start, length, digest, CASE WHEN moved.place IS NOT NULL THEN 'moved' WHEN q.paired THEN 'corrupt' WHEN q.place IS NOT NULL THEN 'missing' ELSE 'intact' END AS finding, coalesce(moved.their_start, q.their_start) AS their_start
FROM (SELECT * FROM l WHERE side = 0) l LEFT JOIN moved ON l.file = moved.file AND l.part = moved.part AND l.place = moved.place LEFT JOIN q ON l.file = q.file AND l.part = q.part AND l.place = q.place
UNION ALL SELECT page_id, file, part, place, start, length, NULL, 'added', start FROM a
"""

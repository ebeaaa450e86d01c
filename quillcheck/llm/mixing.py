"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame functions are used. Sizes are words: runs of characters other than space, tab, line feed, vertical
tab, form feed and carriage return.

1. Targets. Sources, in code point order (null last), weigh 5, 2, 1, repeating. They share ``epochs`` times
   the words of the whole table by weight, but none more than ``limit`` times its own words; what is above goes to
   the others by weight (water filling over the sources' ratios of limit to weight).
2. Blocks. A source's documents fall into ``BLOCKS`` blocks of ``BLOCKS`` parts each by a hash of their id. A source is taken in
   whole passes as often as its target allows; the rest of the target is drawn from its blocks in a permuted order:
   whole blocks, then whole parts of one last block, then the documents of one last part in the order of their hash, up to
   the nearest document.
3. Splitting tree. Every block of a pass is a slot. From the root down, each node's slots are drawn without
   replacement into its two halves, so the sources' quotas of every half follow the multivariate hypergeometric
   distribution and add up exactly. Leaves are output shards.
4. Draw. Each shard takes its quota as a range of every source's permuted slots, so shards are disjoint.
5. Local shuffle. Every copy has a position in its shard, a 60-bit hash of document, copy and shard: rows written in the order
   of (shard, position), as ``shuffled`` deals them, are shuffled within the shard.

All choices come from md5 of ids (of the text where the id is null), so reruns agree, and repeated rows are interchangeable:
equal ids of one source share a part, where ties go by size. Sources whose ratios tie fill up together, whatever their number. Documents are counted by (source, block, part) before anything moves.
What becomes of a document follows from its block, but for the one block of a source that is drawn in part: only its documents are
joined to parts and sorted. Slots are bounded by ``BLOCKS`` times twice the number of sources, the plan by ``BLOCKS`` times that number, with
``BLOCKS`` parts a source. Null texts have size 0 and
take 0 words; a null source is a source of its own; an empty table gives an empty result; other columns are left alone (``keep``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stash, table

WEIGHTS = (5, 2, 1)
EPOCHS, LIMIT = 1.5, 2
#: Blocks of a source and parts of a block (two digits of a hash), and levels of the splitting tree (shards are a power of two).
BLOCKS, LEVELS = 256, 4
#: Blocks of which a part is drawn; of the others it is all or nothing.
PARTLY = "draws > 0 AND draws < words"
WORD = r"[^\x20\x09-\x0D]+"


def _md5(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *(F.col(p) if isinstance(p, str) else p.cast("string") for p in parts)))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Key, source, size, digest (for the order within a part), block and part; the columns ``keep`` in a struct ``row``."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    row = [F.struct(*keep).alias("row")] if keep else []
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), F.md5(F.concat(F.lit("doc:"), name)).alias("digest"), *row)
    byte = lambda at: F.conv(F.substring("digest", at, 2), 16, 10).cast("int")
    return rows.withColumn("block", byte(1)).withColumn("part", byte(3))


def targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size) with each source's target in words."""
    everywhere = Window.partitionBy()
    place = F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    t = sources.withColumn("place", place).withColumn("weight", weight)
    t = t.withColumn("total", EPOCHS * F.sum("source_size").over(everywhere)).withColumn("most", LIMIT * F.col("source_size").cast("double"))
    t = t.withColumn("ratio", F.col("most") / F.col("weight"))
    order = everywhere.orderBy("ratio", "place")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("total") - before) / rest)
    # the first source, in the order of the sums, whose share at its level stays below its limit sets the level for all; of sources of one
    # ratio the first counts, as the levels of the others leave out what those before it may still take
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everywhere)["level"]
    target = F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))
    return t.select("source", "source_size", target.alias("target"))


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: for each source and block its words, the passes that take it whole, what is drawn of it besides, and its shards; and for
    each part of a block that is drawn in part, the part's words and what is drawn of them."""
    parts = rows.groupBy("source", "block", "part").agg(F.sum("size").alias("own"))
    blocks = parts.groupBy("source", "block").agg(F.sum("own").alias("words"))
    sources = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    t = targets(sources).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("int"))
    t = t.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    b = blocks.alias("b").join(t.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "block", "words", "source_size", "target", "passes", "rest")
    name = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null"))
    order = Window.partitionBy("source").orderBy(_md5(F.lit("block"), name, F.col("block")), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = b.withColumn("left", F.col("rest") - before)  # words still to draw when the block's turn comes
    b = b.withColumn("draws", F.when(F.col("left") > 0, F.least("left", F.col("words").cast("double"))).otherwise(0.0))
    # slots: one for each pass over the block, and one for what is drawn besides
    n = F.col("passes") + F.when(F.col("draws") > 0, 1).otherwise(0)
    slots = b.withColumn("pass", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
    permuted = Window.partitionBy("source").orderBy(_md5(F.lit("slot"), name, F.col("block"), F.col("pass")), "block", "pass")
    slots = slots.select("source", "block", "pass", F.row_number().over(permuted).alias("slot"))
    # the tree deals out quotas: tokens of a source, not yet its blocks
    tokens = slots.select("source", "slot", F.lit(0).alias("node"))
    for level in range(LEVELS):
        draw = Window.partitionBy("node").orderBy(_md5(F.lit(f"tree{level}"), name, F.col("slot")), F.col("source").asc_nulls_last(), "slot")
        nth, size = F.row_number().over(draw), F.count("*").over(Window.partitionBy("node"))
        tokens = tokens.withColumn("right", (nth > F.floor(size / 2)).cast("int")).select("source", "slot", (F.col("node") * 2 + F.col("right")).alias("node"))
    quotas = tokens.groupBy("source", F.col("node").alias("shard")).agg(F.count("*").alias("quota"))
    quotas = quotas.withColumn("stop", F.sum("quota").over(Window.partitionBy("source").orderBy("shard")))
    ranges = quotas.select("source", "shard", F.explode(F.expr("sequence(stop - quota + 1, stop)")).alias("slot"))
    # each shard takes the next of the source's permuted slots
    s, r = slots.alias("s"), ranges.alias("r")
    dealt = s.join(r, F.col("s.source").eqNullSafe(F.col("r.source")) & (F.col("s.slot") == F.col("r.slot"))).select("s.source", "s.block", "pass", "shard")
    shards = dealt.groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"].cast("int")).alias("shards"))
    p = b.alias("p").join(shards.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.block") == F.col("s.block")), "left")
    # written as tables, whose sizes Spark knows: it sends them to all tasks where they are small enough, and texts stay where they are
    p, _ = stash(p.select("p.source", "p.block", "words", "source_size", "target", "passes", "draws", "shards"))
    # what a block gives, its parts give in a permuted order
    some = p.where(PARTLY).select("source", "block", "draws")
    each = parts.alias("w").join(some.alias("p"), F.col("w.source").eqNullSafe(F.col("p.source")) & (F.col("w.block") == F.col("p.block"))).select("w.source", "w.block", "part", "own", "draws")
    turn = Window.partitionBy("source", "block").orderBy(_md5(F.lit("part"), name, F.col("block"), F.col("part")), "part")
    earlier = F.coalesce(F.sum("own").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = F.greatest(F.lit(0.0), F.least(F.col("draws") - earlier, F.col("own").cast("double")))
    return p, stash(each.select("source", "block", "part", F.col("own").alias("part_words"), drawn.alias("part_draws")))[0]


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: key, size, source_size, target, copies (0 to 2), taken (words), and the shard and position of each
    copy (``shards``, ``positions``). With ``keep``, these columns come along in a struct ``row``."""
    shared_dir(docs.sparkSession)
    rows = sized(docs, key, text, source).checkpoint()
    p, parts = plan(rows)
    if keep:  # other columns, texts as a rule, are read again instead of written and shuffled
        rows = sized(docs, key, text, source, keep)
    row = ["row"] if keep else []
    r = rows.alias("r").join(p.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.block") == F.col("p.block")))
    r = r.select("key", "r.source", "r.block", "part", "size", "digest", "source_size", "target", "passes", "draws", "words", "shards", *row)
    whole = r.where(f"NOT ({PARTLY})").withColumn("drawn", F.col("draws") > 0)
    some = r.where(PARTLY).alias("r").join(parts.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.block") == F.col("p.block")) & (F.col("r.part") == F.col("p.part")))
    some = some.select("r.*", "part_words", "part_draws")
    order = Window.partitionBy("source", "block", "part").orderBy("digest", "key", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = (F.col("part_draws") > 0) & ((F.col("part_draws") >= F.col("part_words")) | (before + F.col("size") / 2 <= F.col("part_draws")))
    r = whole.unionByName(some.withColumn("drawn", drawn).drop("part_words", "part_draws"))
    r = r.withColumn("copies", F.col("passes") + F.col("drawn").cast("int"))
    r = r.withColumn("shards", F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), F.col("copies")))
    position = lambda shard, i: F.conv(F.substring(_md5(F.lit("position"), shard, i, F.col("digest")), 1, 15), 16, 10).cast("long")
    return r.select(F.col("key").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "shards", F.transform("shards", position).alias("positions"), *row)


def shuffled(mixed: DataFrame) -> DataFrame:
    """The kept columns of ``mix(.., keep=..)``, a row for each copy, dealt and sorted by shard and position."""
    each = mixed.select("row", F.explode(F.arrays_zip("shards", "positions")).alias("at"))
    return each.repartitionByRange("at.shards", "at.positions").sortWithinPartitions("at.shards", "at.positions").select("row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    listed = lambda c: F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", listed("shards"), listed("positions"))


def _tree_sql() -> str:
    out = []
    for k in range(LEVELS):
        out.append(f"n{k + 1} AS (SELECT source, name, slot, node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY md5('tree{k}:' || name || ':' || slot), source NULLS LAST, slot) > floor(count(*) OVER (PARTITION BY node) / 2) THEN 1 ELSE 0 END AS node FROM n{k})")
    return ",\n".join(out)


OP10_SQL = rf"""
WITH r AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size, md5('doc:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))) AS digest FROM documents),
rb AS (SELECT *, CAST('0x' || substr(digest, 1, 2) AS INTEGER) AS block, CAST('0x' || substr(digest, 3, 2) AS INTEGER) AS part FROM r),
bp AS (SELECT source, block, part, sum(size)::BIGINT AS own FROM rb GROUP BY source, block, part),
b0 AS (SELECT source, block, sum(own)::BIGINT AS words FROM bp GROUP BY source, block),
s0 AS (SELECT source, sum(words)::BIGINT AS source_size FROM b0 GROUP BY source),
s1 AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total, 2 * source_size::DOUBLE AS most FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s0)),
s2 AS (SELECT *, most / weight AS ratio FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM s2),
s4 AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM s3 WHERE level <= ratio ORDER BY ratio, place LIMIT 1) * weight, most)) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INTEGER ELSE 1 END AS passes FROM s4),
b1 AS (SELECT b0.*, coalesce('s:' || b0.source, 'null') AS name, source_size, target, passes, target - passes * source_size AS rest FROM b0 JOIN s5 ON b0.source IS NOT DISTINCT FROM s5.source),
b2 AS (SELECT *, rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY md5('block:' || name || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM b1),
b3 AS (SELECT *, CASE WHEN remaining > 0 THEN least(remaining, words::DOUBLE) ELSE 0 END AS draws FROM b2),
k AS (SELECT source, name, block, pass, row_number() OVER (PARTITION BY source ORDER BY md5('slot:' || name || ':' || block || ':' || pass), block, pass) AS slot
      FROM (SELECT source, name, block, unnest(range(1, passes + 1 + CASE WHEN draws > 0 THEN 1 ELSE 0 END)) AS pass FROM b3)),
n0 AS (SELECT source, name, slot, 0 AS node FROM k),
{_tree_sql()},
q AS (SELECT source, node AS shard, count(*) AS quota FROM n{LEVELS} GROUP BY source, node),
q2 AS (SELECT *, sum(quota) OVER (PARTITION BY source ORDER BY shard) AS stop FROM q),
d AS (SELECT k.source, k.block, pass, shard FROM k JOIN q2 ON k.source IS NOT DISTINCT FROM q2.source AND slot > stop - quota AND slot <= stop),
g AS (SELECT source, block, list(shard ORDER BY pass) AS shards FROM d GROUP BY source, block),
w AS (SELECT bp.source, bp.block, part, own AS words, b3.source_size, target, passes, greatest(0::DOUBLE, least(draws - coalesce(sum(own) OVER (PARTITION BY bp.source, bp.block ORDER BY md5('part:' || name || ':' || bp.block || ':' || part), part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), own::DOUBLE)) AS draws
      FROM bp JOIN b3 ON bp.source IS NOT DISTINCT FROM b3.source AND bp.block = b3.block),
j AS (SELECT rb.*, w.source_size, target, passes, draws, words, g.shards,
      coalesce(sum(size) OVER (PARTITION BY rb.source, rb.block, rb.part ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM rb JOIN w ON rb.source IS NOT DISTINCT FROM w.source AND rb.block = w.block AND rb.part = w.part LEFT JOIN g ON rb.source IS NOT DISTINCT FROM g.source AND rb.block = g.block),
c AS (SELECT *, passes + CASE WHEN draws > 0 AND (draws >= words OR before + size / 2 <= draws) THEN 1 ELSE 0 END AS copies FROM j),
z AS (SELECT *, coalesce(shards, [])[1:copies] AS own FROM c)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, array_to_string(own, ',') AS shards,
       array_to_string(list_transform(own, lambda s, i: CAST('0x' || substr(md5('position:' || s || ':' || (i - 1) || ':' || digest), 1, 15) AS BIGINT)), ',') AS positions FROM z
"""

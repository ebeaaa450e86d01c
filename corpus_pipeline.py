"""Corpus pipeline: language ID, toxicity, near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept. All but the last return
the columns of ``documents``; other columns that a table may have go no further.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quillcheck
from quillcheck.llm import bpe, common, mixing, ppm, probminhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best code takes as many bits a byte as no model at all is in none of the languages.
RAW_BITS = 8.0


def _prepare(spark: SparkSession) -> None:
    quillcheck.ship(spark)
    common.bound_batches(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those that no language's model can shorten. Repeated rows are judged
    alike; an empty table, or one without labelled rows, gives an empty result."""
    _prepare(spark)
    model = ppm.train(docs.where(common.id_remainder("doc_id", 3) != 1))
    found = docs.withColumn("_found", ppm.language(spark, F.col("text"), model))
    known = (F.col("_found.lang") != "und") & (F.col("_found.bits") < RAW_BITS * F.col("_found.bytes"))
    return found.where(known).select(COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity is 0.5 or more. A null text counts as empty; repeated rows are judged alike; without labels all stay; an
    empty table gives an empty result."""
    _prepare(spark)
    kept = common.id_remainder("doc_id", 5) != 0
    labels = common.table(spark, sf_dir, "labels").where(kept)
    model = toxicity.train(docs.where(kept), labels, toxicity.letter_costs(toxicity.count_letters(docs)))
    judged = docs.withColumn("_toxic", toxicity.toxicity(spark, F.col("text"), model))
    return judged.where(F.col("_toxic.score") < 0.5).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates: that of the least id (rows without an id come last; ties by text, then by the
    other columns). Classes are of rows, so rows of one id with different texts are documents of their own, and a row goes only where
    one of its class stays. Texts without words are near to nothing and stay; an empty table gives an empty result."""
    _prepare(spark)
    rows, _ = common.stash(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))
    classes = probminhash.near_classes(rows, key="_row").select(F.col("id").alias("_row"), "class_id")
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"), F.xxhash64(*others).alias("others"), "_row")
    best = rows.select("_row", order.alias("order")).join(classes, "_row").groupBy("class_id").agg(F.min("order").alias("best")).select("best._row")
    return rows.join(best, "_row", "left_semi").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (0 to 2 times), dealt to output shards and shuffled within them: rows are written in the order of
    shard and position. Null texts have no words and come along with their block; an empty table gives an empty result."""
    return mixing.shuffled(mixing.mix(docs, keep=tuple(COLUMNS))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with what they decode to checked against the text. Null and empty texts have no ids; repeated rows are
    encoded alike; an empty table gives an empty result."""
    _prepare(spark)
    encoded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), *bpe.tokenizer())
    exact = F.col("coded.decoded") == F.coalesce("text", F.lit("")).cast("binary")
    ids = F.col("coded.token_ids")
    return encoded.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), ids.alias("token_ids"), exact.alias("exact"))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
#: Language models, toxicity and near duplicates are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again, those of the stage before go."""
    docs, before = common.table(spark, sf_dir, "documents").select(COLUMNS), None
    for _, stage in STAGES[:-1]:
        docs, path = common.stash(stage(spark, docs, sf_dir))
        if before:
            common.unstash(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

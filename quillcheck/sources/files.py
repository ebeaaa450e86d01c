"""Other files: TeX and JSON lines; texts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def read_tex(spark: SparkSession, path: str) -> DataFrame:
    """TeX files: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def document_text(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, text) as whole documents: doc, text, a line feed after each page."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc").agg(F.concat(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n"), F.lit("\n")).alias("text"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark items in JSON lines as entries; authors are joined by ``and``, the key is the id, the DOI or ``unknown``."""
    schema = "id string, doi string, type string, title string, authors array<string>, year string, arxiv_id string, venue string"
    items = spark.read.schema(schema).json(path)
    text = lambda c: F.coalesce(c, F.lit(""))
    key = F.coalesce(F.nullif("id", F.lit("")), F.nullif("doi", F.lit("")), F.lit("unknown"))
    kept = items.where("title is not null or id is not null or doi is not null")
    return kept.select(F.xxhash64(key, text(F.col("title"))).alias("id"), key.alias("key"), F.coalesce("type", F.lit("article")).alias("type"), text(F.col("title")).alias("title"), F.concat_ws(" and ", "authors").alias("author"), F.coalesce("year", F.lit("None")).alias("year"), text(F.col("venue")).alias("venue"), text(F.col("doi")).alias("doi"), F.col("arxiv_id"))

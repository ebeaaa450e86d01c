"""Corrected bibliographies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

_ENTRY = rf"^@{T.WORD}+\{{({T.WORD}+),"


def fixed(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Files (file, text) with fields added at the end of entries: file, text.

    ``fixes`` has file, key and suggested_fixes (array of field and value), one row a key (``last_fixes`` picks it). An entry begins with
    a line ``@type{key,`` and ends at the line whose braces close it. Lines are numbered within their file, so a window
    holds one file's lines.
    """
    lines = files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    key = F.regexp_extract("line", _ENTRY, 1)
    order = Window.partitionBy("file").orderBy("n")
    s = lines.withColumn("starts", key != "").withColumn("entry", F.sum((key != "").cast("int")).over(order))
    s = s.withColumn("key", F.max(F.when(F.col("starts"), key)).over(Window.partitionBy("file", "entry")))
    braces = F.length(F.regexp_replace("line", r"[^{]", "")) - F.length(F.regexp_replace("line", r"[^}]", ""))
    inside = Window.partitionBy("file", "entry").orderBy("n")
    s = s.withColumn("depth", F.sum(F.when(F.col("starts"), 1).otherwise(braces)).over(inside))
    closed = (F.col("entry") > 0) & ~F.col("starts") & (F.col("depth") <= 0)
    s = s.withColumn("closing", closed & (F.sum(closed.cast("int")).over(inside) == 1))
    s = s.join(fixes.where("size(suggested_fixes) > 0").select("file", "key", "suggested_fixes"), ["file", "key"], "left")
    # the last line before the closing one that is not blank gets a comma
    blank = T.strip(F.col("line")) == ""
    last = F.max(F.when(~blank, F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("patched", F.when(F.col("closing") & F.col("suggested_fixes").isNotNull(), last))
    marks = s.where("patched is not null").select("file", F.col("patched").alias("n"), F.lit(True).alias("comma"))
    s = s.join(marks.distinct(), ["file", "n"], "left")
    bare = F.regexp_replace("line", rf"{T.WS}+\z", "")
    line = F.when(F.coalesce("comma", F.lit(False)) & ~F.substring(bare, -1, 1).isin(",", "{"), F.concat(bare, F.lit(","))).otherwise(F.col("line"))
    added = F.transform("suggested_fixes", lambda x: F.concat(F.lit("  "), x["field"], F.lit(" = {"), x["value"], F.lit("},")))
    out = F.when(F.col("patched").isNotNull(), F.concat(F.array_join(added, "\n"), F.lit("\n"), line)).otherwise(line)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", out.alias("line")))), lambda x: x["line"]), "\n")
    return s.groupBy("file").agg(whole.alias("text"))


def last_fixes(results: DataFrame) -> DataFrame:
    """The last result with fixes of each key: file, key, suggested_fixes. ``results`` has file, ord, key, suggested_fixes."""
    return results.where("size(suggested_fixes) > 0").groupBy("file", "key").agg(F.max_by("suggested_fixes", "ord").alias("suggested_fixes"))

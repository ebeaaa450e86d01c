"""Cross audit of TeX sources and bibliographies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import CITE

_INCLUDE = r"\\(?:input|include)\{([^}]+)\}"


def without_comments(tex: Column) -> Column:
    """TeX without comments; an escaped percent sign stays."""
    return F.regexp_replace(tex, r"(?d)(?<!\\)%.*", "")


def with_includes(files: DataFrame) -> DataFrame:
    """Files (path, text) with \\input and \\include replaced by the named files of the same folder, one level deep.

    Names without ``.tex`` get it; unknown ones stay as they are. The text between includes and the included texts are put together
    in order by position.
    """
    found = F.regexp_extract_all("text", F.lit(_INCLUDE), F.lit(0))
    parts = F.split("text", _INCLUDE, -1)
    # pieces at even places are the text between, those at odd places the includes
    pieces = F.transform(F.sequence(F.lit(0), 2 * F.size(found)), lambda k: F.struct(k.alias("at"), F.when(k % 2 == 0, parts[(k / 2).cast("int")]).otherwise(found[((k - 1) / 2).cast("int")]).alias("piece")))
    each = files.select("path", F.explode(pieces).alias("p")).select("path", "p.*")
    name = T.strip(F.regexp_extract("piece", _INCLUDE, 1))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    each = each.withColumn("want", F.when(F.col("at") % 2 == 1, F.concat(folder, name, F.when(name.endswith(".tex"), F.lit("")).otherwise(F.lit(".tex")))))
    known = files.select(F.col("path").alias("want"), F.col("text").alias("included"))
    whole = each.join(known, "want", "left").withColumn("piece", F.coalesce("included", "piece"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "piece")))
    return whole.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))


def cited_keys(tex: Column) -> Column:
    """The distinct keys that a text cites, comments aside."""
    lists = F.regexp_extract_all(without_comments(tex), F.lit(CITE.replace(r"\s", T.WS)), F.lit(1))
    keys = F.flatten(F.transform(lists, lambda x: F.split(x, ",")))
    return F.array_distinct(F.filter(F.transform(keys, T.strip), lambda k: k != ""))


def citations(files: DataFrame) -> DataFrame:
    """Distinct cited keys: file, key. ``files`` has file and text."""
    return files.select("file", F.explode(cited_keys(F.col("text"))).alias("key")).distinct()


def phantom_references(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """Cited keys (file, key) without an entry (file, key)."""
    gone = cited.select("file", "key").distinct().join(entries.select("file", "key"), ["file", "key"], "left_anti")
    message = F.concat(F.lit("Phantom reference: \\cite{"), "key", F.lit("} used in .tex but not defined in .bib"))
    return gone.select("file", F.lit("FAIL").alias("type"), F.lit("phantom_ref").alias("category"), "key", message.alias("message"))


def orphan_entries(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that are never cited."""
    idle = entries.select("file", "key").distinct().join(cited.select("file", "key"), ["file", "key"], "left_anti")
    message = F.concat(F.lit("Orphan entry: '"), "key", F.lit("' defined in .bib but never cited in .tex"))
    return idle.select("file", F.lit("WARN").alias("type"), F.lit("orphan_entry").alias("category"), "key", message.alias("message"))


def audit(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Both kinds of issues; order by file, category descending, key gives the report's order."""
    cited = citations(files)
    return phantom_references(cited, entries).unionByName(orphan_entries(cited, entries))

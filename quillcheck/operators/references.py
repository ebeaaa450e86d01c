"""References of document text: the section, its items, and their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import NEXT_SECTION, REF_HEADING, REF_ITEMS, REF_YEAR

_MANY = "(?m)(?d)"
_BRACKET, _DOT = (_MANY + T.spelled(p) for p in REF_ITEMS)
_YEAR = T.spelled(REF_YEAR)


def section(text: Column) -> Column:
    """The reference list of a text, trimmed; null without a heading."""
    heading, following = _MANY + T.spelled(REF_HEADING), _MANY + T.spelled(NEXT_SECTION)
    after = F.get(F.split(text, heading, 2), F.lit(1))
    return T.strip(F.element_at(F.split(after, following, 2), 1))


def items(references: Column) -> Column:
    """Array of reference strings: numbered in brackets, numbered with dots, or parted by blank lines."""
    marked = lambda pattern: F.filter(F.transform(F.slice(F.split(references, pattern, -1), 2, 1 << 30), T.squeeze), lambda x: x != "")
    chunks = F.filter(F.split(references, rf"\n{T.WS}*\n", -1), lambda x: F.length(T.strip(x)) > 30)
    return F.when(F.regexp_count(references, F.lit(_BRACKET)) >= 3, marked(_BRACKET)).when(F.regexp_count(references, F.lit(_DOT)) >= 3, marked(_DOT)).otherwise(F.transform(chunks, T.squeeze))


def parts(ref: Column) -> Column:
    """Struct of raw, title, author, year of a reference string."""

    def read(v: Column) -> Column:
        second = T.strip(F.regexp_replace(T.strip(F.coalesce(F.get(v["dots"], F.lit(1)), F.lit(""))), rf"\(?\p{{Nd}}{{4}}\)?\.?{T.WS}*", ""))
        longest = F.element_at(F.array_sort(F.transform(F.slice(v["sentences"], 1, 3), lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s")))), 1)["s"]
        before = F.element_at(F.split(v["ref"], _YEAR, 2), 1)
        author = F.when(v["year"] != "", F.regexp_replace(T.strip(before), r"[,. ]+\z", "")).otherwise(T.strip(F.element_at(v["dots"], 1)))
        return T.let({"v": v, "second": second, "longest": longest, "author": author}, choose)

    def choose(w: Column) -> Column:
        v = w["v"]
        title = F.when((F.size(v["dots"]) >= 3) & (F.length(w["second"]) > 10), w["second"]).when(v["quoted"] != "", v["quoted"]).when(F.size(v["sentences"]) >= 2, T.strip(w["longest"])).otherwise("")
        return F.struct(v["ref"].alias("raw"), title.alias("title"), w["author"].alias("author"), v["year"].alias("year"))

    values = {"ref": ref, "year": F.regexp_extract(ref, _YEAR, 1), "dots": F.split(ref, r"\.", -1), "sentences": F.split(ref, rf"\.{T.WS}+", -1), "quoted": F.regexp_extract(ref, '(?d)["\u201c](.+?)["\u201d]', 1)}
    return T.let(values, read)


def references(docs: DataFrame) -> DataFrame:
    """Parsed references of documents (doc, text): doc, index (from 1), raw, title, author, year."""
    each = docs.select("doc", F.posexplode(items(section(F.col("text")))).alias("at", "ref"))
    own = each.select("doc", (F.col("at") + 1).alias("index"), F.col("ref").alias("raw"), parts(F.col("ref")).alias("p"))
    return own.select("doc", "index", "raw", "p.title", "p.author", "p.year")  # raw beside the parts: who reads it alone needs none


def to_bibtex(resolved: DataFrame) -> DataFrame:
    """Resolved references (doc, index, rec) as one BibTeX text a document, in the order of the list."""
    rec = F.col("rec")
    key = T.bib_key(rec["authors"], rec["year"], F.col("index"))
    entry = T.bib_entry(key, rec["title"], rec["authors"], rec["year"], rec["venue"], rec["doi"], rec["arxiv_id"])
    rows = resolved.where(rec.isNotNull()).select("doc", "index", entry.alias("entry"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "entry"))), lambda x: x["entry"]), "\n\n")
    return rows.groupBy("doc").agg(F.concat(text, F.lit("\n")).alias("bibtex"))

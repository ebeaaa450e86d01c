"""Answers of the five scholarly services as catalog rows.

Each function takes a table of raw answers (``asked``: the identifier or title that was asked for; ``body``: the answer's JSON or
Atom text) and returns catalog rows, with ``asked`` and ``lookup_error`` beside: null where the answer could be read, else ``no answer``
(the body is null or empty) or ``unreadable``. Answers without a record give no row, but those with an error do, so that an outage can be
told from a miss; ``usable`` drops them. A search's hits are in the service's order (``pos``, from 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CATALOG = "source string, rec_id string, pos bigint, title string, authors array<string>, year string, venue string, doi string, arxiv_id string, citation_count bigint, is_retracted boolean"
_NAMES = [c.split()[0] for c in CATALOG.split(", ")]
_DATES = ("published-print", "published-online", "created")
_CROSSREF = (
    "struct<message:struct<title:array<string>,author:array<struct<given:string,family:string>>,"
    + ",".join(f"`{d}`:struct<`date-parts`:array<array<int>>>" for d in _DATES)
    + ",`container-title`:array<string>,`update-to`:array<struct<type:string>>>>"
)
_DBLP = "struct<result:struct<hits:struct<hit:array<struct<`@id`:string,info:struct<title:string,authors:struct<author:string>,year:string,venue:string,doi:string>>>>>>"
_S2 = "struct<data:array<struct<paperId:string,title:string,authors:array<struct<name:string>>,year:int,venue:string,citationCount:bigint,externalIds:struct<DOI:string,ArXiv:string>>>>"
_OPENALEX = "struct<results:array<struct<id:string,title:string,authorships:array<struct<author:struct<display_name:string>>>,publication_year:int,primary_location:struct<source:struct<display_name:string>>,doi:string,cited_by_count:bigint,is_retracted:boolean>>>"


def _rows(answers: DataFrame, source: str, readable: Column, **columns: Column) -> DataFrame:
    """Catalog rows of the columns given; the others are null."""
    error = F.when(~T.filled(F.col("body")), "no answer").when(~readable, "unreadable")
    kinds = dict(c.split(" ", 1) for c in CATALOG.split(", "))
    made = {"source": F.lit(source), "pos": F.lit(0)} | columns
    own = [(F.when(error.isNull(), made[n]) if n != "source" else made[n]).cast(kinds[n]).alias(n) if n in made else F.lit(None).cast(kinds[n]).alias(n) for n in _NAMES]
    return answers.select("asked", *own, error.alias("lookup_error"))


def usable(rows: DataFrame) -> DataFrame:
    """The catalog rows among parsed answers."""
    return rows.where("lookup_error is null").select(_NAMES)


def errors(rows: DataFrame) -> DataFrame:
    """What was asked for in vain, for ``verdict.verify(.., errors=..)``: source, asked, lookup_error."""
    return rows.where("lookup_error is not null").select("source", "asked", "lookup_error")


def crossref_year(message: Column) -> Column:
    """The first date with parts, its first part."""
    parts = lambda d: F.get(message[d]["date-parts"], F.lit(0))
    return F.coalesce(*(F.when(F.size(parts(d)) > 0, F.get(parts(d), F.lit(0)).cast("string")) for d in _DATES))


def crossref_records(answers: DataFrame) -> DataFrame:
    """One record a DOI; a work without a title has an empty one."""
    a = answers.select("asked", "body", F.from_json("body", _CROSSREF)["message"].alias("m"))
    m = F.col("m")
    authors = F.filter(F.transform(m["author"], lambda p: T.full_name(p["given"], p["family"])), lambda n: n != "")
    return _rows(
        a, "crossref", m.isNotNull(), rec_id=F.col("asked"), title=F.coalesce(F.get(m["title"], F.lit(0)), F.lit("")), authors=F.coalesce(authors, F.array().cast("array<string>")), year=crossref_year(m),
        venue=F.coalesce(T.first_filled(m["container-title"]), F.lit("")), doi=F.col("asked"), is_retracted=F.coalesce(F.exists(m["update-to"], lambda u: F.coalesce(u["type"] == "retracted-article", F.lit(False))), F.lit(False)),
    )


def arxiv_records(answers: DataFrame) -> DataFrame:
    """One record an arXiv id, from Atom text: the feed's second title is the paper's. Entities stay as they are."""
    titles = F.regexp_extract_all("body", F.lit("(?s)<title[^>]*>(.*?)</title>"), F.lit(1))
    a = answers.select("asked", "body", titles.alias("titles"))
    title = T.squeeze(F.get("titles", F.lit(1)))
    authors = F.regexp_extract_all("body", F.lit("(?d)<name>(.*?)</name>"), F.lit(1))
    year = F.nullif(F.substring(F.regexp_extract("body", "(?d)<published>(.*?)</published>", 1), 1, 4), F.lit(""))
    rows = _rows(a, "arxiv", F.col("body").contains("<feed") | (F.size("titles") > 0), rec_id=F.col("asked"), title=title, authors=authors, year=year, arxiv_id=F.col("asked"))
    return rows.where("lookup_error is not null or title is not null and not startswith(lower(title), 'error')")


def _hits(answers: DataFrame, schema: str, hits: str) -> DataFrame:
    """Answers with a row for each hit, and one without hit where the answer cannot be read."""
    a = answers.select("asked", "body", F.from_json("body", schema).alias("a"))
    rows = a.select("asked", "body", F.col("a").isNotNull().alias("ok"), F.posexplode_outer(f"a.{hits}").alias("pos", "h"))
    readable = T.filled(F.col("body")) & F.coalesce(F.get_json_object("body", "$").isNotNull(), F.lit(False))
    return rows.withColumn("ok", readable).where(F.col("h").isNotNull() | ~readable)


def _text(json: Column) -> Column:
    """A string, or the ``text`` of an object."""
    return F.when(json.startswith("{"), F.get_json_object(json, "$.text")).otherwise(json)


def _list(json: Column) -> Column:
    """The elements of a list, or the one that stands for a list."""
    return F.when(json.startswith("["), F.from_json(json, "array<string>")).when(json.isNotNull(), F.array(json)).otherwise(F.array().cast("array<string>"))


def dblp_records(answers: DataFrame) -> DataFrame:
    """All hits of a title search; a single author comes without a list, and names may end in a number."""
    a = _hits(answers, _DBLP, "result.hits.hit")
    i = F.col("h.info")
    authors = F.transform(_list(i["authors"]["author"]), lambda x: T.catalog_name(_text(x)))
    venue = F.coalesce(F.get(_list(i["venue"]), F.lit(0)), F.lit(""))
    key = F.coalesce(F.col("h.@id"), F.concat_ws("#", "asked", "pos"))
    return _rows(a, "dblp", F.col("ok"), rec_id=key, pos=F.col("pos"), title=T.catalog_title(F.coalesce(i["title"], F.lit(""))), authors=authors, year=i["year"], venue=venue, doi=F.coalesce(i["doi"], F.lit("")))


def s2_records(answers: DataFrame) -> DataFrame:
    """All hits of a title search."""
    a = _hits(answers, _S2, "data")
    h = F.col("h")
    authors = F.coalesce(F.transform(h["authors"], lambda x: F.coalesce(x["name"], F.lit(""))), F.array().cast("array<string>"))
    year = F.when(h["year"] != 0, h["year"].cast("string"))
    key = F.coalesce(h["paperId"], F.concat_ws("#", "asked", "pos"))
    return _rows(a, "s2", F.col("ok"), rec_id=key, pos=F.col("pos"), title=F.coalesce(h["title"], F.lit("")), authors=authors, year=year, venue=F.coalesce(h["venue"], F.lit("")), doi=h["externalIds"]["DOI"], arxiv_id=h["externalIds"]["ArXiv"], citation_count=h["citationCount"])


def openalex_records(answers: DataFrame) -> DataFrame:
    """All hits of a title search; names without text are left out, and DOIs lose their address."""
    a = _hits(answers, _OPENALEX, "results")
    h = F.col("h")
    authors = F.filter(F.transform(h["authorships"], lambda x: x["author"]["display_name"]), lambda n: T.filled(n))
    year = F.when(h["publication_year"] != 0, h["publication_year"].cast("string"))
    key = F.coalesce(h["id"], F.concat_ws("#", "asked", "pos"))
    venue = F.coalesce(h["primary_location"]["source"]["display_name"], F.lit(""))
    return _rows(a, "openalex", F.col("ok"), rec_id=key, pos=F.col("pos"), title=F.coalesce(h["title"], F.lit("")), authors=F.coalesce(authors, F.array().cast("array<string>")), year=year, venue=venue, doi=T.bare_doi(F.coalesce(h["doi"], F.lit(""))), citation_count=h["cited_by_count"], is_retracted=F.coalesce(h["is_retracted"], F.lit(False)))


PARSERS = {"arxiv": arxiv_records, "crossref": crossref_records, "dblp": dblp_records, "s2": s2_records, "openalex": openalex_records}


def catalog(answers: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Catalog rows of the answers of several services, and the lookups in vain."""
    parsed = [PARSERS[source](a) for source, a in answers.items()]
    every = parsed[0]
    for p in parsed[1:]:
        every = every.unionByName(p)
    return usable(every), errors(every)

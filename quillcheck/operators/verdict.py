"""Verdicts: checks of every source that has an entry, folded into one status, all within the entry's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matchers as M
from ..functions import text as T
from ..functions.fixed import ARXIV_FIELDS, CATALOGS, NON_ARTICLES
from ..functions.lineage import cut
from . import lookup

TOOL = "quillcheck"


def _check(field: str, status: Column | str, detail: Column, source: Column | str) -> Column:
    status, source = (F.lit(x) if isinstance(x, str) else x for x in (status, source))
    return F.struct(F.lit(field).alias("field"), status.alias("status"), detail.alias("detail"), source.alias("source"))


def found_arxiv(entries: DataFrame) -> Column:
    """The entry's arXiv id, else one found in those of its fields that it has as columns."""
    fields = {n: F.col(n) for n in ARXIV_FIELDS if n in entries.columns}
    own = F.when(T.filled(F.col("arxiv_id")), F.col("arxiv_id"))
    return F.coalesce(own, T.arxiv_id(fields)) if fields else own


def phantoms(entries: DataFrame) -> DataFrame:
    """Adds phantom_doi and phantom_arxiv: well-formed identifiers that their catalog does not have, and arxiv_found (see ``found_arxiv``).

    An id that is found in other fields only is not looked up, as in a lookup by the entry's own id. Catalogs that gave no answer
    (``lookup_errors``) make no phantoms.
    """
    answered = lambda s: ~F.array_contains("lookup_errors", s) if "lookup_errors" in entries.columns else F.lit(True)
    doi = F.coalesce("doi", F.lit("")).rlike(r"^10\.\p{Nd}{4,}/") & F.col("rec_crossref").isNull() & answered("crossref")
    arxiv = F.coalesce("arxiv_found", F.lit("")).rlike(r"^\p{Nd}{4}\.\p{Nd}{4,5}") & F.col("rec_arxiv").isNull() & answered("arxiv")
    return entries.withColumn("arxiv_found", found_arxiv(entries)).withColumn("phantom_doi", doi).withColumn("phantom_arxiv", arxiv)


def gather(entries: DataFrame, catalog: DataFrame, side: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """The lookup cascade: records by arXiv id and DOI, then by title in dblp and s2, and in openalex only where none has a hit.

    The title searches of all catalogs are one join, over ``side`` (``lookup.prepared``) where it is given. The catalog itself is read with
    its filters and columns, and not written. The entries with their identifiers' records are read by several later steps, so they are
    written once. ``errors`` (source, asked) are lookups in vain.
    """
    e = lookup.with_errors(entries, errors) if errors is not None else entries
    e = lookup.by_id(e, catalog, "arxiv", "arxiv_id")
    e = cut(phantoms(lookup.by_id(e, catalog, "crossref", "doi")))
    hits = lookup.title_hits(e, catalog, lookup.SEARCHED, F.col("phantom_doi") | F.col("phantom_arxiv"), side)
    wide = hits.groupBy("id").agg(*(F.first(F.when(F.col("source") == s, F.col("rec")), True).alias(f"rec_{s}") for s in lookup.SEARCHED))
    known = F.col("rec_arxiv").isNotNull() | F.col("rec_crossref").isNotNull() | F.col("rec_dblp").isNotNull() | F.col("rec_s2").isNotNull()
    return e.join(wide, "id", "left").withColumn("rec_openalex", F.when(~known, F.col("rec_openalex")))


#: Places of the checks of each source among an entry's checks; phantoms stand at 2 and 3.
_PLACES = {"arxiv": 0, "crossref": 1, "dblp": 4, "s2": 5, "openalex": 6}


def source_checks(gathered: DataFrame) -> DataFrame:
    """Per entry, the checks of all sources with a record, softened where the source is confirmed: id, by_source (array of place,
    source, confirmed, checks).

    Records become rows, so that each matcher stands in the plan once.
    """
    found = F.array_compact(F.array(*(F.when(F.col(f"rec_{s}").isNotNull(), F.struct(F.lit(k).alias("place"), F.lit(s).alias("source"), F.col(f"rec_{s}").alias("rec"))) for s, k in _PLACES.items())))
    rows = gathered.select("id", "title", "author", "year", "venue", F.explode(found).alias("f")).select("id", "title", "author", "year", "venue", "f.*")
    rec, source = F.col("rec"), F.col("source")
    rows = rows.select("id", "place", "source", "rec", M.match_title(F.col("title"), rec["title"]).alias("mt"), M.match_authors(F.col("author"), rec["authors"]).alias("ma"), M.match_year(F.col("year"), rec["year"]).alias("my"), M.match_venue(F.col("venue"), rec["venue"]).alias("mv"))
    sure = (F.col("mt.status") == "OK") & F.col("ma.status").isin("OK", "WARN")
    far, one = sure & (F.col("my.status") == "FAIL"), sure & (F.col("my.status") == "WARN") & F.col("my.detail").contains("off by 1")
    status = F.when(far, "WARN").when(one, "OK").otherwise(F.col("my.status"))
    detail = F.when(far, F.concat("my.detail", F.lit(" (downgraded: title+author confirmed)"))).when(one, F.concat("my.detail", F.lit(" (accepted: confirmed match)"))).otherwise(F.col("my.detail"))
    checks = F.array_compact(
        F.array(
            _check("title", F.col("mt.status"), F.col("mt.detail"), source),
            _check("authors", F.col("ma.status"), F.col("ma.detail"), source),
            _check("year", status, detail, source),
            F.when((source != "arxiv") & T.filled(rec["venue"]), _check("venue", F.col("mv.status"), F.col("mv.detail"), source)),
            F.when(source.isin("crossref", "openalex") & F.coalesce(rec["is_retracted"], F.lit(False)), _check("retraction", "FAIL", F.lit("RETRACTED PAPER!"), source)),
            F.when(source.isin("s2", "openalex") & rec["citation_count"].isNotNull(), _check("citations", "OK", F.concat(F.lit("citation count: "), rec["citation_count"].cast("string")), source)),
        )
    )
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "source", sure.alias("confirmed"), checks.alias("checks")))).alias("by_source"))


def _phantom(kind: str, name: str, what: str, source: str) -> Column:
    column = "doi" if kind == "doi" else "arxiv_found"
    detail = F.concat(F.lit(f"{name} '"), F.col(column), F.lit(f"' has valid format but {what} -- likely hallucinated or incorrect"))
    return F.when(F.col(f"phantom_{kind}"), _check(f"phantom_{kind}", "FAIL", detail, source))


def fold(gathered: DataFrame) -> DataFrame:
    """Per entry: id, key, title, overall, sources_tried, sources_hit, checks (array in order), suggested_fixes (array), and lookup_errors where
    these were asked for."""
    gathered = cut(gathered)  # read for the checks and for the entries themselves
    hit = lambda s: F.col(f"rec_{s}").isNotNull()
    no_hit = ~(hit("arxiv") | hit("crossref") | hit("dblp") | hit("s2"))
    tried = F.array_compact(F.array(F.when(T.filled(F.col("arxiv_id")), "arxiv"), F.when(T.filled(F.col("doi")), "crossref"), F.lit("dblp"), F.lit("s2"), F.when(no_hit, "openalex")))
    g = gathered.withColumn("sources_tried", tried).withColumn("sources_hit", F.array_compact(F.array(*(F.when(hit(s), s) for s in CATALOGS))))
    article = ~F.lower(F.coalesce("type", F.lit(""))).isin(*NON_ARTICLES)
    none = F.size("sources_hit") == 0
    unmatched = F.when(
        none & article,
        _check("verification", "FAIL", F.concat(F.lit("NO API MATCH -- paper may be hallucinated or title differs significantly (tried: "), F.array_join("sources_tried", ", "), F.lit(")")), ""),
    ).when(none, _check("verification", "WARN", F.concat(F.lit("No API match for @"), "type", F.lit(" entry -- non-article types have limited API coverage")), ""))
    own = source_checks(g)
    g = g.join(own, "id", "left").withColumn("by_source", F.coalesce("by_source", F.filter(F.array(F.struct(F.lit(0).alias("place"), F.lit("").alias("source"), F.lit(False).alias("confirmed"), F.array(_check("", "", F.lit(""), "")).alias("checks"))), lambda x: F.lit(False))))
    part = lambda low, high: F.flatten(F.transform(F.filter("by_source", lambda x: x["place"].between(low, high)), lambda x: x["checks"]))
    checks = F.concat(part(0, 1), F.array_compact(F.array(_phantom("doi", "DOI", "doesn't resolve", "crossref"), _phantom("arxiv", "arXiv ID", "doesn't exist", "arxiv"))), part(4, 6), F.array_compact(F.array(unmatched)))
    g = cut(g.withColumn("checks", checks).withColumn("confirmed", F.transform(F.filter("by_source", lambda x: x["confirmed"]), lambda x: x["source"])))
    counted = F.filter("checks", lambda c: (F.size("confirmed") == 0) | F.array_contains(F.col("confirmed"), c["source"]))
    any_of = lambda state: F.exists(counted, lambda c: c["status"] == state)
    g = g.withColumn("overall", F.when(any_of("FAIL"), "FAIL").when(any_of("WARN"), "WARN").otherwise("OK"))
    risky = (F.col("overall") == "OK") & (F.col("phantom_doi") | F.col("phantom_arxiv"))
    risk = lambda kind, what: F.when(risky & F.col(f"phantom_{kind}"), _check("hallucination_risk", "WARN", F.lit(f"Search found a similar paper but {what} -- verify this is the correct reference"), TOOL))
    more = F.array_compact(F.array(risk("doi", "DOI doesn't resolve"), risk("arxiv", "arXiv ID doesn't exist")))
    doi = F.when(~T.filled(F.col("doi")), F.coalesce(*(F.when(T.filled(F.col(f"rec_{s}.doi")), F.col(f"rec_{s}.doi")) for s in ("dblp", "s2", "openalex"))))
    eprint = F.when(~T.filled(F.col("arxiv_id")) & T.filled(F.col("rec_s2.arxiv_id")), F.col("rec_s2.arxiv_id"))
    fix = lambda name, v: F.when(v.isNotNull(), F.struct(F.lit(name).alias("field"), v.alias("value")))
    first = F.when(T.filled(F.col("rec_dblp.doi")) | T.filled(F.col("rec_s2.doi")), F.array_compact(F.array(fix("doi", doi), fix("eprint", eprint)))).otherwise(F.array_compact(F.array(fix("eprint", eprint), fix("doi", doi))))
    return g.select("id", "key", "title", F.when(risky, "WARN").otherwise(F.col("overall")).alias("overall"), "sources_tried", "sources_hit", F.concat("checks", more).alias("checks"), first.alias("suggested_fixes"), *(c for c in ("lookup_errors",) if c in gathered.columns))


def verify(entries: DataFrame, catalog: DataFrame, side: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """Entries against catalogs, end to end."""
    return fold(gather(entries, catalog, side, errors))


def long_checks(results: DataFrame) -> DataFrame:
    """One row a check: id, seq, field, status, detail, source."""
    return results.select("id", F.posexplode("checks").alias("seq", "c")).select("id", "seq", "c.*")

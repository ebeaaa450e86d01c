"""Lookups of entries in scholarly catalogs: by identifier and by title.

Entries have id, key, type, title, author, year, venue, doi, arxiv_id, and catalogs source, rec_id, pos, title, authors,
year, venue, doi, arxiv_id, citation_count, is_retracted (``catalog`` in SURVEY's terms). Where a catalog has several records for an identifier, the
first by (pos, rec_id) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matchers as M
from ..functions import text as T
from ..functions.lineage import cut
from . import ranking
from .similarity import set_key, similar_sets

RECORD = ("rec_id", "title", "authors", "year", "venue", "doi", "arxiv_id", "citation_count", "is_retracted")
#: Lowest title similarity of a candidate, and what an equal surname adds to its rank.
LEAST, BONUS = 0.6, 0.3


#: Catalogs that are searched by title in the verification.
SEARCHED = ("dblp", "s2", "openalex")


def _spread(key: Column, row: Column) -> Column:
    """A join key; rows without one get keys of their own, which nothing meets, so that they do not share a task."""
    return F.when(T.filled(key), F.concat(F.lit("="), key)).otherwise(F.concat(F.lit("-"), F.xxhash64(row).cast("string")))


def by_id(entries: DataFrame, catalog: DataFrame, source: str, column: str) -> DataFrame:
    """Entries with ``rec_<source>``: the catalog's record of the same identifier, or null."""
    own = catalog.where((F.col("source") == source) & T.filled(F.col(column)))
    found = own.groupBy(F.concat(F.lit("="), F.col(column)).alias("_at")).agg(F.min_by(F.struct(*RECORD), F.struct("pos", "rec_id")).alias(f"rec_{source}"))
    return entries.join(found, _spread(F.col(column), F.col("id")) == F.col("_at"), "left").drop("_at")


def prepared(catalog: DataFrame, sources: tuple[str, ...] = SEARCHED) -> DataFrame:
    """The side of the catalog that title searches read, written once: source, set (the title's tokens), theirs (the first surname), and the
    first place (pos, rec_id) of each."""
    own = catalog.where(F.col("source").isin(*sources))
    title = F.when(F.col("source") == "dblp", T.catalog_title(F.col("title"))).otherwise(F.col("title"))
    has = own.select("source", "pos", "rec_id", T.record_surname(F.col("authors")).alias("theirs"), set_key(T.title_tokens(title)).alias("set"))
    # empty sets go behind the cut: a filter before it would be pushed down and work out every set twice
    return cut(has.groupBy("source", "set", "theirs").agg(F.min(F.struct("pos", "rec_id")).alias("place"))).where("set <> ''")


def search_titles(entries: DataFrame, catalog: DataFrame, sources: tuple[str, ...] = SEARCHED, side: DataFrame | None = None) -> DataFrame:
    """The best candidate of each title form in each catalog: id, form (0: the title, 1: without acronym digits), source, rec, similarity, rank.

    Candidates have a title similarity of ``LEAST`` or more and rank by it, plus ``BONUS`` for an equal first surname, then by their place in the
    catalog. Both sides meet as token sets, so copies of a title do not multiply: a set's best record of any author is found once, that of
    the entry's own first author by set and surname. Records join last.
    """
    side = prepared(catalog, sources) if side is None else side.where(F.col("source").isin(*sources))
    other = T.without_acronym_digits(F.col("title"))
    forms = F.array_compact(F.array(F.struct(F.lit(0).alias("form"), F.col("title").alias("sought")), F.when(other != F.col("title"), F.struct(F.lit(1).alias("form"), other.alias("sought")))))
    asked = entries.select("id", T.first_surname(F.col("author")).alias("surname"), F.explode(forms).alias("f"))
    asked = cut(asked.select("id", "surname", "f.form", set_key(T.title_tokens(F.col("f.sought"))).alias("a"))).where("a <> ''")
    sets = lambda df, c: df.select(F.col(c).alias("set")).distinct().withColumn("tokens", F.split("set", " "))
    near = cut(similar_sets(sets(asked, "a"), sets(side, "set"), LEAST))
    groups = asked.select("a", "surname").distinct()
    hit = lambda rank: F.min(F.struct((-rank).alias("rank"), "place.pos", "place.rec_id", "similarity")).alias("hit")
    any_author = side.groupBy("source", F.col("set").alias("b")).agg(F.min("place").alias("place"))
    top = near.join(any_author, "b").groupBy("a", "source").agg(hit(F.col("similarity")))
    same = side.select("source", F.col("set").alias("b"), F.col("theirs").alias("surname"), "place").where("surname <> ''")
    own = groups.join(near, "a").join(same, ["b", "surname"]).groupBy("a", "surname", "source").agg(hit(F.col("similarity") + F.lit(BONUS)))
    best = groups.join(top, "a").select("a", "surname", "source", "hit").unionByName(own).groupBy("a", "surname", "source").agg(F.min("hit").alias("hit"))
    found = asked.join(best, ["a", "surname"]).select("id", "form", "source", "hit.*")
    at = ["source", "pos", "rec_id"]
    full = catalog.where(F.col("source").isin(*sources)).groupBy(*at).agg(F.min(F.struct(*(c for c in RECORD if c != "rec_id"))).alias("r"))
    rec = F.struct(*(F.col("rec_id") if c == "rec_id" else F.col(f"r.{c}").alias(c) for c in RECORD))
    return found.join(full, at).select("id", "form", "source", rec.alias("rec"), "similarity", (-F.col("rank")).alias("rank"))


def title_hits(entries: DataFrame, catalog: DataFrame, sources: tuple[str, ...], require_author: Column, side: DataFrame | None = None) -> DataFrame:
    """Hits of title searches: id, source and rec, the first title form's best candidate that may stand for the entry."""
    e = entries.select("id", "title", "author", "year", require_author.alias("strict"))
    c = search_titles(entries, catalog, sources, side).join(e, "id")
    rec = {k: F.col(f"rec.{k}") for k in RECORD} | {"score": T.title_similarity(F.col("title"), F.col("rec.title"))}
    fit = c.where(M.accepts({k: F.col(k) for k in ("author", "year")}, rec, F.col("strict")))
    return fit.groupBy("id", "source").agg(F.min_by("rec", "form").alias("rec"))


def with_errors(entries: DataFrame, errors: DataFrame) -> DataFrame:
    """Entries with ``lookup_errors``: the catalogs that gave no answer for them. ``errors`` has source and asked (an identifier, or a title)."""
    asks = F.array(*(F.struct(F.lit(s).alias("source"), F.col(c).alias("asked")) for s, c in (("arxiv", "arxiv_id"), ("crossref", "doi"), ("dblp", "title"), ("s2", "title"), ("openalex", "title"))))
    each = entries.select("id", F.explode(asks).alias("q")).select("id", "q.*").where(T.filled(F.col("asked")))
    failed = each.join(errors.select("source", "asked").distinct(), ["source", "asked"], "left_semi")
    return entries.join(failed.groupBy("id").agg(F.array_sort(F.collect_list("source")).alias("lookup_errors")), "id", "left").withColumn("lookup_errors", F.coalesce("lookup_errors", F.array().cast("array<string>")))


def resolve_references(refs: DataFrame, catalog: DataFrame, least: float = 0.5) -> DataFrame:
    """Parsed references (id, title, author) with the record that they resolve to (``rec``) and its catalog (``resolved_by``): the best title
    of the crossref catalog with a similarity of ``least`` or more (``LEAST`` at least), else that of s2; null where neither has one."""
    hits = search_titles(refs.select("id", "title", "author"), catalog, ("crossref", "s2")).where((F.col("form") == 0) & (F.col("similarity") >= least))
    first = hits.groupBy("id").agg(F.min(F.struct("source", "rec")).alias("hit"))
    return refs.join(first, "id", "left").withColumn("resolved_by", F.col("hit.source")).withColumn("rec", F.col("hit.rec")).drop("hit")


#: Characters of a raw reference that are searched, and the least score of a record for it.
RAW, SCORE = 300, 12.0


def resolve_raw(refs: DataFrame, catalog: DataFrame, source: str = "crossref", least: float = SCORE) -> DataFrame:
    """Records of a catalog for raw reference strings (id, raw): id, rec, score. Title, authors, year and venue of a record are its text; the
    best BM25 score of ``least`` or more counts, of equal ones the first in the catalog."""
    own = catalog.where(F.col("source") == source)
    text = F.concat_ws(" ", "title", F.array_join("authors", " "), "year", "venue")
    index = ranking.build(own.select(F.struct("pos", "rec_id").alias("place"), text.alias("text")))
    hits = ranking.search(index, refs.select("id", F.substring("raw", 1, RAW).alias("text")), least)
    full = own.groupBy(F.struct("pos", "rec_id").alias("place")).agg(F.min(F.struct(*RECORD)).alias("rec"))
    return hits.join(full, "place").select("id", "rec", "score")


def resolve(refs: DataFrame, catalog: DataFrame, least: float = SCORE, least_title: float = LEAST) -> DataFrame:
    """Parsed references (id, raw, title, author) with ``rec``, ``resolved_by`` and ``score``: the record of crossref that the raw string finds; where
    there is none (small catalogs give low scores), the best title of crossref, then of s2."""
    refs = cut(refs)  # both the search and its result read them
    raw = resolve_raw(refs, catalog, "crossref", least)
    found = cut(refs.join(raw, "id", "left"))
    missed = found.where(F.col("rec").isNull() & T.filled(F.col("title"))).select("id", "title", "author")
    titles = search_titles(missed, catalog, ("crossref", "s2")).where((F.col("form") == 0) & (F.col("similarity") >= least_title))
    titles = titles.groupBy("id").agg(F.min(F.struct("source", "rec")).alias("hit"))
    both = found.join(titles, "id", "left")
    return both.withColumn("resolved_by", F.when(F.col("rec").isNotNull(), "crossref").otherwise(F.col("hit.source"))).withColumn("rec", F.coalesce("rec", "hit.rec")).drop("hit")

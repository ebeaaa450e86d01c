"""Field matchers: struct(status, detail) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .fixed import SHORT_VENUES, VENUES

_CHECK = lambda status, detail: F.struct(F.lit(status).alias("status"), detail.alias("detail"))


def _say(template: str, *values: Column) -> Column:
    """A template whose {} are filled by columns (null as the empty text)."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, after in zip(values, parts[1:]):
        out += [F.coalesce(value.cast("string"), F.lit("")), F.lit(after)]
    return F.concat(*out)


def match_title(title: Column, found: Column, score: Column | None = None) -> Column:
    """Titles: OK from 0.85, WARN from 0.7, else FAIL."""

    def rate(v: Column) -> Column:
        s, two = v["s"], v["two"]
        return F.when(s >= 0.85, _CHECK("OK", _say("title match ({})", two))).when(s >= 0.7, _CHECK("WARN", _say("title partial match ({}): '{}'", two, v["found"]))).otherwise(_CHECK("FAIL", _say("title mismatch ({}): bib='{}' vs api='{}'", two, v["title"], v["found"])))

    scored = T.title_similarity(title, found) if score is None else score
    return T.let({"s": scored, "title": title, "found": found}, lambda v: T.let({"s": v["s"], "two": T.two_digits(v["s"]), "title": v["title"], "found": v["found"]}, rate))


def match_authors(author: Column, authors: Column) -> Column:
    """First surnames (accents folded) and the number of authors."""
    ours, theirs = T.first_surname(author), T.record_surname(authors)
    plain = T.strip_latex(author)
    values = {"ours": ours, "theirs": theirs, "same": T.fold_accents(ours) == T.fold_accents(theirs), "n": T.count_authors(author), "m": F.coalesce(F.size(authors), F.lit(0)), "others": F.lower(plain).contains("others")}

    def rate(v: Column) -> Column:
        count_ok = v["others"] | (F.abs(v["n"] - v["m"]) <= 2)
        return (
            F.when(v["m"] <= 0, _CHECK("WARN", F.lit("no authors from API")))
            .when((v["ours"] == "") | (v["theirs"] == ""), _CHECK("WARN", F.lit("could not extract surnames")))
            .when(v["same"] & count_ok, _CHECK("OK", _say("first author '{}' matches, count bib={} api={}", v["ours"], v["n"], v["m"])))
            .when(v["same"], _CHECK("WARN", _say("first author matches but count differs: bib={} api={}", v["n"], v["m"])))
            .otherwise(_CHECK("FAIL", _say("first author mismatch: bib='{}' api='{}'", v["ours"], v["theirs"])))
        )

    return T.let(values, rate)


def whole_year(c: Column) -> Column:
    """A year as a number, or null."""
    return T.strip(c).try_cast("int")


def match_year(year: Column, found: Column) -> Column:
    """Years by their difference."""
    a, b = whole_year(year), whole_year(found)
    gap = F.abs(a - b)
    both = lambda t: _say(t, a, b)
    return (
        F.when(~T.filled(found), _CHECK("WARN", F.lit("no year from API")))
        .when(a.isNull() | b.isNull(), _CHECK("WARN", _say("unparseable years: bib={} api={}", year, found)))
        .when(gap == 0, _CHECK("OK", _say("year exact match ({})", a)))
        .when(gap == 1, _CHECK("WARN", both("year off by 1: bib={} api={}")))
        .when(gap == 2, _CHECK("WARN", both("year off by 2: bib={} api={} (preprint vs published?)")))
        .otherwise(_CHECK("FAIL", both("year mismatch: bib={} api={}")))
    )


def _pairs(pairs) -> Column:
    """Pairs of texts as an array of short and full, in one expression."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("array(" + ", ".join(f"named_struct('short', {quoted(a)}, 'full', {quoted(b)})" for a, b in pairs) + ")")


def normal_venue(c: Column) -> Column:
    """A venue in lower case, short forms spelled out."""

    def spell(s: Column) -> Column:
        v = s["v"]
        return F.coalesce(F.get(F.filter(_pairs(SHORT_VENUES), lambda k: v.startswith(k["short"])), F.lit(0))["full"], v)

    return T.let({"v": T.strip(F.lower(T.strip_latex(c)))}, spell)


def match_venue(venue: Column, found: Column) -> Column:
    """Venues by names, tokens and abbreviations; never FAIL."""
    preprint = lambda v: v.contains("arxiv") | v.contains("corr")
    known = _pairs(VENUES)
    has = lambda v, k: v.contains(k["short"]) | v.contains(k["full"])

    def compare(v: Column) -> Column:
        a, b = v["a"], v["b"]
        shared = F.get(F.filter(known, lambda k: has(a, k) & has(b, k)), F.lit(0))["short"]
        return T.let({"a": a, "b": b, "venue": v["venue"], "found": v["found"], "s": T.jaccard(T.tokens(a), T.tokens(b)), "shared": shared}, rate)

    def rate(v: Column) -> Column:
        a, b, s = v["a"], v["b"], v["s"]
        return (
            F.when(~T.filled(v["found"]), _CHECK("WARN", F.lit("no venue from API")))
            .when(~T.filled(v["venue"]), _CHECK("WARN", F.lit("no venue in bib")))
            .when(preprint(a) & preprint(b), _CHECK("OK", F.lit("venue match (both arXiv/CoRR)")))
            .when(s >= 0.5, _CHECK("OK", _say("venue match ({})", T.two_digits(s))))
            .when(v["shared"].isNotNull(), _CHECK("OK", _say("venue match via abbreviation '{}'", v["shared"])))
            .when(a.contains(b) | b.contains(a), _CHECK("OK", F.lit("venue match (substring)")))
            .otherwise(_CHECK("WARN", _say("venue unclear: bib='{}' api='{}'", F.substring(v["venue"], 1, 50), F.substring(v["found"], 1, 50))))
        )

    return T.let({"a": normal_venue(venue), "b": normal_venue(found), "venue": venue, "found": found}, compare)


def accepts(entry: dict[str, Column], rec: dict[str, Column], require_author: Column) -> Column:
    """Whether a title search's record may stand for the entry."""
    no_authors = F.coalesce(F.size(rec["authors"]), F.lit(0)) <= 0
    same = T.fold_accents(T.first_surname(entry["author"])) == T.fold_accents(T.record_surname(rec["authors"]))
    gap = F.when(T.filled(rec["year"]), F.coalesce(F.abs(whole_year(entry["year"]) - whole_year(rec["year"])), F.lit(0))).otherwise(0)
    return F.when(no_authors, True).when(same, True).when(require_author, False).when(gap >= 2, False).otherwise(rec["score"] >= 0.85)

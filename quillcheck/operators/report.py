"""Summaries and reports of verification results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signs and headings of reports.
ICONS = {"OK": "\u2705", "WARN": "\u26a0\ufe0f", "FAIL": "\u274c"}


def status_counts(results: DataFrame, by: str | None = None) -> DataFrame:
    """Counts of OK, WARN and FAIL, and all."""
    rows = results.groupBy(by) if by else results.groupBy()
    return rows.agg(*(F.count_if(F.col("overall") == s).alias(s.lower()) for s in ICONS), F.count("*").alias("total"))


def source_coverage(results: DataFrame) -> DataFrame:
    """Entries found in each source: source, entries, place (by count, then by first appearance). ``results`` has ord and sources_hit."""
    each = results.select("ord", F.posexplode("sources_hit").alias("k", "source"))
    counts = each.groupBy("source").agg(F.count("*").alias("entries"), F.min(F.struct("ord", "k")).alias("first"))
    rank = F.expr("cast(row_number() over (order by entries desc, first) as int)")  # one row a source: a handful
    return counts.select("source", "entries", rank.alias("place"))


def first_fail(checks: Column) -> Column:
    """Field of the first failed check, or unknown."""
    return F.coalesce(F.get(F.filter(checks, lambda c: c["status"] == "FAIL"), F.lit(0))["field"], F.lit("unknown"))


def fail_summary(results: DataFrame) -> DataFrame:
    """The entries that failed, and the first failed check of each: file, ord, key, reason."""
    return results.where("overall = 'FAIL'").select("file", "ord", "key", first_fail(F.col("checks")).alias("reason"))


def _icon(status: Column) -> Column:
    out = F.lit("\u2753")
    for k, v in ICONS.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def entry_text(results: DataFrame) -> DataFrame:
    """Each entry's part of the report: file, ord, overall, text."""
    said = lambda bold: lambda c: F.concat(F.lit("- "), _icon(c["status"]), F.lit(" **" if bold else " "), c["field"], F.lit("**: " if bold else ": "), c["detail"], F.when(c["source"] != "", F.concat(F.lit(" ["), c["source"], F.lit("]"))).otherwise(F.lit("")))
    odd = F.filter("checks", lambda c: c["status"] != "OK")
    lines = F.when(F.size(odd) > 0, F.transform(odd, said(True))).otherwise(F.transform("checks", said(False)))
    fixes = F.transform("suggested_fixes", lambda x: F.concat(F.lit("- Add `"), x["field"], F.lit(" = {"), x["value"], F.lit("}`")))
    brief = F.array_join(F.transform("suggested_fixes", lambda x: F.concat(F.lit("`"), x["field"], F.lit("="), x["value"], F.lit("`"))), ", ")
    some = F.size("suggested_fixes") > 0
    none = F.array().cast("array<string>")
    head = F.array(F.concat(F.lit("### "), _icon(F.col("overall")), F.lit(" `"), "key", F.lit("`\n")), F.concat(F.lit("**"), "title", F.lit("**  ")), F.concat(F.lit("Sources: "), F.when(F.size("sources_hit") > 0, F.array_join("sources_hit", ", ")).otherwise("no match"), F.lit("\n")))
    full = F.concat(lines, F.when(some, F.concat(F.array(F.lit(""), F.lit("**Suggested fixes:**")), fixes)).otherwise(none))
    short = F.when(some, F.array(F.concat(F.lit("- Fixes available: "), brief))).otherwise(none)
    body = F.concat(head, F.when(F.col("overall") == "OK", short).otherwise(full), F.array(F.lit("")))
    return results.select("file", "ord", "overall", F.array_join(body, "\n").alias("text"))


def markdown(results: DataFrame, tex_issues: DataFrame | None = None, dup_issues: DataFrame | None = None) -> DataFrame:
    """One Markdown report a bibliography file: file, report.

    Results have file, ord, key, title, overall, sources_hit, checks, suggested_fixes. A report holds one bibliography, so it is put together in one row.
    """
    counts = results.groupBy("file").agg(F.count("*").alias("total"), *(F.count_if(F.col("overall") == s).alias(s) for s in ICONS), F.count_if(F.size("sources_hit") > 0).alias("hit"))
    each = results.select("file", "ord", F.posexplode("sources_hit").alias("k", "source")).groupBy("file", "source").agg(F.count("*").alias("n"), F.min(F.struct("ord", "k")).alias("first"))
    covered = each.groupBy("file").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "source"))).alias("sources"))
    texts = entry_text(results).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("overall", "ord", "text"))).alias("entries"))
    out = counts.join(covered, "file", "left").join(texts, "file")
    said = {}
    for name, issues in (("tex", tex_issues), ("dup", dup_issues)):
        if issues is None:
            out = out.withColumn(name, F.array().cast("array<string>"))
            continue
        order = F.struct(F.when(F.col("category") == "phantom_ref", 0).otherwise(1).alias("a"), F.col("key").alias("b")) if name == "tex" else F.struct(F.col("i").alias("a"), F.col("j").alias("b"))
        line = F.concat(F.lit("- "), _icon(F.col("type")), F.lit(" `"), "key", F.lit("` \u2014 "), "message") if name == "tex" else F.concat(F.lit(f"- {ICONS['WARN']} "), "message")
        said[name] = issues.select("file", F.struct(order.alias("o"), line.alias("line")).alias("x")).groupBy("file").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias(name))
        out = out.join(said[name], "file", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    row = lambda label, n: F.concat(F.lit(f"| {label} | "), F.col(n).cast("string"), F.lit(" |"))
    part = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.array(head), lines)).otherwise(none)
    own = lambda s: F.transform(F.filter("entries", lambda e: e["overall"] == s), lambda e: e["text"])
    titled = lambda s, label: part(F.concat(F.lit(f"## {ICONS[s]} {label} ("), F.col(s).cast("string"), F.lit(")\n")), own(s))
    sources = F.array_join(F.transform("sources", lambda x: F.concat(x["source"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")"))), " \u00b7 ")
    head = F.array(
        F.lit("# Citation report\n"), F.lit("| Metric | Count |"), F.lit("|--------|-------|"), row("Total entries", "total"), row(f"{ICONS['OK']} OK", "OK"), row(f"{ICONS['WARN']} WARN", "WARN"), row(f"{ICONS['FAIL']} FAIL", "FAIL"), F.lit(""),
        F.concat(F.lit("**API coverage:** "), F.col("hit").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" entries found in at least one source  ")),
    )
    closed = lambda lines: F.when(F.size(lines) > 0, F.concat(lines, F.array(F.lit("")))).otherwise(none)
    whole = F.concat(head, F.when(F.col("sources").isNotNull(), F.array(F.concat(F.lit("**Sources:** "), sources))).otherwise(none), F.array(F.lit("")), closed(part(F.lit("## TeX Cross-Audit\n"), F.col("tex"))), closed(part(F.lit("## Duplicates\n"), F.col("dup"))), titled("FAIL", "Issues"), titled("WARN", "Warnings"), titled("OK", "Verified"))
    return out.select("file", F.array_join(whole, "\n").alias("report"))


def _issues(results: DataFrame, issues: DataFrame | None, name: str, order: Column) -> DataFrame:
    """Issues of each file as an array of (type, category, key, message), in order."""
    files = results.select("file").distinct()
    none = F.array().cast("array<struct<type:string,category:string,key:string,message:string>>")
    if issues is None:
        return files.withColumn(name, none)
    own = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct("type", "category", "key", "message").alias("i")))), lambda x: x["i"])
    return files.join(issues.groupBy("file").agg(own.alias(name)), "file", "left").withColumn(name, F.coalesce(name, none))


def json_report(results: DataFrame, version: str, tex_issues: DataFrame | None = None, dup_issues: DataFrame | None = None, elapsed: float | None = None) -> DataFrame:
    """One JSON document a bibliography file: file, report. ``elapsed`` are the seconds that the verification took."""
    fields = ("key", "title", "overall", "sources_tried", "sources_hit", "checks")
    fixes = F.map_from_entries("suggested_fixes").alias("suggested_fixes")
    seconds = [] if elapsed is None else [F.lit(round(elapsed, 1)).alias("elapsed_seconds")]
    counts = F.struct(F.count("*").alias("total"), *(F.count_if(F.col("overall") == s).alias(s.lower()) for s in ICONS), *(F.max(c).alias("elapsed_seconds") for c in seconds))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct(*fields, fixes)).alias("r")))), lambda x: x["r"])
    each = results.groupBy("file").agg(F.to_json(counts.alias("s")).alias("summary"), F.array_join(rows, ",").alias("results"))
    tex = _issues(results, tex_issues, "tex_issues", F.struct(F.when(F.col("category") == "phantom_ref", 0).otherwise(1).alias("a"), F.col("key").alias("b")))
    dup = _issues(results, dup_issues, "dup_issues", F.struct(F.col("i").alias("a"), F.col("j").alias("b")) if dup_issues is not None else F.lit(0))
    all_ = each.join(tex, "file").join(dup, "file")
    head = F.regexp_replace(F.to_json(F.struct(F.lit(version).alias("version"), F.col("file"))), r"\}$", "")
    return all_.select("file", F.concat(head, F.lit(',"summary":'), "summary", F.lit(',"results":['), "results", F.lit('],"tex_issues":'), F.to_json("tex_issues"), F.lit(',"dup_issues":'), F.to_json("dup_issues"), F.lit("}")).alias("report"))


# Signs of scan verdicts.
SCAN_ICONS = {"FAIL": "\u2620\ufe0f", "WARN": "\u26a0\ufe0f", "CLEAN": "\u2705"}
_PASSED = "No prompt injection detected. Paper passes integrity check."
_REJECT = "**\u26d4 RECOMMENDATION: REJECT** -- This paper contains adversarial prompt injections targeting AI review systems. This constitutes academic misconduct and should be flagged to the program committee."


def scan_line(summary: DataFrame) -> Column:
    """One line on a scanned document; ``summary`` has verdict, fail_count, warn_count and pages_scanned."""
    icon = F.when(F.col("verdict") == "FAIL", SCAN_ICONS["FAIL"]).when(F.col("verdict") == "WARN", SCAN_ICONS["WARN"] + " ").otherwise(SCAN_ICONS["CLEAN"])
    return F.concat(icon, F.lit(" "), "verdict", F.lit(": "), F.col("fail_count").cast("string"), F.lit(" injection(s), "), F.col("warn_count").cast("string"), F.lit(" warning(s) in "), F.col("pages_scanned").cast("string"), F.lit(" pages"))


def scan_report(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """One Markdown report a scanned document: doc, report. ``summary`` has doc, verdict, fail_count, warn_count, pages_scanned and
    hidden_text_blocks, ``findings`` the rows of ``injection.scan``. A report holds one document, so it is put together in one row."""
    none = F.array().cast("array<string>")
    said = F.concat(F.lit("- **["), "category", F.lit("]** "), "description")
    page = F.when(F.coalesce("page", F.lit(0)) != 0, F.concat(F.lit("  - Page: "), F.col("page").cast("string")))
    text = F.when((F.col("severity") == "FAIL") & (F.coalesce("text_snippet", F.lit("")) != ""), F.concat(F.lit("  - Text: `"), F.substring(F.translate("text_snippet", "\n", " "), 1, 120), F.lit("`")))
    lines = findings.select("doc", "seq", "severity", F.array_compact(F.array(said, page, text, F.lit(""))).alias("lines"))
    own = lambda s: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.struct("seq", "lines")))), lambda x: x["lines"])).alias(s)
    out = summary.join(lines.groupBy("doc").agg(own("FAIL"), own("WARN")), "doc", "left")
    value = lambda label, c: F.concat(F.lit(f"**{label}:** "), F.col(c).cast("string"))
    head = F.array(F.lit("# Injection scan report"), F.lit(""), F.concat(F.lit("**File:** `"), F.col("doc").cast("string"), F.lit("`")), value("Pages scanned", "pages_scanned"), value("Hidden text blocks", "hidden_text_blocks"), value("Verdict", "verdict"), F.lit(""))
    part = lambda s, label, n: F.when(F.col(n) > 0, F.concat(F.array(F.concat(F.lit(f"## {SCAN_ICONS[s]} {label} ("), F.col(n).cast("string"), F.lit(")")), F.lit("")), F.col(s))).otherwise(none)
    foot = F.when(F.col("verdict") == "FAIL", F.array(F.lit("---"), F.lit(""), F.lit(_REJECT))).otherwise(none)
    body = F.when(F.col("verdict") == "CLEAN", F.array(F.lit(_PASSED))).otherwise(F.concat(part("FAIL", "Injections Found", "fail_count"), part("WARN", "Warnings", "warn_count"), foot))
    return out.select("doc", F.array_join(F.concat(head, body), "\n").alias("report"))


def scan_json(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON document a scanned document: doc, report. Snippets have at most 200 characters."""
    one = F.struct("severity", "category", "description", "page", F.substring("text_snippet", 1, 200).alias("text_snippet"), "location")
    own = F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("f")))), lambda x: x["f"])
    every = summary.join(findings.groupBy("doc").agg(own.alias("findings")), "doc", "left")
    none = F.array().cast("array<struct<severity:string,category:string,description:string,page:int,text_snippet:string,location:string>>")
    fields = F.struct("doc", "verdict", "fail_count", "warn_count", "pages_scanned", "hidden_text_blocks", F.coalesce("findings", none).alias("findings"))
    return every.select("doc", F.to_json(fields).alias("report"))

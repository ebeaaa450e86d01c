"""Command line: verify a bibliography, scan documents, extract references, keep feedback.

Catalogs are Parquet tables (``--catalog``); documents are Parquet tables of pages, or PDF files.
Exit codes: 0 fine, 1 something failed, 2 a file is missing.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, ship
from .operators import feedback, report
from .plans import verify as plans
from .sources import documents

_FEEDBACK = "QUILLCHECK_FEEDBACK_DIR"


def _write(text: str, path: str | None) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as out:
            out.write(text)
    else:
        print(text)


def _write_each(made: DataFrame, key: str, kind: str, folder: str) -> None:
    """A report for each document, written by the tasks that make them."""
    documents.write_documents(made.withColumn("_name", F.concat(F.regexp_replace(F.col(key).cast("string"), "^.*/", ""), F.lit(f".{kind}"))), folder, "_name", "report")


def _counts(results: DataFrame) -> str:
    n = report.status_counts(results).first()
    return f"{report.ICONS['OK']} {n['ok']}  {report.ICONS['WARN']} {n['warn']}  {report.ICONS['FAIL']} {n['fail']}  ({n['total']} entries)"


def _verify(spark: SparkSession, a: argparse.Namespace) -> int:
    made = plans.verify_bib(spark, a.bib, spark.read.parquet(a.catalog), a.tex, per_folder=a.per_folder)
    print(_counts(made["results"]))
    for r in report.fail_summary(made["results"]).orderBy("file", "ord").toLocalIterator():
        print(f"  {report.ICONS['FAIL']} {r['key']} \u2014 {r['reason']}")
    kind = "json" if a.json else "markdown"
    if a.out_dir:
        _write_each(made[kind], "file", "json" if a.json else "md", a.out_dir)
    else:
        _write("\n".join(r["report"] for r in made[kind].orderBy("file").toLocalIterator()), a.out)
    if a.fix:
        _write("\n".join(r["text"] for r in plans.fixed_bib(spark, a.bib, made["results"]).orderBy("file").toLocalIterator()), a.fix)
    bad = not made["results"].where("overall = 'FAIL'").isEmpty()
    return int(bad or made["tex_issues"] is not None and not made["tex_issues"].where("type = 'FAIL'").isEmpty())


def _scan(spark: SparkSession, a: argparse.Namespace) -> int:
    meta = spark.read.parquet(a.meta) if a.meta else plans.read_metadata(spark, a.pdf)
    found, summary = plans.scan_pages(plans.read_pages(spark, a.pdf), meta, visible=not a.no_visible, hidden=not a.no_hidden, metadata=not a.no_metadata)
    summary = summary.orderBy("doc")
    for r in summary.select("doc", report.scan_line(summary).alias("line")).toLocalIterator():
        print(f"{r['doc']}: {r['line']}")
    made = report.scan_json(summary, found) if a.json else report.scan_report(summary, found)
    if a.out_dir:
        _write_each(made, "doc", "json" if a.json else "txt", a.out_dir)
    else:
        _write("\n".join(r["report"] for r in made.orderBy("doc").toLocalIterator()), a.out)
    return int(not summary.where("verdict = 'FAIL'").isEmpty())


def _pdf(spark: SparkSession, a: argparse.Namespace) -> int:
    pages = plans.read_pages(spark, a.pdf)
    if not a.no_scan and not plans.scan_pages(pages, plans.read_metadata(spark, a.pdf))[1].where("verdict = 'FAIL'").isEmpty():
        print("The document holds instructions aimed at reviewers; stopped.", file=sys.stderr)
        return 1
    try:
        log, bib = plans.references_to_bib(pages, spark.read.parquet(a.catalog))
    except ValueError as e:
        print(f"{a.pdf}: {e}", file=sys.stderr)
        return 2
    print(f"{log.where('resolved_by is not null').count()} of {log.count()} references resolved")
    for r in log.where("resolved_by is null").orderBy("doc", "index").toLocalIterator():
        print(f"  {report.ICONS['FAIL']} {r['title_guess'] or r['raw'][:60]}")
    if a.bib_out:
        _write("\n".join(r["bibtex"] for r in bib.orderBy("doc").toLocalIterator()), a.bib_out)
        if a.verify:
            results = plans.verify_bib(spark, a.bib_out, spark.read.parquet(a.catalog))["results"]
            print(_counts(results))
            return int(not results.where("overall = 'FAIL'").isEmpty())
    return 0


def _feedback(spark: SparkSession, a: argparse.Namespace) -> int:
    if not (a.show or a.stats):
        if not a.issue:
            print("--issue is needed (or --show, --stats)", file=sys.stderr)
            return 2
        print(feedback.log_feedback(a.dir, a.issue, a.severity, context=a.context, tag=a.tag, bib_file=a.bib, expected=a.expected, actual=a.actual))
        return 0
    found = os.path.isdir(a.dir) and any(n.endswith(".json") for n in os.listdir(a.dir))
    rows = feedback.read_feedback(spark, a.dir) if found else None
    if a.stats:
        print(", ".join(f"{r['severity']}: {r['records']}" for r in feedback.stats(rows).toLocalIterator()) if found else "total: 0")
        return 0
    shown = 0
    for r in feedback.latest(rows, a.last).toLocalIterator() if found else ():
        print(f"[{(r['timestamp'] or '?')[:19]}] {(r['severity'] or '?').upper():>10}  {r['issue'] or ''}")
        if r["context"]:
            print(f"{'':14}context: {r['context']}")
        shown += 1
    if not shown:
        print("No feedback recorded yet.")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillcheck", description=__doc__)
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)
    v = sub.add_parser("verify", help="check a bibliography")
    v.add_argument("bib")
    for flag in ("--tex", "--out", "--fix", "--out-dir"):
        v.add_argument(flag)
    v.add_argument("--catalog", required=True)
    v.add_argument("--per-folder", action="store_true", help="TeX files stand against the bibliographies of their own folder")
    v.add_argument("--json", action="store_true")
    v.add_argument("-w", "--workers", type=int, help="taken for the sake of old command lines; Spark's tasks do the work")
    s = sub.add_parser("scan", help="look for instructions aimed at reviewers")
    s.add_argument("pdf")
    s.add_argument("--out")
    s.add_argument("--out-dir", help="a report for each document in this folder, instead of one text")
    s.add_argument("--meta", help="Parquet table of the documents' metadata")
    for flag in ("--json", "--no-visible", "--no-hidden", "--no-metadata"):
        s.add_argument(flag, action="store_true")
    p = sub.add_parser("pdf", help="extract references")
    p.add_argument("pdf")
    p.add_argument("--catalog", required=True)
    for flag in ("--bib-out", "--out"):
        p.add_argument(flag)
    for flag in ("--verify", "--no-scan", "--json"):
        p.add_argument(flag, action="store_true")
    f = sub.add_parser("feedback", help="keep and show feedback")
    for flag in ("--issue", "--context", "--tag", "--bib", "--expected", "--actual"):
        f.add_argument(flag)
    f.add_argument("--severity", default="minor", choices=feedback.SEVERITIES)
    f.add_argument("--dir", default=os.environ.get(_FEEDBACK, "feedback"))
    f.add_argument("--last", type=int)
    for flag in ("--show", "--stats"):
        f.add_argument(flag, action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "pdf" and a.verify and not a.bib_out:
        print("--verify needs --bib-out", file=sys.stderr)
        return 2
    for path in (getattr(a, "bib", None) if a.command == "verify" else None, getattr(a, "pdf", None), getattr(a, "tex", None)):
        if path and "://" not in path and not any(c in path for c in "*?[") and not os.path.exists(path):
            print(f"No such file: {path}", file=sys.stderr)
            return 2
    spark = SparkSession.builder.appName("quillcheck").config("spark.ui.enabled", "false").getOrCreate()
    ship(spark)
    return {"verify": _verify, "scan": _scan, "pdf": _pdf, "feedback": _feedback}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())

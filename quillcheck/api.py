"""What users call, over files and catalog tables.

Results are DataFrames (one row an entry, issue or finding) or, where a report is asked for, texts of single documents. ``spark`` is the running
session where it is left out.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import ship
from .operators import feedback, references, report, similarity, verdict
from .plans import verify as plans
from .sources import bibtex, files

log_feedback = feedback.log_feedback


def _session(spark: SparkSession | None) -> SparkSession:
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    ship(spark)
    return spark


@dataclass
class VerificationResult:
    """One entry's result."""

    key: str
    title: str
    sources_tried: list[str] = field(default_factory=list)
    sources_hit: list[str] = field(default_factory=list)
    checks: list[dict] = field(default_factory=list)
    overall: str = "OK"
    suggested_fixes: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, row: Row) -> VerificationResult:
        """The result in a row of ``verdict.verify``."""
        fixes = {f["field"]: f["value"] for f in row["suggested_fixes"]}
        return cls(row["key"], row["title"], [*row["sources_tried"]], [*row["sources_hit"]], [c.asDict() for c in row["checks"]], row["overall"], fixes)


def parse_bib(path: str, spark: SparkSession | None = None) -> DataFrame:
    """Entries of BibTeX files."""
    return bibtex.read_bib(_session(spark), path)


def verify_bib(bib: str, catalog: DataFrame, tex: str | None = None, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
    """Results of all entries of BibTeX files, and a Markdown report for each file."""
    made = plans.verify_bib(_session(spark), bib, catalog, tex)
    return made["results"], made["markdown"]


_ENTRY = ("key", "type", "title", "author", "year", "venue", "doi", "arxiv_id")


def verify_entry(entry: dict, catalog: DataFrame, spark: SparkSession | None = None) -> VerificationResult:
    """The result of a single entry, given as a dictionary."""
    row = {n: entry.get(n) or "" for n in _ENTRY} | {n: entry[n] or "" for n in ("journal", "url", "note", "eprint") if n in entry}
    row["venue"] = row["venue"] or entry.get("booktitle") or entry.get("journal") or ""
    one = _session(spark).createDataFrame([(0, *row.values())], ", ".join(["id bigint", *(f"{n} string" for n in row)]))
    return VerificationResult.of(verdict.verify(one, catalog).first())


def audit_tex_bib(tex: str, entries: DataFrame, spark: SparkSession | None = None, per_folder: bool = False) -> DataFrame:
    """Cited keys without an entry, and entries that are never cited; a TeX file that is not there cites nothing. ``per_folder``: TeX files stand
    against the bibliographies of their own folder."""
    return plans.audit_tex(_session(spark), tex, entries, per_folder)


def detect_duplicates(entries: DataFrame) -> DataFrame:
    """Pairs of entries of one file with similar titles."""
    return similarity.duplicate_issues(entries)


def generate_report(results: DataFrame, tex_issues: DataFrame | None = None, dup_issues: DataFrame | None = None) -> DataFrame:
    """A Markdown report for each file."""
    return report.markdown(results, tex_issues, dup_issues)


def generate_fixed_bib(bib: str, results: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """The BibTeX files with suggested fields added: file, text."""
    return plans.fixed_bib(_session(spark), bib, results)


def show_feedback(folder: str, last: int | None = None, spark: SparkSession | None = None) -> DataFrame:
    """The last feedback records, the newest first."""
    return feedback.latest(feedback.read_feedback(_session(spark), folder), last)


def feedback_stats(folder: str, spark: SparkSession | None = None) -> dict[str, int]:
    """Numbers of feedback records by severity, and of all (``total``)."""
    return {r["severity"]: r["records"] for r in feedback.stats(feedback.read_feedback(_session(spark), folder)).collect()}


def _pages(pdf: str | DataFrame, spark: SparkSession | None) -> DataFrame:
    return plans.read_pages(_session(spark), pdf) if isinstance(pdf, str) else pdf


def extract_refs_from_pdf(pdf: str | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Parsed references of documents (PDF files, a Parquet table of pages, or pages); nothing is looked up."""
    return references.references(files.document_text(_pages(pdf, spark)))


def pdf_to_bib(pdf: str | DataFrame, catalog: DataFrame, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
    """A BibTeX text for each document, and the log of all its references; raises ValueError where there are no references at all."""
    log, bib = plans.references_to_bib(_pages(pdf, spark), catalog)
    return bib, log


@dataclass
class ScanResult:
    """What the scan of one document found."""

    pdf_path: str
    findings: list[dict]
    pages_scanned: int
    hidden_text_blocks: int
    verdict: str
    fail_count: int
    warn_count: int

    def to_dict(self) -> dict:
        return asdict(self) | {"findings": [f | {"text_snippet": (f["text_snippet"] or "")[:200]} for f in self.findings]}

    def summary(self) -> str:
        """One line."""
        icon = report.SCAN_ICONS[self.verdict] + (" " if self.verdict == "WARN" else "")
        return f"{icon} {self.verdict}: {self.fail_count} injection(s), {self.warn_count} warning(s) in {self.pages_scanned} pages"


def scan_pdf(pdf: str | DataFrame, meta: DataFrame | None = None, check_visible: bool = True, check_hidden: bool = True, check_metadata: bool = True, spark: SparkSession | None = None) -> list[ScanResult]:
    """Scan results of documents, one for each; for many documents, ``plans.verify.scan_pages`` gives tables."""
    spark = _session(spark)
    if isinstance(pdf, str) and meta is None:
        meta = plans.read_metadata(spark, pdf)
    pages = _pages(pdf, spark)
    found, summary = plans.scan_pages(pages, meta, visible=check_visible, hidden=check_hidden, metadata=check_metadata)
    own = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct("severity", "category", "description", "page", "text_snippet", "location").alias("f")))), lambda x: x["f"])
    rows = summary.join(found.groupBy("doc").agg(own.alias("findings")), "doc", "left").orderBy("doc").collect()
    return [ScanResult(str(r["doc"]), [f.asDict() for f in r["findings"] or []], r["pages_scanned"], r["hidden_text_blocks"], r["verdict"], r["fail_count"], r["warn_count"]) for r in rows]


def format_scan_report(result: ScanResult, spark: SparkSession | None = None) -> str:
    """The Markdown report of one document."""
    spark = _session(spark)
    summary = spark.createDataFrame([(result.pdf_path, result.verdict, result.fail_count, result.warn_count, result.pages_scanned, result.hidden_text_blocks)], "doc string, verdict string, fail_count long, warn_count long, pages_scanned long, hidden_text_blocks long")
    rows = [(result.pdf_path, i, f["severity"], f["category"], f["description"], f["page"], f["text_snippet"]) for i, f in enumerate(result.findings)]
    findings = spark.createDataFrame(rows, "doc string, seq int, severity string, category string, description string, page int, text_snippet string")
    return report.scan_report(summary, findings).first()["report"]


__all__ = [
    "verify_bib", "verify_entry", "VerificationResult", "parse_bib", "audit_tex_bib", "detect_duplicates", "generate_report", "generate_fixed_bib",
    "log_feedback", "show_feedback", "feedback_stats", "extract_refs_from_pdf", "pdf_to_bib", "scan_pdf", "format_scan_report", "ScanResult",
]

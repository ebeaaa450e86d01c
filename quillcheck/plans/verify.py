"""End-to-end plans over files."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import cut
from ..operators import autofix, injection, lookup, references, report, similarity, texaudit, verdict
from ..sources import bibtex, files, pdf


def _folder(path: str) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def audit_tex(spark: SparkSession, tex: str, entries: DataFrame, per_folder: bool = False) -> DataFrame:
    """TeX files, includes read in, against all entries: every entry is taken as one bibliography, whose name is that of its first file.

    ``per_folder``: each folder is a project of its own, whose TeX files stand against the bibliographies of the same folder; cited keys of a
    folder without a bibliography are under the folder's name. A path without TeX files cites nothing, so that all entries are orphans."""
    folder = tex.rsplit("/", 1)[0] + "/*.tex" if "/" in tex and (per_folder or not any(c in tex for c in "*?[")) else tex
    project = _folder if per_folder else lambda _: F.lit("")
    try:
        every = files.read_tex(spark, folder)
        main = files.read_tex(spark, tex).select("path")
        sources = texaudit.with_includes(every).join(main, "path", "left_semi").select(project("path").alias("file"), "text")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        sources = spark.createDataFrame([], "file string, text string")
    audited = texaudit.audit(sources, entries.withColumn("file", project("file")))
    first = entries.groupBy(project("file").alias("_project")).agg(F.min("file").alias("_file"))
    return audited.join(first, F.col("file") == F.col("_project"), "left").select(F.coalesce("_file", "file").alias("file"), "type", "category", "key", "message")


def verify_bib(spark: SparkSession, bib: str, catalog: DataFrame, tex: str | None = None, errors: DataFrame | None = None, per_folder: bool = False) -> dict[str, DataFrame]:
    """Entries of BibTeX files against a catalog: results, tex_issues (``per_folder``: see ``audit_tex``), dup_issues, markdown, json (one row a file)."""
    from .. import __version__

    began = time.time()
    entries = cut(bibtex.read_bib(spark, bib))
    results = cut(verdict.verify(entries, catalog, errors=errors).join(entries.select("id", "file", "ord"), "id"))
    dups = similarity.duplicate_issues(entries)
    issues = cut(audit_tex(spark, tex, entries, per_folder)) if tex else None
    made = {"entries": entries, "results": results, "tex_issues": issues, "dup_issues": dups}
    return made | {"markdown": report.markdown(results, issues, dups), "json": report.json_report(results, __version__, issues, dups, time.time() - began)}


def fixed_bib(spark: SparkSession, bib: str, results: DataFrame) -> DataFrame:
    """The BibTeX files with suggested fields added: file, text."""
    texts = spark.read.text(bib, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return autofix.fixed(texts, autofix.last_fixes(results))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a Parquet table, or of PDF files."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else pdf.pages(cut(pdf.read_spans(pdf.files(spark, path))))


def read_metadata(spark: SparkSession, path: str) -> DataFrame | None:
    """Metadata of PDF files; a table of pages has none."""
    return None if path.rstrip("/").endswith(".parquet") else pdf.metadata(pdf.files(spark, path))


def scan_pages(pages: DataFrame, meta: DataFrame | None = None, **which: bool) -> tuple[DataFrame, DataFrame]:
    """Findings of documents given as pages, and a summary of each (see ``injection.summary``)."""
    found = cut(injection.scan(pages, meta, **which))
    return found, injection.summary(pages, found)


def references_to_bib(pages: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of documents resolved in a catalog: the log of all references (with their key, and the title where they are
    unresolved), and a BibTeX text for each document. Raises ValueError where there are no references at all."""
    refs = references.references(files.document_text(pages)).withColumn("id", F.xxhash64("doc", "index"))
    resolved = cut(lookup.resolve(refs, catalog))
    if resolved.isEmpty():
        raise ValueError("no references found")
    key = F.when(F.col("rec").isNotNull(), T.bib_key(F.col("rec.authors"), F.col("rec.year"), F.col("index")))
    log = resolved.withColumn("key", key).withColumn("title_guess", F.when(F.col("rec").isNull(), F.col("title")))
    return log, references.to_bibtex(resolved)

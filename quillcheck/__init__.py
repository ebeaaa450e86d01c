"""quillcheck: citation and document integrity checks as Spark DataFrame operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

__version__ = "0.1.0"

#: What users call; see ``quillcheck.api``.
EXPORTS = (
    "verify_bib", "verify_entry", "VerificationResult", "parse_bib", "audit_tex_bib", "detect_duplicates", "generate_report", "generate_fixed_bib",
    "log_feedback", "show_feedback", "feedback_stats", "extract_refs_from_pdf", "pdf_to_bib", "scan_pdf", "format_scan_report", "ScanResult",
)


def __getattr__(name: str):
    if name in EXPORTS:
        from . import api

        return getattr(api, name)
    raise AttributeError(name)


def ship(spark) -> None:
    """Send this package to the executors' Python workers, once in a Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_quillcheck_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="quillcheck-"), "quillcheck.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("quillcheck", os.path.relpath(path, home)))
    sc.addPyFile(target)
    sc._quillcheck_shipped = True

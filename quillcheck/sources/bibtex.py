"""BibTeX files as entries.

Braces nest and strings join with ``#``, which no regular expression reads, so a small scanner runs in Arrow batches: over short texts as a whole, and over
files in the ranges in which Spark reads them (``bibsplit``); everything after it is column expressions. Entries of every type are kept. ``@string`` definitions and month
names are filled in, ``@comment`` and ``@preamble`` are skipped, field names are in lower case, and the last of a repeated field counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Names that stand for months.
MONTHS = dict(zip(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")))
_RAW = "file string, ord int, key string, type string, raw map<string,string>"


def _balanced(text: str, at: int) -> int:
    """The place after the brace that closes the one at ``at``; one after the text's end where none does."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if not depth:
                return i + 1
    return len(text) + 1


def _value(text: str, at: int, names: dict[str, str]) -> tuple[str, int]:
    """A field's value, its parts joined, and where it ends."""
    parts = []
    while at < len(text):
        while at < len(text) and (text[at].isspace() or text[at] == "#"):
            at += 1
        if at >= len(text) or text[at] in ",})":
            break
        if text[at] == "{":
            end = _balanced(text, at)
            parts.append(text[at + 1 : end - 1])
        elif text[at] == '"':
            end, depth = at + 1, 0
            while end < len(text) and (text[end] != '"' or depth):
                depth += (text[end] == "{") - (text[end] == "}")
                end += 1
            parts.append(text[at + 1 : end])
            end += 1
        else:
            end = at
            while end < len(text) and text[end] not in ",#})" and not text[end].isspace():
                end += 1
            word = text[at:end]
            parts.append(names.get(word.lower(), word))
        at = end
    return "".join(parts), at


def _header(text: str, at: int) -> tuple[str, int]:
    """Kind (lower case) of the entry that may begin with the sign at ``at``, and where its bracket stands (-1: no entry)."""
    brace = at + 1
    while brace < len(text) and (text[brace].isalnum() or text[brace] in "_-"):
        brace += 1
    kind, start = text[at + 1 : brace].lower(), brace
    while start < len(text) and text[start].isspace():
        start += 1
    return kind, start if kind and start < len(text) and text[start] in "{(" else -1


def _end(text: str, start: int) -> int:
    """The place after the entry whose bracket stands at ``start``; one after the text's end where it is not closed."""
    if text[start] == "{":
        return _balanced(text, start)
    stop = text.find("\n)", start)
    return stop + 2 if stop >= 0 else len(text) + 1


def _closed(text: str, start: int, end: int) -> str:
    """What stands between an entry's brackets."""
    return text[start + 1 : end - 1]


def _fields(body: str, kind: str, names: dict[str, str]) -> tuple[str, dict[str, str]]:
    """Key and fields of an entry; names that ``names`` knows are filled in."""
    key, place = "", 0
    if kind != "string":
        comma = body.find(",")
        key, place = (body if comma < 0 else body[:comma]).strip(), len(body) if comma < 0 else comma + 1
    fields: dict[str, str] = {}
    while place < len(body):
        equals = body.find("=", place)
        if equals < 0:
            break
        name = body[place:equals].strip(" \t\r\n,").lower()
        fields[name], place = _value(body, equals + 1, names)
        place += 1
    return key, fields


def scan(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """Entries of a BibTeX text: key, type (lower case) and fields."""
    out, names, at = [], dict(MONTHS), 0
    while (at := text.find("@", at)) >= 0:
        kind, start = _header(text, at)
        if start < 0:
            at += 1
            continue
        at = end = _end(text, start)
        if kind in ("comment", "preamble"):
            continue
        key, fields = _fields(_closed(text, start, end), kind, names)
        if kind == "string":
            names |= fields
        else:
            out.append((key, kind, {k: " ".join(v.split()) for k, v in fields.items()}))
    return out


def read_bib(spark: SparkSession, path: str) -> DataFrame:
    """Entries of BibTeX files of any size; see ``bibsplit``."""
    from .bibsplit import read_split

    return typed(read_split(spark, path))


def parse_texts(files: DataFrame) -> DataFrame:
    """Entries of BibTeX texts (file, text), typed: file, ord and the columns that the lookups take, with all fields in ``raw``."""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(name, i, *entry) for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, entry in enumerate(scan(text or ""))]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([list(r[k].items()) if k == 4 else r[k] for r in rows], t) for k, t in enumerate(kinds)], ["file", "ord", "key", "type", "raw"])

    return typed(files.select("file", "text").mapInArrow(parse, _RAW))


def typed(raw: DataFrame) -> DataFrame:
    """Scanned entries (file, ord, key, type, raw) with the standard columns; missing fields are empty, a missing arXiv id is null."""
    field = lambda name: F.coalesce(F.col("raw")[name], F.lit(""))
    arxiv = T.arxiv_id({n: field(n) for n in ("journal", "eprint", "url", "note", "archiveprefix")})
    venue = F.when(field("booktitle") != "", field("booktitle")).otherwise(field("journal"))
    plain = {n: field(n).alias(n) for n in ("year", "journal", "booktitle", "volume", "pages", "doi", "url")}
    return raw.select("file", "ord", "key", "type", T.strip_latex(field("title")).alias("title"), field("title").alias("title_raw"), field("author").alias("author"), T.strip_latex(field("author")).alias("author_clean"), *plain.values(), arxiv.alias("arxiv_id"), venue.alias("venue"), "raw", F.xxhash64("file", "ord").alias("id"))

"""BibTeX files in ranges against the scanner of whole files."""

import random

import pytest

from quillcheck.sources import bibsplit, bibtex


def entries(text):
    return [(i, *e) for i, e in enumerate(bibtex.scan(text))]


BITS = ["@article{k1,", "@misc{", "@Book (k,", "\n)", "}", "{", "title = {A {B} c},\n", "year = 1999,", ' note = "x {y" z} w",', "@string{j = \"Jo\" # {urnal}}", "@string{k2 = j # \" two\", zz = 3}", "journal = j # k2 # mar,", "@comment{no {x}}", "@preamble{\"p\"}", "\n", "\n", "\n@article", " \n", "@", "@ {", "text", "a@b.c", ", ", "é = {ü}", "@online\n{o,\n", "\\}", "="]


def test_scanner_ends_on_unclosed_brackets():
    assert bibtex.scan("x @misc(a, b = c") == [("a", "misc", {"b": "c"})]
    assert bibtex.scan("x @misc{a, b = {c") == [("a", "misc", {"b": "c"})]


def test_states_follow_from_range_to_range():
    rng = random.Random(1)
    for _ in range(4000):
        lines = "".join(rng.choice(BITS) for _ in range(rng.randint(1, 25))).split("\n")
        ranges, at = [], 0
        while at < len(lines):
            n = rng.randint(1, 3)
            ranges.append("\n".join(lines[at : at + n]) + "\n")
            at += n
        state, open_, found = 0, "", []
        for text in ranges:
            told = bibsplit.summary(text)
            rows = bibsplit.pieces(text, state)
            before, (state, ends) = state, bibsplit.follow(state, told)
            assert bool(rows and rows[0][0] == -1) == bool(before) and (not before or rows[0][2] == ends)
            for _, begins, whole, piece in rows:
                open_ = piece if begins else open_ + piece
                if whole:
                    found.append(open_)
                    open_ = ""
            assert bool(state) == bool(rows and not rows[-1][2])
        if open_:
            found.append(open_)
        whole = "".join(ranges)
        names, out = dict(bibtex.MONTHS), []
        for piece in found:  # one after another, as the whole file is read
            kind, start = bibtex._header(piece, 0)
            if start < 0 or kind in ("comment", "preamble"):
                continue
            key, fields = bibtex._fields(bibtex._closed(piece, start, bibtex._end(piece, start)), kind, names)
            if kind == "string":
                names |= fields
            else:
                out.append((key, kind, {k: " ".join(v.split()) for k, v in fields.items()}))
        assert out == bibtex.scan(whole), ranges


@pytest.mark.parametrize("size", ["37b", "400b", "128m"])
def test_files_in_ranges(spark, tmp_path, size):
    rng = random.Random(size)
    texts = {}
    for k in range(6):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 120)))
        texts[f"odd{k}.bib"] = text
    texts["empty.bib"] = ""
    body = "@string{j = \"Journal\"}\n@STRING{full = j # \" of Things\"}\n"
    for k in range(60):
        body += f"@article{{key{k},\n  title = {{A {{Nested}} title\n   number {k} with @misc{{inside}}}},\n  author = \"One, A. and Two, B.\",\n  journal = {'full' if k % 2 else 'J'},\n  month = mar, year = {1990 + k}\n}}\n\n"
        if k == 30:
            body += "@string{full = {Another}}\n@comment{nothing @misc{x}}\n"
    texts["plain.bib"] = body
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = bibsplit.read_split(spark, f"{tmp_path}/*.bib").collect()
        typed = bibtex.read_bib(spark, f"{tmp_path}/plain.bib").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by = {name: [] for name in texts}
    for r in got:
        by[r.file.rsplit("/", 1)[1]].append((r.ord, r.key, r.type, r.raw))
    for name, text in texts.items():
        assert sorted(by[name], key=lambda r: r[0]) == entries(text), name
    assert len(typed) == 60 and {r.venue for r in typed} == {"Journal of Things", "Journal", "Another"}

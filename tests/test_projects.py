"""TeX files against the bibliographies of their own folders."""

import quillcheck


def test_each_folder_is_a_project(spark, tmp_path):
    for name, keys, text in (("one", "ab", r"\cite{a} \input{part}"), ("two", "ac", r"\cite{a,b}"), ("three", "", r"\cite{z}")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "main.tex").write_text(text)
        if keys:
            (tmp_path / name / "refs.bib").write_text("".join(f"@misc{{{k}, title={{T {k}}}}}\n" for k in keys))
    (tmp_path / "one" / "part.tex").write_text(r"\cite{q}")
    entries = quillcheck.parse_bib(f"{tmp_path}/*/refs.bib", spark)
    got = quillcheck.audit_tex_bib(f"{tmp_path}/*/main.tex", entries, spark, per_folder=True).collect()
    short = lambda f: f[f.index(tmp_path.name) + len(tmp_path.name) + 1 :]
    assert {(short(r.file), r.category, r.key) for r in got} == {("one/refs.bib", "phantom_ref", "q"), ("one/refs.bib", "orphan_entry", "b"), ("two/refs.bib", "phantom_ref", "b"), ("two/refs.bib", "orphan_entry", "c"), ("three", "phantom_ref", "z")}
    whole = quillcheck.audit_tex_bib(f"{tmp_path}/*/main.tex", entries, spark).collect()
    assert {(r.category, r.key) for r in whole} == {("phantom_ref", "z"), ("orphan_entry", "c")}

"""Text functions against tables of inputs and results written from the rules."""

from pyspark.sql import functions as F

from quillcheck.functions import matchers as M
from quillcheck.functions import text as T


def run(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r["x"] for r in rows.select("i", column(F.col("s")).alias("x")).orderBy("i").collect()]


#: Markup and the plain text that the rules ask for, traps included.
LATEX = [
    ("", ""),
    (None, ""),
    ("plain  text\t here\n", "plain text here"),
    ("{A} {{B}} $x$", "A B x"),
    ("\\textbf{bold} \\textit{a {b} c}", "bold a b c"),
    ("\\emph{x y}", "x y"),
    ("\\'{e}\\\"o\\v{s}\\c{c}", "\u00e9\u00f6\u0161\u00e7"),
    ("\\`{a} \\~n \\=a \\.z \\^{u}", "\u00e0 \u00f1 \u0101 \u017c \u00fb"),
    ("\\^{x}", "x\u0302"),  # no composed form
    ("\\u{g}", "g"),  # the breve is no accent command
    ("\\vspace", "\u0161pace"),  # commands that begin like accents
    ("\\varphi", "\u01cerphi"),
    ("\\cite{x}", "i\u0327tex"),
    ("\\v s", "s"),
    ("\\'{\\i}", "'"),
    ("Q\\&A 50\\% \\LaTeX\\ by", "Q&A 50% by"),
    ("\\alpha beta", "beta"),
    ("a\\", "a\\"),
    ("\u00e9t\u00e9", "\u00e9t\u00e9"),
    ("M{\\\"u}ller and G\\\"odel", "M\u00fcller and G\u00f6del"),
]


def test_latex(spark):
    assert run(spark, [s for s, _ in LATEX], T.strip_latex) == [plain for _, plain in LATEX]


def test_surnames(spark):
    authors = ["", "Müller, Hans and B, C", "Ada Lovelace", "{\\'E}mile Zola AND x", ", Jr", "  A  B  and C", "others"]
    assert run(spark, authors, T.first_surname) == ["", "müller", "lovelace", "x", "", "b", "others"]


def test_folding(spark):
    assert run(spark, ["Çédille ı ß ø", "ABC", None], T.fold_accents) == ["cedille i ß ø", "abc", None]


def test_two_digits(spark):
    fractions = sorted({n / d for d in range(1, 41) for n in range(d + 1)})
    rows = spark.createDataFrame([(x,) for x in fractions], "x double").select("x", T.two_digits(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in rows] == [f"{r['x']:.2f}" for r in rows]


def test_arxiv_ids(spark):
    values = ["arXiv:2101.00001v2", "ARXIV hep-th/9901001", "https://arxiv.org/abs/2101.00001", "", "see arXiv: 2101.12345."]
    assert run(spark, values, lambda c: T.arxiv_id({"note": c})) == ["2101.00001v2", "hep-th/9901001", None, None, "2101.12345"]
    assert run(spark, [" 2101.00001x "], lambda c: T.arxiv_id({"eprint": c})) == ["2101.00001x"]


def test_years(spark):
    pairs = [("2017", "2017", "OK"), (" 2017 ", "2018", "WARN"), ("2017", "2019", "WARN"), ("2017", "2020", "FAIL"), ("2017a", "2017", "WARN"), ("", "2017", "WARN"), ("2017", None, "WARN")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r["s"] for r in rows.select("i", M.match_year(F.col("a"), F.col("b"))["status"].alias("s")).orderBy("i").collect()] == [s for *_, s in pairs]


def test_title_bands(spark):
    words = [f"w{i}" for i in range(20)]
    pairs = [(" ".join(words), " ".join(words[:17]), "OK"), (" ".join(words[:10]), " ".join(words[:7]), "WARN"), (" ".join(words[:10]), " ".join(words[:6]), "FAIL"), ("éé", "éé", "FAIL")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r["s"] for r in rows.select("i", M.match_title(F.col("a"), F.col("b"))["status"].alias("s")).orderBy("i").collect()] == [s for *_, s in pairs]


def test_accent_fold_takes_every_document(spark, tmp_path):
    import unicodedata

    from quillcheck.plans.queries import accent_fold

    docs = [(1, "Café déjà vu. Naïve\nrésumé", "en"), (2, "Größe. Über", "de"), (3, "élan", None), (4, "", "en"), (5, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    got = {r["id"]: r["folded"] for r in accent_fold(spark, str(tmp_path)).collect()}
    assert got.keys() == {1, 2, 3, 4, 5} and all(got[i] == fold(t) for i, t, _ in docs if t is not None)

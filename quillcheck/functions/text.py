"""Text functions as column expressions.

Regular expressions spell out what differs between engines: white space is ``[\\p{IsWhite_Space}\\x1c-\\x1f]``, word characters
are ``[\\p{L}\\p{N}_]``, digits ``\\p{Nd}``; ``(?d)`` keeps ``.`` and ``$`` to line feeds, ``(?iu)`` folds all of Unicode.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ACCENTS, ARXIV_FIELDS, ARXIV_FORMS, LATEX_ACCENTS, LATEX_COMMAND, LATEX_ESCAPE, LATEX_TEXT

WS = r"[\p{IsWhite_Space}\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
_MARK = "\ue000"


def spelled(pattern: str) -> str:
    """A pattern with \\s, \\w, \\W and \\d spelled out."""
    inside = pattern.replace(r"[:\s]", rf"[:\p{{IsWhite_Space}}\x1c-\x1f]")
    return inside.replace(r"\s", WS).replace(r"\w", WORD).replace(r"\W", WORD.replace("[", "[^")).replace(r"\d", r"\p{Nd}")


def let(values: dict[str, Column], body) -> Column:
    """``body`` of a struct of values, each of which is worked out once a row, however often the body uses it."""
    bound = F.array(F.named_struct(*(x for k, c in values.items() for x in (F.lit(k), c))))
    return F.get(F.transform(bound, body), F.lit(0))


def filled(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c, F.lit("")) != ""


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed."""
    one = F.regexp_replace(c, f"{WS}+", " ")
    return F.trim(one)


def strip(c: Column) -> Column:
    """White space trimmed at both ends."""
    return F.regexp_replace(c, rf"(?d)\A{WS}+|{WS}+\z", "")


@lru_cache
def _composed() -> tuple[str, str, str, str]:
    """Pairs of an accent command and a letter that have a composed form, each after a mark; these forms; the commands, and their combining marks."""
    pairs, forms = [], []
    for command, mark in ACCENTS.items():
        for code in range(0x41, 0x250):
            form = unicodedata.normalize("NFC", chr(code) + mark)
            if len(form) == 1:
                pairs.append(_MARK + command + chr(code))
                forms.append(form)
    return "".join(pairs), "".join(forms), "".join(ACCENTS), "".join(ACCENTS.values())


def _compose(part: Column) -> Column:
    """A command's letter with its accent, and what follows."""
    pairs, forms, commands, marks = _composed()

    at = F.instr(F.lit(pairs), F.substring(part, 1, 2))
    single = F.substr(F.lit(forms), ((at - 2) / 3).cast("int") + 1, F.lit(1))
    made = F.when(at > 0, single).otherwise(F.concat(F.substring(part, 2, 1), F.translate(F.substring(part, 1, 1), commands, marks)))
    return F.concat(made, F.substr(part, F.lit(3)))


def _accents(c: Column, pattern: str) -> Column:
    parts = F.split(F.regexp_replace(c, pattern, _MARK + "$1$2"), _MARK, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(_compose(p))), "")


def _unmarked(c: Column) -> Column:
    """Plain text of LaTeX markup, its white space left as it is."""
    c = F.coalesce(c, F.lit(""))
    t = F.regexp_replace(c, spelled(LATEX_TEXT), "$1")
    for pattern in LATEX_ACCENTS:
        t = _accents(t, spelled(pattern))
    t = F.regexp_replace(t, spelled(LATEX_ESCAPE), "$1")
    t = F.regexp_replace(t, spelled(LATEX_COMMAND), "")
    marked = F.when(c.contains("\\"), t).otherwise(c)
    return F.translate(marked, "{}$", "")


def strip_latex(c: Column) -> Column:
    """Plain text of LaTeX markup; null gives the empty text."""
    return squeeze(_unmarked(c))


def _base(c: str) -> str:
    """Compatibility decomposition without combining marks, and with a dotted i."""
    return "".join(x for x in unicodedata.normalize("NFKD", c).replace("\u0131", "i") if not unicodedata.combining(x))


#: Hangul syllables decompose by arithmetic: first and last, and the letters that they consist of.
_SYLLABLES = (0xAC00, 0xD7A3)
_JAMO = tuple("".join(map(chr, range(first, first + n))) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


@lru_cache
def _folding() -> tuple[str, str, str, str, str]:
    """What folding does to characters, as the Unicode tables of this Python tell: characters that become one other or (at the end) none, what
    they become; characters that become several, these joined by a mark; and the latter with the Hangul syllables as a class of a pattern.

    A capital sigma is left to the lower-casing of the whole text, which knows where a word ends."""
    one, become, gone, many, several = [], [], [], [], []
    for code in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)):
        if 0x4E00 <= code < 0xA000 or 0x20000 <= code < 0x2F800 or 0x30000 <= code < 0xE0000 or code >= 0xF0000:
            continue  # nothing there decomposes
        c = chr(code)
        base = _base(c)
        if not base:
            gone.append(c)
        elif len(base) > 1:
            many.append(c)
            several.append(base)
        elif (low := base if base == "\u03a3" else base.lower()) != c:
            one.append(c)
            become.append(low)
    ranges, at = [], [*map(ord, many), 0]
    while len(at) > 1:
        stop = next(k for k in range(len(at)) if at[k + 1] != at[k] + 1)
        ranges.append(f"\\x{{{at[0]:x}}}-\\x{{{at[stop]:x}}}")
        at = at[stop + 1 :]
    capitals = [chr(k) for k in range(65, 91)]
    return "".join(capitals + one + gone), "".join(capitals).lower() + "".join(become), "".join(many), _MARK.join(several), "".join(ranges) + f"\\x{{{_SYLLABLES[0]:x}}}-\\x{{{_SYLLABLES[1]:x}}}"


def _syllable(c: Column) -> Column:
    at = F.ascii(c) - _SYLLABLES[0]
    pick = lambda letters, k: F.substr(F.lit(letters), k.cast("int") + 1, F.lit(1))
    last = at % 28
    return F.concat(pick(_JAMO[0], F.floor(at / 588)), pick(_JAMO[1], F.floor(at % 588 / 28)), F.when(last > 0, pick(_JAMO[2], last - 1)).otherwise(""))


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks, lower case, by tables and expressions of the JVM."""
    one, become, many, several, kinds = _folding()

    def expand(piece: Column) -> Column:
        at = F.instr(F.lit(many), piece)
        known = F.when(at > 0, F.get(F.split(F.lit(several), _MARK), at - 1)).otherwise(_syllable(piece))
        return F.when((F.length(piece) == 1) & piece.rlike(f"[{kinds}]"), known).otherwise(piece)

    def fold(v: Column) -> Column:
        c = v["c"]
        pieces = F.regexp_extract_all(c, F.lit(f"[{kinds}]|[^{kinds}]+"), F.lit(0))
        whole = F.when(c.rlike(f"[{kinds}]"), F.array_join(F.transform(pieces, expand), "")).otherwise(c)
        folded = let({"f": F.translate(whole, one, become)}, lambda w: F.when(w["f"].contains("\u03a3"), F.lower(w["f"])).otherwise(w["f"]))
        return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(folded)

    return let({"c": c}, fold)


def tokens(c: Column) -> Column:
    """The set of [a-z0-9]+ tokens of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def title_tokens(c: Column) -> Column:
    """The tokens of a title without its LaTeX markup; white space parts tokens, so it need not be collapsed."""
    return tokens(_unmarked(c))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets; 0 where either is empty."""
    sizes = {"a": F.size(a), "b": F.size(b), "both": F.size(F.array_intersect(a, b))}
    return let(sizes, lambda n: F.when((n["a"] == 0) | (n["b"] == 0), 0.0).otherwise(n["both"] / (n["a"] + n["b"] - n["both"])))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts, a row of bits for each character of one of them."""

    def length(x: str, y: str) -> int:
        if len(x) > len(y):
            x, y = y, x
        places: dict[str, int] = {}
        for i, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << i
        every = (1 << len(x)) - 1
        row = every  # a zero bit where the subsequence grows by that character
        for c in y:
            met = row & places.get(c, 0)
            row = (row + met | row - met) & every
        return len(x) - row.bit_count()

    @F.arrow_udf("int")
    def count(lefts, rights):
        import pyarrow as pa

        return pa.array([None if x is None or y is None else length(x, y) for x, y in zip(lefts.to_pylist(), rights.to_pylist())], pa.int32())

    return count(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Token-set ratio (0 to 1) of two titles: the best agreement, in insertions and deletions, among what their token sets share and what they
    share followed by the rest of each. 1 where one set holds the other, 0 where either has no token; tokens are parted by white space, and case counts."""
    pieces = lambda c: F.array_distinct(F.filter(F.split(strip_latex(c), f"{WS}+"), lambda t: t != ""))
    x, y = pieces(a), pieces(b)
    line = lambda tokens: F.array_join(F.array_sort(tokens), " ")
    rest_x, rest_y = line(F.array_except(x, y)), line(F.array_except(y, x))
    both = line(F.array_intersect(x, y))
    common = common_subsequence(rest_x, rest_y)
    whole = lambda distance, total: F.when(total > 0, 1 - distance / total).otherwise(1.0)
    m, n, k = (F.length(t).cast("double") for t in (rest_x, rest_y, both))
    gap = F.when(k > 0, 1.0).otherwise(0.0)
    full = whole(m + n - 2 * common, 2 * (k + gap) + m + n)
    shared = lambda r: F.when(k > 0, whole(gap + r, 2 * k + gap + r)).otherwise(0.0)
    ratio = F.when((k > 0) & ((m == 0) | (n == 0)), 1.0).otherwise(F.greatest(full, shared(m), shared(n)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(ratio)


def title_similarity(a: Column, b: Column, fuzzy: bool = False) -> Column:
    """Similarity of two titles: Jaccard of their token sets, or with ``fuzzy`` the token-set ratio."""
    if fuzzy:
        return token_set_ratio(a, b)
    return let({"a": title_tokens(a), "b": title_tokens(b)}, lambda s: jaccard(s["a"], s["b"]))


#: Fractions whose two-digit form rounds down, as their binary value or the even digit says.
_DOWN = [1 / 8, 5 / 8, 3 / 40, 7 / 40, 17 / 40, 19 / 40, 23 / 40, 29 / 40, 33 / 40, 39 / 40]


def two_digits(x: Column) -> Column:
    """A similarity with two decimals, rounded as its exact value says."""
    return F.format_string("%.2f", F.when(x.isin(_DOWN), x - 1e-6).otherwise(x))


def _last(words: Column) -> Column:
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))


def first_surname(author: Column) -> Column:
    """Surname of the first author of a field, lower case; empty where there is none."""
    first = F.element_at(F.split(strip_latex(author), f"{WS}+and{WS}+", 2), 1)
    name = F.substring_index(first, ",", 1)
    return F.lower(_last(F.split(strip(name), f"{WS}+")))


def record_surname(authors: Column) -> Column:
    """Surname of a record's first author, lower case; empty where there is none."""
    first = F.coalesce(F.get(authors, F.lit(0)), F.lit(""))
    return F.lower(_last(F.split(strip(first), f"{WS}+")))


def count_authors(author: Column) -> Column:
    return F.size(F.split(strip_latex(author), f"{WS}+and{WS}+", -1))


def arxiv_id(fields: dict[str, Column]) -> Column:
    """The first arXiv id in the fields, or an eprint that starts like one; else null."""
    found = []
    for name in ARXIV_FIELDS:
        value = F.coalesce(fields.get(name, F.lit("")), F.lit(""))
        found += [F.nullif(F.regexp_extract(value, "(?iu)" + spelled(form), 1), F.lit("")) for form in ARXIV_FORMS]
    eprint = strip(F.coalesce(fields.get("eprint", F.lit("")), F.lit("")))
    found.append(F.when(eprint.rlike(r"^\p{Nd}{4}\.\p{Nd}{4,5}"), eprint))
    return F.coalesce(*found)


def without_acronym_digits(title: Column) -> Column:
    """Digits dropped from words of capitals and digits, as another form to search for."""
    edge = r"(?<![\p{L}\p{N}_])"
    return F.regexp_replace(title, rf"({edge}[A-Z]+)(\p{{Nd}}+)(?![\p{{L}}\p{{N}}_])", "$1")


def catalog_name(c: Column) -> Column:
    """An author's name without a trailing number of four digits."""
    return strip(F.regexp_replace(c, rf"(?d){WS}+\p{{Nd}}{{4}}$", ""))


def catalog_title(c: Column) -> Column:
    return F.rtrim(c, F.lit("."))


def bare_doi(c: Column) -> Column:
    return F.regexp_replace(c, r"^https://doi\.org/", "")


def full_name(given: Column, family: Column) -> Column:
    return strip(F.concat_ws(" ", F.coalesce(given, F.lit("")), F.coalesce(family, F.lit(""))))


def first_filled(values: Column) -> Column:
    """The first non-empty value of an array, else null."""
    return F.get(F.filter(values, lambda x: filled(x)), F.lit(0))


def bib_key(authors: Column, year: Column, index: Column) -> Column:
    """Key of a resolved reference: surname, year and number."""
    name = F.coalesce(F.get(authors, F.lit(0)), F.lit(""))
    surname = F.when(strip(name) == "", F.lit("unknown")).otherwise(record_surname(authors))
    surname = F.when(F.coalesce(F.size(authors), F.lit(0)) <= 0, F.lit("ref")).otherwise(F.regexp_replace(surname, "[^a-z]", ""))
    return F.concat(surname, F.when(filled(year), year).otherwise("xxxx"), F.lit("_"), index.cast("string"))


def bib_entry(key: Column, title: Column, authors: Column, year: Column, venue: Column, doi: Column, arxiv: Column) -> Column:
    """A resolved reference as BibTeX."""
    names = F.array_join(F.coalesce(authors, F.array().cast("array<string>")), " and ")
    line = lambda name, c: F.when(filled(c), F.concat(F.lit(f"  {name:<9} = {{"), c, F.lit("},")))
    return F.concat_ws("\n", F.concat(F.lit("@article{"), key, F.lit(",")), line("title", title), line("author", names), line("year", year), line("journal", venue), line("doi", doi), line("eprint", arxiv), F.when(filled(arxiv), F.lit("  archiveprefix = {arXiv},")), F.lit("}"))

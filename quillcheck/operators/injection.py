"""Scan of documents for instructions aimed at automated reviewers: text, layout, annotations and metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.fixed import INJECTIONS, INVISIBLE
from ..functions.lineage import cut

AROUND = 40
METADATA = ("title", "author", "subject", "keywords", "creator", "producer")


def regex(pattern: str) -> str:
    return "(?iu)" + T.spelled(pattern)


#: For each pattern, words of which any match has one: a cheap look for them comes before the pattern.
_WORDS = (
    ("previous",), ("disregard",), ("forget",), ("reviewer",), ("reviewer",), ("must",), ("role",), ("score", "rating", "grade"), ("score", "10"), ("accept",), ("recommend",),
    ("weakness", "flaw", "issue", "problem", "limitation"), ("section",), ("weakness",), ("prompt", "instruction", "guidelines"), ("prompt", "instruction", "guidelines"),
    ("json", "xml", "markdown", "following"), ("begin",), ("dan", "anything", "developer", "unrestricted"), ("[system]", "[inst]", "<<sys>>", "<|im_start|>", "<|system|>"),
    ("excellent", "great", "strong", "outstanding"), ("important", "note", "instruction"),
)


def folded(c: Column) -> Column:
    """Lower case, with the four other characters that match ASCII letters where case is ignored."""
    return F.lower(F.translate(c, "\u0130\u0131\u017f\u212a", "iisk"))


def _may(low: Column, number: int) -> Column:
    """Whether pattern ``number`` (from 0) may occur in a text, by its folded form."""
    out = F.lit(False)
    for word in _WORDS[number]:
        out = out | low.contains(word)
    return out


def pattern_counts(c: Column, low: Column | None = None) -> list[Column]:
    """How often each pattern occurs, as columns p01, p02, ...; ``low`` is ``folded(c)``, where it is a column already."""
    low = folded(c) if low is None else low
    return [F.when(_may(low, k - 1), F.regexp_count(c, F.lit(regex(p)))).otherwise(F.when(c.isNotNull(), 0)).cast("long").alias(f"p{k:02d}") for k, (p, _, _) in enumerate(INJECTIONS, 1)]


def any_pattern(c: Column, low: Column | None = None) -> Column:
    low = folded(c) if low is None else low
    out = F.lit(False)
    for k, (p, _, _) in enumerate(INJECTIONS):
        out = out | _may(low, k) & c.rlike(regex(p))
    return out


_MATCHES = "array<struct<nth:int,snippet:string>>"


def _places(c: Column, pattern: Column) -> Column:
    """The matches of one pattern with their surroundings."""

    def cut(v: Column) -> Column:
        # lengths of the pieces around matches and of the matches give every start, by running sums
        def step(acc: Column, i: Column) -> Column:
            start = acc["end"] + F.length(v["parts"][i])
            low = F.greatest(start - AROUND, F.lit(0))
            stop = start + F.length(v["every"][i])
            snippet = T.strip(F.substr(v["c"], low + 1, stop + AROUND - low))
            return F.struct(stop.alias("end"), F.concat(acc["found"], F.array(F.struct((i + 1).alias("nth"), snippet.alias("snippet")))).alias("found"))

        none = F.struct(F.lit(0).alias("end"), F.array().cast(_MATCHES).alias("found"))
        return F.aggregate(F.sequence(F.lit(0), F.size(v["every"]) - 1), none, step, lambda acc: acc["found"])

    return T.let({"c": c, "every": F.regexp_extract_all(c, pattern, F.lit(0)), "parts": F.split(c, pattern, -1)}, cut)


def matches(rows: DataFrame, text: str) -> DataFrame:
    """A row for each match of each pattern in a text column: the other columns, pattern, nth, severity, description and snippet.

    A match's place follows from the lengths of the pieces around the matches, so no Python is needed. Which patterns occur is found first; the
    places are worked out for these only, in an expression that stands in the plan once.
    """
    low = rows.where(F.col(text) != "").withColumn("_low", folded(F.col(text)))
    which = F.array_compact(F.array(*(F.when(_may(F.col("_low"), k) & F.col(text).rlike(regex(p)), k + 1) for k, (p, _, _) in enumerate(INJECTIONS))))
    kept = [c for c in rows.columns if c != text]
    each = low.select(*kept, text, F.explode(which).alias("pattern"))
    own = lambda k: F.element_at(F.array(*(F.lit(regex(x[k]) if k == 0 else x[k]) for x in INJECTIONS)), F.col("pattern"))
    each = each.select(*kept, "pattern", F.explode(_places(F.col(text), own(0))).alias("m"))
    return each.select(*kept, "pattern", "m.nth", own(2).alias("severity"), own(1).alias("description"), "m.snippet")


def _texts(rows: DataFrame, text: Column, step: int, item: Column, location: Column, page: Column | None = None) -> DataFrame:
    """Texts to look for patterns in: doc, step, page, item, location, text."""
    return rows.select("doc", F.lit(step).alias("step"), (F.col("page") if page is None else page).cast("int").alias("page"), item.cast("int").alias("item"), location.alias("location"), text.alias("text"))


def pattern_findings(texts: DataFrame) -> DataFrame:
    """Pattern findings of texts as ``_texts`` gives them: doc, seq, severity, category, description, page, text_snippet, location."""
    each = matches(texts, "text")
    category = F.when(F.col("location").startswith("page"), "visible_injection").otherwise("metadata_injection")
    order = F.struct("step", F.coalesce("page", F.lit(0)).alias("page"), "item", F.lit(1).alias("part"), "pattern", "nth")
    return each.select("doc", order.alias("seq"), "severity", category.alias("category"), "description", "page", F.col("snippet").alias("text_snippet"), "location")


def text_findings(rows: DataFrame, text: str, location: Column, page: Column, seq: int) -> DataFrame:
    """Pattern findings of a text column; see ``pattern_findings``."""
    return pattern_findings(_texts(rows, F.col(text), seq, F.lit(0), location, page))


def invisible_runs(c: Column) -> Column:
    """Runs of five or more characters that do not show."""
    return F.regexp_extract_all(c, F.lit(f"{INVISIBLE}{{5,}}"), F.lit(0))


def escaped(run: Column) -> Column:
    """A run as a quoted literal with escapes, at most 100 characters of it."""
    def one(ch: Column) -> Column:
        n = F.ascii(ch).cast("long")
        digits = F.lower(F.hex(n))
        return F.when(n < 256, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0"))).when(n == 0x34F, ch).when(n < 65536, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0"))).otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))

    body = F.array_join(F.transform(F.filter(F.split(run, ""), lambda x: x != ""), one), "")
    return F.substring(F.concat(F.lit("'"), body, F.lit("'")), 1, 100)


def invisible_findings(pages: DataFrame, seq: int = 2) -> DataFrame:
    each = pages.select("doc", "page", F.posexplode(invisible_runs(F.col("text"))).alias("item", "run"))
    order = F.struct(F.lit(seq).alias("step"), F.coalesce("page", F.lit(0)).alias("page"), F.col("item"), F.lit(0).alias("part"), F.lit(0).alias("pattern"), F.lit(0).alias("nth"))
    description = F.concat(F.lit("Cluster of "), F.length("run").cast("string"), F.lit(" invisible Unicode characters -- may carry hidden payload"))
    where = F.when(F.coalesce("page", F.lit(0)) != 0, F.concat(F.lit("page "), F.col("page").cast("string"))).otherwise("unknown")
    return each.select("doc", order.alias("seq"), F.lit("WARN").alias("severity"), F.lit("invisible_unicode").alias("category"), description.alias("description"), "page", escaped(F.col("run")).alias("text_snippet"), where.alias("location"))


def hidden_reason(size: Column, color: Column) -> Column:
    """Why a span does not show, or null: micro font before white text."""
    part = lambda k: F.shiftright(color, k).bitwiseAND(F.lit(255))
    white = (part(16) > 250) & (part(8) > 250) & (part(0) > 250)
    said = F.concat(F.lit("white text (RGB="), part(16).cast("string"), F.lit(","), part(8).cast("string"), F.lit(","), part(0).cast("string"), F.lit(")"))
    return F.when((size > 0) & (size < 1.0), F.concat(F.lit("micro font ("), F.format_string("%.2f", size), F.lit("pt)"))).when(white, said)


def spans(pages: DataFrame) -> DataFrame:
    """Text spans of pages with blocks: doc, page, item (place on the page), text, size, color."""
    b = pages.select("doc", "page", F.posexplode("blocks").alias("b", "block")).where("block.type = 0")
    lines = b.select("doc", "page", "b", F.posexplode("block.lines").alias("l", "line"))
    own = lines.select("doc", "page", "b", "l", F.posexplode("line.spans").alias("s", "span"))
    item = F.col("b") * 1_000_000 + F.col("l") * 1000 + F.col("s")
    return own.select("doc", "page", item.alias("item"), T.strip(F.coalesce("span.text", F.lit(""))).alias("text"), F.coalesce("span.size", F.lit(12.0)).alias("size"), F.coalesce("span.color", F.lit(0)).alias("color"))


def hidden_spans(pages: DataFrame) -> DataFrame:
    """Spans that do not show: doc, page, item, text, reason, severity."""
    s = spans(pages).where("length(text) >= 3").withColumn("reason", hidden_reason(F.col("size"), F.col("color"))).where("reason is not null")
    return s.select("doc", "page", "item", "text", "reason", F.when(any_pattern(F.col("text")), "FAIL").otherwise("WARN").alias("severity"))


def _on_page(*rest: Column | str) -> Column:
    return F.concat(F.lit("page "), F.col("page").cast("string"), *(F.lit(x) if isinstance(x, str) else x for x in rest))


def _own(step: int) -> Column:
    """The place of a finding that is no pattern's."""
    return F.struct(F.lit(step).alias("step"), F.coalesce("page", F.lit(0)).alias("page"), F.col("item").cast("int").alias("item"), F.lit(0).alias("part"), F.lit(0).alias("pattern"), F.lit(0).alias("nth"))


def hidden_texts(pages: DataFrame, seq: int = 3) -> tuple[DataFrame, DataFrame]:
    """Findings of hidden spans, and their texts for the patterns."""
    h = hidden_spans(pages)
    own = h.select("doc", _own(seq).alias("seq"), "severity", F.lit("hidden_text").alias("category"), F.concat(F.lit("Hidden text detected ("), "reason", F.lit("): may contain adversarial instructions")).alias("description"), "page", F.substring("text", 1, 200).alias("text_snippet"), _on_page(", ", F.col("reason")).alias("location"))
    return own, _texts(h.where("severity = 'FAIL'"), F.col("text"), seq, F.col("item"), _on_page(" (hidden: ", F.col("reason"), ")"))


def _outside(block: Column) -> Column:
    return (block["x0"] > F.col("width") + 50) | (block["x1"] < -50) | (block["y0"] > F.col("height") + 50) | (block["y1"] < -50)


def suspicious(pages: DataFrame) -> DataFrame:
    """Pages with only those blocks that lie off the page or have a span that does not show, written once, so that files are read once for all
    that looks for these. Places count the blocks that are left."""
    hides = lambda block: F.exists(block["lines"], lambda line: F.exists(line["spans"], lambda s: hidden_reason(F.coalesce(s["size"], F.lit(12.0)), F.coalesce(s["color"], F.lit(0))).isNotNull()))
    left = pages.withColumn("blocks", F.filter("blocks", lambda b: F.coalesce(_outside(b), F.lit(False)) | F.coalesce(hides(b), F.lit(False))))
    return cut(left.select("doc", "page", "width", "height", "blocks").where("size(blocks) > 0"))


def offpage_blocks(pages: DataFrame) -> DataFrame:
    """Text blocks more than 50 units outside the page: doc, page, item, text, x0, y0."""
    b = pages.select("doc", "page", "width", "height", F.posexplode("blocks").alias("item", "block")).where("block.type = 0")
    outside = _outside(F.col("block"))
    words = F.flatten(F.transform("block.lines", lambda line: F.transform(line["spans"], lambda s: F.coalesce(s["text"], F.lit("")))))
    out = b.where(outside).select("doc", "page", "item", F.array_join(words, "").alias("text"), "block.x0", "block.y0")
    return out.where(F.length(T.strip(F.col("text"))) > 10)


def offpage_texts(pages: DataFrame, seq: int = 5) -> tuple[DataFrame, DataFrame]:
    """Findings of blocks off the page, and their texts for the patterns."""
    o = offpage_blocks(pages)
    where = _on_page(", off-page at (", F.format_string("%.0f", "x0"), ",", F.format_string("%.0f", "y0"), ")")
    own = o.select("doc", _own(seq).alias("seq"), F.lit("FAIL").alias("severity"), F.lit("offpage_text").alias("category"), F.lit("Text positioned outside visible page area -- likely hidden adversarial content").alias("description"), "page", F.substring(T.strip(F.col("text")), 1, 200).alias("text_snippet"), where.alias("location"))
    return own, _texts(o, F.col("text"), seq, F.col("item"), _on_page(" (off-page)"))


def annotation_texts(pages: DataFrame, seq: int = 4) -> DataFrame:
    a = pages.select("doc", "page", F.posexplode("annotations").alias("item", "text"))
    return _texts(a, F.col("text"), seq, F.col("item"), _on_page(", annotation"))


def annotation_findings(pages: DataFrame) -> DataFrame:
    """Pattern findings of annotations."""
    return pattern_findings(annotation_texts(pages))


def metadata_fields(meta: DataFrame) -> DataFrame:
    """Metadata as rows: doc, place, field, value."""
    fields = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(k).alias("field"), F.col(k).alias("value")) for i, k in enumerate(METADATA)))
    return meta.select("doc", F.explode(fields).alias("f")).select("doc", "f.*").where("length(value) > 50")


def metadata_texts(meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Warnings on very long metadata fields, and the texts of long ones for the patterns."""
    m = metadata_fields(meta)
    none = F.lit(None).cast("int")
    where = F.concat(F.lit("metadata."), F.col("field"))
    order = F.struct(F.lit(0).alias("step"), F.lit(0).alias("page"), F.col("place").alias("item"), F.lit(2).alias("part"), F.lit(0).alias("pattern"), F.lit(0).alias("nth"))
    said = F.concat(F.lit("Unusually long metadata field '"), "field", F.lit("' ("), F.length("value").cast("string"), F.lit(" chars) -- may contain hidden instructions"))
    long = m.where("length(value) > 500").select("doc", order.alias("seq"), F.lit("WARN").alias("severity"), F.lit("metadata_injection").alias("category"), said.alias("description"), none.alias("page"), F.substring("value", 1, 200).alias("text_snippet"), where.alias("location"))
    return long, _texts(m, F.col("value"), 0, F.col("place"), where, none)


def metadata_findings(meta: DataFrame) -> DataFrame:
    """Findings in long metadata fields, and a warning for very long ones."""
    long, texts = metadata_texts(meta)
    return pattern_findings(texts).unionByName(long)


def scan(pages: DataFrame, meta: DataFrame | None = None, visible: bool = True, hidden: bool = True, metadata: bool = True) -> DataFrame:
    """All findings of documents, in order and without repeats: doc, seq, severity, category, description, page, text_snippet, location.

    Of findings alike in description, page and the first 50 characters of the snippet, the first stays.
    """
    texts, parts = [], []
    if metadata and meta is not None:
        long, own = metadata_texts(meta)
        texts, parts = [own], [long]
    if visible:
        texts.append(_texts(pages, F.col("text"), 1, F.lit(0), _on_page()))
        parts.append(invisible_findings(pages))
    if hidden:
        for own, deep in (hidden_texts(pages), offpage_texts(pages)):
            parts.append(own)
            texts.append(deep)
        texts.append(annotation_texts(pages))
    every = invisible_findings(pages).limit(0)  # where nothing is asked for
    if texts:  # the patterns stand in the plan once, over all texts
        every = pattern_findings(reduce(DataFrame.unionByName, texts))
    every = reduce(DataFrame.unionByName, parts, every)
    # seq is by page first within the page steps
    seq = F.struct((F.col("seq.step") > 0).cast("int").alias("a"), F.col("seq.page").alias("b"), F.col("seq.step").alias("c"), F.col("seq.item").alias("d"), F.col("seq.part").alias("e"), F.col("seq.pattern").alias("f"), F.col("seq.nth").alias("g"))
    every = every.withColumn("seq", seq)
    same = Window.partitionBy("doc", "description", "page", F.substring("text_snippet", 1, 50)).orderBy("seq")
    kept = every.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth")
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("seq")) - 1)


def verdicts(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document of ``docs`` (doc): verdict FAIL, WARN or CLEAN, fail_count, warn_count."""
    counts = findings.groupBy("doc").agg(F.count_if(F.col("severity") == "FAIL").alias("fail_count"), F.count_if(F.col("severity") == "WARN").alias("warn_count"))
    out = docs.select("doc").join(counts, "doc", "left").na.fill(0, ["fail_count", "warn_count"])
    return out.select("doc", F.when(F.col("fail_count") > 0, "FAIL").when(F.col("warn_count") > 0, "WARN").otherwise("CLEAN").alias("verdict"), "fail_count", "warn_count")


def summary(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Per document of ``pages``: verdict, fail_count, warn_count, pages_scanned and hidden_text_blocks (repeats counted)."""
    size = pages.groupBy("doc").agg(F.count("*").alias("pages_scanned"))
    hidden = hidden_spans(pages).groupBy("doc").agg(F.count("*").alias("hidden_text_blocks"))
    return verdicts(findings, size).join(size, "doc").join(hidden, "doc", "left").na.fill(0, ["hidden_text_blocks"])

"""PDF files as tables: spans, pages with their layout, and metadata.

Files are read as rows of Spark's ``binaryFile`` source. A small reader of our own turns a file into its spans, page by page, so a task
holds one file and one page's spans; lines, blocks and page texts are then built from the spans of all files by windows and
groups. Damaged files give what can be read of them; a file in which nothing can be read has no pages, and an encrypted
one neither (``error`` says so).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPANS = "doc string, page int, width double, height double, annotations array<string>, seq int, text string, x0 double, y0 double, x1 double, y1 double, base double, size double, color int"
#: What ``pages`` gives, for tables of pages that come from elsewhere.
PAGES = "doc string, page int, text string, width double, height double, blocks array<struct<type:int,x0:double,y0:double,x1:double,y1:double,lines:array<struct<spans:array<struct<text:string,size:double,color:int>>>>>>, annotations array<string>"
META = ("title", "author", "subject", "keywords", "creator", "producer")
METADATA = "doc string, " + ", ".join(f"{k} string" for k in META)
#: Spans of a batch that a task sends at once.
SENT = 5000
#: Gaps, in sizes of the font: between words; between lines of a block, and between columns of a line.
WORD_GAP, LINE_GAP, COLUMN_GAP = 0.18, 2.2, 4.0


def files(spark: SparkSession, path: str) -> DataFrame:
    """PDF files: doc, content."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content")


def _rows(batches: Iterator[pa.RecordBatch], rows_of, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for batch in batches:
        for k in range(batch.num_rows):
            for row in rows_of(batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""):
                held.append(row)
                if len(held) >= SENT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                    held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def read_spans(content: DataFrame) -> DataFrame:
    """Spans of all pages of PDF contents (doc, content), in the order in which they are drawn. A page without text has one row
    with a null ``seq``."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in SPANS.split(", "))])

    def rows_of(doc: str, data: bytes) -> Iterator[tuple]:
        from .pdfobjects import File
        from .pdftext import Page

        pdf = File(data)
        if "Encrypt" in pdf.trailer:
            return
        for number, node in enumerate(pdf.pages(), 1):
            page = Page(pdf, node)
            head, some = (doc, number, page.width, page.height, page.annotations()), False
            try:
                for seq, s in enumerate(page.spans()):
                    some = True
                    yield (*head, seq, *(s[k] for k in ("text", "x0", "y0", "x1", "y1", "base", "size", "color")))
            except (ValueError, TypeError, IndexError, KeyError, AttributeError, OverflowError, RecursionError):
                pass  # what was drawn before the damage counts
            if not some:
                yield (*head, *(None,) * 9)

    return content.select("doc", "content").mapInArrow(lambda batches: _rows(batches, rows_of, schema), SPANS)


def pages(spans: DataFrame) -> DataFrame:
    """Pages (doc, page, text, width, height, blocks, annotations) of spans.

    Spans of one base line follow each other in a line, with a space where there is a gap; a line ends where the base line changes or a column's
    gap is passed. Lines below each other whose boxes overlap are a block. A page's text is its lines, each ended by a line feed."""
    head = ("width", "height", "annotations")
    kept = [F.first(c).alias(c) for c in head]
    page = Window.partitionBy("doc", "page").orderBy("seq")
    before = lambda c: F.lag(c).over(page)
    size = F.greatest(F.least("size", before("size")), F.lit(0.01))
    new = before("seq").isNull() | (F.abs(F.col("base") - before("base")) > 0.5 * size) | (F.abs(F.col("x0") - before("x1")) > COLUMN_GAP * size)
    apart = (F.col("x0") - before("x1") > WORD_GAP * size) & ~before("text").endswith(" ") & ~F.col("text").startswith(" ")
    s = spans.withColumn("new", new).withColumn("apart", F.coalesce(apart & ~new, F.lit(False)))
    s = s.withColumn("line", F.sum(F.col("new").cast("int")).over(page))
    piece = F.when(F.col("seq").isNotNull(), F.struct("seq", F.concat(F.when(F.col("apart"), " ").otherwise(""), "text").alias("text"), "size", "color"))
    boxes = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    lines = s.groupBy("doc", "page", "line").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("size").alias("size"), F.min("base").alias("base"), *boxes, *kept)
    down = Window.partitionBy("doc", "page").orderBy("line")
    above = lambda c: F.lag(c).over(down)
    step = F.col("base") - above("base")
    follows = (step > 0) & (step <= LINE_GAP * F.greatest("size", F.lit(0.01))) & (F.col("x0") <= above("x1")) & (F.col("x1") >= above("x0"))
    lines = lines.withColumn("block", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(down))
    spans_of = F.transform("pieces", lambda p: F.struct(p["text"].alias("text"), p["size"].alias("size"), p["color"].alias("color")))
    said = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    row = F.when(F.size("pieces") > 0, F.struct("line", said.alias("text"), F.struct(spans_of.alias("spans")).alias("line_of")))
    blocks = lines.groupBy("doc", "page", "block").agg(F.array_sort(F.collect_list(row)).alias("rows"), *boxes, *kept)
    block = F.struct(F.lit(0).alias("type"), "x0", "y0", "x1", "y1", F.transform("rows", lambda r: r["line_of"]).alias("lines"))
    text = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    each = F.when(F.size("rows") > 0, F.struct("block", block.alias("b"), text.alias("text")))
    full = blocks.groupBy("doc", "page").agg(F.array_sort(F.collect_list(each)).alias("bs"), *kept)
    whole = F.when(F.size("bs") > 0, F.concat(F.array_join(F.transform("bs", lambda b: b["text"]), "\n"), F.lit("\n"))).otherwise("")
    return full.select("doc", "page", whole.alias("text"), "width", "height", F.transform("bs", lambda b: b["b"]).alias("blocks"), "annotations")


def metadata(content: DataFrame) -> DataFrame:
    """Metadata of PDF contents (doc, content): title, author, subject, keywords, creator, producer (empty where they are missing), pages, and
    error (null, ``encrypted`` or ``no pages``)."""
    schema = pa.schema([("doc", pa.string()), *((k, pa.string()) for k in META), ("pages", pa.int32()), ("error", pa.string())])

    def rows_of(doc: str, data: bytes) -> Iterator[tuple]:
        from .pdfobjects import File
        from .pdftext import text_of

        pdf = File(data)
        info, n = pdf.get(pdf.trailer.get("Info")), sum(1 for _ in pdf.pages())
        locked = "Encrypt" in pdf.trailer
        said = [text_of(pdf, info.get(k.capitalize())) if isinstance(info, dict) and not locked else "" for k in META]
        yield (doc, *said, n, "encrypted" if locked else None if n else "no pages")

    return content.select("doc", "content").mapInArrow(lambda batches: _rows(batches, rows_of, schema), METADATA + ", pages int, error string")

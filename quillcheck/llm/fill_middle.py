"""Fill-in-middle transformation by relational units.

A text is cut into units, and prefix, middle and suffix end between units. Where they end is worked out in tables:

1. Units: ``posexplode`` of the matches of the unit pattern; only identity, position and lengths go on, texts stay where they are. A match of
   ``CODE_POINTS`` holds up to ``GROUP`` units of one code point each, so there is a row for so many units; of other patterns
   each match is one unit, and what the pattern leaves out is a unit for each code point.
2. Running sums of units and of code points over a document's matches give where each match ends.
3. Cut requests: two unit ordinals for each document, drawn from a hash of its id. They are joined to the match that holds
   the unit (by identity and ordinal), which gives their offsets in code points.
4. The offsets of a document are aggregated into one row and joined to its text; ``substring`` cuts.

Rows of one id and one text are one document to the tables (their rows of units are merged before they move), so repeated rows and
rows of one id with different texts get the results that each would get alone. A null text counts as empty and stays plain; a null
id draws as the empty id. An empty table gives an empty result; other columns are left alone, and names that the operator adds
must be free. Texts of any length are taken whole: a document has one row of units for every ``GROUP`` code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free, table

#: Code points in a match of ``CODE_POINTS``.
GROUP = 1024
#: Of 100 documents, those that are transformed, and of 100 of these, those whose suffix comes first.
RATE, SUFFIX_FIRST = 90, 20
# What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Units:
    """A pattern whose matches are units; with ``per`` over 1, a match holds one unit for each code point, ``per`` in all but the last."""

    pattern: str
    per: int = 1

    def matches(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern if self.per > 1 else f"{self.pattern}|(?s:.)"), F.lit(0))

    def count(self, match: Column) -> Column:
        return (F.length(match) if self.per > 1 else F.lit(1)).cast("long")


CODE_POINTS = Units(f"(?s).{{1,{GROUP}}}", GROUP)
WORDS, LINES = Units(r"\S+\s*"), Units(r"[^\n]*\n")


def _draw(name: Column, seed: int, group: int) -> Column:
    """One of the unsigned 8-digit groups of the hash of seed and id."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 8 * group - 7, 8), 16, 10).cast("long")


def cuts(docs: DataFrame, key: str, text: str, units: Units = CODE_POINTS, seed: int = 1) -> DataFrame:
    """For each distinct (key, text) with a non-empty text: identity, n (units), and the offsets first and second of its cuts."""
    name, body = _name(key), F.coalesce(text, F.lit(""))
    each = docs.select(_identity(name, body).alias("identity"), name.alias("name"), F.posexplode(units.matches(body)).alias("pos", "match"))
    each = each.select("identity", "name", "pos", units.count(F.col("match")).alias("units"), F.length("match").cast("long").alias("chars"))
    each = each.groupBy("identity", "name", "pos").agg(F.max("units").alias("units"), F.max("chars").alias("chars"))
    order = Window.partitionBy("identity").orderBy("pos")
    each = each.withColumn("stop", F.sum("chars").over(order)).withColumn("last", F.sum("units").over(order))
    n = F.max("last").alias("n")
    asked = each.groupBy("identity").agg(n, F.max("name").alias("name"))
    asked = asked.select("identity", "n", F.explode(F.array(*(_draw(F.col("name"), seed, k) % (F.col("n") + 1) for k in (1, 2)))).alias("ordinal"))
    # the unit that a piece ends with, counted from 1; at 0 it ends before all units
    asked = asked.withColumn("pos", F.expr(f"cast((ordinal - 1) div {units.per} as int)"))
    inside = (F.col("ordinal") - 1) % units.per + 1 if units.per > 1 else F.col("chars")
    found = asked.alias("a").join(each.select("identity", "pos", "chars", "stop").alias("e"), (F.col("a.identity") == F.col("e.identity")) & (F.col("a.pos") == F.col("e.pos")) & (F.col("ordinal") > 0), "left")
    offset = F.coalesce(F.col("stop") - F.col("chars") + inside, F.lit(0).cast("long"))
    return found.select("a.identity", "n", offset.alias("offset")).groupBy("identity").agg(F.max("n").alias("n"), F.min("offset").alias("first"), F.max("offset").alias("second"))


def _name(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def _identity(name: Column, body: Column) -> Column:
    return F.unhex(F.md5(F.concat(name, F.lit(":"), body)))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", units: Units = CODE_POINTS, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    Texts that hold one of the marks stay plain, so that every output can be taken apart again (``restored``)."""
    free(docs, *ADDED, "_identity", "_n", "_first", "_second")
    name, body = _name(key), F.coalesce(text, F.lit(""))
    found = cuts(docs.select(key, text), key, text, units, seed).select(F.col("identity").alias("_identity"), F.col("n").alias("_n"), F.col("first").alias("_first"), F.col("second").alias("_second"))
    rows = docs.withColumn("_identity", _identity(name, body)).join(found, "_identity", "left")
    marked = body.contains(PREFIX) | body.contains(SUFFIX) | body.contains(MIDDLE)
    form = F.when((body == "") | marked | (_draw(name, seed, 3) % 100 >= rate), "plain").when(_draw(name, seed, 4) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("n", F.coalesce("_n", F.lit(0).cast("long"))).withColumn("form", form)
    cut = F.col("form") != "plain"
    first, second = F.col("_first").cast("int"), F.col("_second").cast("int")
    prefix, middle, suffix = body.substr(F.lit(1), first), body.substr(first + 1, second - first), body.substr(second + 1, F.length(body))
    output = F.when(~cut, body).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    rows = rows.withColumn("prefix_chars", F.when(cut, F.col("_first"))).withColumn("middle_chars", F.when(cut, F.col("_second") - F.col("_first"))).withColumn("output", output)
    return rows.drop("_identity", "_n", "_first", "_second")


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: marks occur once each, in the order that the form tells."""
    between = lambda left, right: F.substring_index(F.substring(output, F.instr(output, left) + len(left), F.length(output)), right, 1) if right else F.substring(output, F.instr(output, left) + len(left), F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, ""), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, ""), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle of every text of ``documents``, and the text rebuilt from each output."""
    done = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c, name: F.sha2(c, 256).alias(name)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output"), "output_sha256"), sha(restored(F.col("output"), F.col("form")), "restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""

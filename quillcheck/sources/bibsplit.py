"""BibTeX files in ranges: one large file is read by many tasks.

Spark reads a file's lines in byte ranges. Whether a range begins within an entry depends on all before it, so it is worked out in two passes:

1. Each range tells what becomes of every state in which it may begin: outside of entries, after an entry's ``@type`` whose bracket is
   still to come, within round brackets, or within n braces. It is a few numbers for a range: entries that begin outside
   close in order, and n braces are closed by the n-th brace that closes nothing of the range itself.
2. The states follow from range to range (a file's ranges in one row of small numbers), and each range is read again with its own. Entries
   within a range are whole; those that cross ranges are pieces, which alone are shuffled and put together.

Entries are numbered by counts of the ranges before. ``@string`` definitions are a list for each file, joined to the entries
that use names. The result is that of scanning the whole file.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import cut
from .bibtex import MONTHS, _closed, _end, _fields, _header

OUT, HEAD, ROUND = 0, -1, -2  # states; n > 0: within n braces
_SIGNS = re.compile(r"@[\w-]+\s*[{(]|[{}]|(?m:^\))")
_OPEN_HEAD = re.compile(r"@[\w-]+\s*\Z")
#: Marks around a name in a value, until it is filled in.
_NAME = ("\ufdd0", "\ufdd1")


def summary(text: str) -> dict:
    """What becomes of a range's text: the states after it if it begins outside (out), after a head and in round brackets (head, round; and
    whether what was open ends within it); the states after each of its braces that close nothing (loose: for that many braces
    before it); and the braces that it leaves open."""
    signs = [*_SIGNS.finditer(text)]
    closed_by: dict[int, int] = {}
    stack: list[int] = []
    loose: list[int] = []
    rounds: list[int] = []
    for k, m in enumerate(signs):
        sign = m[0][-1]
        if sign == "{":
            stack.append(k)
        elif sign == "}":
            if stack:
                closed_by[stack.pop()] = k
            else:
                loose.append(k)
        elif m[0] == ")":
            rounds.append(k)
    left = {k: len(stack) - i for i, k in enumerate(stack)}  # braces open at the end, from each open one on
    tail = HEAD if _OPEN_HEAD.search(text) else OUT

    def after(k: int) -> int:
        """The sign that closes what opens at sign ``k``, or the state in which the range ends within it."""
        if signs[k][0][-1] == "{":
            return closed_by.get(k, -1)
        at = bisect_left(rounds, k + 1)
        return rounds[at] if at < len(rounds) else -1

    state = [tail] * (len(signs) + 1)  # if it is outside before the sign
    for k in range(len(signs) - 1, -1, -1):
        state[k] = state[k + 1]
        if signs[k][0][0] == "@":
            stop = after(k)
            state[k] = state[stop + 1] if stop >= 0 else left[k] if signs[k][0][-1] == "{" else ROUND
    first = text.lstrip()[:1]
    stop = closed_by.get(0, -1) if first == "{" else rounds[0] if first == "(" and rounds else -1
    if stop >= 0:
        head = state[stop + 1]
    else:
        head = {"": HEAD, "{": left.get(0, OUT), "(": ROUND}.get(first, state[0])
    return {"out": state[0], "head": head, "head_ends": stop >= 0 or first not in ("", "{", "("), "round": state[rounds[0] + 1] if rounds else ROUND, "round_ends": bool(rounds), "loose": [state[k + 1] for k in loose], "open": len(stack)}


def follow(state: int, told: dict) -> tuple[int, bool]:
    """The state after a range that begins in ``state``, and whether what was open before it ended within it."""
    if state <= 0:
        name = ("out", "head", "round")[-state]
        return told[name], told.get(f"{name}_ends", False)
    ends = state <= len(told["loose"])
    return (told["loose"][state - 1] if ends else state - len(told["loose"]) + told["open"]), ends


def _stop(text: str, state: int, at: int = 0) -> int:
    """Where what is open at a range's begin ends, or -1: not within it."""
    if state == HEAD:
        at = len(text) - len(text.lstrip())
        if at == len(text):
            return -1
        if text[at] not in "{(":
            return 0
        state, at = 1 if text[at] == "{" else ROUND, at + 1
    if state == ROUND:
        m = re.compile(r"(?m)^\)").search(text, at)
        return m.end() if m else -1
    for m in re.compile("[{}]").finditer(text, at):
        state += 1 if m[0] == "{" else -1
        if not state:
            return m.end()
    return -1


def pieces(text: str, state: int) -> list[tuple[int, bool, bool, str]]:
    """Entries that begin in a range, and the piece of one that began before it: place (-1: before), whether it begins, whether it ends, text."""
    out, at = [], 0
    if state:
        at = _stop(text, state)
        if at < 0:
            return [(-1, False, False, text)]
        out.append((-1, False, True, text[:at]))
    while (at := text.find("@", at)) >= 0:
        _, start = _header(text, at)
        if start < 0:
            if _OPEN_HEAD.match(text, at):
                out.append((at, True, False, text[at:]))
                break
            at += 1
            continue
        end = _end(text, start)
        out.append((at, True, end <= len(text), text[at:end]))
        at = end
    return out


class _Marked(dict):
    """Names as they stand, between marks; numbers are no names."""

    def get(self, word: str, default: str) -> str:
        return default if default[:1].isdigit() else f"{_NAME[0]}{default}{_NAME[1]}"


def _ranges(batches):
    """Texts of ranges (file, block, state, text), from batches of lines in order."""
    held, lines = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for *key, line in zip(*columns):
            if key != held:
                if held is not None:
                    yield (*held, "\n".join(lines) + "\n")
                held, lines = key, []
            lines.append(line or "")
    if held is not None:
        yield (*held, "\n".join(lines) + "\n")


def _parse(text: str) -> tuple[str, str, dict[str, str]] | None:
    kind, start = _header(text, 0)
    if start < 0 or kind in ("comment", "preamble"):
        return None
    key, fields = _fields(_closed(text, start, _end(text, start)), kind, _Marked())
    return key, kind, fields


_FIELDS = pa.map_(pa.string(), pa.string())


def _parsed(entries: DataFrame) -> DataFrame:
    """Entries (file, block, at, text) as file, block, at, key, type, raw; comments go."""

    def parse(batches):
        for batch in batches:
            rows = [(*place, *found) for *place, text in zip(*(c.to_pylist() for c in batch.columns)) if (found := _parse(text)) is not None]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array([list(r[k].items()) if k == 5 else r[k] for r in rows], t) for k, t in enumerate(kinds)], ["file", "block", "at", "key", "type", "raw"])

    return entries.select("file", "block", "at", "text").mapInArrow(parse, "file string, block bigint, at bigint, key string, type string, raw map<string,string>")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Entries of BibTeX files: file, ord, key, type, raw."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    kinds = {"out": pa.int64(), "head": pa.int64(), "head_ends": pa.bool_(), "round": pa.int64(), "round_ends": pa.bool_(), "loose": pa.list_(pa.int64()), "open": pa.int64()}

    def tell(batches):
        for file, block, text in _ranges(batches):
            told = summary(text)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), *(pa.array([told[k]], t) for k, t in kinds.items())], ["file", "block", *kinds])

    told = lines.mapInArrow(tell, "file string, block bigint, out bigint, head bigint, head_ends boolean, round bigint, round_ends boolean, loose array<bigint>, open bigint")
    each = told.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", *kinds))).alias("ranges"))

    @F.arrow_udf("array<struct<block:bigint,state:bigint,since:bigint>>")
    def states(files: pa.Array) -> pa.Array:
        out = []
        for ranges in files.to_pylist():
            state, since, rows = OUT, -1, []
            for told in ranges:
                rows.append({"block": told["block"], "state": state, "since": since})
                before, (state, ends) = state, follow(state, told)
                if not before or ends:  # what is open now began in this range
                    since = told["block"]
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int64()), ("since", pa.int64())])))

    begins = cut(each.select("file", F.explode(states("ranges")).alias("r")).select("file", "r.*"))
    at = lines.join(F.broadcast(begins), ["file", "block"]).select("file", "block", "state", "since", "value")  # a row of numbers for each range

    def divide(batches):
        for file, block, state, since, text in _ranges(batches):
            rows = []
            for place, begins_, ends, piece in pieces(text, state):
                rows.append((file, block if begins_ else since, place, block, begins_ and ends, piece))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "block", "at", "part", "whole", "text"])

    found = cut(at.mapInArrow(divide, "file string, block bigint, at bigint, part bigint, whole boolean, text string"))
    crossing = found.where("not whole").groupBy("file", "block").agg(F.max("at").alias("at"), F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
    crossing = crossing.where("at >= 0").select("file", "block", "at", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    entries = cut(_parsed(found.where("whole").select("file", "block", "at", "text").unionByName(crossing)))
    return _numbered(_named(entries))


def _numbered(entries: DataFrame) -> DataFrame:
    """``ord`` by places: counts of a file's ranges are summed, and entries are numbered within their range."""
    counts = entries.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    rows = entries.withColumn("_own", own).join(counts.select("file", "block", before.alias("_before")), ["file", "block"])
    return rows.select("file", (F.col("_before") + F.col("_own")).cast("int").alias("ord"), "key", "type", "raw")


def _named(parsed: DataFrame) -> DataFrame:
    """Entries with names filled in: by the last definition before them, else by the month, else as they stand."""
    strings = parsed.where("type = 'string'").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "at", F.map_entries("raw").alias("fields")))).alias("defined"))

    @F.arrow_udf("array<struct<block:bigint,at:bigint,name:string,value:string>>")
    def resolved(lists: pa.Array) -> pa.Array:
        out = []
        for defined in lists.to_pylist():
            names, rows = dict(MONTHS), []
            for d in defined:
                for f in d["fields"]:  # a definition may use earlier ones
                    value = re.sub(f"{_NAME[0]}(.*?){_NAME[1]}", lambda m: names.get(m[1].lower(), m[1]), f["value"], flags=re.S)
                    rows.append({"block": d["block"], "at": d["at"], "name": f["key"], "value": value})
                names |= {r["name"]: r["value"] for r in rows[len(rows) - len(d["fields"]) :]}
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("block", pa.int64()), ("at", pa.int64()), ("name", pa.string()), ("value", pa.string())])))

    known = strings.select("file", resolved("defined").alias("defined"))
    entries = parsed.where("type <> 'string'").join(known, "file", "left")
    months = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    none = F.array().cast("array<struct<block:bigint,at:bigint,name:string,value:string>>")

    def filled(value):
        parts = F.split(value, f"[{_NAME[0]}{_NAME[1]}]", -1)  # names stand at the odd places

        def name(part):
            low = F.lower(part)
            own = F.filter(F.coalesce("defined", none), lambda d: (d["name"] == low) & (F.struct(d["block"], d["at"]) < F.struct("block", "at")))
            return F.coalesce(F.try_element_at(own, F.lit(-1))["value"], F.try_element_at(months, low), part)

        said = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise(name(p))), "")
        return T.squeeze(F.when(value.contains(_NAME[0]), said).otherwise(value))

    return entries.select("file", "block", "at", "key", "type", F.transform_values("raw", lambda _, v: filled(v)).alias("raw"))

"""Answers of the five scholarly services as rows: source, asked, body, error.

``register`` adds the format ``quillcheck_answers``. A read names what it asks for by filters on ``asked`` (and ``source``), which are pushed
into the reader, or by the option ``asked`` (a JSON list). Each service is one partition, so its pace holds however many executors
there are; other requests wait, failed ones are asked again, and what fails for good is a row with an ``error``. A service that
does not know an identifier gives a row without body and error: a miss is no outage. Call ``load`` anew for each question, as Spark
keeps a relation's pushed filters.

``fetch`` asks for the rows of a table, any number of them, in the same way: a task for each service, answers streamed out as they come.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from . import records

SCHEMA = "source string, asked string, body string, error string"
# Where each service answers, and the least seconds between two calls.
URLS = {
    "arxiv": "http://export.arxiv.org/api/query?id_list={}",
    "crossref": "https://api.crossref.org/works/{}",
    "dblp": "https://dblp.org/search/publ/api?q={}&format=json&h=10",
    "s2": "https://api.semanticscholar.org/graph/v1/paper/search?query={}&limit=10&fields=title,authors,year,venue,externalIds,citationCount",
    "openalex": "https://api.openalex.org/works?search={}&per_page=5",
}
PACE = {"arxiv": 3.0, "crossref": 1.0, "dblp": 1.0, "s2": 1.0, "openalex": 0.5}
#: Calls for one identifier at most, seconds that one may take, and status codes that say: later.
CALLS, TIMEOUT, LATER = 3, 15.0, (408, 425, 429, 500, 502, 503, 504)


class Client:
    """Calls of one service, one after another and no faster than its pace."""

    def __init__(self, source: str, options: dict[str, str]):
        self.source = source
        self.url = options.get(f"url.{source}", URLS[source])
        self.pace = float(options.get("pace", PACE[source]))
        self.calls = int(options.get("calls", CALLS))
        self.timeout = float(options.get("timeout", TIMEOUT))
        self.next = 0.0

    def _call(self, asked: str) -> str:
        now = time.monotonic()
        if now < self.next:
            time.sleep(self.next - now)
        self.next = time.monotonic() + self.pace
        request = urllib.request.Request(self.url.format(urllib.parse.quote(asked, safe="/" if self.source == "crossref" else "")), headers={"User-Agent": "quillcheck", "Accept": "*/*"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return answer.read().decode("utf-8", "replace")

    def ask(self, asked: str) -> tuple[str, str, str | None, str | None]:
        """A row: the body, a miss (neither body nor error), or what went wrong last."""
        error = None
        for k in range(max(1, self.calls)):
            if k:
                self.next = max(self.next, time.monotonic() + self.pace * 2**k)
            try:
                return self.source, asked, self._call(asked), None
            except urllib.error.HTTPError as e:
                if e.code in (404, 410):
                    return self.source, asked, None, None
                error = f"HTTP {e.code}"
                if e.code not in LATER:
                    break
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"[:200]
        return self.source, asked, None, error


class _Service(InputPartition):
    def __init__(self, source: str, asked: list[str]):
        self.source, self.asked = source, asked


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.sources = [s for s in options.get("sources", ",".join(URLS)).split(",") if s]
        self.asked = json.loads(options["asked"]) if "asked" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("asked",), ("source",)):
                yield f
            elif f.attribute == ("asked",):
                self.asked = [x for x in values if self.asked is None or x in self.asked]
            else:
                self.sources = [s for s in self.sources if s in values]

    def partitions(self) -> list[InputPartition]:
        if self.asked is None:
            raise ValueError("name what to ask for: a filter on asked, or the option asked")
        each = [*dict.fromkeys(x for x in self.asked if x)]
        return [_Service(s, each) for s in self.sources if s in URLS and each]

    def read(self, partition: _Service) -> Iterator[tuple]:
        client = Client(partition.source, self.options)
        for asked in partition.asked:
            yield client.ask(asked)


class Answers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillcheck_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Add the format ``quillcheck_answers`` to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Answers)


def fetch(requests: DataFrame, **options: str) -> DataFrame:
    """Answers to the rows of a table (source, asked), each asked once: a task for each service."""
    names = [*URLS]
    known = requests.where(F.col("source").isin(names) & (F.coalesce("asked", F.lit("")) != "")).select("source", "asked").distinct()
    own = known.withColumn("_task", F.array_position(F.array(*map(F.lit, names)), F.col("source")).cast("int") - 1).repartitionById(len(names), F.col("_task"))

    def ask(batches):
        import pyarrow as pa

        clients: dict[str, Client] = {}
        for batch in batches:
            for source, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                client = clients.setdefault(source, Client(source, options)) if source not in clients else clients[source]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in client.ask(asked)], ["source", "asked", "body", "error"])

    return own.select("source", "asked").mapInArrow(ask, SCHEMA)


def requests_of(entries: DataFrame) -> DataFrame:
    """What a verification of entries asks for: identifiers where there are any, titles of all."""
    asks = {"arxiv": "arxiv_id", "crossref": "doi", "dblp": "title", "s2": "title", "openalex": "title"}
    each = F.array(*(F.struct(F.lit(s).alias("source"), F.col(c).alias("asked")) for s, c in asks.items()))
    return entries.select(F.explode(each).alias("q")).select("q.*").where(F.coalesce("asked", F.lit("")) != "").distinct()


def catalog(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog rows of answers, and the lookups that failed (source, asked, lookup_error), as ``verdict.verify`` takes them."""
    rows = None
    for source, parse in records.PARSERS.items():
        own = parse(answers.where((F.col("source") == source) & F.col("body").isNotNull()))
        rows = own if rows is None else rows.unionByName(own)
    failed = answers.where(F.col("error").isNotNull()).select("source", "asked", F.col("error").alias("lookup_error"))
    return records.usable(rows), failed.unionByName(records.errors(rows))

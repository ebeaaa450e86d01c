"""Answers of services behind a local socket, documents written by tasks, and the feedback log."""

import http.server
import json
import os
import threading
import time
import urllib.parse
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillcheck.operators import feedback, verdict
from quillcheck.sources import documents, services


class Server:
    """Answers like the five services, with failures: ``bad`` always, ``busy`` at first, ``slow`` too late, ``gone`` is unknown."""

    def __init__(self):
        self.calls, self.times = Counter(), {}
        server = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                source, asked = urllib.parse.unquote(self.path).lstrip("/").split("/", 1)
                server.calls[source, asked] += 1
                server.times.setdefault(source, []).append(time.monotonic())
                code, body = 200, server.answer(source, asked)
                if asked.startswith("gone"):
                    code = 404
                elif asked.startswith("bad"):
                    code = 500
                elif asked.startswith("no"):
                    code = 403
                elif asked.startswith("busy") and server.calls[source, asked] < 3:
                    code = 429
                elif asked.startswith("slow"):
                    time.sleep(2)
                try:
                    self.send_response(code)
                    self.end_headers()
                    self.wfile.write(body.encode())
                except OSError:
                    pass

            def log_message(self, *_):
                pass

        self.http = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.options = {f"url.{s}": f"http://127.0.0.1:{self.http.server_port}/{s}/{{}}" for s in services.URLS} | {"pace": "0.05", "timeout": "1"}

    def answer(self, source, asked):
        if source == "crossref":
            return json.dumps({"message": {"title": [f"Title of {asked}"], "author": [{"given": "Ada", "family": "Lee"}], "created": {"date-parts": [[2001]]}}})
        if source == "arxiv":
            return f"<feed><title>q</title><entry><title>Title of {asked}</title><name>Ada Lee</name><published>2001-01-01</published></entry></feed>"
        if source == "dblp":
            return json.dumps({"result": {"hits": {"hit": [{"@id": "1", "info": {"title": asked + ".", "year": "2001", "authors": {"author": {"text": "Ada Lee"}}}}]}}})
        if source == "s2":
            return json.dumps({"data": [{"paperId": "p", "title": asked, "authors": [{"name": "Ada Lee"}], "year": 2001}]})
        return json.dumps({"results": []})


@pytest.fixture(scope="module")
def server():
    made = Server()
    yield made
    made.http.shutdown()


def test_answers_as_a_source(spark, server):
    services.register(spark)
    read = spark.read.format("quillcheck_answers").options(**server.options).load()
    asked = ["10.1/a b", "gone", "bad", "busy", "slow", "no"]
    rows = read.where(F.col("asked").isin(*asked) & (F.col("source") == "crossref"))
    assert rows.rdd.getNumPartitions() == 1
    got = {r.asked: r for r in rows.collect()}
    assert got["10.1/a b"].body and got["10.1/a b"].error is None and json.loads(got["10.1/a b"].body)["message"]["title"] == ["Title of 10.1/a b"]
    assert (got["gone"].body, got["gone"].error) == (None, None)
    assert got["bad"].error == "HTTP 500" and got["busy"].error is None and got["no"].error == "HTTP 403" and "imed" in got["slow"].error
    assert server.calls["crossref", "no"] == 1 and server.calls["crossref", "busy"] == server.calls["crossref", "bad"] == 3
    assert all(s == "crossref" for s, _ in server.calls)  # filters reach the reader
    times = server.times["crossref"]
    assert times[-1] - times[0] > 0.045 * (len(times) - 1)
    with pytest.raises(Exception, match="name what to ask for"):
        spark.read.format("quillcheck_answers").options(**server.options).load().collect()


def test_answers_feed_a_verification(spark, server):
    cols = "id long, key string, type string, title string, author string, year string, venue string, doi string, arxiv_id string"
    entries = spark.createDataFrame([(1, "a", "article", "Title of 10.1000/x", "Lee, Ada", "2001", "", "10.1000/x", ""), (2, "b", "article", "bad title of a thing", "Roe, B", "2002", "", "bad10.1", ""), (3, "c", "article", "Some words of a title", "Lee, Ada", "2001", "", "gone/10.1", "")], cols)
    asked = services.requests_of(entries)
    assert asked.count() == 3 + 3 * 3
    answers = services.fetch(asked, **server.options)
    rows = answers.collect()
    assert len(rows) == 12 and Counter(r.source for r in rows) == {"crossref": 3, "dblp": 3, "s2": 3, "openalex": 3}
    catalog, errors = services.catalog(spark.createDataFrame(rows, services.SCHEMA))
    assert {(r.source, r.asked) for r in errors.collect()} == {("crossref", "bad10.1"), *((s, "bad title of a thing") for s in ("dblp", "s2", "openalex"))}
    got = {r.id: r for r in verdict.verify(entries, catalog, errors=errors).collect()}
    assert got[1].overall == "OK" and {"crossref", "dblp", "s2"} <= {*got[1].sources_hit}
    assert {*got[2].lookup_errors} == {"crossref", "dblp", "s2", "openalex"} and got[3].lookup_errors == []


def test_documents_are_written_by_tasks(spark, tmp_path):
    rows = spark.range(10_000).select(F.concat(F.lit("report "), "id", F.lit(".md")).alias("file"), F.concat(F.lit("# né "), "id").alias("report")).repartition(7)
    documents.write_documents(rows, str(tmp_path / "out"), "file", "report")
    names = os.listdir(tmp_path / "out")
    assert len(names) == 10_000 and not any(n.startswith("_") for n in names)
    assert (tmp_path / "out" / "report 77.md").read_text(encoding="utf-8") == "# né 77"
    odd = spark.createDataFrame([("a/b.txt", "x"), ("../c", None)], "file string, report string")
    documents.write_documents(odd, f"file://{tmp_path}/out", "file", "report")
    assert {"a%2Fb.txt", "..%2Fc"} <= {*os.listdir(tmp_path / "out")} and (tmp_path / "out" / "..%2Fc").read_text() == ""
    with pytest.raises(Exception, match="already"):
        documents.write_documents(odd, str(tmp_path / "out"), "file", "report", replace=False)
    with pytest.raises(Exception, match="same name"):
        documents.write_documents(odd.union(odd), str(tmp_path / "twice"), "file", "report")
    assert os.listdir(tmp_path / "twice") == []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    broken = F.when(F.col("id") == 999, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 1000, 1, 4).select(F.concat(F.lit("f"), "id").alias("file"), broken.alias("report"))
    with pytest.raises(Exception):
        documents.write_documents(rows, str(tmp_path / "out"), "file", "report")
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_two_writers_in_one_second(spark, tmp_path, scheme):
    folder = f"{scheme}{tmp_path}/log"
    paths, errors = [], []

    def write(k):
        try:
            paths.append(feedback.log_feedback(folder, f"issue {k} " + "x" * 20_000, "major", spark=spark))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    while time.time() % 1 > 0.3:
        time.sleep(0.01)
    threads = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and len(paths) == 2
    files = [n for n in os.listdir(tmp_path / "log") if n.endswith(".json") and not n.startswith(".")]
    assert len(files) == len({os.path.basename(p) for p in paths})
    for name in files:
        assert json.loads((tmp_path / "log" / name).read_text())["issue"].startswith("issue ")
    assert not [n for n in os.listdir(tmp_path / "log") if n.startswith(".") and not n.endswith(".crc")]
    assert feedback.read_feedback(spark, folder).count() == len(files)


def test_records_in_shared_storage(spark, tmp_path):
    """Through Spark's file systems, as for any folder with a scheme: a later record replaces an earlier one whole."""
    for k in range(3):
        feedback._put_shared(spark, f"file://{tmp_path}/log/a.json", json.dumps({"issue": f"n {k}", "severity": "major"}))
    assert [n for n in os.listdir(tmp_path / "log") if not n.endswith(".crc")] == ["a.json"]
    assert [(r.issue, r.file) for r in feedback.read_feedback(spark, f"file://{tmp_path}/log").collect()] == [("n 2", "a.json")]

"""Feedback log: one JSON document a report."""

from __future__ import annotations

import json
import os
import re
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import SEVERITIES

SCHEMA = "timestamp string, issue string, severity string, context string, tag string, bib_file string, expected string, actual string"


def record(issue: str, severity: str = "minor", **more: str | None) -> dict:
    """A feedback record without empty fields."""
    if severity not in SEVERITIES:
        raise ValueError(f"severity is one of {', '.join(SEVERITIES)}")
    return {k: v for k, v in {"timestamp": datetime.now(timezone.utc).isoformat(), "issue": issue, "severity": severity, **more}.items() if v is not None}


def _put_local(path: str, text: str) -> None:
    part = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    with open(part, "w", encoding="utf-8") as out:
        out.write(text)
    os.replace(part, path)


def _put_shared(spark: SparkSession, path: str, text: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    store = target.getFileSystem(conf)
    store.mkdirs(target.getParent())
    out = store.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    for left in range(4, -1, -1):
        try:
            return context.rename(part, target, how)
        except Py4JJavaError:  # some stores replace in two steps, between which another writer may come
            if not left:
                store.delete(part, False)
                raise


def log_feedback(folder: str, issue: str, severity: str = "minor", spark: SparkSession | None = None, **more: str | None) -> str:
    """Write a record as <time>_<severity>.json; within a second, the same severity's later record replaces the earlier.

    A record is written under a name of its own and then renamed, so readers and other writers see whole files only. A folder with a scheme
    (``hdfs://..``) is reached through Spark's file systems, by ``spark`` or the running session."""
    entry = record(issue, severity, **more)
    name = f"{datetime.now(timezone.utc):%Y%m%d_%H%M%S}_{severity}.json"
    text = json.dumps(entry, indent=2, ensure_ascii=False)
    folder = re.sub("^file:/+", "/", folder)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder):
        session = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        path = f"{folder.rstrip('/')}/{name}"
        _put_shared(session, path, text)
        return path
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    _put_local(path, text)
    return path


def read_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """All records with their file's name; documents that are not JSON are left out."""
    texts = spark.read.text(f"{folder}/*.json", wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    rows = texts.select(F.from_json("value", SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "file")
    return rows.where("r is not null and r._bad is null").select("r.*", "file").drop("_bad")


def latest(feedback: DataFrame, last: int | None = None) -> DataFrame:
    """The last records by file name, the newest first; all without ``last``."""
    rows = feedback.orderBy(F.desc("file"))
    return rows.limit(last) if last else rows


def stats(feedback: DataFrame) -> DataFrame:
    """Records of each severity (zero where there are none; no severity counts as minor) and of all (``total``): severity, records."""
    counts = feedback.groupBy(F.coalesce("severity", F.lit("minor")).alias("severity")).agg(F.count("*").alias("n"))
    known = feedback.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    each = known.join(counts, "severity", "full_outer").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("records"))
    return each.unionByName(counts.agg(F.lit("total").alias("severity"), F.coalesce(F.sum("n"), F.lit(0)).alias("records")))

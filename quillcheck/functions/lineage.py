"""Cutting the lineage of intermediate results that several branches of a plan read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that ``spark.checkpoint.dir`` names; in local mode, where none is set, in a temporary one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", "")
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="quillcheck-checkpoint-"))
    return df.checkpoint()

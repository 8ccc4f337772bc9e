"""Helpers for DataFrames: cut lineage, and numbers in an order without a task that holds all rows."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Where spark.checkpoint.dir says. A temporary folder is made only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"checkpoint-{uuid.uuid4().hex}")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder once: what follows starts from there, and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, column: str, order: list[str | Column], start: int = 0) -> DataFrame:
    """rows numbered from start + 1 in the given order (ties in any). Rows are range-sorted and counted by partition, and
    each partition begins where those before it end: only the counts meet in one place."""
    at = f"{column}_at"
    # a second range sort might draw other borders, so this one is kept; the number holds the partition in its upper bits
    sorted_ = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    counts = sorted(sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    begin, before = [], start
    for r in counts:
        begin.append((r["part"], before))
        before += r["n"]
    offsets = rows.sparkSession.createDataFrame(begin, f"{column}_part long, {column}_begin long")
    out = sorted_.join(F.broadcast(offsets), part == F.col(f"{column}_part"))
    return out.withColumn(column, F.col(f"{column}_begin") + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop(at, f"{column}_part", f"{column}_begin")

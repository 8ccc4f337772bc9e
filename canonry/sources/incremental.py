"""Distinct values of a table of files without reading again what has not changed.

Of each file there is a summary: its distinct spellings of the watched column and their rows. Summaries are rows under the
file's path, size and time, so that only files that are new or changed are read; those of files that are gone don't count
any more. They are appended, and rewritten once most of them are dead or there are many appendices.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_path
from ..operators.mappings import small
from ..operators.store import Change, Kept, Snapshot, Store
from .tables import values_of

SUMMARY = "file string, raw string, n long"
#: Appendices after which summaries are rewritten.
APPENDICES = 16


def file_id() -> Column:
    """Path, size and time of the file that a row is of."""
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    return F.concat_ws("|", path, F.col("_metadata.file_size").cast("string"), F.unix_micros("_metadata.file_modification_time").cast("string"))


def listed(spark, path: str) -> list[str]:
    """file_id of each data file under a folder, from the listing alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    out = []
    while files.hasNext():
        f = files.next()
        name = f.getPath().getName()
        if not name.startswith((".", "_")):
            url = re.sub("^file:/+", "file:/", f.getPath().toUri().toString())
            out.append(f"{url}|{f.getLen()}|{f.getModificationTime() * 1000}")
    return sorted(out)


class FileSummaries:
    """Summaries of one column of the Parquet files under a folder, kept in a store's table."""

    def __init__(self, store: Store, table: str, path: str, column: str) -> None:
        self.store, self.spark, self.table, self.path, self.column = store, store.spark, table, path, column
        self.read = 0  # files that the last refresh read

    def refresh(self) -> bool:
        """Bring summaries up to the files; whether anything has changed."""
        live = listed(self.spark, self.path)
        changed = False

        def change(now: Snapshot) -> Change | None:
            nonlocal changed
            marks = now.marks(self.table)
            have = now.read(self.table) if now.version(self.table) else self.spark.createDataFrame([], SUMMARY)
            known = {r["file"] for r in have.select("file").distinct().collect()}  # a row for each file
            fresh = [f for f in live if f not in known]
            dead = len(known) - (len(live) - len(fresh))
            self.read, changed = len(fresh), bool(fresh or dead)
            if not changed and marks:
                return None
            made = self.summaries(fresh)
            paths = now.held(self.table)["paths"] if now.version(self.table) else []
            noted = {self.table: {"files": str(len(live))}}
            if dead > len(live) or len(paths) >= APPENDICES or not paths:
                return Change({self.table: self.alive(have, live).unionByName(made)}, noted)
            return Change({self.table: Kept(paths, made, have.schema)} if fresh else {}, noted)

        self.store.transact(change)
        return changed

    def summaries(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], SUMMARY)
        rows = self.spark.read.parquet(*[plain_path(f.rsplit("|", 2)[0]) for f in files]).select(file_id().alias("file"), F.col(f"`{self.column}`").cast("string").alias("raw"))
        # a file without values has a row too, by which it is known
        return rows.groupBy("file", "raw").agg(F.count("*").alias("n"))

    def alive(self, have: DataFrame, live: list[str]) -> DataFrame:
        names = self.spark.createDataFrame([(f,) for f in live], "file string")
        return have.join(small(names), "file", "left_semi").select("file", "raw", "n")

    def counts(self) -> DataFrame:
        """raw, n over all files as they were at the last refresh."""
        have = self.alive(self.store.read(self.table), listed(self.spark, self.path))
        return have.where(F.col("raw").isNotNull()).groupBy("raw").agg(F.sum("n").alias("n"))

    def values(self) -> DataFrame:
        """What distinct_values gives for the whole table."""
        self.refresh()
        return values_of(self.counts())

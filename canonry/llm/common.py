"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that part words; every other character belongs to a word.
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. A temporary one is made only where none is set, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"checkpoint-{uuid.uuid4().hex}")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that later work survives lost executors and starts from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers that make a partition.
FITTED = 200_000


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than so many rows of a few numbers need: each partition writes files to every shuffle."""
    return df.coalesce(max(-(-rows // FITTED), 1))


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps that checkpoints have replaced. It does so when the driver collects
    its garbage, which may take long: every spark.cleaner.periodicGC.interval, half an hour unless set."""
    for _ in range(2):  # the first lets go of what Python held, the second of what hung on that
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def give_back() -> None:
    """Let the system have what this process has freed. Workers stay between steps, those of DataFrames beside those of RDDs:
    an idle one would keep as much as its largest task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """array<string> of the maximal runs without white space; null text gives an empty array."""
    one = F.translate(F.coalesce(text, F.lit("")), WHITE[1:], " " * (len(WHITE) - 1))
    return F.array_remove(F.split(one, " "), "")


def crc32_mod(doc_id: Column, k: int) -> Column:
    """Remainder of crc32(doc_id as text); a null doc_id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k).cast("int")


def split_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def documents_only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns of any name can't clash with those made later."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def with_row(documents: DataFrame, *columns: str) -> DataFrame:
    """_row, a struct of all columns, beside doc_id, text and other named columns: whatever extra columns are called, they
    can't clash with those made later."""
    every = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")
    return documents.select(every, *[F.col(f"`{c}`") for c in ("doc_id", "text", *columns)])


def unwrapped(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Back to the columns of documents, from rows with _row."""
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in documents.columns])


#: Up to so many bytes a side is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, materialised, and marked to be broadcast if its rows take so few bytes: texts, binaries and arrays by their
    lengths, other values as eight."""
    df = cut(df)

    def width(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        return F.greatest(F.size(c), F.lit(0)) * 8 + 24 if kind.startswith("array") else F.lit(8)

    size = df.agg(F.coalesce(F.sum(sum((width(n, k) for n, k in df.dtypes), F.lit(8)).cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if size <= most else df


def text_key() -> Column:
    """Of the column text; a null text counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def other(rows: DataFrame) -> DataFrame:
    """rows with doc_id and tkey under other names, as the second side of a join on same_document."""
    return rows.withColumnsRenamed({"doc_id": "_id", "tkey": "_tkey"})


def same_document() -> Column:
    """Whether doc_id, null or not, and tkey are equal on both sides: such rows are repeats."""
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey"))


def first_of_each(documents: DataFrame, members: DataFrame) -> DataFrame:
    """Of each root's documents the row with the smallest doc_id, one with a null id only if all are null; of rows that
    repeat an id and text one stays. Columns unchanged. members: doc_id, tkey, root of every row."""
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tkey")).alias("row"))
    stay = cut(first.select(F.col("row.doc_id").alias("doc_id"), F.col("row.tkey").alias("tkey")))
    rows = with_row(documents).withColumn("tkey", text_key())
    kept = rows.join(other(stay), same_document(), "left_semi")
    if not members.groupBy("doc_id", "tkey").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "tkey"])
    return unwrapped(kept, documents)

"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous sweeps.

Documents are tokenised once. Pieces are sorted by length over range partitions, so equal lengths form runs, and so do
gaps of equal size in sequences. A sweep matches each run of pieces, longest first, with its successor: the run of the
smallest gaps that hold it. Pieces of a run that want the same gaps are told apart by their rank in the sort; gaps are
updated, and sweeps repeat until no run is left. There are at most `capacity` lengths and gap sizes, so the runs, and
nothing that grows with the documents, meet on the driver; ranks and places are worked out where the pieces are.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids, its end included.

    A document longer than capacity is cut into pieces of capacity; what is over makes a shorter first one. Null and
    empty texts are a single end. Repeated rows and null ids make pieces of their own.
    """
    path = path or tokens.vocabulary_path()
    end = array("I", [END_ID]).tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.worker(tokens.Encoder, path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"]):
                ids = memoryview(encoder.ids(text if isinstance(text, str) else "") + end)
                total, at, piece = len(ids) // 4, 0, 0
                while at < total:
                    length = (total - at) % capacity or capacity
                    rows.append((doc_id, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                    at, piece = at + length, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return common.documents_only(documents, "doc_id", "text").mapInPandas(pieces, PIECES)


class Plan:
    """Which ranks of which length go to which sequences: a row for each match of a run of pieces with a run of gaps."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces in each, offset
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs of sequences, as first and count
        self.sizes: list[int] = []  # of gaps, sorted
        self.sequences = 0

    def open_gaps(self, size: int, first: int, count: int) -> None:
        if size <= 0 or count <= 0:
            return
        if size not in self.gaps:
            self.sizes.insert(int(np.searchsorted(self.sizes, size)), size)
            self.gaps[size] = []
        runs = self.gaps[size]
        if runs and sum(runs[-1]) == first:
            runs[-1] = (runs[-1][0], runs[-1][1] + count)
        else:
            runs.append((first, count))

    def place(self, length: int, rank: int, number: int, size: int, first: int, count: int) -> int:
        """Put up to number pieces into a run of gaps, as many into each as it holds; returns how many found a place."""
        each = size // length
        placed = min(number, each * count)
        full, over = divmod(placed, each)
        self.rows.append((length, rank, first, each, self.capacity - size))
        self.open_gaps(size - each * length, first, full)
        if over:
            self.open_gaps(size - over * length, first + full, 1)
        self.open_gaps(size, first + full + bool(over), count - full - bool(over))
        return placed

    def sweep(self, length: int, number: int) -> None:
        """Match number pieces of one length with the smallest gaps that hold them, then with new sequences."""
        rank = 0
        while rank < number:
            at = int(np.searchsorted(self.sizes, length))
            if at == len(self.sizes):
                need = -(-(number - rank) // (self.capacity // length))
                first, self.sequences = self.sequences, self.sequences + need
                rank += self.place(length, rank, number - rank, self.capacity, first, need)
                continue
            size = self.sizes[at]
            runs = self.gaps[size]
            first, count = runs.pop()
            if not runs:
                del self.gaps[size], self.sizes[at]
            rank += self.place(length, rank, number - rank, size, first, count)


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """lengths: number of pieces by length."""
    out = Plan(capacity)
    for length in sorted(lengths, reverse=True):
        out.sweep(length, lengths[length])
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, partitions: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces, which hold a column length of 1 to capacity.

    Ties between equal lengths go by doc_id and piece, and repeated rows in any order. An empty table gives an empty
    result. Both the pieces and their sort are checkpointed: ranks must not change when an executor is lost.
    """
    spark = pieces.sparkSession
    pieces = common.cut(pieces)
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["length", "doc_id", "piece"]
    ranged = common.cut(pieces.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    # range partitions overlap in their end lengths alone: at most capacity + partitions rows
    runs = sorted((r["_part"], r["length"], r["n"]) for r in ranged.groupBy("_part", "length").agg(F.count("*").alias("n")).collect())
    lengths: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for part, length, n in runs:
        before[(part, length)] = lengths.get(length, 0)
        lengths[length] = lengths.get(length, 0) + n
    rows = np.array(plan(lengths, capacity).rows, "i8").reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = spark.sparkContext.broadcast((rows, before))  # bounded by the number of lengths, gaps and partitions

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, before = shared.value
        seen: dict[int, int] = {}
        # one number holds a row's length and first rank; both stay below 2**40 and 2**20
        starts = (rows[:, 0] << 40) + rows[:, 1]
        for batch in batches:
            if not len(batch):
                continue
            length, part = batch["length"].to_numpy("i8"), int(batch["_part"].iloc[0])
            edges = np.flatnonzero(np.diff(length, prepend=-1))
            rank = np.arange(len(length))
            for a, b in zip(edges, [*edges[1:], len(length)]):
                one = int(length[a])
                rank[a:b] += before[(part, one)] + seen.get(one, 0) - a
                seen[one] = seen.get(one, 0) + int(b - a)
            row = rows[np.searchsorted(starts, (length << 40) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield batch.drop(columns="_part").assign(sequence_id=row[:, 2] + nth // row[:, 3], offset=row[:, 4] + nth % row[:, 3] * length)

    names = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ranged.mapInPandas(places, f"{names}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack(cut_pieces(documents, capacity, path), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}

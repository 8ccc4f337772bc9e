"""Vector code compression: product quantization trained by Lloyd's rounds that move only what changed.

The state of a round is each vector with its codes of this and the previous round, and, on the driver, the integer sum and
count of each codebook entry. A part whose code changed sends its components to the new entry and takes them from the old
one; contributions are added up in each task before they are shuffled, so that a settled part costs nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Up to so large an integer component sums and errors stay exact; a table with a larger one is refused.
LARGEST = 1 << 30
CHUNK = 2048


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for a null vector, or one with a null or non-finite component."""
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long")))


def kept(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> tuple[DataFrame, int]:
    """vec_id, label, x of the rows that take part, and their dimension.

    A row whose vector is null, or holds a null or non-finite component, is dropped. Vectors have as many components as
    that of the smallest vec_id: one of another length, or a length that parts don't divide, is refused.
    """
    rows = common.documents_only(vectors, "vec_id", "embedding", "label").select("vec_id", "label", integers(F.col("embedding"), scale).alias("x")).where(F.col("x").isNotNull())
    size = F.size("x")
    reach = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    seen = rows.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.max(reach).alias("reach")).first()
    if (seen["reach"] or 0) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // scale}: sums would not be exact")
    if seen["least"] != seen["most"] or (seen["least"] or 0) % parts:
        raise ValueError("vectors must be of one length, which the number of parts divides")
    return rows.withColumn("x", F.col("x").cast("array<int>")), seen["least"] or 0


def first_codebooks(rows: DataFrame, parts: int, entries: int, dim: int) -> np.ndarray:
    """parts x entries x width: the vectors of the smallest vec_ids, ascending; nulls last, ties by components and label."""
    order = [F.asc_nulls_last("vec_id"), "x", F.asc_nulls_first("label")]
    first = [r["x"] for r in rows.orderBy(*order).limit(entries).collect()]  # entries rows
    return np.array(first, "i8").reshape(len(first), parts, dim // parts).transpose(1, 0, 2)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower number, and its squared distance. Products are exact: in doubles
    while they stay below 2^53, else in integers of any size."""
    top = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0), 1))
    kind = "f8" if 4 * top * top * max(x.shape[1], 1) < 1 << 53 else object
    b = book.astype(kind)
    square, code, error = (b * b).sum(1), np.empty(len(x), "i8"), np.empty(len(x), object if kind is object else "i8")
    for at in range(0, len(x), CHUNK):
        a = x[at : at + CHUNK].astype(kind)
        off = square[None, :] - 2 * a.dot(b.T)
        code[at : at + CHUNK] = best = off.argmin(1)
        error[at : at + CHUNK] = off[np.arange(len(a)), best] + (a * a).sum(1)
    return code, error


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype("i8")


def assign(state: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, x, code, before, error: each row's codes by these codebooks, and those it had (empty at first)."""
    shared = state.sparkSession.sparkContext.broadcast(books)  # parts x entries x width integers
    fields = [f for f in state.schema.names if f in ("vec_id", "label", "x")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["x"])
            parts = np.split(x, len(shared.value), axis=1)
            found = [nearest(p, b) for p, b in zip(parts, shared.value)]
            code = np.stack([c for c, _ in found], 1).astype("i2")
            error = np.array([int(e) for e in sum(e for _, e in found)], "i8")
            lists = lambda m: pa.array(list(m), pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([*[batch[f] for f in fields], lists(code), batch["code"], pa.array(error)], names=[*fields, "code", "before", "error"])

    kinds = dict(state.dtypes)
    schema = ", ".join(f"{f} {kinds[f]}" for f in fields) + ", code array<short>, before array<short>, error long"
    return state.select(*fields, "code").mapInArrow(run, schema)


def moves(state: DataFrame, parts: int, entries: int) -> DataFrame:
    """part, entry, at, delta: what the parts whose code changed add to and take from entries, by component; at -1 is
    their number. Each task adds up its own first."""
    changed = state.where(~F.col("code").eqNullSafe(F.col("before"))).select("x", "code", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = matrix(batch["x"])
            width = x.shape[1] // parts
            if total is None:
                total = np.zeros((parts, entries, width + 1), "i8")
            new = matrix(batch["code"])
            had = np.diff(batch["before"].offsets.to_numpy()) > 0
            old = np.full_like(new, -1)
            old[had] = batch["before"].flatten().to_numpy().reshape(-1, parts)
            for p in range(parts):
                part = np.concatenate([x[:, p * width : (p + 1) * width], np.ones((len(x), 1), "i8")], 1)
                moved = new[:, p] != old[:, p]
                np.add.at(total[p], new[moved, p], part[moved])
                left = moved & (old[:, p] >= 0)
                np.subtract.at(total[p], old[left, p], part[left])
        if total is not None:
            part, entry, at = np.nonzero(total)
            at_number = np.where(at == total.shape[2] - 1, -1, at)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(at_number, pa.int32()), pa.array(total[part, entry, at])], names=["part", "entry", "at", "delta"])

    sent = changed.mapInArrow(run, "part int, entry int, at int, delta long")
    return sent.groupBy("part", "entry", "at").agg(F.sum(F.col("delta").cast("decimal(20,0)")).alias("delta"))


class Codebooks:
    """Entries with the sums and counts of the parts that chose them, all integers of any size; parts x entries x width."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.sums, self.counts = np.zeros(entries.shape, object), np.zeros(entries.shape[:2], object)

    def move(self, deltas: list) -> None:
        """Bring sums and counts up to date, and each entry that has parts to their floored mean."""
        for part, entry, at, delta in deltas:
            if at < 0:
                self.counts[part, entry] += int(delta)
            else:
                self.sums[part, entry, at] += int(delta)
        used = self.counts > 0
        self.entries = self.entries.copy()
        self.entries[used] = (self.sums[used] // self.counts[used][:, None]).astype("i8")

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def train(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """rows (vec_id, label, x) with their final codes and errors, and the codebooks after so many rounds."""
    books = Codebooks(first_codebooks(rows, parts, entries, dim))
    state = rows.withColumn("code", F.array().cast("array<short>"))
    for _ in range(rounds):
        state = common.cut(assign(state, books.entries))
        deltas = moves(state, parts, books.entries.shape[1]).collect()  # parts x entries x (width + 1) numbers at most
        books.move([(r["part"], r["entry"], r["at"], r["delta"]) for r in deltas])
        state = state.select("vec_id", "label", "x", "code")
    return assign(state, books.entries), books


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (0-based entry numbers), error (summed squared distance) and codebooks_sha256 of each vector.

    Rows that kept() drops have none; repeated rows and null ids each keep theirs; of equally near entries the lowest
    counts; with fewer vectors than entries the codebooks are shorter; an empty table gives an empty result; extra
    columns are left out.
    """
    rows, dim = kept(vectors, scale, parts)
    if not dim:
        return rows.select("vec_id", "label", F.expr(f"array_repeat(0S, {parts})").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    coded, books = train(rows, dim, parts, entries, rounds)
    return coded.select("vec_id", "label", "code", "error", F.lit(books.digest()).alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """codes with vector: the middle of what each chosen entry stands for, one component after the other."""
    tables = [F.array(*[F.array(*[F.lit((int(v) + 0.5) / scale) for v in entry]) for entry in part]) for part in books.entries]
    return codes.withColumn("vector", F.concat(*[F.element_at(t, F.col("code")[p].cast("int") + 1) for p, t in enumerate(tables)]))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = common.cut(encode(common.read_table(spark, sf_dir, "embeddings")))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    text = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")
    out = coded.join(common.small(sums), F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", text.alias("code"), "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The same in DuckDB, round by round."""
    steps = [
        "k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, part, list_slice(x, CAST(part * (len(x) // {PARTS}) + 1 AS BIGINT), CAST((part + 1) * (len(x) // {PARTS}) AS BIGINT)) AS v FROM k, (SELECT unnest(range({PARTS})) AS part))",
        f"b0 AS (SELECT part, r - 1 AS entry, v FROM p WHERE r <= {ENTRIES})",
    ]
    near = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p.part, min(({near}, b.entry)) AS best FROM p JOIN b{i} b ON p.part = b.part GROUP BY r, p.part)")
        if i < ROUNDS:
            steps.append(f"c{i} AS (SELECT part, entry, list(m ORDER BY i) AS v FROM (SELECT a.part, best[2] AS entry, i, CAST(floor(CAST(sum(p.v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM a{i} a JOIN p ON a.r = p.r AND a.part = p.part, (SELECT unnest(range(1, (SELECT max(len(v)) FROM p) + 1)) AS i) GROUP BY ALL) GROUP BY part, entry)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(c.v, b.v) AS v FROM b{i} b LEFT JOIN c{i} c ON b.part = c.part AND b.entry = c.entry)")
    steps.append(f"e AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS s FROM b{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM k JOIN e USING (r), h"


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLE_SQL = {"op12_vector_codes": _sql()}

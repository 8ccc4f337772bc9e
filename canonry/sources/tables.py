"""Scans of a watched column: distinct values under their match key, with how often they occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import normalize, not_blank

RUN_LIMIT, SCAN_LIMIT, PREVIEW_LIMIT = 5_000, 20_000, 1_000


def raw_counts(df: DataFrame, column: str) -> DataFrame:
    """raw, n: byte-exact distinct values and their rows. Only the watched column is read."""
    raw = df.select(F.col(f"`{column}`").cast("string").alias("raw")).where(F.col("raw").isNotNull())
    return raw.groupBy("raw").agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """nv, literal_value, source_frequency: one spelling for each key, the commonest, then the first. The key is worked
    out on distinct spellings alone. limit: the most frequent values."""
    out = values_of(raw_counts(df, column))
    return out if limit is None else out.orderBy(F.desc("source_frequency"), "nv").limit(limit)


def values_of(counts: DataFrame) -> DataFrame:
    """distinct_values, from distinct spellings and their rows (raw, n)."""
    keyed = counts.withColumn("nv", normalize(F.col("raw"))).where(not_blank(F.col("nv")))
    return keyed.groupBy("nv").agg(F.min_by("raw", F.struct(-F.col("n"), "raw")).alias("literal_value"), F.sum("n").alias("source_frequency"))


def distinct_keys(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """As distinct_values, without frequencies."""
    return distinct_values(df, column, limit).select("nv", "literal_value")


def diff_scan(df: DataFrame, column: str, limit: int = SCAN_LIMIT) -> tuple[DataFrame, bool]:
    """The most frequent spellings under their keys, and whether there are more than limit."""
    top = raw_counts(df, column).orderBy(F.desc("n"), "raw").limit(limit + 1)
    truncated = top.count() > limit
    kept = top.orderBy(F.desc("n"), "raw").limit(limit).withColumn("nv", normalize(F.col("raw"))).where(not_blank(F.col("nv")))
    return kept.groupBy("nv").agg(F.min_by("raw", F.struct(-F.col("n"), "raw")).alias("literal_value"), F.sum("n").alias("source_frequency")), truncated


def preview_values(df: DataFrame, column: str) -> DataFrame:
    """All distinct values that aren't null, blanks among them, sorted."""
    return df.select(F.col(f"`{column}`").alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")


def readable(df: DataFrame) -> bool:
    from pyspark.errors import PySparkException

    try:
        df.limit(1).count()
        return True
    except PySparkException:
        return False


def columns(df: DataFrame) -> list[dict]:
    """name, ordinal, type, is_text and why a column can't be watched."""
    return [{"name": f.name, "ordinal": i, "type": f.dataType.simpleString(), "is_text": isinstance(f.dataType, T.StringType), "reason": None if isinstance(f.dataType, T.StringType) else "not a text column"} for i, f in enumerate(df.schema.fields, 1)]


def tables(spark: SparkSession, schema: str | None = None, limit: int = PREVIEW_LIMIT) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(schema))[:limit]


def approx_rows(spark: SparkSession, name: str) -> int | None:
    """From the table's statistics, if it has any."""
    stats = spark.table(name)._jdf.queryExecution().optimizedPlan().stats().rowCount()
    return int(stats.get().toString()) if stats.isDefined() else None


def column_from_map(rows: DataFrame, name: str, data: str = "data", order: str = "row_num") -> DataFrame:
    """nv, literal_value (the first seen), source_frequency of one column of stored rows, commonest first."""
    cells = rows.select(F.col(data)[name].alias("raw"), F.col(order).alias("o")).where(F.col("raw").isNotNull())
    counts = cells.groupBy("raw").agg(F.count("*").alias("n"), F.min("o").alias("o")).withColumn("nv", normalize(F.col("raw"))).where(not_blank(F.col("nv")))
    return counts.groupBy("nv").agg(F.min_by("raw", F.struct("o", "raw")).alias("literal_value"), F.sum("n").alias("source_frequency")).orderBy(F.desc("source_frequency"), "nv")


def column_from_json(df: DataFrame, json_column: str, field: str) -> DataFrame:
    """distinct_values of one field of JSON text."""
    return distinct_values(df.select(F.get_json_object(f"`{json_column}`", f"$.{field}").alias("value")), "value")


def session_rows(rows: DataFrame, session: str) -> DataFrame:
    return rows.where(F.col("session_nonce") == session).orderBy("row_num")


def run_states(runs: DataFrame, ids: list[int]) -> DataFrame:
    return runs.where(F.col("run_id").isin(ids))


def peek(df: DataFrame, limit: int = PREVIEW_LIMIT) -> DataFrame:
    return df.limit(limit)


def described(rows: DataFrame) -> list[dict]:
    """columns() from the rows of a DESCRIBE statement (col_name, data_type), up to the first that isn't a column."""
    from itertools import takewhile

    own = takewhile(lambda r: r["col_name"] and not r["col_name"].startswith("#"), rows.collect())  # a row for each column
    text = ("string", "varchar", "char")
    return [{"name": r["col_name"], "ordinal": i, "type": r["data_type"], "is_text": (t := r["data_type"].split("(")[0].lower() in text), "reason": None if t else "not a text column"} for i, r in enumerate(own, 1)]


def key_columns(df: DataFrame, keys: list[str]) -> list[str]:
    """Declared key columns, as the table spells them and in key order; a catalog here knows none by itself."""
    named = {c.lower(): c for c in df.columns}
    if missing := [k for k in keys if k.lower() not in named]:
        raise ValueError(f"no such column: {', '.join(missing)}")
    return [named[k.lower()] for k in keys]

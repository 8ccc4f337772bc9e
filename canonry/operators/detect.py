"""Finding values that no mapping or queue knows yet, and the queue they wait in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import normalize, not_blank
from ..sources.tables import RUN_LIMIT, distinct_values


def unknown(values: DataFrame, mapping: DataFrame, queue: DataFrame, include_mapped: bool = False) -> DataFrame:
    """values (nv, ...) that aren't queued nor, unless include_mapped, mapped."""
    out = values if include_mapped else values.join(mapping.select("nv"), "nv", "left_anti")
    return out.join(queue.select(F.col("normalized_value").alias("nv")), "nv", "left_anti")


def reconcile(source: DataFrame, column: str, mapping: DataFrame, queue: DataFrame, limit: int | None = RUN_LIMIT) -> DataFrame:
    """The source's unknown values with their whole frequency; the limit comes after what is known has gone, so that
    each pass makes headway."""
    found = unknown(distinct_values(source, column), mapping, queue)
    return found if limit is None else found.orderBy(F.desc("source_frequency"), "nv").limit(limit)


def classify(changes: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """nv, literal_value, new_rows, known of the values that rows of a change feed bring in (op I or U)."""
    fresh = changes.where(F.col("op").isin("I", "U"))
    return distinct_values(fresh, column).join(mapping.select("nv", F.lit(True).alias("known")), "nv", "left").select("nv", "literal_value", F.col("source_frequency").alias("new_rows"), F.coalesce("known", F.lit(False)).alias("known"))


def change_flags(changes: DataFrame, column: str) -> DataFrame:
    """deletes (updates count, as they remove a value), blank_inserts and inserts, from one pass."""
    key = normalize(F.col(f"`{column}`").cast("string"))
    brings = F.col("op").isin("I", "U")
    return changes.select("op", key.alias("nv")).agg(
        F.count_if(F.col("op").isin("D", "U")).alias("deletes"),
        F.count_if(brings & ~F.coalesce(not_blank(F.col("nv")), F.lit(False))).alias("blank_inserts"),
        F.count_if(brings).alias("inserts"),
    )


def rebuild_needed(flags: dict, unmapped_rows: bool, kind: str) -> bool:
    """Whether an export must be made anew: rows went, blanks came, or raw rows pass through into a table."""
    return bool(flags["deletes"] or flags["blank_inserts"] or (unmapped_rows and kind == "table" and flags["inserts"]))


def choose_mode(keys: list[str], feed: bool, readable: bool) -> tuple[str, str | None]:
    """How a source is watched: "stream" with keys and a change feed that can be read, else "diff" and why."""
    reason = next((why for ok, why in ((keys, "no key columns"), (feed, "no change feed"), (readable, "the change feed can't be read")) if not ok), None)
    return ("diff", reason) if reason else ("stream", None)


def after_gap(seen: int | None, oldest: int, newest: int, recreated: bool = False) -> str:
    """What to do with a feed's position: "read" what is new, "wait" if nothing is, or "reconcile" the whole source and begin
    at newest, as changes may be lost: none was seen yet, the table was made anew, the position has gone, or it lies ahead."""
    if seen is None or recreated or seen < oldest - 1 or seen > newest:
        return "reconcile"
    return "read" if seen < newest else "wait"


def queue_rows(values: DataFrame, pipeline_id: int, now: Column) -> DataFrame:
    """nv, literal_value, source_frequency as queue rows."""
    return values.select(F.lit(pipeline_id).cast("long").alias("pipeline_id"), "literal_value", F.col("nv").alias("normalized_value"), F.col("source_frequency").cast("long").alias("source_frequency"), now.alias("detected_at"))


def merge_queue(queue: DataFrame, new: DataFrame, add: bool) -> DataFrame:
    """queue with new rows. add: frequencies add up, as for a feed; else the new one counts, as for a full scan. The
    first spelling and time stay."""
    both = queue.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    frequency = F.sum("source_frequency") if add else F.max_by("source_frequency", "_new")
    first = lambda c: F.min_by(c, F.struct("_new", "detected_at", "literal_value")).alias(c)
    return both.groupBy("pipeline_id", "normalized_value").agg(first("literal_value"), frequency.cast("long").alias("source_frequency"), first("detected_at")).select(*queue.columns)


def drop_overlong(values: DataFrame, column: str, cap: int | None) -> DataFrame:
    """Values within a cap of characters; no cap: all."""
    return values if cap is None else values.where(F.length(column) <= cap)


def drain(queue: DataFrame, pipeline_id: int, limit: int | None = RUN_LIMIT) -> DataFrame:
    """The oldest values of a pipeline, then by spelling; blanks never leave the queue this way."""
    own = queue.where((F.col("pipeline_id") == pipeline_id) & not_blank(F.col("normalized_value")))
    inorder = own.orderBy(F.asc_nulls_last("detected_at"), "literal_value")
    return inorder if limit is None else inorder.limit(limit)


def purge_blanks(queue: DataFrame) -> DataFrame:
    return queue.where(not_blank(F.col("normalized_value")))


def dequeue(queue: DataFrame, pipeline_id: int, done: DataFrame) -> DataFrame:
    """queue without what was exported (nv)."""
    gone = done.select(F.lit(pipeline_id).cast("long").alias("pipeline_id"), F.col("nv").alias("normalized_value")).distinct()
    return queue.join(gone, ["pipeline_id", "normalized_value"], "left_anti")


def settle(queue: DataFrame, pipeline_id: int, done: DataFrame) -> DataFrame:
    """queue after a drain exported done (nv, n): what came for a value after the drain read it stays, with that frequency."""
    gone = done.groupBy(F.col("nv").alias("_nv")).agg(F.max("n").alias("_n"))
    mine = (F.col("pipeline_id") == pipeline_id) & (F.col("normalized_value") == F.col("_nv"))
    rest = queue.join(gone, mine, "left").withColumn("source_frequency", F.col("source_frequency") - F.coalesce("_n", F.lit(0)))
    return rest.where(F.col("_n").isNull() | (F.col("source_frequency") > 0)).select(*queue.columns)


def clear_queue(queue: DataFrame, pipeline_id: int) -> DataFrame:
    return queue.where(F.col("pipeline_id") != pipeline_id)


def queue_sizes(queue: DataFrame) -> DataFrame:
    return queue.groupBy("pipeline_id").agg(F.count("*").alias("queue_size"), F.sum("source_frequency").alias("queued_rows"))


def queue_listing(queue: DataFrame, pipeline_id: int) -> DataFrame:
    return queue.where(F.col("pipeline_id") == pipeline_id).orderBy(F.asc_nulls_last("detected_at"), "literal_value")


def snapshot_changes(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """op, keys, column: inserted, updated and deleted rows between two snapshots, from one full outer join."""
    a = old.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.col(column).alias("_a_value"), F.lit(True).alias("_a"))
    b = new.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col(column).alias("_b_value"), F.lit(True).alias("_b"))
    on = [F.col(f"_a_{k}") == F.col(f"_b_{k}") for k in keys]
    op = F.when(F.col("_a").isNull(), "I").when(F.col("_b").isNull(), "D").when(~F.col("_a_value").eqNullSafe(F.col("_b_value")), "U")
    rows = a.join(b, on, "full").select(op.alias("op"), *[F.coalesce(f"_b_{k}", f"_a_{k}").alias(k) for k in keys], F.col("_b_value").alias(column))
    return rows.where(F.col("op").isNotNull())


def live_changes(changes: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Change rows (op and keys) with the live row's columns; deletes have none."""
    return changes.select("op", *keys).join(live, keys, "left")


def deleted_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the old snapshot that the new one lacks, as often as it lacks them."""
    return old.exceptAll(new)


def signature(spark, path: str) -> str:
    """Of a folder's files: names, sizes and times, read from the listing alone. Equal signatures: nothing to scan."""
    import hashlib

    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


def health(df: DataFrame, column: str) -> str | None:
    """Why a source can't be read; None if it can."""
    from pyspark.sql import types as T

    field = next((f for f in df.schema.fields if f.name.lower() == column.lower()), None)
    if field is None:
        return "column is missing"
    return None if isinstance(field.dataType, T.StringType) else "column is not text"

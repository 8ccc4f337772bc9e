"""The queue as keyed state of a stream: one entry for each pipeline and match key, kept by Spark's state store.

Rows of a change feed and rows that tell what a drain has exported come in one stream. Spark replays a batch that wasn't
committed from the same state, so every row counts once whatever fails; the queue's table follows the state, batch by
batch, and notes the batch in the same commit. Rows are added up where they are before they are shuffled, so that a value
that a third of all rows holds costs its key's task one row for each input batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.normalize import normalize, not_blank
from ..operators.commits import Files
from ..operators.store import Change, Snapshot, Store

#: Rows of the combined stream: values that came (n of them), or that a drain has exported (n of them).
CAME, DRAINED = "came", "drained"
EVENTS = "pipeline_id long, kind string, literal_value string, n long"
STATE = "literal_value string, source_frequency long, detected_at timestamp"
OUT = "pipeline_id long, normalized_value string, literal_value string, source_frequency long, detected_at timestamp, drained long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def came(changes: DataFrame, pipeline_id: int, column: str) -> DataFrame:
    """Events of a feed's rows (op, column): what inserts and updates bring in."""
    rows = changes.where(F.col("op").isin("I", "U") & F.col(f"`{column}`").isNotNull())
    return rows.select(F.lit(pipeline_id).cast("long").alias("pipeline_id"), F.lit(CAME).alias("kind"), F.col(f"`{column}`").cast("string").alias("literal_value"), F.lit(1).cast("long").alias("n"))


def drained(pipeline_id: int, done: list[tuple[str, int]]) -> str:
    """Events of what a drain has exported (spellings and their frequencies, an installment at most), as lines of JSON."""
    return "".join(json.dumps({"pipeline_id": pipeline_id, "kind": DRAINED, "literal_value": x, "n": n}) + "\n" for x, n in done)


def tell(store: Store, control: str, name: str, pipeline_id: int, done: list[tuple[str, int]]) -> None:
    """Put what a drain has exported where the stream finds it, once for each name. What is told in all, and by which name
    last, is noted first: a driver that fails in between leaves a name whose file is missing, to be told again."""
    told, last = f"told.{pipeline_id}", f"last.{pipeline_id}"

    def change(now: Snapshot) -> Change | None:
        marks = now.marks("queue")
        if marks.get(last) == name:
            return None
        return Change(marks={"queue": {told: str(int(marks.get(told, 0)) + sum(n for _, n in done)), last: name}})

    store.transact(change)
    Files(store.spark, control).create(f"{name}.json", drained(pipeline_id, done))


def last_told(store: Store, pipeline_id: int) -> str | None:
    return store.marks("queue").get(f"last.{pipeline_id}")


def settled(store: Store, pipeline_id: int) -> bool:
    """Whether the queue's table shows all that drains have told the stream. Until then another drain would see values that
    are done."""
    marks = store.marks("queue")
    return marks.get(f"told.{pipeline_id}", "0") == marks.get(f"drained.{pipeline_id}", "0")


def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Equal events of each input batch as one."""
    for batch in batches:
        yield batch.groupby(["pipeline_id", "kind", "literal_value"], sort=False, as_index=False)["n"].sum()


class Queued(StatefulProcessor):
    """The entry of a key: its spelling and time are those of the first batch that brought it, its frequency all that came
    less all that was drained. Within a batch, what was drained is taken off first: it came before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        spellings: dict[str, int] = {}
        gone = 0
        for batch in rows:
            for kind, literal, n in zip(batch["kind"], batch["literal_value"], batch["n"]):
                if kind == DRAINED:
                    gone += int(n)
                else:
                    spellings[literal] = spellings.get(literal, 0) + int(n)
        had = self.entry.get() if self.entry.exists() else None
        literal, count, at = had if had is not None else (None, 0, None)
        count = max(0, count - gone)
        if not count:
            literal, at = None, None
        if spellings:
            if literal is None:
                literal = min(spellings, key=lambda s: (-spellings[s], s))  # the commonest, then the first
                at = datetime.now(timezone.utc).replace(tzinfo=None)
            count += sum(spellings.values())
        if count:
            self.entry.update((literal, count, at))
        elif had is not None:
            self.entry.clear()
        yield pd.DataFrame({"pipeline_id": [key[0]], "normalized_value": [key[1]], "literal_value": [literal], "source_frequency": [count], "detected_at": pd.Series([at], dtype="datetime64[us]"), "drained": [gone]})

    def close(self) -> None:
        pass


def entries(events: DataFrame) -> DataFrame:
    """Each key's entry after every batch that has an event of it; frequency 0: it has left the queue."""
    keyed = events.mapInPandas(summed, EVENTS).withColumn("normalized_value", normalize(F.col("literal_value"))).where(not_blank(F.col("normalized_value")))
    return keyed.groupBy("pipeline_id", "normalized_value").transformWithStateInPandas(Queued(), outputStructType=OUT, outputMode="Update", timeMode="None")


def follow(store: Store, name: str, batch: DataFrame, batch_id: int, table: str = "queue") -> bool:
    """Bring the queue's table up to the state after a batch. False: it was there already."""
    batch = batch.persist()
    mark = f"stream.{name}"
    done = False

    def change(now: Snapshot) -> Change | None:
        nonlocal done
        done = int(now.marks(table).get(mark, -1)) < batch_id
        if not done:
            return None
        queue = now.read(table)
        rest = queue.join(batch.select("pipeline_id", "normalized_value"), ["pipeline_id", "normalized_value"], "left_anti").select(*queue.columns)
        noted = {f"drained.{r['pipeline_id']}": str(int(now.marks(table).get(f"drained.{r['pipeline_id']}", 0)) + r["n"]) for r in gone}
        return Change({table: rest.unionByName(batch.where("source_frequency > 0").select(*queue.columns))}, {table: noted | {mark: str(batch_id)}})

    try:
        gone = batch.where("drained > 0").groupBy("pipeline_id").agg(F.sum("drained").alias("n")).collect()  # a row for each pipeline
        store.transact(change)
    finally:
        batch.unpersist()
    return done


def watched(spark: SparkSession, changes: DataFrame, pipeline_id: int, column: str, control: str) -> DataFrame:
    """A pipeline's events: its feed's rows as a stream, and what drains put into the control folder."""
    Files(spark, control).make()
    return came(changes, pipeline_id, column).unionByName(spark.readStream.schema(EVENTS).json(control))


def start(store: Store, name: str, events: DataFrame, checkpoint: str, every: str | None = "1 minute") -> StreamingQuery:
    """Run a stream of events into the queue. every: None takes what is there and stops. The checkpoint folder holds the
    state, so it has to be shared and kept; a name goes with it."""
    spark: SparkSession = store.spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    writer = entries(events).writeStream.outputMode("update").queryName(name).foreachBatch(lambda df, n: follow(store, name, df, n) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

"""Change feeds: what rows bring in joins the queue exactly once, with the feed's position in the same commit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import detect
from ..operators.store import Change, Snapshot, Store
from ..sources.tables import distinct_values


@dataclass
class ChangeLog:
    """A feed that is kept as a table: op (I, U or D), the source's columns, and the version of the change that a row is of.

    read: gives the table as it is now. table: names this making of the source; another one when it was made anew.
    since: the version before the oldest that the feed still has, where its keeper knows it.
    """

    read: Callable[[], DataFrame]
    table: str = ""
    version: str = "_version"
    since: int | None = None

    def bounds(self) -> tuple[int, int]:
        """The oldest and newest version; an empty feed has its newest just before its oldest."""
        got = self.read().agg(F.min(self.version).alias("oldest"), F.max(self.version).alias("newest")).first()
        oldest = self.since + 1 if self.since is not None else (1 if got["oldest"] is None else got["oldest"])
        return oldest, oldest - 1 if got["newest"] is None else got["newest"]

    def between(self, after: int, to: int) -> DataFrame:
        return self.read().where((F.col(self.version) > after) & (F.col(self.version) <= to))


def consume(store: Store, pipeline_id: int, column: str, changes: DataFrame, mark: str, position: int, more: dict[str, str] | None = None) -> dict | None:
    """Queue the non-blank values that rows of a feed (op, column) bring in, mapped ones too, adding frequencies, and note
    the position: both in one commit, which is made again on top of whatever another driver commits meanwhile.

    Returns the flags of the changes and how many values came; None if the position was noted before.
    """
    changes = changes.persist()
    new = detect.queue_rows(distinct_values(changes.where(F.col("op").isin("I", "U")), column), pipeline_id, F.current_timestamp()).persist()
    applied = False

    def change(now: Snapshot) -> Change | None:
        nonlocal applied
        applied = int(now.marks("queue").get(mark, -1)) >= position
        if applied:
            return None
        return Change({"queue": detect.merge_queue(now.read("queue"), new, add=True)} if flags["values"] else {}, {"queue": {mark: str(position)} | (more or {})})

    try:
        flags = detect.change_flags(changes, column).first().asDict() | {"values": new.count()}
        store.transact(change)
    finally:
        new.unpersist()
        changes.unpersist()
    return None if applied else flags


class QueueFeed:
    """Consumes rows (op, column, ...) of one pipeline. Batches that were applied before a restart are skipped."""

    def __init__(self, store: Store, pipeline_id: int, column: str, on_flags: Callable[[dict], None] | None = None) -> None:
        self.store, self.pipeline_id, self.column, self.on_flags = store, pipeline_id, column, on_flags

    def apply(self, batch: DataFrame, batch_id: int) -> bool:
        """Queue what rows bring in. False: it was done before."""
        flags = consume(self.store, self.pipeline_id, self.column, batch, f"batch.{self.pipeline_id}", batch_id)
        if flags is not None and self.on_flags:
            self.on_flags({k: v for k, v in flags.items() if k != "values"})
        return flags is not None

    def start(self, changes: DataFrame, checkpoint: str, every: str | None = "1 minute") -> StreamingQuery:
        """every: None takes what is there and stops."""
        writer = changes.writeStream.foreachBatch(lambda df, n: self.apply(df, n) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

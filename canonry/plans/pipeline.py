"""Pipelines: detection, scheduled standardization, sweeps and their states, one watched column each."""

from __future__ import annotations

import threading
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.conventions import spec_errors
from ..functions.normalize import normalize_value
from ..functions.schedule import DEFAULT, PAUSE_AFTER, Schedule, backoff_minutes
from ..functions.text import classify_error, map_name, quoted
from ..operators import detect, export, leases, mappings, maps
from ..operators.grouping import Grouper, Run, auto_group, items_of, run_document, run_of
from ..operators.leases import Lease, holds
from ..operators.store import Change, Conflict, Snapshot, Store
from ..sources.incremental import FileSummaries
from ..sources.keys import discover_keys
from ..sources.tables import RUN_LIMIT, distinct_values, key_columns, raw_counts, values_of
from ..streaming import keyed
from ..streaming.feed import ChangeLog, consume

#: After so long, a run that is being written or failed is gone on with, and a pipeline's lease has run out.
STALE = timedelta(minutes=30)
BLOCKED = ("source_missing", "source_unreadable", "permission")
TIMES = ("retry_at", "last_polled_at", "synced_at", "created_at")


@dataclass
class Pipeline:
    pipeline_id: int
    table: str
    column: str
    spec_id: int
    spec: dict
    export_name: str | None = None
    export_kind: str = "table"
    unmapped_rows: bool = False
    schedule: Schedule = DEFAULT
    status: str = "pending_baseline"
    reason: str | None = None
    message: str | None = None
    failures: int = 0
    retry_at: datetime | None = None
    signature: str | None = None
    queue_size: int | None = None
    keys: list[str] = field(default_factory=list)
    mode: str = "diff"
    mode_reason: str | None = None
    queue_run: int | None = None
    control: str | None = None
    last_polled_at: datetime | None = None
    synced_at: datetime | None = None
    created_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def blocked(self) -> bool:
        return self.reason in BLOCKED


def pipeline_document(pipeline: Pipeline) -> dict:
    """As JSON values."""
    return {k: v.isoformat() if isinstance(v, datetime) else v for k, v in asdict(pipeline).items()}


def pipeline_of(d: dict) -> Pipeline:
    schedule = Schedule(**d["schedule"] | {"days": tuple(d["schedule"]["days"])})
    return Pipeline(**d | {"schedule": schedule} | {t: datetime.fromisoformat(d[t]) if d[t] else None for t in TIMES})


class Engine:
    """Runs pipelines over a store, which other drivers' engines may share. source(name) gives a table as a DataFrame,
    feeds(name) its change feed and folders(name) the folder of its Parquet files, if there is one, declared(name) its
    primary, unique and clustering keys.

    Whatever is read, changed and published goes through one commit of the store. A drain or a written run holds its
    pipeline's lease: a driver that stalls for longer than STALE can't publish over the one that went on.
    """

    def __init__(self, store: Store, source: Callable[[str], DataFrame], grouper: Grouper, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), feeds: Callable[[str], ChangeLog | None] = lambda table: None, folders: Callable[[str], str | None] = lambda table: None, declared: Callable[[str], dict[str, list[list[str]]]] = lambda table: {}) -> None:
        self.store, self.spark, self.source, self.grouper, self.clock, self.feeds, self.folders, self.declared = store, store.spark, source, grouper, clock, feeds, folders, declared
        self.holder = uuid.uuid4().hex
        self.pipelines: dict[int, Pipeline] = {}
        self.builds: dict[str, threading.Lock] = defaultdict(threading.Lock)
        self.listeners: list[Callable[[str, dict], None]] = []

    def tell(self, event: str, **data) -> None:
        for listener in self.listeners:
            listener(event, data)

    # life cycle

    def create(self, table: str, column: str, spec: dict, **options) -> Pipeline:
        """A pipeline on a text column. An unfinished one on the same column is replaced; a live one is refused."""
        if problems := spec_errors(spec):
            raise ValueError("; ".join(problems))
        if problem := detect.health(self.source(table), column):
            raise ValueError(problem)
        self.load_state()
        for p in list(self.pipelines.values()):
            if (p.table.lower(), p.column.lower()) == (table.lower(), column.lower()):
                if p.status != "pending_baseline":
                    raise ValueError("the column is watched already")
                self.delete(p.pipeline_id)
        if options.get("export_name"):
            export.guard(table, options["export_name"], claims={p.export_name: p.table for p in self.pipelines.values() if p.export_name})
        options["keys"] = self.keys_of(table, options.get("keys"))
        number = self.store.new_id("pipelines")
        self.pipelines[number] = pipeline = Pipeline(number, table, column, number, spec, created_at=self.clock(), **options)
        self.choose(pipeline)
        if spec.get("seeds"):
            self.seed(pipeline, spec["seeds"])
        self.keep(pipeline)
        return pipeline

    def keys_of(self, table: str, keys: list[str] | str | None) -> list[str]:
        """Columns that exports are laid out by: those given, or those declared, or with "discover" those found."""
        source = self.source(table)
        if keys == "discover":
            return discover_keys(source)
        return key_columns(source, keys or export.ordering(self.declared(table)))

    def choose(self, pipeline: Pipeline) -> None:
        """How the source is watched: by its feed, from where that is now (what is in the source already is the first run's
        work), or by scans, and why."""
        feed = self.feeds(pipeline.table)
        bounds = None
        if feed is not None:
            try:
                bounds = feed.bounds()
            except Exception:  # noqa: BLE001  whatever keeps it from being read, the source is scanned
                bounds = None
        pipeline.mode, pipeline.mode_reason = detect.choose_mode(pipeline.keys, feed is not None, bounds is not None)
        if pipeline.mode == "stream":
            marks = {"queue": {self.position(pipeline): str(bounds[1]), self.made(pipeline): feed.table}}
            self.store.transact(lambda now: Change(marks=marks))

    def delete(self, pipeline_id: int) -> None:
        """The pipeline, its queue and its unfinished run go; exports and mappings stay."""
        pipeline = self.pipelines.pop(pipeline_id)
        self.store.transact(lambda now: Change({"queue": detect.clear_queue(now.read("queue"), pipeline_id)}))
        if pipeline.queue_run is not None and (run := self.run(pipeline.queue_run)) and run.status != "completed":
            self.step(run, "abandoned")
        self.store.forget("pipelines", pipeline_id)

    def resume(self, pipeline: Pipeline) -> None:
        pipeline.status, pipeline.reason, pipeline.message, pipeline.failures, pipeline.retry_at = "active", None, None, 0, None
        self.keep(pipeline)
        self.refresh(pipeline)

    def pause(self, pipeline: Pipeline, reason: str, message: str) -> None:
        pipeline.status, pipeline.reason, pipeline.message = "paused", reason, message
        self.keep(pipeline)
        self.tell("alert", pipeline_id=pipeline.pipeline_id, reason=reason, message=message)

    def seed(self, pipeline: Pipeline, literals: list[str]) -> None:
        rows = self.spark.createDataFrame([(x,) for x in literals], "literal_value string")
        fresh = [r["literal_value"] for r in mappings.seed_rows(rows, self.store.read("literal_matches"), pipeline.spec_id).collect()]
        self.confirm(pipeline, [(x, x) for x in fresh], 0)

    # state

    def now(self):
        return F.lit(self.clock().replace(tzinfo=None)).cast("timestamp")

    def mapping(self, pipeline: Pipeline, state: Snapshot | None = None) -> DataFrame:
        state = state or self.store.snapshot()
        return mappings.lookup(state.read("literal_matches"), state.read("approved_names"), pipeline.spec_id)

    def confirm(self, pipeline: Pipeline, pairs: list[tuple[str, str]], run_id: int, lease: Lease | None = None) -> None:
        """Write literals and their names, in one commit."""
        if not pairs:
            return
        decided = self.spark.createDataFrame([(x, n, pipeline.spec_id, i) for i, (x, n) in enumerate(pairs)], "literal_value string, alias_name string, spec_id long, seq int")

        def change(state: Snapshot) -> Change:
            names, matches = state.read("approved_names"), state.read("literal_matches")
            last = lambda df, c: df.agg({c: "max"}).first()[0] or 0
            names = mappings.upsert_names(names, decided, self.now(), last(names, "alias_id"))
            ids = names.where(mappings.in_scope(pipeline.spec_id)).select("alias_name", "alias_id")
            rows = decided.join(ids, "alias_name").select("literal_value", "alias_id", "spec_id", "seq")
            return Change({"approved_names": names, "literal_matches": mappings.upsert_matches(matches, rows, self.now(), run_id, last(matches, "match_id"))})

        self.store.transact(holds(lease, change))

    def keep(self, pipeline: Pipeline) -> None:
        """The pipeline as it is now, for other drivers and after a restart."""
        if pipeline.pipeline_id in self.pipelines:
            self.store.update("pipelines", pipeline.pipeline_id, lambda _: pipeline_document(pipeline))

    def load_state(self) -> None:
        """All pipelines as they were last kept, by whichever driver; objects of this one stay the same objects."""
        for i in self.store.ids("pipelines"):
            if (kept := self.store.load("pipelines", i)[1]) is not None:
                fresh = pipeline_of(kept)
                if i in self.pipelines:
                    self.pipelines[i].__dict__.update(fresh.__dict__)
                else:
                    self.pipelines[i] = fresh
        for i in set(self.pipelines) - set(self.store.ids("pipelines")):
            del self.pipelines[i]

    def run(self, run_id: int) -> Run | None:
        rev, kept = self.store.load("runs", run_id)
        if kept is None:
            return None
        run = run_of(kept)
        run.rev = rev
        return run

    def save_run(self, run: Run) -> Run:
        """Conflict if another driver saved it since this one read it."""
        run.changed_at = self.clock()
        run.rev = self.store.save("runs", run.run_id, run_document(run), run.rev)
        return run

    def step(self, run: Run, status: str) -> Run:
        run.status = status
        return self.save_run(run)

    # runs

    def open_run(self, pipeline: Pipeline, limit: int = RUN_LIMIT) -> Run:
        """A run over the pipeline's queue as it is now. One that an earlier attempt left is used again, whole: one that was
        created or running, or has been in validation or failed for longer than STALE; else there is a new one."""
        rows = detect.drain(self.store.read("queue"), pipeline.pipeline_id, limit).select(F.col("normalized_value").alias("nv"), "literal_value", "source_frequency")
        fresh = self.run_over(pipeline, rows)
        if pipeline.queue_run is not None and (old := self.run(pipeline.queue_run)) is not None:
            stale = old.changed_at is not None and self.clock() - old.changed_at > STALE
            if old.status in ("created", "running") or (old.status in ("validating", "failed") and stale):
                fresh.run_id, fresh.rev = old.run_id, old.rev
        if not fresh.run_id:
            fresh.run_id, fresh.rev = self.store.new_id("runs"), 1
        self.save_run(fresh)
        if pipeline.queue_run != fresh.run_id:
            pipeline.queue_run = fresh.run_id
            self.keep(pipeline)
        return fresh

    def initial_run(self, pipeline: Pipeline, limit: int = RUN_LIMIT) -> Run:
        values = distinct_values(self.source(pipeline.table), pipeline.column, limit)
        run = self.grouped(pipeline, self.run_over(pipeline, values))
        run.run_id, run.rev = self.store.new_id("runs"), 1
        return self.save_run(run)

    def run_over(self, pipeline: Pipeline, values: DataFrame) -> Run:
        """Items of values, with the names that the lookup has; not kept, and without a number."""
        known = {r["nv"]: r["alias_name"] for r in values.select("nv").join(self.mapping(pipeline), "nv").collect()}
        items = items_of(((r["literal_value"], r["source_frequency"]) for r in values.orderBy(F.desc("source_frequency"), "nv").collect()), known)
        return Run(0, pipeline.spec_id, items, changed_at=self.clock())

    def grouped(self, pipeline: Pipeline, run: Run) -> Run:
        literals = self.spark.createDataFrame([(i.literal,) for i in run.items], "literal_value string")
        names = mappings.known_names(self.store.read("approved_names").where(mappings.in_scope(pipeline.spec_id)), literals).collect()
        return auto_group(self.spark, run, self.grouper, [r["alias_name"] for r in names], pipeline.spec.get("convention_rules"))

    def propose(self, pipeline: Pipeline, values: DataFrame) -> Run:
        """What grouping values would give; nothing is kept."""
        return self.grouped(pipeline, self.run_over(pipeline, values))

    def approve(self, pipeline: Pipeline, run: Run) -> None:
        """Accepted, to be written when the pipeline is committed."""
        self.step(run, "approved")
        pipeline.status = "paused"
        self.keep(pipeline)

    def commit(self, pipeline: Pipeline, run: Run) -> dict:
        """Write a reviewed run: items_written, aliases_updated, already_in_progress. A run that is being written, or is
        written, isn't written again, whichever driver does it; one that failed may be."""
        told = {"items_written": len(run.mappings()), "aliases_updated": len({g.name for g in run.groups})}
        kept = self.run(run.run_id)
        if kept is None or kept.status in ("validating", "completed"):
            return told | {"already_in_progress": True}
        try:
            run.rev = kept.rev
            self.step(run, "validating")
        except Conflict:  # another driver was first
            return told | {"already_in_progress": True}
        try:
            self.confirm(pipeline, run.mappings(), run.run_id)
            if pipeline.status == "pending_baseline" or (pipeline.status == "paused" and pipeline.reason is None):
                pipeline.status = "active"
                pipeline.synced_at = pipeline.created_at
            self.keep(pipeline)
            self.refresh(pipeline)
        except Exception:
            self.step(run, "failed")
            raise
        self.step(run, "completed")
        return told | {"already_in_progress": False}

    # detection

    def position(self, pipeline: Pipeline) -> str:
        return f"feed.{pipeline.pipeline_id}"

    def made(self, pipeline: Pipeline) -> str:
        return f"feedtable.{pipeline.pipeline_id}"

    def poll(self, pipeline: Pipeline, signature: str | None = None) -> int:
        """Queue what is new in the source: from its feed, or its unknown values by a scan, unless the signature is the one
        of the last. Returns how many values came."""
        if pipeline.status != "active":
            return 0
        if pipeline.mode == "stream":
            return self.poll_feed(pipeline, self.feeds(pipeline.table))
        if signature is not None and signature == pipeline.signature:
            return 0
        try:
            source = self.source(pipeline.table)
            if problem := detect.health(source, pipeline.column):
                self.pause(pipeline, "source_missing", problem)
                return 0
            new = self.reconcile(pipeline)
        except Exception as e:
            if classify_error(e) == "table":
                self.pause(pipeline, "source_missing", str(e)[:500])
                return 0
            raise
        pipeline.signature = signature
        self.checked(pipeline)
        return new

    def checked(self, pipeline: Pipeline, fresh: bool = True) -> None:
        """Metrics after a poll. fresh: the source was truly read up to now, so an empty queue means that all is done."""
        pipeline.queue_size = self.queued(pipeline)
        pipeline.last_polled_at = self.clock()
        if fresh and not pipeline.queue_size:
            pipeline.synced_at = self.clock()
        self.keep(pipeline)
        self.tell("metrics", pipeline_id=pipeline.pipeline_id, queue_size=pipeline.queue_size)

    def queued(self, pipeline: Pipeline) -> int:
        return self.store.read("queue").where(F.col("pipeline_id") == pipeline.pipeline_id).count()

    def poll_feed(self, pipeline: Pipeline, feed: ChangeLog | None) -> int:
        """Queue what the feed has brought since the position that the queue's last commit of it names. Where changes may be
        lost (first poll, source made anew, position gone or ahead), the feed is taken up at its newest and the whole source
        is reconciled, in one commit; the export is made anew, and freshness isn't claimed."""
        try:
            oldest, newest = feed.bounds()
        except Exception:  # noqa: BLE001
            pipeline.mode, pipeline.mode_reason = detect.choose_mode(pipeline.keys, feed is not None, False)
            self.keep(pipeline)
            return self.poll(pipeline)
        marks = self.store.marks("queue")
        seen = marks.get(self.position(pipeline))
        todo = detect.after_gap(None if seen is None else int(seen), oldest, newest, marks.get(self.made(pipeline), feed.table) != feed.table)
        if todo == "wait":
            self.checked(pipeline)
            return 0
        if todo == "read":
            return self.poll_changes(pipeline, feed.between(int(seen), newest), newest)
        new = self.reconcile(pipeline, {self.position(pipeline): str(newest), self.made(pipeline): feed.table})
        self.tell("gap", pipeline_id=pipeline.pipeline_id, position=newest)
        self.refresh(pipeline)
        self.checked(pipeline, fresh=False)
        return new

    def poll_changes(self, pipeline: Pipeline, changes: DataFrame, position: int | None = None) -> int:
        """Queue all values that rows of a change feed (op, column) bring in, mapped ones too, adding frequencies; the source
        isn't scanned. New values wait for the drain: only deletes, updates, new blanks, or raw rows that pass through make
        the export anew. position: of the last change; changes up to it count once. Returns how many values came."""
        if pipeline.status != "active":
            return 0
        mark = self.position(pipeline)
        if position is None:
            position = int(self.store.marks("queue").get(mark, 0)) + 1
        flags = consume(self.store, pipeline.pipeline_id, pipeline.column, changes, mark, position)
        if flags is None:
            return 0
        if detect.rebuild_needed(flags, pipeline.unmapped_rows, pipeline.export_kind):
            self.refresh(pipeline)
        self.checked(pipeline)
        return flags["values"]

    def counts(self, pipeline: Pipeline) -> DataFrame:
        """raw, n of the watched column: over summaries of the source's files where it is a folder, so that only files that
        have changed are read."""
        if folder := self.folders(pipeline.table):
            summaries = FileSummaries(self.store, f"files_{pipeline.pipeline_id}", folder, pipeline.column)
            summaries.refresh()
            return summaries.counts()
        return raw_counts(self.source(pipeline.table), pipeline.column)

    def watch(self, pipeline: Pipeline, changes: DataFrame, folder: str, every: str | None = "1 minute") -> StreamingQuery:
        """Keep the pipeline's queue as the state of a stream of changes (op, column). folder: shared and kept; the stream's
        checkpoint is there, and what drains tell it. Rows count once whatever fails, the driver too."""
        pipeline.control = f"{folder}/drained"
        self.keep(pipeline)
        events = keyed.watched(self.spark, changes, pipeline.pipeline_id, pipeline.column, pipeline.control)
        return keyed.start(self.store, f"pipeline_{pipeline.pipeline_id}", events, f"{folder}/checkpoint", every)

    def take_off(self, pipeline: Pipeline, run: Run, lease: Lease) -> None:
        """What a drain has exported leaves the queue; what came for a value meanwhile stays."""
        if pipeline.control:
            lease.check(self.store.snapshot())
            keyed.tell(self.store, pipeline.control, f"{run.run_id}-{run.rev}", pipeline.pipeline_id, [(i.literal, i.frequency) for i in run.items])
            return
        done = self.spark.createDataFrame([(normalize_value(i.literal), i.frequency) for i in run.items], "nv string, n long")
        self.store.transact(holds(lease, lambda now: Change({"queue": detect.purge_blanks(detect.settle(now.read("queue"), pipeline.pipeline_id, done))})))

    def reconcile(self, pipeline: Pipeline, marks: dict[str, str] | None = None) -> int:
        """Queue the source's unknown values, with notes of the same commit; returns how many were new."""
        found = detect.queue_rows(detect.unknown(values_of(self.counts(pipeline)), self.mapping(pipeline), self.store.read("queue").limit(0)), pipeline.pipeline_id, self.now()).persist()
        new = 0

        def change(state: Snapshot) -> Change:
            nonlocal new
            queue = state.read("queue")
            own = queue.where(F.col("pipeline_id") == pipeline.pipeline_id).select("normalized_value")
            rest = found.join(own, "normalized_value", "left_anti").orderBy(F.desc("source_frequency"), "normalized_value").limit(RUN_LIMIT).select(*queue.columns)
            new = rest.count()
            return Change({"queue": detect.merge_queue(queue, rest, add=False)} if new else {}, {"queue": marks} if marks else {})

        try:
            self.store.transact(change)
        finally:
            found.unpersist()
        pipeline.queue_size = self.queued(pipeline)
        self.keep(pipeline)
        self.tell("metrics", pipeline_id=pipeline.pipeline_id, queue_size=pipeline.queue_size)
        return new

    def poll_table(self, table: str, signature: str | None = None) -> int:
        """All columns of a table in one pass with one time; each export is rebuilt at most once, if rows changed."""
        own = [p for p in self.pipelines.values() if p.table.lower() == table.lower()]
        changed = [p for p in own if signature is None or p.signature != signature]
        new = sum(self.poll(p, signature) for p in own)
        for p in {p.export_name.lower(): p for p in changed if p.export_name and p.status == "active"}.values():
            self.refresh(p)
        at = self.clock()
        for p in own:
            p.last_polled_at = at
            self.keep(p)
        return new

    def process_now(self, pipeline: Pipeline) -> int:
        """Drain by hand: an empty queue is reconciled first; installments follow until the queue is empty."""
        if not self.queued(pipeline):
            self.reconcile(pipeline)
        done = 0
        while got := self.drain(pipeline):
            done += got
        return done

    # standardization

    def drain(self, pipeline: Pipeline, limit: int = RUN_LIMIT) -> int:
        """One installment of the queue: grouped, confirmed, exported and dequeued. Returns its size; 0 too while another
        drain of the pipeline goes on, here or in another driver, or a stream hasn't taken off what the last one exported."""
        lease = leases.take(self.store, f"lease_{pipeline.pipeline_id}", self.holder, self.clock(), STALE)
        if lease is None:
            return 0
        run = None
        try:
            if pipeline.control and not keyed.settled(self.store, pipeline.pipeline_id):
                # the stream hasn't yet taken off what the last drain exported; it may not even have been told
                if (last := keyed.last_told(self.store, pipeline.pipeline_id)) and (told := self.run(int(last.split("-")[0]))):
                    keyed.tell(self.store, pipeline.control, last, pipeline.pipeline_id, [(i.literal, i.frequency) for i in told.items])
                return 0
            if not self.queued(pipeline):
                pipeline.queue_size = 0
                return 0
            run = self.open_run(pipeline, limit)
            if not run.items:
                self.step(run, "completed")
                return 0
            self.step(run, "running")
            run = self.step(self.grouped(pipeline, run), "validating")
            self.confirm(pipeline, run.mappings(), run.run_id, lease)
            self.refresh(pipeline, lease)
            self.take_off(pipeline, run, lease)
            self.step(run, "completed")
            pipeline.queue_size = self.queued(pipeline)
            if not pipeline.queue_size:
                pipeline.synced_at = self.clock()
            pipeline.failures, pipeline.retry_at = 0, None
            self.keep(pipeline)
            return len(run.items)
        except leases.Lost:  # the one who went on accounts for the run
            raise
        except Exception as e:
            if run is not None and run.status != "completed":
                self.step(run, "failed")
            pipeline.failures += 1
            pipeline.retry_at = self.clock() + timedelta(minutes=backoff_minutes(pipeline.failures))
            self.keep(pipeline)
            if pipeline.failures >= PAUSE_AFTER:
                self.pause(pipeline, "failures", str(e)[:500])
            raise
        finally:
            leases.release(self.store, lease)

    def tick(self) -> dict[int, int]:
        """Drain what is due: active, not blocked, window open, not backing off, and with a queue or an unknown one."""
        out = {}
        for p in self.pipelines.values():
            due = p.status == "active" and not p.blocked() and p.schedule.active(self.clock()) and p.queue_size != 0
            if due and (p.retry_at is None or p.retry_at <= self.clock()):
                try:
                    out[p.pipeline_id] = self.drain(p)
                except Exception as e:  # noqa: BLE001  one pipeline's failure isn't another's
                    self.tell("failed", pipeline_id=p.pipeline_id, error=str(e)[:500])
        return out

    def busy(self, pipeline: Pipeline) -> bool:
        """Whether some driver drains it now."""
        held = self.store.marks(f"lease_{pipeline.pipeline_id}")
        return bool(held.get("holder")) and datetime.fromisoformat(held["until"]) > self.clock()

    def sweep(self) -> None:
        """Reconcile every active pipeline, except in a closed window or while it is busy, and rebuild each export once."""
        built = set()
        for p in self.pipelines.values():
            closed = p.schedule.kind == "window" and not p.schedule.active(self.clock())
            if p.status != "active" or p.blocked() or closed or self.busy(p):
                continue
            self.reconcile(p)
            if p.export_name and p.export_name.lower() not in built:
                built.add(p.export_name.lower())
                self.refresh(p)

    # exports

    def siblings(self, pipeline: Pipeline) -> dict[str, Pipeline]:
        """Pipelines that share the export, by column; the caller counts even before it is active."""
        same = [p for p in self.pipelines.values() if p.export_name and pipeline.export_name and p.export_name.lower() == pipeline.export_name.lower() and p.table.lower() == pipeline.table.lower() and p.status == "active"]
        return {p.column.upper(): p for p in [*same, pipeline]}

    def refresh(self, pipeline: Pipeline, lease: Lease | None = None) -> None:
        """Make the export anew. Builds of one target follow each other here; of those of several drivers the one that rests
        on the newest mappings is what stays."""
        if not pipeline.export_name or pipeline.export_kind == "none":
            return
        with self.builds[pipeline.export_name.lower()]:

            source = self.source(pipeline.table)
            named = {c.upper(): c for c in source.columns}
            if pipeline.export_kind == "view":
                self.refresh_view(pipeline, {named[c]: p for c, p in self.siblings(pipeline).items()})
                return
            if pipeline.export_kind == "column" and pipeline.signature is not None and self.store.marks(pipeline.export_name).get("signature") == pipeline.signature:
                # the source is as it was: only rows whose names changed, in the files that hold them
                export.sync_companions(self.store, pipeline.export_name, {named[c]: self.mapping(p) for c, p in self.siblings(pipeline).items()})
                self.tell("exported", pipeline_id=pipeline.pipeline_id, target=pipeline.export_name)
                return

            def change(state: Snapshot) -> Change:
                names = {named[c]: self.mapping(p, state) for c, p in self.siblings(pipeline).items()}
                made = export.companion_columns(source, names) if pipeline.export_kind == "column" else export.standardize(source, names, pipeline.unmapped_rows)
                return Change({pipeline.export_name: export.ordered(made, pipeline.keys)}, {pipeline.export_name: {"signature": pipeline.signature or ""}})

            self.store.transact(holds(lease, change))
            self.tell("exported", pipeline_id=pipeline.pipeline_id, target=pipeline.export_name)

    def refresh_view(self, pipeline: Pipeline, watched: dict[str, Pipeline]) -> None:
        """Bring the maps of a view up to date; the view itself stays, once made, and shows the live source."""
        tables = {c: f"map_{map_name(pipeline.export_name, c)}" for c in watched}
        for c, p in watched.items():
            maps.sync_map(self.store, tables[c], self.counts(p), self.mapping(p))
        sql = maps.view_over_maps(pipeline.table, self.spark.table(pipeline.table).columns, {c: self.store.name(t) for c, t in tables.items()}, pipeline.unmapped_rows)
        self.spark.sql(f"CREATE OR REPLACE VIEW {quoted(self.store.name(pipeline.export_name))} AS {sql}")
        self.tell("exported", pipeline_id=pipeline.pipeline_id, target=pipeline.export_name)

    def metrics(self, pipeline: Pipeline) -> dict:
        return mappings.column_metrics(distinct_values(self.source(pipeline.table), pipeline.column), self.mapping(pipeline)).first().asDict()

    def listing(self) -> list[Pipeline]:
        oldest = datetime.min.replace(tzinfo=timezone.utc)
        return sorted(self.pipelines.values(), key=lambda p: (p.last_polled_at or oldest, p.created_at), reverse=True)

"""One-time standardization of a table or file: grouped without the lookup, exported, and remembered by session.

Sessions, their rows and files are kept in the store, so that another driver, or this one after a restart, goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import normalize_value
from ..sources.tables import distinct_values
from . import export
from .grouping import ONE_TIME_LIMIT, Grouper, Run, auto_group, items_of, run_document, run_of
from .store import Change, Snapshot, Store, hashed


@dataclass
class Session:
    """nonce: names the session. runs: by column. table: where its rows are; stored: whether in the store, as rows of a file
    are. file: whether it has one."""

    nonce: str
    table: str
    stored: bool
    runs: dict[str, Run] = field(default_factory=dict)
    target: str | None = None
    file: bool = False
    rev: int = 0


class OneTime:
    """source(name) gives a table as a DataFrame."""

    def __init__(self, store: Store, source: Callable[[str], DataFrame] | None = None, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> None:
        self.store, self.spark, self.source, self.clock = store, store.spark, source or store.read, clock

    # state

    def session(self, nonce: str) -> Session:
        rev, kept = self.store.load("sessions", nonce)
        if kept is None:
            raise KeyError(nonce)
        return Session(**kept | {"runs": {c: run_of(d) for c, d in kept["runs"].items()}, "rev": rev})

    def keep(self, session: Session) -> Session:
        """Whole; no earlier save stands in its way."""
        document = {k: v for k, v in session.__dict__.items() if k != "rev"} | {"runs": {c: run_document(r) for c, r in session.runs.items()}}
        session.rev = self.store.update("sessions", session.nonce, lambda _: document)
        return session

    def archived(self, session: Session, written: bool) -> None:
        """One row for each session: when it was opened, and last written to where."""
        at = F.lit(self.clock().replace(tzinfo=None)).cast("timestamp")
        none = F.lit(None).cast("timestamp")

        def change(now: Snapshot) -> Change:
            have = now.read("archive")
            old = have.where(F.col("session_nonce") == session.nonce)
            opened = old.agg(F.min("opened_at")).first()[0] if written else None
            row = self.spark.createDataFrame([(session.nonce, session.target, list(session.runs))], "session_nonce string, target string, columns array<string>")
            row = row.select("*", (F.lit(opened).cast("timestamp") if opened is not None else at).alias("opened_at"), (at if written else none).alias("written_at"))
            return Change({"archive": have.where(F.col("session_nonce") != session.nonce).unionByName(row)})

        self.store.transact(change)

    def rows(self, session: Session) -> DataFrame:
        return self.store.read(session.table) if session.stored else self.source(session.table)

    def open(self, nonce: str, source: DataFrame | str, columns: list[str], file: bytes | None = None) -> Session:
        """A session with a run for each column; more distinct values than ONE_TIME_LIMIT are refused. source: a table's name,
        or rows, which are kept then."""
        session = Session(nonce, source if isinstance(source, str) else f"rows_{hashed(nonce)}", not isinstance(source, str), file=file is not None)
        found = self.source(source) if isinstance(source, str) else source
        for run_id, column in enumerate(columns, 1):
            got = distinct_values(found, column).orderBy(F.desc("source_frequency"), "nv").limit(ONE_TIME_LIMIT + 1).collect()
            if len(got) > ONE_TIME_LIMIT:
                raise ValueError(f"{column} has more than {ONE_TIME_LIMIT} distinct values")
            session.runs[column] = Run(run_id, None, items_of((r["literal_value"], r["source_frequency"]) for r in got))
        if session.stored:
            self.store.publish(session.table, found)
        if file is not None:
            self.store.put_file(nonce, file)
        self.archived(session, written=False)
        return self.keep(session)

    def group(self, nonce: str, grouper: Grouper, rules: dict | None = None) -> Session:
        session = self.session(nonce)
        session.runs = {c: auto_group(self.spark, run, grouper, rules=rules, use_lookup=False) for c, run in session.runs.items()}
        return self.keep(session)

    def mappings(self, nonce: str) -> dict[str, dict[str, str]]:
        """By column, names by key."""
        return {c: {normalize_value(literal): name for literal, name in run.mappings()} for c, run in self.session(nonce).runs.items()}

    def standardized(self, nonce: str) -> DataFrame:
        tables = {c: self.spark.createDataFrame(list(m.items()), "nv string, alias_name string") for c, m in self.mappings(nonce).items()}
        return export.standardize(self.rows(self.session(nonce)), tables, unmapped_rows=True)

    def write(self, nonce: str, target: str, overwrite: bool = False, confirmed: bool = False) -> None:
        """Into a table: a new one, or over an old one; over another session's only if confirmed."""
        if overwrite and self.store.marks(target).get("session", nonce) != nonce and not confirmed:
            raise PermissionError(f"{target} was last written by another session")
        (self.store.publish if overwrite else self.store.create)(target, self.standardized(nonce), marks={"session": nonce})
        session = self.session(nonce)
        session.target = target
        self.keep(session)
        self.archived(session, written=True)

    def patched_csv(self, nonce: str, header: int | None = None) -> bytes:
        """The session's CSV file with mapped cells changed and every other byte kept."""
        from ..sources import files

        data = self.store.get_file(nonce)
        grid = files.csv_grid(data)
        at = files.header_row(grid)[0] if header is None else header
        names, _ = files.headers(grid[at])
        edits = {}
        for column, mapping in self.mappings(nonce).items():
            c = names.index(column)
            for k, place in enumerate(files.kept_rows(grid, at)):
                old = grid[place][c] if c < len(grid[place]) else ""
                new = mapping.get(normalize_value(old))
                if new is not None and new != old:
                    edits[k, column] = new
        return files.patch_csv(data, edits, at)

    def status(self, nonce: str) -> dict:
        return {c: {"status": r.status, "items": len(r.items), "groups": len(r.groups)} for c, r in self.session(nonce).runs.items()}

    def archive(self, limit: int = 200) -> list[str]:
        """The newest sessions first."""
        newest = self.store.read("archive").orderBy(F.desc(F.greatest("opened_at", F.coalesce("written_at", "opened_at"))), F.desc("session_nonce")).limit(limit)
        return [r["session_nonce"] for r in newest.collect()]

    def forget(self, nonce: str) -> None:
        """The session, its rows and its file go; what it wrote stays."""
        session = self.session(nonce)
        if session.stored:
            self.store.drop(session.table)
        if session.file:
            self.store.drop_file(nonce)
        self.store.transact(lambda now: Change({"archive": now.read("archive").where(F.col("session_nonce") != nonce)}))
        self.store.forget("sessions", nonce)


def text_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Every column as text."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])

"""Map tables: what each raw value of a column is called, so that a live view is a plain join on raw bytes.

A map has a row for each distinct spelling that was seen, with its key and its name. New spellings are appended; it is
written anew only when names have changed. A view over source and maps needs no key of its own, so nothing of it is Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut
from ..functions.normalize import composed_key_sql, normalize
from ..functions.text import quoted, ticked
from .mappings import dictionary
from .store import Change, Kept, Snapshot, Store

MAP = "raw string, nv string, alias_name string"
#: Appendices after which a map is written anew.
APPENDICES = 8


def sync_map(store: Store, table: str, raws: DataFrame, mapping: DataFrame) -> tuple[int, int]:
    """Bring a map up to the spellings (raw) of a column and to its mapping (nv, alias_name); returns how many spellings
    were added and how many changed their name. Nothing to change: nothing is written."""
    spellings = raws.select("raw").where(F.col("raw").isNotNull()).distinct()
    names = dictionary(mapping)
    added = renamed = 0

    def named(rows: DataFrame) -> DataFrame:
        return rows.select("raw", "nv").join(names, "nv", "left").select("raw", "nv", "alias_name")

    def change(now: Snapshot) -> Change | None:
        nonlocal added, renamed
        have = now.read(table) if now.version(table) else store.spark.createDataFrame([], MAP)
        fresh = cut(named(spellings.join(have.select("raw"), "raw", "left_anti").withColumn("nv", normalize(F.col("raw")))))
        other = names.withColumnRenamed("alias_name", "_now")
        renamed = have.join(other, "nv", "left").where(~F.col("alias_name").eqNullSafe(F.col("_now"))).count()
        added = fresh.count()
        paths = now.held(table)["paths"] if now.version(table) else []
        if paths and not (added or renamed):
            return None
        if paths and not renamed and len(paths) < APPENDICES:
            return Change({table: Kept(paths, fresh, have.schema, alike=True)})
        return Change({table: named(have.join(spellings, "raw", "left_semi")).unionByName(fresh)})

    store.transact(change)
    return added, renamed


def view_over_maps(source: str, columns: list[str], maps: dict[str, str], unmapped_rows: bool = False) -> str:
    """A live view over a source table and maps (by watched column): the rows that export.standardize gives. A spelling
    that no map has seen yet counts as unmapped."""
    number = {c: i for i, c in enumerate(maps)}
    value = {c: f"cast(s.{ticked(c)} AS string)" for c in maps}
    shown = ", ".join(f"coalesce(m{number[c]}.alias_name, {value[c]}) AS {ticked(c)}" if c in maps else f"s.{ticked(c)}" for c in columns)
    joins = " ".join(f"LEFT JOIN {quoted(t)} m{number[c]} ON m{number[c]}.raw = {value[c]}" for c, t in maps.items())
    kept = " AND ".join(f"(m{number[c]}.alias_name IS NOT NULL OR coalesce({composed_key_sql(value[c])}, '') = '')" for c in maps)
    return f"SELECT {shown} FROM {quoted(source)} s {joins}" + ("" if unmapped_rows or not maps else f" WHERE {kept}")

"""Standardized copies of a source: tables, views, companion columns and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.frames import cut
from ..functions.normalize import BEYOND, CONTROL, SPACES, beyond, composed_key, composed_key_sql, normalize
from ..functions.text import plain_path, standardized_name
from .mappings import dictionary, small

#: Begins what stands for a value that has to be composed; no key holds it, as it is a control character.
RAW = "\x01"


def helper(columns: list[str]) -> str:
    """A prefix that none of the columns has."""
    prefix = "_h"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def looked_up(source: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """at, name: what a value is joined by, and its canonical name. Keys of the mapping stand for themselves; values of the
    column that have to be composed before they become keys stand for themselves too, marked, so that rows needn't be
    composed. Only the watched column is read, and only distinct values meet Python."""
    names = dictionary(mapping)
    value = F.col(f"`{column}`").cast("string")
    odd = source.select(value.alias("raw")).where(beyond(F.col("raw"))).distinct().withColumn("nv", normalize(F.col("raw")))
    marked = odd.join(names, "nv").select(F.concat(F.lit(RAW), "raw").alias("at"), F.col("alias_name").alias("name"))
    return cut(names.select(F.col("nv").alias("at"), F.col("alias_name").alias("name")).unionByName(marked))


def _joined(source: DataFrame, mappings: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """source joined to each watched column's mapping; the aliases, and whether a value is blank, by column.

    Rows are read once, and what they are joined by is worked out where they are, in JVM expressions, without a shuffle;
    only mappings are measured, and broadcast if small.
    """
    prefix = helper(source.columns)
    value = {c: F.col(f"`{c}`").cast("string") for c in mappings}
    out = source.withColumns({f"{prefix}key{i}": F.when(beyond(v), F.concat(F.lit(RAW), v)).otherwise(composed_key(v)) for i, v in enumerate(value.values())}) if mappings else source
    alias, blank = {}, {}
    for i, (column, mapping) in enumerate(mappings.items()):
        found = looked_up(source, column, mapping).select(F.col("at").alias(f"{prefix}at{i}"), F.col("name").alias(f"{prefix}alias{i}"))
        out = out.join(small(found), F.col(f"{prefix}key{i}") == F.col(f"{prefix}at{i}"), "left")
        alias[column], blank[column] = F.col(f"{prefix}alias{i}"), is_blank(value[column])
    return out, alias, blank


def is_blank(value: Column) -> Column:
    """Whether a value is blank, without Python: composing characters never makes a blank of what isn't one, nor back."""
    return value.isNull() | (F.regexp_replace(F.regexp_replace(value, CONTROL, ""), f"[{SPACES}]+", "") == "")


def standardize(source: DataFrame, mappings: dict[str, DataFrame], unmapped_rows: bool = False) -> DataFrame:
    """All columns in their order, watched ones replaced by their names. mappings: nv, alias_name by column.

    A row stays if each watched value is blank or mapped; with unmapped_rows all rows stay, unmapped values as they are.
    """
    out, alias, blank = _joined(source, mappings)
    if not unmapped_rows and mappings:
        out = out.where(reduce(lambda a, b: a & b, [alias[c].isNotNull() | blank[c] for c in mappings]))
    return out.select(*[F.coalesce(alias[c], F.col(f"`{c}`").cast("string")).alias(c) if c in mappings else F.col(f"`{c}`") for c in source.columns])


def companion_columns(source: DataFrame, mappings: dict[str, DataFrame]) -> DataFrame:
    """The source with a standardized column for each watched one, null where the value isn't mapped."""
    taken = {c.lower() for c in source.columns}
    for column in mappings:
        if standardized_name(column).lower() in taken:
            raise ValueError(f"{standardized_name(column)} exists already")
    out, alias, _ = _joined(source, mappings)
    return out.select(*[F.col(f"`{c}`") for c in source.columns], *[alias[c].alias(standardized_name(c)) for c in mappings])


def companion_delta(synced: DataFrame, mappings: dict[str, DataFrame]) -> DataFrame:
    """Rows of a table with companion columns that a sync would change; none in a steady state."""
    out, changed = _synced(synced, mappings)
    return out.where(changed).select(*[F.col(f"`{c}`") for c in synced.columns if c not in {standardized_name(x) for x in mappings}], *[F.col(f"`{standardized_name(c)}`") for c in mappings])


def _synced(synced: DataFrame, mappings: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
    """synced with its companion columns as they should be, and whether a row's were otherwise."""
    names = {c: standardized_name(c) for c in mappings}
    prefix = helper([*synced.columns, *names.values()]) + "old"
    plain = synced.withColumnsRenamed({n: f"{prefix}{i}" for i, n in enumerate(names.values())})
    out, alias, _ = _joined(plain, mappings)
    changed = reduce(lambda a, b: a | b, [~F.col(f"{prefix}{i}").eqNullSafe(alias[c]) for i, c in enumerate(mappings)], F.lit(False))
    return out.withColumns({names[c]: alias[c] for c in mappings}).withColumn(f"{prefix}changed", changed), F.col(f"{prefix}changed")


def sync_companions(store, table: str, mappings: dict[str, DataFrame]) -> int:
    """Brings a stored table's companion columns up to date and returns how many rows that changed. Columns that are
    missing count as null. Only files that hold a row whose value is mapped otherwise, or not any more, are written anew;
    the others stay as they are under the new version. None to change: nothing is written."""
    from .store import Change, Kept, Snapshot

    touched = 0

    def change(now: Snapshot) -> Change | None:
        nonlocal touched
        have = now.read(table)
        missing = [standardized_name(c) for c in mappings if standardized_name(c).lower() not in {x.lower() for x in have.columns}]
        schema = StructType([*have.schema.fields, *[StructField(c, StringType()) for c in missing]])
        read = lambda paths: now.spark.read.schema(schema).parquet(*paths)  # noqa: E731  a file without a column has nulls
        every = read(now.held(table)["paths"])
        at = helper(schema.names) + "file"
        rows, changed = _synced(every.withColumn(at, F.col("_metadata.file_path")), mappings)
        files = {r[at]: r["n"] for r in rows.where(changed).groupBy(at).agg(F.count("*").alias("n")).collect()}  # a row for each file at most
        touched = sum(files.values())
        if not touched and not missing:
            return None
        stale = {plain_path(f) for f in files}
        stay = [f for f in map(plain_path, every.inputFiles()) if f not in stale]
        rest = None
        if stale:
            again, _ = _synced(read(sorted(stale)), mappings)
            rest = again.select(*[F.col(f"`{c}`") for c in schema.names])
        return Change({table: Kept(stay, rest, schema)})

    store.transact(change)
    return touched


def pasted_table(source: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """The source with standardized_<column> right after the column; matched on the raw value, empty if unmapped.
    mapping: literal_value, alias_name."""
    found = mapping.groupBy(F.col("literal_value").alias("_raw")).agg(F.max("alias_name").alias("_alias"))
    out = source.join(small(found), F.col(f"`{column}`") == F.col("_raw"), "left")
    new = F.when(is_blank(F.col(f"`{column}`")), "").otherwise(F.coalesce("_alias", F.lit(""))).alias(f"standardized_{column}")
    return out.select(*[x for c in source.columns for x in ([F.col(f"`{c}`"), new] if c == column else [F.col(f"`{c}`")])])


def file_rows(rows: DataFrame, mappings: dict[str, DataFrame]) -> DataFrame:
    """Rows of a file with mapped cells replaced, all else as it is."""
    return standardize(rows, mappings, unmapped_rows=True)


def ordered(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Laid out by key for writing: range partitions, each sorted. Reading back promises no order."""
    if not keys:
        return df
    return (df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)


def ordering(keys: dict[str, list[list[str]]]) -> list[str]:
    """What an export is sorted by: the primary key, else the first unique key by name, else the clustering key."""
    return next((sorted(keys[kind])[0] if kind == "unique" else keys[kind][0] for kind in ("primary", "unique", "clustering") if keys.get(kind)), [])


def guard(source: str, target: str, internal: tuple[str, ...] = (), claims: dict[str, str] | None = None) -> None:
    """Refuses a target that is the source, is internal, or is another source's export. claims: source by target."""
    low = target.lower()
    if low == source.lower():
        raise ValueError("an export can't replace its source")
    if any(low == x.lower() or low.startswith(x.lower() + ".") for x in internal):
        raise ValueError("the target is internal")
    owner = {k.lower(): v for k, v in (claims or {}).items()}.get(low)
    if owner and owner.lower() != source.lower():
        raise ValueError(f"{target} is the export of {owner}")


def view_sql(source: str, columns: list[str], maps: dict[str, str], unmapped_rows: bool = False) -> str:
    """A live view over a source table and mapping tables (nv, alias_name), joined on the key; needs value_normalize. Rows
    whose watched values need no composing are keyed without it."""
    from ..functions.text import quoted

    watched = {c: f"cast(s.{quoted(c)} as string)" for c in maps}
    odd = " OR ".join(f"coalesce({x} rlike r'{BEYOND}', false)" for x in watched.values()) or "false"

    def part(key, where: str) -> str:
        keys = "".join(f", {key(x)} AS _key{i}" for i, x in enumerate(watched.values()))
        return f"SELECT s.*{keys} FROM {quoted(source)} s WHERE {where}"

    rows = f"({part(composed_key_sql, f'NOT ({odd})')} UNION ALL {part('value_normalize({})'.format, odd)})" if maps else quoted(source)
    shown = ", ".join(f"coalesce(m{list(maps).index(c)}.alias_name, cast(s.{quoted(c)} as string)) AS {quoted(c)}" if c in maps else f"s.{quoted(c)}" for c in columns)
    joins = " ".join(f"LEFT JOIN (SELECT nv, max(alias_name) AS alias_name FROM {quoted(t)} GROUP BY nv) m{i} ON m{i}.nv = s._key{i}" for i, t in enumerate(maps.values()))
    kept = " AND ".join(f"(m{i}.nv IS NOT NULL OR coalesce(s._key{i}, '') = '')" for i in range(len(maps)))
    return f"SELECT {shown} FROM {rows} s {joins}" + ("" if unmapped_rows or not maps else f" WHERE {kept}")

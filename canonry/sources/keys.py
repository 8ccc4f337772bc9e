"""Keys that a table has but doesn't declare: screened by sketches in one pass, then proved by an exact aggregate."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a key at most, and columns (those with the most distinct values) that keys of several are sought among.
WIDEST, AMONG = 3, 8
#: Relative error of the sketches; a candidate may fall short of the rows by four times that.
ERROR = 0.02
KEYABLE = (T.StringType, T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.BinaryType)


def profile(df: DataFrame, columns: list[tuple[str, ...]]) -> tuple[int, dict[tuple[str, ...], tuple[int, int]]]:
    """Rows, and of each combination of columns the estimated distinct values and the rows with a null: one pass."""
    quoted = lambda c: F.col(f"`{c}`")
    wide = [F.approx_count_distinct(F.xxhash64(*map(quoted, cs)) if len(cs) > 1 else quoted(cs[0]), ERROR).alias(f"d{i}") for i, cs in enumerate(columns)]
    nulls = [F.count_if(sum((quoted(c).isNull().cast("int") for c in cs), F.lit(0)) > 0).alias(f"n{i}") for i, cs in enumerate(columns)]
    row = df.agg(F.count("*").alias("rows"), *wide, *nulls).first()
    return row["rows"], {cs: (row[f"d{i}"], row[f"n{i}"]) for i, cs in enumerate(columns)}


def proved(df: DataFrame, columns: tuple[str, ...]) -> bool:
    """Whether no two rows are equal in these columns, none of which is null."""
    named = [F.col(f"`{c}`") for c in columns]
    missing = sum((c.isNull().cast("int") for c in named), F.lit(0)) > 0
    return df.where(missing).isEmpty() and df.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(named)]).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()


def preference(df: DataFrame, columns: tuple[str, ...]) -> tuple:
    """Numbers before texts, names that say so before others, then the table's order."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    telling = lambda c: c.lower() in ("id", "key") or c.lower().endswith(("_id", "id", "_key", "key"))
    return (sum(not telling(c) for c in columns), sum(not isinstance(kinds[c], T.IntegralType) for c in columns), [df.columns.index(c) for c in columns])


def discover_keys(df: DataFrame, widest: int = WIDEST) -> list[str]:
    """The columns of the narrowest key found, of several the preferred one; none: an empty list. An empty table has no
    key, as anything would be one."""
    usable = [f.name for f in df.schema.fields if isinstance(f.dataType, KEYABLE)]
    if not usable:
        return []
    rows, seen = profile(df, [(c,) for c in usable])
    if not rows:
        return []
    whole = [c for c in usable if not seen[(c,)][1]]
    among = sorted(whole, key=lambda c: (-seen[(c,)][0], df.columns.index(c)))[:AMONG]
    for width in range(1, widest + 1):
        sets = [(c,) for c in whole] if width == 1 else [tuple(sorted(cs, key=df.columns.index)) for cs in combinations(among, width)]
        if not sets:
            return []
        found = seen if width == 1 else profile(df, sets)[1]
        likely = [cs for cs in sets if found[cs][0] >= rows * (1 - 4 * ERROR)]
        for cs in sorted(likely, key=lambda cs: preference(df, cs)):
            if proved(df, cs):
                return list(cs)
    return []

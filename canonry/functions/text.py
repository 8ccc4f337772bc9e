"""Small helpers on texts: lenient JSON, names of columns and exports, error classes."""

from __future__ import annotations

import hashlib
import json
import re
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

CURLY = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})


def objects(text: str) -> list[str]:
    """Balanced top-level {...} parts, strings respected."""
    out, depth, start, quoted, skip = [], 0, 0, False, False
    for i, ch in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = depth > 0
        elif ch == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def lenient_json(text: str | None) -> dict | None:
    """The first JSON object in an answer that may have fences, talk around it or typographic quotes."""
    if not text:
        return None
    bare = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
    plain = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", bare.translate(CURLY))
    for candidate in [bare, *objects(bare), plain, *objects(plain)]:
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return None


def column_letter(index: int) -> str:
    """0 is A, 26 is AA."""
    out, n = "", max(0, int(index)) + 1
    while n:
        n, over = divmod(n - 1, 26)
        out = chr(65 + over) + out
    return out


def sheet_range(sheet: str, cells: str) -> str:
    return "'" + sheet.replace("'", "''") + "'!" + cells


def standardized_name(column: str) -> str:
    return f"{column}_STANDARDIZED"


EXPORT_KINDS = ("table", "view", "column", "none")


def export_kind(value) -> str:
    return value if value in EXPORT_KINDS else "table"


def lookup_table_name(column: str) -> str:
    return re.sub(r"\W+", "_", column).strip("_").upper() + "_LOOKUP"


def map_name(export: str, column: str) -> str:
    """Sixteen hex digits that name a view's map."""
    return hashlib.md5(f"{export}::{column}".encode()).hexdigest()[:16]


def standardized_file(name: str) -> str:
    stem, dot, ending = name.rpartition(".")
    return f"{stem} (standardized).{ending}" if dot else f"{name} (standardized)"


def is_simple_name(name: str) -> bool:
    return bool(name) and not re.search(r"[\x00-\x1f\x7f\"'`\\]", name)


def quoted(name: str) -> str:
    """A column or table name for SQL; dots part it."""
    if not all(is_simple_name(p) for p in name.split(".")):
        raise ValueError(f"not a safe name: {name!r}")
    return ".".join(f"`{p}`" for p in name.split("."))


def sql_literal(text: str | None) -> str:
    """A text as a literal of SQL, for statements that can't take parameters (a view's); spark.sql(..., args) serves else."""
    return "NULL" if text is None else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def plain_path(url: str) -> str:
    """A file's path as a reader takes it, from the URL that Spark gives, in one form for local files."""
    return re.sub("^file:/+", "file:/", unquote(url))


def ticked(column: str) -> str:
    """Any column name for SQL."""
    return "`" + column.replace("`", "``") + "`"


def parse_table_name(name: str, catalog: str | None = None) -> tuple[str | None, str | None, str]:
    """Catalog, schema and table of a name of one to three parts; another catalog than the given one is refused."""
    parts = name.split(".")
    if not 1 <= len(parts) <= 3 or not all(is_simple_name(p) for p in parts):
        raise ValueError(f"not a table name: {name!r}")
    found = (*[None] * (3 - len(parts)), *parts)
    if catalog and found[0] and found[0].lower() != catalog.lower():
        raise ValueError(f"{name!r} is not in {catalog!r}")
    return found


def first_word(value: Column) -> Column:
    return F.split_part(F.lower(F.trim(value)), F.lit(" "), F.lit(1))


def marker_deletes(marker: str | None) -> int | None:
    """The third number of a heartbeat "inserts:updates:deletes"."""
    parts = (marker or "").split(":")
    return int(parts[2]) if len(parts) == 3 and parts[2].isdigit() else None


ERROR_CLASSES = {
    "table": ("TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND", "UNRESOLVED_COLUMN", "DATATYPE_MISMATCH", "FILE_NOT_EXIST"),
    "global": ("CATALOG", "SCHEMA_NOT_FOUND", "UNAUTHORIZED", "AUTHENTICATION"),
    "reset": ("CHECKPOINT", "STREAMING_OFFSET", "INCOMPATIBLE_OFFSET", "STATE_STORE"),
}


def classify_error(error: BaseException) -> str:
    """table: this source is at fault; global: all are; reset: a change feed must begin anew; transient: try again."""
    condition = getattr(error, "getCondition", getattr(error, "getErrorClass", lambda: None))() or ""
    text = f"{condition} {error}".upper()
    return next((kind for kind, marks in ERROR_CLASSES.items() if any(m in text for m in marks)), "transient")


def price(usage: dict, rates: dict) -> float:
    """Cost of tokens by kind, at rates per million."""
    return sum(usage.get(kind, 0) * rate for kind, rate in rates.items()) / 1e6

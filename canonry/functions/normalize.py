"""The match key of a value: NFC, control characters dropped, white space collapsed and trimmed, lower case.

The order is fixed: tabs and newlines are control characters, so they go before white space is collapsed.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CONTROL = r"[\u0000-\u001F\u007F-\u009F]"
#: The white space that is collapsed.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Text without such characters is in NFC whatever it holds, and needs no Python.
BEYOND = r"[^\x00-\u02FF]"

_control, _spaces = re.compile(CONTROL), re.compile(f"[{SPACES}]+")


def normalize_value(value: str | None) -> str:
    """Null gives an empty key."""
    if value is None:
        return ""
    kept = _control.sub("", unicodedata.normalize("NFC", value))
    return _spaces.sub(" ", kept).strip(" ").lower()


def is_blank_value(value: str | None) -> bool:
    return normalize_value(value) == ""


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def beyond(value: Column) -> Column:
    """Whether a value has to be composed before it becomes a key; false for null."""
    return F.coalesce(value.rlike(BEYOND), F.lit(False))


def composed_key(value: Column) -> Column:
    """The key of a value that is in NFC, as many are: no Python."""
    kept = F.regexp_replace(value, CONTROL, "")
    return F.lower(F.regexp_replace(F.regexp_replace(kept, f"[{SPACES}]+", " "), "^ | $", ""))


def normalize(value: Column) -> Column:
    """The key as a column; null stays null. Only values that may need composing are sent to Python: to others it sees
    nulls. For distinct values; rows go through with_keys."""
    return composed_key(F.coalesce(_nfc(F.when(beyond(value), value)), value))


def with_keys(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """df with the key of each column under another name. Rows whose values need no composing never meet Python; the few
    others are read again by themselves."""
    text = {c: F.col(f"`{c}`").cast("string") for c in keys}
    if not keys:
        return df
    odd = reduce(lambda a, b: a | b, [beyond(t) for t in text.values()])
    plain = df.where(~odd).withColumns({keys[c]: composed_key(t) for c, t in text.items()})
    return plain.unionByName(df.where(odd).withColumns({keys[c]: normalize(t) for c, t in text.items()}))


def not_blank(key: Column) -> Column:
    """Whether a normalized key counts as a value."""
    return key.isNotNull() & (key != "")


def register(spark: SparkSession) -> None:
    """value_normalize(string) for SQL."""
    spark.udf.register("value_normalize", F.pandas_udf(lambda s: s.map(normalize_value, na_action="ignore"), "string"))


def value_dictionary(df: DataFrame, column: str) -> DataFrame:
    """raw, nv: each distinct value that isn't blank, with its key. The UDF runs once per distinct value, not per row."""
    raw = df.select(F.col(f"`{column}`").cast("string").alias("raw")).where(F.col("raw").isNotNull()).distinct()
    return raw.withColumn("nv", normalize(F.col("raw"))).where(not_blank(F.col("nv")))


def keyed(df: DataFrame, column: str, key: str = "nv") -> DataFrame:
    """df with the column's key. Equal to normalize() row by row."""
    return with_keys(df, {column: key})


def composed_key_sql(x: str) -> str:
    """composed_key as Spark SQL."""
    return f"lower(regexp_replace(regexp_replace(regexp_replace({x}, r'{CONTROL}', ''), r'[{SPACES}]+', ' '), '^ | $', ''))"


#: The same steps for DuckDB, for one argument x.
def sql(x: str) -> str:
    spaces = r"[ \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
    return rf"lower(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({x}), '[\x{{00}}-\x{{1f}}\x{{7f}}-\x{{9f}}]', '', 'g'), '{spaces}', ' ', 'g'), '^ | $', '', 'g'))"

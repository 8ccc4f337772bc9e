"""Confirmed mappings: a dictionary from match keys to canonical names, within the scope of a column specification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import numbered
from ..functions.normalize import normalize, not_blank
from ..functions.text import first_word

TOP_NAMES, SIMILAR_NAMES, SIMILAR_WORDS, PAGE_LIMIT = 200, 100, 300, 500
#: Bytes up to which a dictionary is broadcast; beyond, Spark chooses.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked to be broadcast if its rows take so few bytes: strings by their lengths, other values as eight."""
    width = sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) + 8 if kind == "string" else F.lit(8) for c, kind in df.dtypes), F.lit(16))
    size = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if size <= most else df


def dictionary(mapping: DataFrame) -> DataFrame:
    """nv, alias_name: one row for each key, the last name of several, so that joins never multiply rows."""
    return mapping.where(not_blank(F.col("nv"))).groupBy("nv").agg(F.max("alias_name").alias("alias_name"))


def in_scope(spec_id: int | None) -> Column:
    """Null is a scope of its own."""
    return F.col("spec_id").eqNullSafe(F.lit(spec_id).cast("long"))


def lookup(matches: DataFrame, names: DataFrame, spec_id: int | None) -> DataFrame:
    """nv, alias_name of a scope: one row for each key, whatever the tables hold twice."""
    own = matches.where(in_scope(spec_id)).select(F.col("normalized_value").alias("nv"), "alias_id").where(not_blank(F.col("nv")))
    return own.join(names.select("alias_id", "alias_name"), "alias_id").groupBy("nv").agg(F.max("alias_name").alias("alias_name"))


def lookup_pass(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """items (with nv) and alias_name where the mapping has it, matched_from_lookup."""
    return items.join(dictionary(mapping), "nv", "left").withColumn("matched_from_lookup", F.col("alias_name").isNotNull())


def column_metrics(values: DataFrame, mapping: DataFrame) -> DataFrame:
    """total_source_values and total_mapped in rows, from distinct values with frequencies."""
    joined = values.join(dictionary(mapping).select("nv", F.lit(1).alias("hit")), "nv", "left")
    return joined.agg(F.coalesce(F.sum("source_frequency"), F.lit(0)).alias("total_source_values"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("source_frequency"))), F.lit(0)).alias("total_mapped"))


def in_column(matches: DataFrame, values: DataFrame) -> DataFrame:
    """Mappings whose key occurs in a column."""
    return matches.join(values.select(F.col("nv").alias("_nv")).distinct(), F.col("normalized_value") == F.col("_nv"), "left_semi")


def search(mappings: DataFrame, text: str) -> DataFrame:
    """Rows whose literal or name holds the text, in any case; % and _ are ordinary."""
    low = F.lit(text.lower())
    return mappings.where(F.contains(F.lower("literal_value"), low) | F.contains(F.lower("alias_name"), low))


def mapping_rows(matches: DataFrame, names: DataFrame, spec_id: int | None) -> DataFrame:
    return matches.where(in_scope(spec_id)).join(names.select("alias_id", "alias_name"), "alias_id")


def page(mappings: DataFrame, limit: int = 100) -> tuple[DataFrame, int]:
    """The newest mappings, and how many there are."""
    return mappings.orderBy(F.desc_nulls_last("confirmed_at"), "literal_value").limit(max(1, min(PAGE_LIMIT, limit))), mappings.count()


def top_names(names: DataFrame, limit: int = TOP_NAMES) -> DataFrame:
    return names.orderBy(F.desc_nulls_last("usage_count"), F.desc_nulls_last("last_used_at"), "alias_name").limit(limit)


def known_names(names: DataFrame, values: DataFrame, column: str = "literal_value") -> DataFrame:
    """The commonest names and, if there may be more, those that begin like one of the values."""
    top = top_names(names).select("alias_name", F.lit(0).alias("_part"), "usage_count")
    words = values.select(first_word(F.col(column)).alias("w")).where(F.length("w") >= 2).distinct().orderBy("w").limit(SIMILAR_WORDS)
    rest = names.join(top.select("alias_name"), "alias_name", "left_anti").withColumn("w", first_word(F.col("alias_name")))
    similar = rest.join(words, "w", "left_semi").orderBy(F.desc_nulls_last("usage_count"), "alias_name").limit(SIMILAR_NAMES)
    return top.unionByName(similar.select("alias_name", F.lit(1).alias("_part"), "usage_count")).select("alias_name", "usage_count")


def by_name(mappings: DataFrame) -> DataFrame:
    """alias_name and its literals, sorted."""
    return mappings.groupBy("alias_name").agg(F.sort_array(F.collect_set("literal_value")).alias("literals"), F.count("*").alias("n"))


def known_literals(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("alias_name", "literal_value").agg(F.count("*").alias("n"))


def lookup_export(mappings: DataFrame) -> DataFrame:
    return mappings.select(F.col("alias_name").alias("canonical_name"), F.col("literal_value").alias("raw_value"), "confirmed_at").orderBy("canonical_name", "raw_value")


def run_mapping(mappings: DataFrame) -> DataFrame:
    return mappings.select(F.col("literal_value").alias("original_value"), F.col("alias_name").alias("standardized_value"))


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by one aggregate."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min_by(whole, F.struct(*order)).alias("r")).select("r.*")


def with_ids(rows: DataFrame, column: str, order: list[str], start: int = 0) -> DataFrame:
    """rows numbered from start + 1 in the given order, as many as there are; no task has them all."""
    return numbered(rows, column, order, start)


def upsert_names(names: DataFrame, proposed: DataFrame, now: Column, next_id: int) -> DataFrame:
    """names with proposed (alias_name, spec_id) added or their usage counted up."""
    wanted = proposed.select("alias_name", "spec_id").where(F.col("alias_name").isNotNull()).distinct().withColumn("_new", F.lit(True))
    same = names["alias_name"].eqNullSafe(wanted["alias_name"]) & names["spec_id"].eqNullSafe(wanted["spec_id"])
    kept = names.join(wanted, same, "left").select(
        names["alias_id"], names["alias_name"], names["spec_id"],
        (F.coalesce(names["usage_count"], F.lit(0)) + F.when(F.col("_new"), 1).otherwise(0)).cast("long").alias("usage_count"),
        F.when(F.col("_new"), now).otherwise(names["last_used_at"]).alias("last_used_at"),
    )
    fresh = with_ids(wanted.join(names, same, "left_anti").drop("_new"), "alias_id", ["spec_id", "alias_name"], next_id)
    return kept.unionByName(fresh.select("alias_id", "alias_name", "spec_id", F.lit(1).cast("long").alias("usage_count"), now.alias("last_used_at")))


def upsert_matches(matches: DataFrame, decided: DataFrame, now: Column, run_id: int, next_id: int) -> DataFrame:
    """matches with decided (literal_value, alias_id, spec_id, seq): one row for each key and scope. Of literals with the
    same key the first counts; a literal that is there already keeps its spelling."""
    keyed = decided.withColumn("normalized_value", normalize(F.col("literal_value"))).where(not_blank(F.col("normalized_value")))
    new = first_per_key(keyed, ["normalized_value", "spec_id"], ["seq", "literal_value"]).select(F.col("normalized_value").alias("_nv"), F.col("spec_id").alias("_spec"), F.col("alias_id").alias("_alias"), F.col("literal_value").alias("_literal"))
    same = (F.col("normalized_value") == F.col("_nv")) & F.col("spec_id").eqNullSafe(F.col("_spec"))
    hit = F.col("_nv").isNotNull()
    kept = matches.join(new, same, "left").select(
        "match_id", "literal_value", "normalized_value", F.when(hit, F.col("_alias")).otherwise(F.col("alias_id")).alias("alias_id"), "spec_id",
        F.when(hit, F.lit(run_id).cast("long")).otherwise(F.col("run_id")).alias("run_id"), F.when(hit, now).otherwise(F.col("confirmed_at")).alias("confirmed_at"),
    )
    fresh = with_ids(new.join(matches, same, "left_anti"), "match_id", ["_spec", "_nv"], next_id)
    return kept.unionByName(fresh.select("match_id", F.col("_literal").alias("literal_value"), F.col("_nv").alias("normalized_value"), F.col("_alias").alias("alias_id"), F.col("_spec").alias("spec_id"), F.lit(run_id).cast("long").alias("run_id"), now.alias("confirmed_at")))


def seed_rows(literals: DataFrame, matches: DataFrame, spec_id: int | None) -> DataFrame:
    """literal_value, seq of seeds (literal_value) that the scope doesn't know yet, once for each key."""
    keyed = literals.withColumn("nv", normalize(F.col("literal_value"))).where(not_blank(F.col("nv")))
    known = matches.where(in_scope(spec_id)).select(F.col("normalized_value").alias("nv"))
    return first_per_key(keyed, ["nv"], ["literal_value"]).join(known, "nv", "left_anti").select("literal_value", F.lit(0).alias("seq"))


def repoint(matches: DataFrame, names: DataFrame, spec_id: int | None, key: str, to_alias: int) -> tuple[DataFrame, DataFrame]:
    """One mapping moved to another name; the old name's usage falls, and it goes if nothing points to it. A key that the
    scope doesn't know, or that has the name already, changes nothing."""
    mine = in_scope(spec_id) & (F.col("normalized_value") == key)
    old = [r["alias_id"] for r in matches.where(mine).select("alias_id").distinct().collect() if r["alias_id"] != to_alias]
    if not old:
        return matches, names
    moved = matches.withColumn("alias_id", F.when(mine, F.lit(to_alias).cast("long")).otherwise(F.col("alias_id")))
    fewer = F.when(F.col("alias_id").isin(old), F.greatest(F.col("usage_count") - 1, F.lit(0))).when(F.col("alias_id") == to_alias, F.col("usage_count") + 1).otherwise(F.col("usage_count"))
    used = moved.select(F.col("alias_id").alias("_used")).distinct()
    left = names.withColumn("usage_count", fewer.cast("long")).join(used, F.col("alias_id") == F.col("_used"), "left")
    return moved, left.where(F.col("_used").isNotNull() | ~F.col("alias_id").isin(old)).drop("_used")


def rename(matches: DataFrame, names: DataFrame, spec_id: int | None, alias_id: int, new_name: str) -> tuple[DataFrame, DataFrame]:
    """A name changed for all its mappings; if the scope has the new name already, the two become one."""
    found = names.where(in_scope(spec_id) & (F.col("alias_name") == new_name) & (F.col("alias_id") != alias_id)).select("alias_id").first()
    if found is None:
        return matches, names.withColumn("alias_name", F.when(F.col("alias_id") == alias_id, new_name).otherwise(F.col("alias_name")))
    target = found["alias_id"]
    added = names.where(F.col("alias_id") == alias_id).agg(F.coalesce(F.sum("usage_count"), F.lit(0)).alias("n")).first()["n"]
    moved = matches.withColumn("alias_id", F.when(F.col("alias_id") == alias_id, F.lit(target).cast("long")).otherwise(F.col("alias_id")))
    return moved, names.where(F.col("alias_id") != alias_id).withColumn("usage_count", (F.col("usage_count") + F.when(F.col("alias_id") == target, added).otherwise(0)).cast("long"))


def rename_everywhere(matches: DataFrame, names: DataFrame, old_name: str, new_name: str) -> tuple[DataFrame, DataFrame]:
    """rename in every scope that has the old name. Where a scope has the new one too, usage counts are added up."""
    old = names.where(F.col("alias_name") == old_name).groupBy(F.col("spec_id").alias("_spec")).agg(F.min("alias_id").alias("_old"), F.sum("usage_count").alias("_used"))
    new = names.where(F.col("alias_name") == new_name).groupBy("spec_id").agg(F.min("alias_id").alias("_new"))
    pairs = old.join(new, old["_spec"].eqNullSafe(new["spec_id"]), "left").select("_old", "_new", "_used")
    if old_name == new_name or pairs.isEmpty():
        return matches, names
    moved = matches.join(small(pairs.where("_new is not null").drop("_used")), F.col("alias_id") == F.col("_old"), "left")
    moved = moved.withColumn("alias_id", F.coalesce("_new", "alias_id")).select(*matches.columns)
    gone = names.join(small(pairs), F.col("alias_id") == F.col("_old"), "left").where(F.col("_old").isNull() | F.col("_new").isNull())
    gone = gone.withColumn("alias_name", F.when(F.col("_old").isNotNull(), F.lit(new_name)).otherwise(F.col("alias_name"))).select(*names.columns)
    added = pairs.where("_new is not null").groupBy(F.col("_new").alias("_to")).agg(F.sum("_used").alias("_more"))
    kept = gone.join(small(added), F.col("alias_id") == F.col("_to"), "left").withColumn("usage_count", (F.col("usage_count") + F.coalesce("_more", F.lit(0))).cast("long"))
    return moved, kept.select(*names.columns)


def with_metadata(rows: DataFrame, meta: DataFrame, on: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """rows with columns of their metadata (new names by old), matched null-safely on row: metadata columns; rows without
    stay, and of metadata rows with the same key one counts."""
    one = meta.groupBy(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on.values())]).agg(F.max(F.struct(*columns)).alias("_meta"))
    same = [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)]
    return rows.join(small(one.select("*", *[F.col(f"_meta.{c}").alias(new) for c, new in columns.items()]).drop("_meta")), same, "left").select(*rows.columns, *columns.values())


def remove(matches: DataFrame, spec_id: int | None, keys: DataFrame) -> DataFrame:
    """matches without a scope's keys (nv)."""
    gone = keys.select(F.col("nv").alias("_nv")).distinct()
    return matches.join(gone, in_scope(spec_id) & (F.col("normalized_value") == F.col("_nv")), "left_anti")


def newest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The row with the latest time of each key; ties by the whole row."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(whole, F.struct(at, *rows.columns)).alias("r")).select("r.*")


def bulk_changes(matches: DataFrame, spec_id: int | None, moves: DataFrame, deletes: DataFrame, now: Column) -> DataFrame:
    """matches of a scope after a saved edit: moves (nv, alias_id) and deletes (nv), by key."""
    to = moves.groupBy(F.col("nv").alias("_nv")).agg(F.max("alias_id").alias("_to"))
    moved = matches.join(to, in_scope(spec_id) & (F.col("normalized_value") == F.col("_nv")), "left")
    hit = F.col("_to").isNotNull()
    changed = moved.select(*[F.when(hit, F.col("_to")).otherwise(F.col(c)).alias(c) if c == "alias_id" else F.when(hit, now).otherwise(F.col(c)).alias(c) if c == "confirmed_at" else F.col(c) for c in matches.columns])
    return remove(changed, spec_id, deletes)


def usage_counts(matches: DataFrame, names: DataFrame) -> DataFrame:
    """names with how many mappings point to each."""
    used = matches.groupBy("alias_id").agg(F.count("*").alias("mappings"))
    return names.join(used, "alias_id", "left").withColumn("mappings", F.coalesce("mappings", F.lit(0)))


def audit_rows(log: DataFrame, decisions: DataFrame, now: Column, longest: int = 800) -> DataFrame:
    """The log with decisions (literal_value, run_id, original_alias_name, user_changed_to) added, texts within a bound."""
    cut = lambda c: F.substring(c, 1, longest).alias(c)
    return log.unionByName(decisions.select(cut("literal_value"), "run_id", cut("original_alias_name"), cut("user_changed_to"), now.alias("decided_at")))

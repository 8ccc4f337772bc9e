"""Registered queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conventions, frames, naming, normalize
from ..functions.patterns import automaton
from ..functions.schedule import Schedule
from ..functions.text import first_word
from ..operators import detect, export, grouping, mappings, maps
from ..operators.store import Change, Store
from ..sources import keys, tables
from ..sources.incremental import FileSummaries
from ..streaming.feed import QueueFeed

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PRIORITIES = {"1-urgent": "Urgent", "2-high": "High", "3-medium": "Normal"}
EVENTS = {"click": "Engagement", "view": "Engagement", "purchase": "Revenue"}
SEGMENTS = {"building": "Construction", "machinery": "Industry"}
TYPES = {"economy": "Economy", "small": "Small"}
FLAGS, STATUSES = {"a": "Accepted", "r": "Returned"}, {"o": "Open", "f": "Filled"}


def mapping(spark: SparkSession, pairs: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(pairs.items()), "nv string, alias_name string")


def values(pairs: dict[str, str], name: str) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in pairs.items())
    return f"{name}(nv, alias_name) AS (VALUES {rows})"


N = normalize.sql


@query(f"SELECT doc_id, {N('text')} AS nv, ({N('text')} = '') AS is_blank FROM documents")
def normalize_documents(spark, sf_dir):
    df = normalize.with_keys(read(spark, sf_dir, "documents").select("doc_id", "text"), {"text": "nv"})
    return df.select("doc_id", "nv", (F.col("nv") == "").alias("is_blank"))


DISTINCT = """SELECT nv, literal_value, source_frequency FROM (
  SELECT nv, arg_min(raw, (-n, raw)) AS literal_value, CAST(sum(n) AS BIGINT) AS source_frequency
  FROM (SELECT {n} AS nv, {c} AS raw, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE nv <> '' GROUP BY nv)"""


def distinct_sql(table: str, column: str) -> str:
    return DISTINCT.format(n=N(column), c=column, t=table)


@query(distinct_sql("part", "p_name"))
def distinct_values(spark, sf_dir):
    return tables.distinct_values(read(spark, sf_dir, "part"), "p_name")


@query(distinct_sql("part", "p_type").replace("SELECT nv, literal_value, source_frequency FROM", "SELECT nv, literal_value FROM", 1))
def distinct_keys(spark, sf_dir):
    return tables.distinct_keys(read(spark, sf_dir, "part"), "p_type")


@query(f"SELECT * FROM ({distinct_sql('part', 'p_name')}) ORDER BY source_frequency DESC, nv LIMIT 20")
def top_values(spark, sf_dir):
    return tables.distinct_values(read(spark, sf_dir, "part"), "p_name", 20)


@query(f"WITH top AS (SELECT p_name AS raw, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, raw LIMIT 30) SELECT {N('raw')} AS nv, arg_min(raw, (-n, raw)) AS literal_value, CAST(sum(n) AS BIGINT) AS source_frequency FROM top GROUP BY 1")
def diff_scan(spark, sf_dir):
    return tables.diff_scan(read(spark, sf_dir, "part"), "p_name", 30)[0]


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def preview_values(spark, sf_dir):
    return tables.preview_values(read(spark, sf_dir, "customer"), "c_mktsegment")


def export_sql(everything: bool) -> str:
    where = "" if everything else "WHERE m.nv IS NOT NULL OR o_orderpriority IS NULL"
    return f"WITH {values(PRIORITIES, 'm')} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, coalesce(m.alias_name, o_orderpriority) AS o_orderpriority FROM orders LEFT JOIN m ON m.nv = {N('o_orderpriority')} {where}"


@query(export_sql(False))
def export_mapped_only(spark, sf_dir):
    return export.standardize(read(spark, sf_dir, "orders"), {"o_orderpriority": mapping(spark, PRIORITIES)})


@query(export_sql(True))
def export_raw_passthrough(spark, sf_dir):
    return export.standardize(read(spark, sf_dir, "orders"), {"o_orderpriority": mapping(spark, PRIORITIES)}, unmapped_rows=True)


@query(f"""WITH {values(FLAGS, 'f')}, {values(STATUSES, 's')} SELECT l_orderkey, l_linenumber, f.alias_name AS l_returnflag, s.alias_name AS l_linestatus
FROM lineitem JOIN f ON f.nv = {N('l_returnflag')} JOIN s ON s.nv = {N('l_linestatus')}""")
def export_two_columns(spark, sf_dir):
    source = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return export.standardize(source, {"l_returnflag": mapping(spark, FLAGS), "l_linestatus": mapping(spark, STATUSES)})


@query(f"WITH {values(EVENTS, 'm')} SELECT event_id, event_type, alias_name AS \"event_type_STANDARDIZED\" FROM events LEFT JOIN m ON m.nv = {N('event_type')}")
def companion_column(spark, sf_dir):
    return export.companion_columns(read(spark, sf_dir, "events").select("event_id", "event_type"), {"event_type": mapping(spark, EVENTS)})


@query(f"WITH {values(EVENTS, 'm')} SELECT event_id, event_type, alias_name AS \"event_type_STANDARDIZED\" FROM events JOIN m ON m.nv = {N('event_type')} WHERE event_type = 'click'")
def companion_delta(spark, sf_dir):
    pairs = {"event_type": mapping(spark, EVENTS)}
    synced = export.companion_columns(read(spark, sf_dir, "events").select("event_id", "event_type"), pairs)
    name = "event_type_STANDARDIZED"
    stale = synced.withColumn(name, F.when(F.col("event_type") == "click", F.lit(None).cast("string")).otherwise(F.col(name)))
    return export.companion_delta(stale, pairs).drop("_old0")


@query("SELECT p_partkey, p_type, CASE p_type WHEN 'ECONOMY' THEN 'Economy' ELSE '' END AS standardized_p_type, p_size FROM part")
def pasted_table(spark, sf_dir):
    exact = spark.createDataFrame([("ECONOMY", "Economy"), ("small", "Small")], "literal_value string, alias_name string")
    return export.pasted_table(read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), "p_type", exact)


@query(f"WITH {values(SEGMENTS, 'm')} SELECT count(*) AS total_source_values, count(m.nv) AS total_mapped FROM customer LEFT JOIN m ON m.nv = {N('c_mktsegment')} WHERE {N('c_mktsegment')} <> ''")
def column_metrics(spark, sf_dir):
    return mappings.column_metrics(tables.distinct_values(read(spark, sf_dir, "customer"), "c_mktsegment"), mapping(spark, SEGMENTS))


QUEUED = "(VALUES ('promo')) AS q(nv)"


def queue_of(spark, literals: list[str]) -> DataFrame:
    rows = [(1, x, x.lower(), 1) for x in literals]
    return spark.createDataFrame(rows, "pipeline_id long, literal_value string, normalized_value string, source_frequency long").withColumn("detected_at", F.lit("2024-01-01").cast("timestamp"))


@query(f"WITH {values(TYPES, 'm')} SELECT * FROM ({distinct_sql('part', 'p_type')}) v WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.nv = v.nv) AND NOT EXISTS (SELECT 1 FROM {QUEUED} WHERE q.nv = v.nv) ORDER BY source_frequency DESC, nv LIMIT 5000")
def reconcile_unmapped(spark, sf_dir):
    return detect.reconcile(read(spark, sf_dir, "part"), "p_type", mapping(spark, TYPES), queue_of(spark, ["PROMO"]))


@query(f"SELECT * FROM ({distinct_sql('part', 'p_type')}) v WHERE v.nv <> 'promo'")
def unknown_with_mapped(spark, sf_dir):
    return detect.unknown(tables.distinct_values(read(spark, sf_dir, "part"), "p_type"), mapping(spark, TYPES), queue_of(spark, ["PROMO"]), include_mapped=True)


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = read(spark, sf_dir, "events")
    return events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")


def merge_sql(add: bool) -> str:
    return f"""SELECT 1::BIGINT AS pipeline_id, event_type AS literal_value, event_type AS normalized_value, CAST({'count(*)' if add else 'count(*) FILTER (event_id % 2 = 1)'} AS BIGINT) AS source_frequency,
CAST('2024-01-01' AS TIMESTAMP) AS detected_at FROM events GROUP BY event_type"""


def merged(spark, sf_dir, add: bool) -> DataFrame:
    old, new = (detect.queue_rows(tables.distinct_values(h, "event_type"), 1, F.lit(day).cast("timestamp")) for h, day in zip(halves(spark, sf_dir), ("2024-01-01", "2024-01-02")))
    return detect.merge_queue(old, new, add)


@query(merge_sql(True))
def queue_merge_feed(spark, sf_dir):
    return merged(spark, sf_dir, True)


@query(merge_sql(False))
def queue_merge_scan(spark, sf_dir):
    return merged(spark, sf_dir, False)


PART_QUEUE = "SELECT 1::BIGINT AS pipeline_id, p_name AS literal_value, lower(p_name) AS normalized_value, count(*) AS source_frequency, make_timestamp(1704067200000000 + 1000000 * CAST(length(p_name) AS BIGINT)) AS detected_at FROM part GROUP BY p_name"


def part_queue(spark, sf_dir) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1704067200) + F.length("literal_value"))
    return detect.queue_rows(tables.distinct_values(read(spark, sf_dir, "part"), "p_name"), 1, at)


@query(f"SELECT * FROM ({PART_QUEUE}) ORDER BY detected_at, literal_value LIMIT 25")
def queue_drain(spark, sf_dir):
    return detect.drain(part_queue(spark, sf_dir), 1, 25)


@query(f"SELECT * FROM ({PART_QUEUE}) WHERE normalized_value NOT LIKE '%a%'")
def queue_dequeue(spark, sf_dir):
    queue = part_queue(spark, sf_dir)
    return detect.dequeue(queue, 1, queue.where("normalized_value like '%a%'").select(F.col("normalized_value").alias("nv")))


@query(f"SELECT pipeline_id, count(*) AS queue_size, CAST(sum(source_frequency) AS BIGINT) AS queued_rows FROM ({PART_QUEUE}) GROUP BY 1")
def queue_sizes(spark, sf_dir):
    return detect.queue_sizes(part_queue(spark, sf_dir))


@query(f"WITH {values(EVENTS, 'm')} SELECT event_type AS nv, event_type AS literal_value, count(*) AS new_rows, bool_or(m.nv IS NOT NULL) AS known FROM events LEFT JOIN m ON m.nv = event_type WHERE event_id % 3 <> 0 GROUP BY event_type")
def stream_classify(spark, sf_dir):
    changes = read(spark, sf_dir, "events").withColumn("op", F.when(F.col("event_id") % 3 == 0, "D").otherwise("I"))
    return detect.classify(changes, "event_type", mapping(spark, EVENTS))


@query("SELECT count(*) FILTER (event_id % 3 IN (0, 1)) AS deletes, 0::BIGINT AS blank_inserts, count(*) FILTER (event_id % 3 IN (1, 2)) AS inserts FROM events")
def change_flags(spark, sf_dir):
    op = F.when(F.col("event_id") % 3 == 0, "D").when(F.col("event_id") % 3 == 1, "U").otherwise("I")
    return detect.change_flags(read(spark, sf_dir, "events").withColumn("op", op), "event_type")


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'D' ELSE 'U' END AS op, o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'X' END AS o_orderstatus
FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderkey % 5 = 0 AND o_orderstatus <> 'X')""")
def snapshot_changes(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = old.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return detect.snapshot_changes(old, new, ["o_orderkey"], "o_orderstatus")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 10 = 3")
def deletes_detected(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return detect.deleted_rows(old, old.where("o_orderkey % 10 <> 3"))


@query("SELECT c.op, c.o_orderkey, o.o_orderpriority FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'D' ELSE 'I' END AS op, o_orderkey FROM orders) c LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) o USING (o_orderkey)")
def live_changes(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    changes = orders.select(F.when(F.col("o_orderkey") % 4 == 0, "D").otherwise("I").alias("op"), "o_orderkey")
    return detect.live_changes(changes, orders.where("o_orderkey % 4 <> 0"), ["o_orderkey"])


#: Mappings as the tables hold them: customers' names under their nations, in scopes by market segment.
STORED = """matches AS (SELECT CAST(c_custkey AS BIGINT) AS match_id, c_name AS literal_value, lower(c_name) AS normalized_value, CAST(c_nationkey AS BIGINT) AS alias_id,
  CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 7 WHEN 'MACHINERY' THEN NULL ELSE 8 END AS BIGINT) AS spec_id FROM customer),
names AS (SELECT CAST(n_nationkey AS BIGINT) AS alias_id, n_name AS alias_name, CAST(7 AS BIGINT) AS spec_id, CAST(n_regionkey + 1 AS BIGINT) AS usage_count FROM nation)"""


def stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    at, long = F.lit("2024-01-01").cast("timestamp"), lambda c: F.col(c).cast("long")
    scope = F.when(F.col("c_mktsegment") == "BUILDING", 7).when(F.col("c_mktsegment") == "MACHINERY", None).otherwise(8).cast("long")
    matches = read(spark, sf_dir, "customer").select(long("c_custkey").alias("match_id"), F.col("c_name").alias("literal_value"), F.lower("c_name").alias("normalized_value"), long("c_nationkey").alias("alias_id"), scope.alias("spec_id"), F.lit(1).cast("long").alias("run_id"), at.alias("confirmed_at"))
    names = read(spark, sf_dir, "nation").select(long("n_nationkey").alias("alias_id"), F.col("n_name").alias("alias_name"), F.lit(7).cast("long").alias("spec_id"), (long("n_regionkey") + 1).alias("usage_count"), at.alias("last_used_at"))
    return matches, names


MAPPED = f"WITH {STORED} SELECT {{}} FROM matches JOIN names USING (alias_id) WHERE matches.spec_id = 7"


@query(MAPPED.format("alias_name AS canonical_name, literal_value AS raw_value, CAST('2024-01-01' AS TIMESTAMP) AS confirmed_at"))
def lookup_export(spark, sf_dir):
    return mappings.lookup_export(mappings.mapping_rows(*stored(spark, sf_dir), 7))


@query(MAPPED.format("literal_value AS original_value, alias_name AS standardized_value"))
def run_mapping(spark, sf_dir):
    return mappings.run_mapping(mappings.mapping_rows(*stored(spark, sf_dir), 7))


@query(f"WITH {STORED} SELECT literal_value, alias_name FROM matches JOIN names USING (alias_id) WHERE matches.spec_id IS NULL")
def lookup_null_scope(spark, sf_dir):
    return mappings.mapping_rows(*stored(spark, sf_dir), None).select("literal_value", "alias_name")


@query(MAPPED.format("literal_value, alias_name") + " AND (contains(lower(literal_value), '7') OR contains(lower(alias_name), '7'))")
def mappings_search(spark, sf_dir):
    return mappings.search(mappings.mapping_rows(*stored(spark, sf_dir), 7), "7").select("literal_value", "alias_name")


@query(f"WITH {STORED} SELECT literal_value, spec_id FROM matches WHERE normalized_value IN (SELECT lower(c_name) FROM orders JOIN customer ON o_custkey = c_custkey)")
def mappings_in_column(spark, sf_dir):
    named = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_name")
    return mappings.in_column(stored(spark, sf_dir)[0], tables.distinct_values(named, "c_name")).select("literal_value", "spec_id")


@query(f"WITH {STORED}, m AS (SELECT normalized_value AS nv, max(alias_name) AS alias_name FROM matches JOIN names USING (alias_id) WHERE matches.spec_id = 7 GROUP BY 1) SELECT v.nv, v.literal_value, v.source_frequency, m.alias_name, (m.nv IS NOT NULL) AS matched_from_lookup FROM ({distinct_sql('customer', 'c_name')}) v LEFT JOIN m ON m.nv = v.nv")
def lookup_pass(spark, sf_dir):
    return mappings.lookup_pass(tables.distinct_values(read(spark, sf_dir, "customer"), "c_name"), mappings.lookup(*stored(spark, sf_dir), 7))


@query(MAPPED.format("alias_name, array_to_string(list_sort(list(DISTINCT literal_value)), '|') AS literals, count(*) AS n") + " GROUP BY alias_name")
def mappings_by_name(spark, sf_dir):
    return mappings.by_name(mappings.mapping_rows(*stored(spark, sf_dir), 7)).withColumn("literals", F.array_join("literals", "|"))


@query(f"""WITH {STORED} SELECT alias_id, alias_name, spec_id, CAST(usage_count + CASE WHEN alias_name IN (SELECT n_name FROM nation WHERE n_regionkey = 1) THEN 1 ELSE 0 END AS BIGINT) AS usage_count FROM names
UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY 'region ' || r_name), 'region ' || r_name, 7, 1 FROM region""")
def alias_upsert(spark, sf_dir):
    names = stored(spark, sf_dir)[1]
    fresh = read(spark, sf_dir, "region").select(F.concat(F.lit("region "), "r_name").alias("alias_name"))
    proposed = fresh.union(fresh).union(read(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_name")).withColumn("spec_id", F.lit(7).cast("long"))
    return mappings.upsert_names(names, proposed, F.lit("2024-02-01").cast("timestamp"), names.agg(F.max("alias_id")).first()[0]).drop("last_used_at")


@query(f"""WITH {STORED} SELECT match_id, literal_value, normalized_value, CASE WHEN spec_id = 7 AND match_id % 10 = 0 THEN 3 ELSE alias_id END AS alias_id, spec_id FROM matches
UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY lower(s_name)), s_name, lower(s_name), 2, 7 FROM supplier""")
def match_upsert(spark, sf_dir):
    matches, seven = stored(spark, sf_dir)[0], F.lit(7).cast("long").alias("spec_id")
    known = matches.where("spec_id = 7 and match_id % 10 = 0").select(F.upper("literal_value").alias("literal_value"), F.lit(3).cast("long").alias("alias_id"), seven, F.lit(1).alias("seq"))
    supplier = read(spark, sf_dir, "supplier")
    new = [supplier.select(text.alias("literal_value"), F.lit(alias).cast("long").alias("alias_id"), seven, F.lit(seq).alias("seq")) for text, alias, seq in ((F.col("s_name"), 2, 1), (F.upper("s_name"), 1, 2), (F.lit("  "), 1, 3))]
    decided = known.union(new[0]).union(new[1]).union(new[2])
    return mappings.upsert_matches(matches, decided, F.lit("2024-02-01").cast("timestamp"), 2, matches.agg(F.max("match_id")).first()[0]).drop("run_id", "confirmed_at")


@query(f"WITH {STORED} SELECT literal_value, spec_id, CASE alias_id WHEN 2 THEN 1 ELSE alias_id END AS alias_id FROM matches")
def alias_merge(spark, sf_dir):
    matches, names = stored(spark, sf_dir)
    first = names.where("alias_id = 1").first()["alias_name"]
    return mappings.rename(matches, names, 7, 2, first)[0].select("literal_value", "spec_id", "alias_id")


@query(f"""WITH {STORED}, moved AS (SELECT normalized_value AS key, alias_id AS old FROM matches WHERE spec_id = 7 AND alias_id <> 1 ORDER BY match_id LIMIT 1),
after AS (SELECT CASE WHEN spec_id = 7 AND normalized_value = key THEN 1 ELSE alias_id END AS alias_id FROM matches, moved)
SELECT alias_id, alias_name, CAST(CASE WHEN alias_id = old THEN greatest(usage_count - 1, 0) WHEN alias_id = 1 THEN usage_count + 1 ELSE usage_count END AS BIGINT) AS usage_count
FROM names, moved WHERE alias_id <> old OR alias_id IN (SELECT alias_id FROM after)""")
def repoint_moves(spark, sf_dir):
    matches, names = stored(spark, sf_dir)
    key = matches.where("spec_id = 7 and alias_id <> 1").orderBy("match_id").first()["normalized_value"]
    return mappings.repoint(matches, names, 7, key, 1)[1].select("alias_id", "alias_name", "usage_count")


@query(f"WITH {STORED} SELECT alias_id, alias_name, usage_count FROM names")
def repoint_same_name(spark, sf_dir):
    matches, names = stored(spark, sf_dir)
    one = matches.where("spec_id = 7").orderBy("match_id").first()
    names = mappings.repoint(matches, names, 7, one["normalized_value"], one["alias_id"])[1]
    return mappings.repoint(matches, names, 7, "no such key", 1)[1].select("alias_id", "alias_name", "usage_count")


@query("SELECT p_name AS alias_name, count(*) AS usage_count FROM part GROUP BY 1 ORDER BY usage_count DESC, alias_name LIMIT 10")
def top_names(spark, sf_dir):
    names = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("alias_name")).agg(F.count("*").alias("usage_count")).withColumn("last_used_at", F.lit(None).cast("timestamp"))
    return mappings.top_names(names, 10).drop("last_used_at")


@query("SELECT DISTINCT split_part(lower(trim(p_name)), ' ', 1) AS word FROM part")
def first_words(spark, sf_dir):
    return read(spark, sf_dir, "part").select(first_word(F.col("p_name")).alias("word")).distinct()


def styled(rules: dict):
    def run(spark, sf_dir):
        df = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")).union(read(spark, sf_dir, "nation").select("n_name"))
        return df.distinct().select("name", conventions.apply_rules_column(F.col("name"), rules).alias("styled"))

    return run


NAMED = "SELECT name, {} AS styled FROM (SELECT s_name AS name FROM supplier UNION SELECT n_name FROM nation)"
for name, rules, sql in (
    ("convention_upper", {"case": {"value": "upper"}}, "upper(trim(regexp_replace(name, '\\s+', ' ', 'g')))"),
    ("convention_spaces", {"spaces": {"value": "underscore"}}, "regexp_replace(trim(name), '\\s+', '_', 'g')"),
    ("convention_special", {"special_chars": {"value": "alnum_only"}}, "regexp_replace(name, '[^A-Za-z0-9]', '', 'g')"),
    ("convention_lower_hyphen", {"case": {"value": "lower"}, "spaces": {"value": "hyphen"}}, "regexp_replace(lower(trim(name)), '\\s+', '-', 'g')"),
):
    QUERIES[name], ORACLE[name] = styled(rules), NAMED.format(sql)

@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' Inc.' ELSE p_name || ', LTD' END AS name, p_name AS styled FROM part")
def convention_suffix(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" Inc."))).otherwise(F.concat("p_name", F.lit(", LTD")))
    df = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return df.withColumn("styled", conventions.apply_rules_column(F.col("name"), {"corporate_suffix": {"value": "strip"}}))


@query("""SELECT p_name AS name, array_to_string(list_filter([CASE WHEN upper(p_name) <> p_name THEN 'form' END, CASE WHEN len(string_split(p_name, ' ')) > 1 THEN 'words_over' END, CASE WHEN length(p_name) > 12 THEN 'length_over' END], lambda x: x IS NOT NULL), '|') AS problems
FROM (SELECT DISTINCT p_name FROM part)""")
def convention_violations(spark, sf_dir):
    rules = {"case": {"value": "upper"}, "word_count": {"value": "single"}, "length": {"value": "max", "max": 12}}
    df = read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return df.select("name", F.array_join(conventions.violations_column(F.col("name"), rules), "|").alias("problems"))


SCORES = f"""WITH base AS (SELECT DISTINCT p_brand AS grp, p_name AS literal FROM part),
tok AS (SELECT grp, literal, trim(regexp_replace(regexp_replace(literal, '[^\\p{{L}}\\p{{N}}\\s&-]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM base),
std AS (SELECT *, list_filter(string_split(clean, ' '), lambda x: x <> '') AS s FROM tok),
nrm AS (SELECT *, list_filter(s, lambda x: lower(x) NOT IN {naming.STOPWORDS}) AS n FROM std),
kinds AS (SELECT DISTINCT grp, literal, lower(unnest(n)) AS token FROM nrm),
df AS (SELECT grp, token, count(*) AS d FROM kinds GROUP BY 1, 2), sizes AS (SELECT grp, count(*) AS m FROM base GROUP BY 1),
rep AS (SELECT grp, literal, sum(d) / count(*) AS mean_df FROM kinds JOIN df USING (grp, token) GROUP BY 1, 2),
sig AS (SELECT grp, literal, sum(0.75 + 0.25 / pow(list_position(list_transform(n, lambda x: lower(x)), token), 0.4)) AS t, count(*) AS k FROM kinds JOIN nrm USING (grp, literal) GROUP BY 1, 2),
scored AS (SELECT grp, literal, round(sqrt((t / (t + 1.0 + 0.2 * (k - 1.0))) * (0.5 * (1 - (len(s) - len(n)) / len(s)) + 0.5 * (1 - least(0.5, length(regexp_replace(literal, '[a-zA-Z0-9\\s&''-]', '', 'g')) / greatest(length(literal), 1)))) * (mean_df / m)
 * (CASE WHEN length(clean) < 2 THEN 0.3 WHEN length(clean) <= 60 THEN 1.0 WHEN length(clean) <= 100 THEN 0.7 ELSE 0.4 END)), 6) AS name_score FROM nrm JOIN rep USING (grp, literal) JOIN sig USING (grp, literal) JOIN sizes USING (grp))"""


@query(SCORES + ' SELECT grp AS "group", literal, name_score FROM scored')
def name_score(spark, sf_dir):
    return naming.name_scores(read(spark, sf_dir, "part"), "p_brand", "p_name").withColumn("name_score", F.round("name_score", 6))


@query(SCORES + ' SELECT grp AS "group", arg_min(literal, (-name_score, length(literal), literal)) AS literal, max(name_score) AS name_score FROM scored GROUP BY 1')
def best_name(spark, sf_dir):
    return naming.best_names(naming.name_scores(read(spark, sf_dir, "part"), "p_brand", "p_name").withColumn("name_score", F.round("name_score", 6)), 6)


@query("SELECT event_id, (dayofweek(ts) BETWEEN 1 AND 5 AND hour(ts) >= 9 AND hour(ts) < 17) AS office, (dayofweek(ts) IN (5, 6) AND (hour(ts) >= 22 OR hour(ts) < 6)) AS night FROM events")
def schedule_active(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", Schedule().column(F.col("ts")).alias("office"), Schedule(days=(5, 6), start=22, end=6).column(F.col("ts")).alias("night"))


@query("""SELECT v AS nv, v AS literal_value, count(*) AS source_frequency FROM (SELECT json_extract_string(props, '$.k') AS v FROM events) WHERE v IS NOT NULL AND v <> '' GROUP BY 1""")
def json_column_values(spark, sf_dir):
    return tables.column_from_json(read(spark, sf_dir, "events"), "props", "k")


@query(f"SELECT lower(folded) AS folded, count(*) AS members, min(name) AS name FROM (SELECT DISTINCT p_name AS name, regexp_replace(trim(split_part(p_name, ' ', 1)), '\\s+', ' ', 'g') AS folded FROM part) GROUP BY 1")
def premerge_groups(spark, sf_dir):
    df = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("proposed")).distinct()
    return grouping.premerge(df, "proposed").groupBy("folded").agg(F.count("*").alias("members"), F.min("name").alias("name"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'h' WHEN c_acctbal >= 0 THEN 'm' END AS letter, CASE WHEN c_acctbal >= 5000 THEN 0.9::DOUBLE WHEN c_acctbal >= 0 THEN 0.65::DOUBLE ELSE 0.5::DOUBLE END AS score, CASE WHEN c_acctbal >= 5000 THEN 'h' WHEN c_acctbal >= 0 THEN 'm' ELSE 'l' END AS band FROM customer")
def confidence_bands(spark, sf_dir):
    letter = F.when(F.col("c_acctbal") >= 5000, "h").when(F.col("c_acctbal") >= 0, "m")
    df = read(spark, sf_dir, "customer").select("c_custkey", letter.alias("letter")).withColumn("score", naming.confidence_column(F.col("letter")))
    return df.withColumn("band", naming.band_column(F.col("score")))


@query("SELECT nation, coalesce(spec, 'none') AS spec FROM (SELECT n_name AS nation, r_name AS spec FROM nation LEFT JOIN region ON n_nationkey = r_regionkey)")
def scoped_metadata_join(spark, sf_dir):
    df = mappings.with_metadata(read(spark, sf_dir, "nation"), read(spark, sf_dir, "region"), {"n_nationkey": "r_regionkey"}, {"r_name": "spec"})
    return df.select(F.col("n_name").alias("nation"), F.coalesce("spec", F.lit("none")).alias("spec"))


@query(f"WITH {STORED} SELECT alias_name, sum(usage_count)::BIGINT AS usage_count FROM (SELECT CASE alias_name WHEN (SELECT n_name FROM nation WHERE n_nationkey = 2) THEN (SELECT n_name FROM nation WHERE n_nationkey = 3) ELSE alias_name END AS alias_name, usage_count FROM names) GROUP BY 1")
def rename_everywhere(spark, sf_dir):
    matches, names = stored(spark, sf_dir)
    two, three = (names.where(f"alias_id = {i}").first()["alias_name"] for i in (2, 3))
    return mappings.rename_everywhere(matches, names, two, three)[1].select("alias_name", "usage_count")


@query("SELECT label, item, row_number() OVER (PARTITION BY label ORDER BY p_partkey) AS place FROM (SELECT p_type AS label, p_partkey AS item, p_partkey FROM part)")
def item_numbers(spark, sf_dir):
    return grouping.numbered(read(spark, sf_dir, "part").select(F.col("p_type").alias("label"), F.col("p_partkey").alias("item")), "label", "item")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def newest_rows(spark, sf_dir):
    return mappings.newest(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate")


@query("SELECT p_brand, round(avg(coalesce(CASE WHEN p_size > 25 THEN 0.9 END, 0.5)), 9) AS confidence, CASE WHEN avg(coalesce(CASE WHEN p_size > 25 THEN 0.9 END, 0.5)) >= 0.85 THEN 'h' WHEN avg(coalesce(CASE WHEN p_size > 25 THEN 0.9 END, 0.5)) >= 0.55 THEN 'm' ELSE 'l' END AS band FROM part GROUP BY 1")
def group_confidence(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_brand", F.when(F.col("p_size") > 25, 0.9).alias("c"))
    return grouping.support(df, "p_brand", "c").withColumn("confidence", F.round("confidence", 9))


@query(f"WITH {STORED} SELECT alias_name, (SELECT count(*) FROM matches WHERE matches.alias_id = names.alias_id) AS mappings FROM names")
def usage_counts(spark, sf_dir):
    return mappings.usage_counts(*stored(spark, sf_dir)).select("alias_name", "mappings")


@query(f"WITH {STORED} SELECT literal_value, spec_id, CASE WHEN spec_id = 7 AND match_id % 3 = 0 THEN 5 ELSE alias_id END AS alias_id FROM matches WHERE NOT (spec_id IS NOT DISTINCT FROM 7 AND match_id % 5 = 0)")
def bulk_changes(spark, sf_dir):
    matches = stored(spark, sf_dir)[0]
    own = matches.where("spec_id = 7")
    moves = own.where("match_id % 3 = 0").select(F.col("normalized_value").alias("nv"), F.lit(5).cast("long").alias("alias_id"))
    deletes = own.where("match_id % 5 = 0").select(F.col("normalized_value").alias("nv"))
    return mappings.bulk_changes(matches, 7, moves, deletes, F.lit("2024-02-01").cast("timestamp")).select("literal_value", "spec_id", "alias_id")


@query(f"WITH {STORED} SELECT alias_name, literal_value, count(*) AS n FROM matches JOIN names USING (alias_id) WHERE matches.spec_id = 7 GROUP BY 1, 2")
def known_literals(spark, sf_dir):
    return mappings.known_literals(mappings.mapping_rows(*stored(spark, sf_dir), 7))


@query("SELECT n AS alias_name, c AS usage_count FROM (SELECT p_name AS n, count(*) AS c FROM part GROUP BY 1)")
def known_names(spark, sf_dir):
    names = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("alias_name")).agg(F.count("*").alias("usage_count")).withColumn("last_used_at", F.lit(None).cast("timestamp"))
    return mappings.known_names(names, read(spark, sf_dir, "part").select(F.col("p_name").alias("literal_value")))


@query("""WITH names AS (SELECT c_name AS alias_name, count(o_orderkey) AS usage_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
top AS (SELECT * FROM names ORDER BY usage_count DESC, alias_name LIMIT 200),
words AS (SELECT DISTINCT lower(c_name) AS w FROM customer ORDER BY w LIMIT 300),
rest AS (SELECT * FROM names WHERE alias_name NOT IN (SELECT alias_name FROM top) AND lower(alias_name) IN (SELECT w FROM words) ORDER BY usage_count DESC, alias_name LIMIT 100)
SELECT * FROM top UNION ALL SELECT * FROM rest""")
def known_names_beyond_the_top(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    orders = customer.join(read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    names = orders.groupBy(F.col("c_name").alias("alias_name")).agg(F.count("o_orderkey").alias("usage_count")).withColumn("last_used_at", F.lit(None).cast("timestamp"))
    return mappings.known_names(names, customer.select(F.col("c_name").alias("literal_value")))


@query(f"WITH {values(TYPES, 'm')} SELECT * FROM ({distinct_sql('customer', 'c_name')}) v ORDER BY source_frequency DESC, nv LIMIT 40")
def reconcile_limited(spark, sf_dir):
    return detect.reconcile(read(spark, sf_dir, "customer"), "c_name", mapping(spark, TYPES), queue_of(spark, ["PROMO"]), 40)


@query(export_sql(False).replace("('1-urgent', 'Urgent')", "('1-urgent', 'Urgent'), ('1-urgent', 'Zz')").replace("AS (VALUES", "AS (SELECT k, max(a) FROM (VALUES", 1).replace("'Normal')) SELECT", "'Normal')) t(k, a) GROUP BY k) SELECT", 1))
def export_duplicate_keys(spark, sf_dir):
    twice = mapping(spark, PRIORITIES).union(mapping(spark, {"1-urgent": "Zz"}))
    return export.standardize(read(spark, sf_dir, "orders"), {"o_orderpriority": twice})


@query(f"WITH {values(EVENTS, 'm')} SELECT event_id, coalesce(m.alias_name, event_type) AS event_type, value FROM events LEFT JOIN m ON m.nv = {N('event_type')}")
def file_rows(spark, sf_dir):
    return export.file_rows(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), {"event_type": mapping(spark, EVENTS)})


@query("SELECT s_suppkey, 'The ' || s_name || ' & Co.' AS name, s_name || ' and Co' AS styled FROM supplier")
def convention_articles_and_marks(spark, sf_dir):
    name = F.concat(F.lit("The "), "s_name", F.lit(" & Co."))
    df = read(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"))
    rules = {"leading_articles": {"value": "strip"}, "ampersand": {"value": "spell_out"}, "trailing_punct": {"value": "strip"}}
    return df.withColumn("styled", conventions.apply_rules_column(F.col("name"), rules))


@query("SELECT DISTINCT p_brand, 'IBM ' || p_name AS name, 'IBM ' || array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS styled FROM part")
def convention_acronyms(spark, sf_dir):
    df = read(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("IBM "), "p_name").alias("name")).distinct()
    return df.withColumn("styled", conventions.apply_rules_column(F.col("name"), {"case": {"value": "title"}, "acronyms": {"value": "force_caps"}}))


@query("SELECT event_id, event_type FROM events WHERE length(event_type) <= 5")
def within_cap(spark, sf_dir):
    return detect.drop_overlong(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 5)


def scratch(spark) -> Store:
    """A store of a query's own, in the shared folder, without names in the catalog."""
    return Store(spark, folder=f"{frames.shared_folder(spark)}/store-{uuid.uuid4().hex}", views=False)


FEED = "SELECT CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'P' THEN 'U' ELSE 'I' END AS op, o_orderpriority AS v FROM orders"


@query(f"""WITH came AS (SELECT {N('v')} AS nv, min(v) AS v, count(*) AS n FROM ({FEED}) WHERE op <> 'D' GROUP BY 1)
SELECT nv AS normalized_value, v AS literal_value, CAST(CASE WHEN nv IN ('1-urgent', '2-high') THEN n ELSE 2 * n END AS BIGINT) AS source_frequency FROM came""")
def queue_after_feed_and_drain(spark, sf_dir):
    """Two batches of a feed with a drain of two values that read the queue before the second and ended after it; each batch
    is offered again."""
    op = F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "P", "U").otherwise("I")
    batch = read(spark, sf_dir, "orders").select(op.alias("op"), F.col("o_orderpriority").alias("v"))
    store = scratch(spark)
    feed = QueueFeed(store, 1, "v")
    feed.apply(batch, 0)
    drained = frames.cut(store.read("queue").where(F.col("normalized_value").isin("1-urgent", "2-high")).select(F.col("normalized_value").alias("nv"), F.col("source_frequency").alias("n")))
    for number in (0, 1, 1):
        feed.apply(batch, number)
    store.transact(lambda now: Change({"queue": detect.settle(now.read("queue"), 1, drained)}))
    return store.read("queue").select("normalized_value", "literal_value", "source_frequency")


@query(f"WITH {values(PRIORITIES | {'2-high': 'Top'}, 'm')} SELECT o_orderkey, o_orderpriority, m.alias_name AS standardized FROM orders LEFT JOIN m ON m.nv = {N('o_orderpriority')}")
def companion_by_file(spark, sf_dir):
    """A companion column that is added, then changed where one name changes, in the files that hold it."""
    store = scratch(spark)
    store.publish("orders", read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"))
    for pairs in (PRIORITIES, PRIORITIES | {"2-high": "Top"}):
        export.sync_companions(store, "orders", {"o_orderpriority": mapping(spark, pairs)})
    return store.read("orders").withColumnRenamed("o_orderpriority_STANDARDIZED", "standardized")


@query(distinct_sql("customer", "c_mktsegment"))
def incremental_values(spark, sf_dir):
    return FileSummaries(scratch(spark), "files", f"{sf_dir}/customer.parquet", "c_mktsegment").values()


@query(export_sql(True))
def view_over_maps(spark, sf_dir):
    """Orders as a view over maps shows them."""
    store, orders = scratch(spark), read(spark, sf_dir, "orders")
    maps.sync_map(store, "priorities", tables.raw_counts(orders, "o_orderpriority"), mapping(spark, PRIORITIES))
    orders.createOrReplaceTempView("orders_of_view_over_maps")
    store.read("priorities").createOrReplaceTempView("map_of_view_over_maps")
    return spark.sql(maps.view_over_maps("orders_of_view_over_maps", orders.columns, {"o_orderpriority": "map_of_view_over_maps"}, unmapped_rows=True))


def key_sql(table: str, *columns: str) -> str:
    """The key, if its columns tell all rows apart."""
    return f"SELECT '{table}' AS name, CASE WHEN (SELECT count(*) = count(DISTINCT ({', '.join(columns)})) FROM {table}) THEN '{','.join(columns)}' END AS key"


@query(" UNION ALL ".join(key_sql(*x) for x in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("nation", "n_nationkey"), ("events", "event_id"))))
def keys_found(spark, sf_dir):
    names = ["customer", "orders", "part", "nation", "events"]
    return spark.createDataFrame([(n, ",".join(keys.discover_keys(read(spark, sf_dir, n)))) for n in names], "name string, key string")


@query("SELECT c_custkey, c_name, regexp_full_match(c_name, '[A-Z][a-z]+#0*([1-9]|[1-9][0-9])*[02468]') AS fits FROM customer")
def names_by_pattern(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return df.withColumn("fits", automaton("[A-Z][a-z]+#0*([1-9]|[1-9][0-9])*[02468]").matches(F.col("c_name")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def numbered_rows(spark, sf_dir):
    return frames.numbered(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "place", [F.desc("o_totalprice"), "o_orderkey"]).drop("o_totalprice")


@query(f"SELECT {N('raw')} AS nv, arg_min(raw, (o, raw)) AS literal_value, CAST(sum(n) AS BIGINT) AS source_frequency FROM (SELECT event_type AS raw, count(*) AS n, min(event_id) AS o FROM events GROUP BY 1) WHERE {N('raw')} <> '' GROUP BY 1")
def first_seen_values(spark, sf_dir):
    stored = read(spark, sf_dir, "events").select(F.create_map(F.lit("kind"), "event_type").alias("data"), F.col("event_id").alias("row_num"))
    return tables.column_from_map(stored, "kind")


def flagship(spark, sf_dir) -> DataFrame:
    """The orders table standardized by priority, as rows and value by canonical name."""
    done = export.standardize(read(spark, sf_dir, "orders"), {"o_orderpriority": mapping(spark, PRIORITIES)})
    return done.groupBy(F.col("o_orderpriority").alias("canonical_name")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))


QUERIES["flagship"] = flagship
ORACLE["flagship"] = f"SELECT o_orderpriority AS canonical_name, count(*) AS orders, round(sum(o_totalprice), 2) AS value FROM ({export_sql(False)}) GROUP BY 1"

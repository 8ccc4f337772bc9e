"""Work that grows with the change: streams' state, companion columns by file, summaries of files, maps, keys, numbers."""

import random
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from canonry.functions.frames import numbered
from canonry.functions.patterns import Unsupported, automaton
from canonry.functions.text import plain_path
from canonry.operators import detect, export, grouping, maps
from canonry.operators.store import Store
from canonry.plans.pipeline import Engine
from canonry.sources import keys, tables
from canonry.sources.incremental import FileSummaries
from canonry.streaming import keyed


@pytest.fixture
def store(spark):
    store = Store(spark, f"i{datetime.now().timestamp():.6f}".replace(".", "_"))
    yield store
    spark.sql(f"DROP DATABASE IF EXISTS {store.schema} CASCADE")


# the queue as keyed state


def queue_of(store):
    return {(r["pipeline_id"], r["normalized_value"]): (r["literal_value"], r["source_frequency"]) for r in store.read("queue").collect()}


def feed_rows(seed, n):
    rng = random.Random(seed)
    names = ["ATT", "att", " Att", "Verizon", "VERIZON", "Österreich", "Österreich", "  ", None, "hot"]
    return [(rng.choice("IIIUD"), rng.choice(names) if rng.random() < 0.6 else "hot") for _ in range(n)]


def test_state_replays_and_drains(spark, store, tmp_path):
    def arrive(rows, kind="came"):
        if kind == "drained":
            keyed.tell(store, f"{tmp_path}/control", f"{len(rows)}", 7, rows)
            keyed.tell(store, f"{tmp_path}/control", f"{len(rows)}", 7, rows)  # a second time: nothing
        else:
            spark.createDataFrame(rows, "op string, carrier string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        changes = spark.readStream.schema("op string, carrier string").parquet(f"{tmp_path}/in")
        query = keyed.start(store, "feed", keyed.watched(spark, changes, 7, "carrier", f"{tmp_path}/control"), f"{tmp_path}/state", every=None)
        query.awaitTermination(240)
        assert query.exception() is None

    batches = [feed_rows(1, 300), feed_rows(2, 200)]
    want = spark.createDataFrame([], store.read("queue").schema)

    def queued(want, rows):
        values = tables.distinct_values(spark.createDataFrame(rows, "op string, carrier string").where("op in ('I', 'U')"), "carrier")
        return detect.merge_queue(want, detect.queue_rows(values, 7, F.current_timestamp()), add=True)

    for rows in batches:
        arrive(rows)
        run()
        want = queued(want, rows)
    assert queue_of(store) == {(r["pipeline_id"], r["normalized_value"]): (r["literal_value"], r["source_frequency"]) for r in want.collect()}
    at = {r["normalized_value"]: r["detected_at"] for r in store.read("queue").collect()}
    # a restart with nothing new changes nothing, nor does a batch that comes again
    version = store.versions("queue")
    run()
    again = spark.createDataFrame([(7, "hot", "hot", 10**6, datetime(2024, 1, 1), 0)], keyed.OUT)
    assert keyed.follow(store, "feed", again, 0) is False and store.versions("queue") == version
    # a drain takes off what it exported; what came since stays
    hot, att = queue_of(store)[7, "hot"][1], queue_of(store)[7, "att"][1]
    arrive([("hot", hot), ("ATT", att - 2)], kind="drained")
    assert not keyed.settled(store, 7)
    run()
    assert keyed.settled(store, 7)
    assert (7, "hot") not in queue_of(store) and queue_of(store)[7, "att"][1] == 2
    arrive([("I", "hot")])
    run()
    assert queue_of(store)[7, "hot"] == ("hot", 1)
    assert {r["normalized_value"]: r["detected_at"] for r in store.read("queue").collect()}["att"] == at["att"]


def test_an_engine_drains_a_stream(spark, store, tmp_path):
    def arrive(*rows):
        spark.createDataFrame(list(rows), "op string, carrier string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(engine, p):
        changes = spark.readStream.schema("op string, carrier string").parquet(f"{tmp_path}/in")
        query = engine.watch(p, changes, f"{tmp_path}/watch", every=None)
        query.awaitTermination(240)
        assert query.exception() is None

    source = spark.createDataFrame([(1, "ATT")], "id int, carrier string")
    engine = Engine(store, lambda t: source, grouping.FoldingGrouper())
    p = engine.create("src", "carrier", {"description": "x"})
    engine.commit(p, engine.initial_run(p))
    arrive(("I", "Orange"), ("I", "orange"), ("I", "att"), ("D", "x"))
    run(engine, p)
    assert queue_of(store) == {(p.pipeline_id, "orange"): ("Orange", 2), (p.pipeline_id, "att"): ("att", 1)}
    assert engine.drain(p) == 2 and engine.drain(p) == 0  # the stream has to see the first before there is a second
    told = tmp_path / "watch" / "drained" / f"{keyed.last_told(store, p.pipeline_id)}.json"
    text = told.read_text()
    told.unlink()  # as if the driver had failed before it
    assert engine.drain(p) == 0 and told.read_text() == text
    arrive(("I", "ORANGE"), ("I", "Three"))
    run(engine, p)
    assert queue_of(store) == {(p.pipeline_id, "orange"): ("ORANGE", 1), (p.pipeline_id, "three"): ("Three", 1)}
    again = Engine(store, lambda t: source, grouping.FoldingGrouper())
    again.load_state()
    assert again.drain(again.pipelines[p.pipeline_id]) == 2
    run(again, again.pipelines[p.pipeline_id])
    assert queue_of(store) == {}


# companion columns by file


def files_of(store, table):
    return {plain_path(f) for f in store.read(table).inputFiles()}


def test_one_row_of_many_files(spark, store):
    names = spark.createDataFrame([(f"v{i}", f"Name {i}") for i in range(500)], "nv string, alias_name string")
    source = spark.range(1000).select(F.col("id"), F.concat(F.lit("V"), (F.col("id") % 600).cast("string")).alias("carrier"), F.lit("x").alias("_h"), F.lit("y").alias("_alias0"))
    store.publish("t", source.repartitionByRange(50, "id"))
    assert len(files_of(store, "t")) == 50
    assert export.sync_companions(store, "t", {"carrier": names}) == 900  # 100 spellings in 100 rows have no name
    before, rows = files_of(store, "t"), store.read("t").count()
    version = store.versions("t")
    assert export.sync_companions(store, "t", {"carrier": names}) == 0 and store.versions("t") == version
    # v450 is in row 450 alone
    changed = names.withColumn("alias_name", F.when(F.col("nv") == "v450", "Other").otherwise(F.col("alias_name")))
    assert export.sync_companions(store, "t", {"carrier": changed}) == 1
    after = files_of(store, "t")
    assert len(before - after) == 1 and len(after - before) <= 4 and rows == store.read("t").count() == 1000
    want = export.companion_columns(source, {"carrier": changed})
    assert sorted(map(tuple, store.read("t").collect())) == sorted(map(tuple, want.collect()))
    # a name that goes: its rows are blanked, and no others
    assert export.sync_companions(store, "t", {"carrier": changed.where("nv <> 'v3'")}) == 2
    assert store.read("t").where("carrier_STANDARDIZED is null").count() == 102


def test_files_outlive_versions_that_share_them(spark, store, monkeypatch):
    monkeypatch.setattr("canonry.operators.store.GRACE", -1)
    names = spark.createDataFrame([(f"v{i}", f"Name {i}") for i in range(40)], "nv string, alias_name string")
    store.publish("t", spark.range(40).select("id", F.concat(F.lit("v"), "id").alias("c")).repartitionByRange(8, "id"))
    export.sync_companions(store, "t", {"c": names})
    for i in range(4):
        names = names.withColumn("alias_name", F.when(F.col("nv") == f"v{i}", "Other").otherwise(F.col("alias_name")))
        assert export.sync_companions(store, "t", {"c": names}) == 1
    assert store.read("t").count() == 40 and store.read("t").where("c_STANDARDIZED = 'Other'").count() == 4


def test_columns_are_synced_from_the_engine(spark, store):
    source = spark.createDataFrame([(i, n) for i, n in enumerate(["ATT", "att", "VZW", "Orange"])], "id int, carrier string")
    engine = Engine(store, lambda t: source, grouping.FoldingGrouper())
    p = engine.create("src", "carrier", {"description": "x"}, export_name="out", export_kind="column")
    engine.commit(p, engine.initial_run(p, 2))
    engine.poll(p, "s1")
    engine.refresh(p)
    files = files_of(store, "out")
    engine.refresh(p)
    assert files_of(store, "out") == files
    engine.drain(p)
    assert store.read("out").where("carrier_STANDARDIZED is null").count() == 0


def test_exports_with_odd_names_and_values(spark):
    rows = [(1, "ATT", "a", "b"), (2, "Österreich", "c", "d"), (3, "Österreich", "e", "f"), (4, "　", "g", "h"), (5, "ção", "i", "j"), (6, None, "k", "l")]
    source = spark.createDataFrame(rows, "id int, carrier string, _alias0 string, _key0 string")
    names = spark.createDataFrame([("att", "AT&T"), ("österreich", "Austria")], "nv string, alias_name string")
    got = {r["id"]: tuple(r)[1:] for r in export.standardize(source, {"carrier": names}).collect()}
    assert got == {1: ("AT&T", "a", "b"), 2: ("Austria", "c", "d"), 3: ("Austria", "e", "f"), 4: ("　", "g", "h"), 6: (None, "k", "l")}
    plan = export.standardize(source, {"carrier": names})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


# summaries of files


def test_only_changed_files_are_read(spark, store, tmp_path):
    rng, path = random.Random(4), f"{tmp_path}/source"

    def write(part, mode="append"):
        rows = [(rng.choice(["ATT", "att ", "VZW", "Orange", f"v{rng.randint(0, 20)}", None, " "]), i) for i in range(200)]
        spark.createDataFrame(rows, "carrier string, n int").coalesce(1).write.mode(mode).parquet(f"{path}/part={part}")

    def same(summaries):
        got = {tuple(r) for r in summaries.values().select("nv", "literal_value", "source_frequency").collect()}
        whole = tables.distinct_values(spark.read.parquet(path), "carrier")
        return got == {tuple(r) for r in whole.select("nv", "literal_value", "source_frequency").collect()}

    for part in range(6):
        write(part)
    summaries = FileSummaries(store, "files_1", path, "carrier")
    assert same(summaries) and summaries.read == 6
    assert same(summaries) and summaries.read == 0 and not summaries.refresh()
    for _ in range(6):
        action, part = rng.choice(["add", "change", "remove"]), rng.randint(0, 8)
        if action == "remove":
            import shutil

            shutil.rmtree(f"{path}/part={rng.choice([p.name for p in tmp_path.joinpath('source').iterdir()]).partition('=')[2]}")
            spark.catalog.refreshByPath(path)
        else:
            write(part, "append" if action == "add" else "overwrite")
        assert same(summaries) and summaries.read <= 1
    again = FileSummaries(store, "files_1", path, "carrier")
    assert same(again) and again.read == 0


def test_engine_reads_files_that_changed(spark, store, tmp_path):
    path = f"{tmp_path}/s"
    for i, n in enumerate(["ATT", "VZW", "Orange"]):
        spark.createDataFrame([(i, n)], "id int, carrier string").coalesce(1).write.parquet(f"{path}/p={i}")
    engine = Engine(store, lambda t: spark.read.parquet(path), grouping.FoldingGrouper(), folders=lambda t: path)
    p = engine.create("s", "carrier", {"description": "x"})
    engine.commit(p, engine.initial_run(p))
    assert engine.poll(p) == 0
    spark.createDataFrame([(9, "Three")], "id int, carrier string").coalesce(1).write.parquet(f"{path}/p=9")
    assert engine.poll(p) == 1 and engine.poll(p) == 0
    assert store.read(f"files_{p.pipeline_id}").select("file").distinct().count() == 4


# maps under views


def test_a_view_over_maps_follows_every_change(spark, store):
    rows = [(1, "ATT"), (2, "att"), (3, " VZW"), (4, None), (5, " \t"), (6, "Österreich"), (7, "Sprint")]
    names = [("att", "AT&T"), ("vzw", "Verizon")]

    def check(unmapped):
        source, mapping = store.read("src"), spark.createDataFrame(names, "nv string, alias_name string")
        got = maps.sync_map(store, "m", tables.raw_counts(source, "carrier"), mapping)
        view = spark.sql(maps.view_over_maps(store.name("src"), source.columns, {"carrier": store.name("m")}, unmapped))
        want = export.standardize(source, {"carrier": mapping}, unmapped)
        assert sorted(map(repr, view.collect())) == sorted(map(repr, want.collect()))
        plan = view._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "ArrowEval" not in plan
        return got

    store.publish("src", spark.createDataFrame(rows, "id int, carrier string"))
    assert check(False) == (6, 0) and check(True) == (0, 0)
    version = store.versions("m")
    assert check(False) == (0, 0) and store.versions("m") == version
    names.append(("österreich", "Austria"))
    assert check(False) == (0, 1)
    rows += [(8, "Österreich"), (9, "ATT "), (10, "New")]
    store.publish("src", spark.createDataFrame(rows, "id int, carrier string"))
    assert check(False) == (3, 0) and check(True) == (0, 0)
    names[:] = [("att", "A T and T"), ("new", "New Inc")]
    assert check(False)[1] == 7
    store.publish("src", spark.createDataFrame(rows[4:], "id int, carrier string"))
    names.append(("sprint", "Sprint"))
    assert check(False) == (0, 1) and check(True) == (0, 0)


def test_view_exports_from_the_engine(spark, store):
    store.publish("src", spark.createDataFrame([(1, "ATT"), (2, "att"), (3, "VZW")], "id int, carrier string"))
    name = store.name("src")
    engine = Engine(store, spark.table, grouping.FoldingGrouper())
    p = engine.create(name, "carrier", {"description": "x"}, export_name="live", export_kind="view")
    engine.commit(p, engine.initial_run(p))
    live = lambda: sorted(r["id"] for r in spark.table(store.name("live")).collect())
    assert live() == [1, 2, 3]
    store.publish("src", spark.createDataFrame([(1, "ATT"), (4, "Orange"), (5, " ")], "id int, carrier string"))
    assert live() == [1, 5]
    engine.poll(p)
    engine.drain(p)
    assert live() == [1, 4, 5]


# patterns


PIECES = ["a", "b", "é", "𝛼", "[ab]", "[^a]", "[a-c𝛼]", r"\d", r"\w", r"\S", ".", "(?:ab)", "(a|bc)", "(?:a|)", r"\.", "-", " "]


def test_patterns_agree_with_the_usual_engine(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        pattern = "".join(rng.choice(PIECES) + rng.choice(["", "", "*", "+", "?", "{2}", "{1,3}", "{2,}"]) for _ in range(rng.randint(1, 5)))
        pattern = rng.choice(["", "^"]) + pattern + rng.choice(["", "$"])
        try:
            compiled = automaton(pattern)
        except Unsupported:
            continue
        texts = ["".join(rng.choice("aabbc1é𝛼.- \n") for _ in range(rng.randint(0, 8))) for _ in range(20)]
        for t in texts:
            assert compiled.fullmatch(t) == bool(re.fullmatch(pattern.removesuffix("$"), t, re.ASCII)), (pattern, t)
        pairs.append((compiled, texts))
    assert len(pairs) > 250
    for compiled, texts in pairs[::25]:
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        assert [r[0] for r in df.select(compiled.matches(F.col("t"))).collect()] == [compiled.fullmatch(t) for t in texts], compiled.pattern


def test_patterns_end_soon(spark):
    compiled = automaton("(a+)+b")
    start = time.perf_counter()
    assert not compiled.fullmatch("a" * 200) and compiled.fullmatch("a" * 199 + "b")
    assert time.perf_counter() - start < 0.05
    df = spark.createDataFrame([("a" * 200,), ("a" * 199 + "b",)], "t string")
    assert [r[0] for r in df.select(compiled.matches(F.col("t"))).collect()] == [False, True]


@pytest.mark.parametrize("pattern", [r"(a)\1", "(?=a)b", "a^b", r"\bword", "(?i)a", "(?:a{50}){200}", "(?:a|b)*a(?:a|b){12}"])
def test_patterns_beyond_an_automaton(pattern):
    with pytest.raises(Unsupported):
        automaton(pattern)


# keys and numbers


def test_keys_among_decoys(spark):
    n = 3000
    rows = spark.range(n).select(
        F.when(F.col("id") == 7, 8).otherwise(F.col("id")).alias("almost_id"), F.when(F.col("id") == 9, None).otherwise(F.col("id")).alias("hole_id"),
        F.concat(F.lit("r"), "id").alias("label"), (n - F.col("id")).alias("Row Key"), F.rand(1).alias("noise"), F.lit(1).alias("one"),
    )
    assert keys.discover_keys(rows) == ["Row Key"] and keys.discover_keys(rows.drop("Row Key")) == ["label"]
    lines = spark.range(n).select((F.col("id") / 3).cast("int").alias("order_id"), (F.col("id") % 3).alias("line"), (F.col("id") / 2).cast("int").alias("part_id"))
    assert keys.discover_keys(lines) == ["order_id", "line"]
    assert keys.discover_keys(lines.union(lines)) == [] and keys.discover_keys(lines.limit(0)) == [] and keys.discover_keys(rows.select("noise")) == []


def test_exports_are_laid_out_by_the_key_found(spark, store):
    source = spark.range(200).select(((F.col("id") * 77) % 200).alias("row_id"), F.lit("ATT").alias("carrier")).repartition(5)
    engine = Engine(store, lambda t: source, grouping.FoldingGrouper(), declared=lambda t: {})
    p = engine.create("src", "carrier", {"description": "x"}, export_name="out", keys="discover")
    assert p.keys == ["row_id"]
    engine.commit(p, engine.initial_run(p))
    spans = [(r["a"], r["b"]) for r in store.read("out").groupBy(F.col("_metadata.file_path")).agg(F.min("row_id").alias("a"), F.max("row_id").alias("b")).orderBy("a").collect()]
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:])) and store.read("out").count() == 200
    other = Engine(store, lambda t: source, grouping.FoldingGrouper(), declared=lambda t: {"unique": [["row_id"], ["carrier"]], "clustering": [["carrier"]]})
    assert other.keys_of("src", None) == ["carrier"]


def test_numbers_without_one_task(spark):
    rows = spark.range(20_000).select(((F.col("id") * 7919) % 20_011).alias("v"), F.lit("x").alias("n_"))
    got = numbered(rows.repartition(8), "n", ["v"], start=100)
    assert [r["n"] for r in got.orderBy("v").collect()] == list(range(101, 20_101)) and got.columns == ["v", "n_", "n"]
    assert numbered(rows.limit(0), "n", ["v"]).count() == 0
    tied = numbered(spark.createDataFrame([(1,), (1,), (0,), (None,)], "v int"), "n", [F.asc_nulls_last("v")])
    assert sorted((r["n"], r["v"]) for r in tied.collect() if r["v"] is not None) == [(1, 0), (2, 1), (3, 1)]

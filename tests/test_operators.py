from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from canonry.functions.normalize import normalize_value, with_keys
from canonry.operators import detect, export, grouping, mappings
from canonry.operators.onetime import OneTime
from canonry.operators.store import Conflict, Store
from canonry.plans.pipeline import Engine
from canonry.sources import tables
from canonry.streaming.feed import QueueFeed

CARRIERS = [(6, "att", "Bonn"), (2, "AT&T ", "Ulm"), (3, "VZW", "Jena"), (1, "verizon", "Kiel"), (5, "Sprint", "Trier"), (4, None, "Hof"), (7, " \t", "Wien")]
NAMES = [("att", "AT&T"), ("at&t", "AT&T"), ("vzw", "Verizon"), ("verizon", "Verizon")]


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame(CARRIERS, "id int, carrier string, city string")


@pytest.fixture(scope="module")
def mapping(spark):
    return spark.createDataFrame(NAMES, "nv string, alias_name string")


@pytest.fixture
def store(spark):
    store = Store(spark, f"s{datetime.now().timestamp():.6f}".replace(".", "_"))
    yield store
    spark.sql(f"DROP DATABASE IF EXISTS {store.schema} CASCADE")


def test_scans(spark, source):
    got = {r["nv"]: r["source_frequency"] for r in tables.distinct_values(source, "carrier").collect()}
    assert got == {"att": 1, "at&t": 1, "vzw": 1, "verizon": 1, "sprint": 1}
    assert tables.diff_scan(source, "carrier", 3)[1] and not tables.diff_scan(source, "carrier", 10)[1]
    assert tables.preview_values(source, "carrier").count() == 6
    assert [c["is_text"] for c in tables.columns(source)] == [False, True, True]
    assert tables.readable(source)
    stored = spark.createDataFrame([("n", 1, {"c": "ATT"}), ("n", 2, {"c": "att"}), ("n", 3, {"c": "b"})], "session_nonce string, row_num int, data map<string,string>")
    assert [tuple(r) for r in tables.column_from_map(stored, "c").collect()] == [("att", "ATT", 2), ("b", "b", 1)]
    assert tables.session_rows(stored, "n").count() == 3


def test_export(source, mapping):
    kept = {r["id"]: r["carrier"] for r in export.standardize(source, {"carrier": mapping}).collect()}
    assert kept == {6: "AT&T", 2: "AT&T", 3: "Verizon", 1: "Verizon", 4: None, 7: " \t"}
    everything = export.standardize(source, {"carrier": mapping}, unmapped_rows=True)
    assert everything.count() == 7 and everything.columns == source.columns and everything.where("id = 5").first()["carrier"] == "Sprint"


def test_export_two_columns(source, mapping, spark):
    cities = spark.createDataFrame([("bonn", "Bonn"), ("jena", "Jena")], "nv string, alias_name string")
    assert {r["id"] for r in export.standardize(source, {"carrier": mapping, "city": cities}).collect()} == {6, 3}


def test_companion(source, mapping):
    synced = export.companion_columns(source, {"carrier": mapping})
    assert synced.where("id = 5").first()["carrier_STANDARDIZED"] is None and synced.count() == 7
    assert export.companion_delta(synced, {"carrier": mapping}).count() == 0
    with pytest.raises(ValueError):
        export.companion_columns(synced, {"carrier": mapping})


def test_keys_that_need_composing(spark):
    """Rows that Python never sees and those that it does get the same keys as values one by one; keys that a mapping has
    twice don't multiply rows."""
    values = ["Caf\u00e9", "Cafe\u0301", "  \u00c4B\tc ", "\u03a3igma", "\u2003x\u2003", None, "", "\u212b", "plain"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    got = {r["id"]: r["k"] for r in with_keys(df, {"v": "k"}).collect()}
    assert got == {i: None if v is None else normalize_value(v) for i, v in enumerate(values)}
    twice = spark.createDataFrame([("caf\u00e9", "A"), ("caf\u00e9", "B"), ("plain", "P")], "nv string, alias_name string")
    out = export.standardize(df, {"v": twice}, unmapped_rows=True)
    assert out.count() == len(values) and {r["v"] for r in out.where("id < 2").collect()} == {"B"}


def test_export_guards_and_layout(spark, source):
    with pytest.raises(ValueError):
        export.guard("a.t", "A.T")
    with pytest.raises(ValueError):
        export.guard("a.t", "x.y", claims={"X.Y": "other"})
    with pytest.raises(ValueError):
        export.guard("a.t", "internal.q", internal=("internal",))
    export.guard("a.t", "x.y", claims={"x.y": "A.T"})
    assert export.ordering({"unique": [["b"], ["a"]], "clustering": [["c"]]}) == ["a"] and export.ordering({}) == []
    assert export.ordered(source, ["id"], 2).count() == 7


def test_view(spark, store, source, mapping):
    from canonry.functions.normalize import register

    register(spark)
    store.publish("src", source)
    store.publish("maps", mapping)
    sql = export.view_sql(store.name("src"), source.columns, {"carrier": store.name("maps")})
    assert {r["id"] for r in spark.sql(sql).collect()} == {6, 2, 3, 1, 4, 7}


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, " ")], "k int, v string")
    changes = detect.snapshot_changes(old, new, ["k"], "v")
    assert sorted((r["op"], r["k"], r["v"]) for r in changes.collect()) == [("D", 3, None), ("I", 4, " "), ("U", 2, "c")]
    assert detect.change_flags(changes, "v").first().asDict() == {"deletes": 2, "blank_inserts": 1, "inserts": 2}
    assert detect.rebuild_needed({"deletes": 0, "blank_inserts": 0, "inserts": 1}, True, "table") and not detect.rebuild_needed({"deletes": 0, "blank_inserts": 0, "inserts": 1}, True, "view")
    assert detect.deleted_rows(old, new).count() == 2
    assert detect.health(old, "k") and detect.health(old, "zz") and detect.health(old, "V") is None


def test_reconcile_makes_headway(spark, source, mapping):
    empty = spark.createDataFrame([], "pipeline_id long, literal_value string, normalized_value string, source_frequency long, detected_at timestamp")
    found = detect.reconcile(source, "carrier", mapping, empty, 1).collect()
    assert [r["nv"] for r in found] == ["sprint"]


def test_mapping_writes(spark):
    at = F.lit("2024-01-01").cast("timestamp")
    names = spark.createDataFrame([(1, "A", 7, 2), (2, "B", 7, 1)], "alias_id long, alias_name string, spec_id long, usage_count long").withColumn("last_used_at", at)
    matches = spark.createDataFrame([(1, "a", "a", 1, 7, 1), (2, "b", "b", 2, 7, 1), (3, "aa", "aa", 1, 7, 1)], "match_id long, literal_value string, normalized_value string, alias_id long, spec_id long, run_id long").withColumn("confirmed_at", at)
    moved, left = mappings.repoint(matches, names, 7, "b", 1)
    assert {r["alias_name"]: r["usage_count"] for r in left.collect()} == {"A": 3} and moved.where("alias_id = 1").count() == 3
    for key, to in (("b", 2), ("zz", 1)):  # it has that name already; nobody knows it
        moved, left = mappings.repoint(matches, names, 7, key, to)
        assert {r["alias_name"]: r["usage_count"] for r in left.collect()} == {"A": 2, "B": 1} and moved.where("alias_id = 1").count() == 2
    merged, kept = mappings.rename(matches, names, 7, 2, "A")
    assert kept.count() == 1 and merged.where("alias_id = 1").count() == 3
    renamed, kept = mappings.rename(matches, names, 7, 2, "C")
    assert {r["alias_name"] for r in kept.collect()} == {"A", "C"}
    gone = spark.createDataFrame([("a",)], "nv string")
    assert mappings.remove(matches, 7, gone).count() == 2 and mappings.remove(matches, None, gone).count() == 3
    seeds = spark.createDataFrame([("A",), ("New",), ("new",), (" ",)], "literal_value string")
    assert [r["literal_value"] for r in mappings.seed_rows(seeds, matches, 7).collect()] == ["New"]
    assert mappings.known_names(names, seeds).count() == 2 and mappings.page(matches, 1)[1] == 3


def test_chunks():
    items = [grouping.Item(i, f"{'abc'[i // 20]}word {i:02d}") for i in range(60)]
    parts = grouping.chunks(items)
    assert [len(p) for p in parts] == [20, 20, 20] and sum(parts, []) == sorted(items, key=lambda i: i.literal)
    assert [len(p) for p in grouping.chunks([grouping.Item(i, f"same {i:03d}") for i in range(60)])] == [25, 25, 10]
    assert grouping.chunks([]) == []


def test_checked_answers():
    chunk = [grouping.Item(i, x) for i, x in enumerate("abcd", 1)]
    groups, loose = grouping.checked(grouping.Answer((((0, 9, 1), "N", "h"), ((1,), "M", "h")), (2,)), chunk)
    assert [g.items for g in groups] == [(1, 2), (4,)] and loose == [3]
    g = [grouping.Group("A b", (1,), "h"), grouping.Group("a  B", (2, 3), "l"), grouping.Group(None, (4,))]
    assert [(x.name, x.items, x.confidence) for x in grouping.merged_by_name(g)] == [(None, (4,), "m"), ("a  B", (1, 2, 3), "l")]
    assert len(grouping.apply_merges(g, [([1, 1], "x"), ([0, 2], "y"), ([0, 1], "z")])) == 2


def test_auto_group(spark):
    literals = ["Acme Inc", "ACME", "acme, inc.", "The Acme", "International Business Machines", "IBM", "Zeta"]
    run = grouping.Run(1, 7, grouping.items_of([(x, 1) for x in literals] + [(" ", 9)], {"zeta": "Zeta Co"}))
    done = grouping.auto_group(spark, run, grouping.FoldingGrouper())
    by_item = {x: n for x, n in done.mappings()}
    assert set(by_item) == set(literals) and len(done.mappings()) == len(literals)
    assert len({by_item[x] for x in literals[:4]}) == 1 and by_item["Zeta"] == "Zeta Co" and by_item["IBM"] == by_item["International Business Machines"]
    styled = grouping.auto_group(spark, run, grouping.FoldingGrouper(), rules={"case": {"value": "upper"}})
    assert all(n == n.upper() for x, n in styled.mappings() if x != "Zeta")


def failing():
    class Failing:  # sent to workers by value
        def group(self, literals, known_names):
            raise ValueError("no")

    return Failing()


def test_all_chunks_failed(spark):
    with pytest.raises(RuntimeError):
        grouping.auto_group(spark, grouping.Run(1, 7, grouping.items_of([("a", 1)])), failing())


def test_review_and_deviations():
    items = grouping.items_of([("a", 1), ("b", 1), ("c", 1)])
    run = grouping.Run(1, 7, items, [grouping.Group("A", (1, 2), "h", "lookup_validated"), grouping.Group("C", (3,), "h")])
    after = grouping.review(run, moves={2: "New"})
    assert [g.name for g in after.groups] == ["A", "C", "New"] and grouping.deviations(run, after) == [("A", 2)]
    assert grouping.deviations(run, grouping.review(run, {"A": "X"})) == [("B", 1), ("B", 2)]
    assert [g.name for g in grouping.review(run, moves={3: "A"}).groups] == ["A"]


def test_retry():
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "done"

    assert grouping.with_retry(call, sleep=lambda s: None) == "done"
    with pytest.raises(OSError):
        grouping.with_retry(lambda: (_ for _ in ()).throw(OSError("x")), retryable=lambda e: False, sleep=lambda s: None)


def test_store(store, source):
    assert store.publish("t", source) == 1 and store.publish("t", store.read("t").limit(3)) == 2 and store.read("t").count() == 3
    store.publish("t", source)
    assert store.versions("t") == [2, 3]
    with pytest.raises(ValueError):
        store.create("t", source)
    assert store.save("runs", 1, "a", 0) == 1
    with pytest.raises(Conflict):
        store.save("runs", 1, "b", 0)
    assert store.update("runs", 1, lambda d: d + "b") == 2 and store.load("runs", 1) == (2, "ab")
    store.drop("t")
    assert not store.exists("t") and store.read("queue").count() == 0


def test_pipeline(spark, store, source):
    now = [datetime(2024, 1, 1, 10, tzinfo=timezone.utc)]
    data = {"src": source}
    engine = Engine(store, data.__getitem__, grouping.FoldingGrouper(), clock=lambda: now[0])
    events = []
    engine.listeners.append(lambda name, d: events.append(name))
    with pytest.raises(ValueError):
        engine.create("src", "id", {"description": "x"})
    with pytest.raises(ValueError):
        engine.create("src", "carrier", {"description": ""})
    p = engine.create("src", "carrier", {"description": "carriers", "seeds": ["Sprint"]}, export_name="out", unmapped_rows=True)
    run = engine.initial_run(p)
    assert len(run.items) == 5
    engine.commit(p, run)
    assert p.status == "active" and store.read("out").count() == 7
    with pytest.raises(ValueError):
        engine.create("src", "Carrier", {"description": "again"})
    assert engine.poll(p, "s1") == 0 and engine.poll(p, "s1") == 0
    data["src"] = source.union(spark.createDataFrame([(8, "Orange", "Genf")], source.schema))
    assert engine.poll(p, "s2") == 1 and p.queue_size == 1
    now[0] = now[0].replace(hour=20)
    assert engine.tick() == {}
    now[0] = now[0].replace(hour=11)
    assert engine.tick() == {p.pipeline_id: 1} and p.queue_size == 0 and p.synced_at == now[0]
    assert store.read("out").where("id = 8").first()["carrier"] == "Orange" and engine.metrics(p) == {"total_source_values": 6, "total_mapped": 6}
    engine.sweep()
    assert "exported" in events and "metrics" in events
    data["src"] = source.drop("carrier")
    engine.poll(p, "s3")
    assert p.status == "paused" and p.blocked()
    data["src"] = source
    engine.resume(p)
    assert p.status == "active" and p.reason is None
    engine.delete(p.pipeline_id)
    assert engine.listing() == []


def test_changes_state_and_open_runs(spark, store, source):
    now = [datetime(2024, 1, 1, 10, tzinfo=timezone.utc)]
    data = {"src": source}
    engine = Engine(store, data.__getitem__, grouping.FoldingGrouper(), clock=lambda: now[0])
    p = engine.create("src", "carrier", {"description": "carriers"}, export_name="out")
    engine.commit(p, engine.initial_run(p))
    changes = spark.createDataFrame([("I", "Orange"), ("I", "orange"), ("I", "att"), ("D", "zz")], "op string, carrier string")
    assert engine.poll_changes(p, changes) == 2 and p.queue_size == 2
    assert {r["normalized_value"]: r["source_frequency"] for r in store.read("queue").collect()} == {"orange": 2, "att": 1} and engine.poll_changes(p, changes.limit(0)) == 0
    run = engine.open_run(p)
    engine.step(run, "validating")
    assert [i.literal for i in run.items] == ["Orange", "att"] and engine.open_run(p).run_id != run.run_id
    late = engine.step(engine.run(p.queue_run), "validating")
    now[0] = now[0].replace(minute=31)
    assert engine.open_run(p).run_id == late.run_id
    again = Engine(store, data.__getitem__, grouping.FoldingGrouper(), clock=lambda: now[0])
    again.load_state()
    assert again.pipelines == engine.pipelines and again.run(run.run_id) == engine.run(run.run_id)
    assert again.create("src", "city", {"description": "cities"}).pipeline_id == p.pipeline_id + 1


def test_sync_companions_in_place(spark, store, source, mapping):
    store.publish("t", source)
    assert export.sync_companions(store, "t", {"carrier": mapping}) == 4
    before = store.versions("t")
    assert export.sync_companions(store, "t", {"carrier": mapping}) == 0 and store.versions("t") == before
    assert export.sync_companions(store, "t", {"carrier": mapping.where("nv <> 'att'")}) == 1
    assert store.read("t").columns == [*source.columns, "carrier_STANDARDIZED"] and store.read("t").count() == 7


def test_modes_gaps_and_columns(spark, store, source):
    assert detect.choose_mode(["id"], True, True) == ("stream", None) and detect.choose_mode([], True, True)[0] == "diff"
    assert [detect.after_gap(*x) for x in ((None, 1, 5), (3, 1, 5), (5, 1, 5), (2, 9, 12), (8, 9, 12), (20, 9, 12))] == ["reconcile", "read", "wait", "reconcile", "read", "reconcile"]
    assert detect.after_gap(3, 1, 5, recreated=True) == "reconcile"
    store.publish("d", source)
    got = tables.described(spark.sql(f"DESCRIBE {store.name('d')}"))
    assert [(c["name"], c["is_text"]) for c in got] == [("id", False), ("carrier", True), ("city", True)]
    assert tables.key_columns(source, ["CITY", "id"]) == ["city", "id"]
    with pytest.raises(ValueError):
        tables.key_columns(source, ["nope"])


def test_backoff(spark, store, source):
    engine = Engine(store, lambda name: source, failing(), clock=lambda: datetime(2024, 1, 1, 10, tzinfo=timezone.utc))
    p = engine.create("src", "carrier", {"description": "x"})
    p.status = "active"
    engine.reconcile(p)
    engine.tick()
    assert p.failures == 1 and p.retry_at.minute == 2 and engine.tick() == {}


def test_one_time(spark, store):
    from canonry.sources import files

    raw = b"Carrier,City\r\nATT,Bonn\r\natt,Ulm\r\nO'Brien,Hof\r\n"
    table = files.grid_table(spark, files.csv_grid(raw))
    one = OneTime(store)
    one.open("n1", table, ["Carrier"], raw)
    one.group("n1", grouping.FoldingGrouper())
    assert one.status("n1")["Carrier"]["groups"] == 2
    names = {r["Carrier"] for r in one.standardized("n1").collect()}
    assert len(names) == 2 and "O'Brien" in names
    patched = one.patched_csv("n1").decode().split("\r\n")
    assert patched[0] == "Carrier,City" and patched[1].split(",")[0] == patched[2].split(",")[0]
    one.write("n1", "target")
    with pytest.raises(ValueError):
        one.write("n1", "target")
    one.open("n2", table, ["Carrier"])
    one.group("n2", grouping.FoldingGrouper())
    with pytest.raises(PermissionError):
        one.write("n2", "target", overwrite=True)
    one.write("n2", "target", overwrite=True, confirmed=True)
    assert one.archive() == ["n2", "n1"] and store.read("target").count() == 3


def test_stream(spark, store, tmp_path):
    changes = spark.createDataFrame([("I", "ATT"), ("I", "att"), ("D", "x"), ("U", "VZW"), ("I", " ")], "op string, carrier string")
    changes.write.parquet(f"{tmp_path}/in")
    flags = []
    feed = QueueFeed(store, 1, "carrier", flags.append)
    stream = spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/in")
    feed.start(stream, f"{tmp_path}/state", every=None).awaitTermination(120)
    assert {r["normalized_value"]: r["source_frequency"] for r in store.read("queue").collect()} == {"att": 2, "vzw": 1}
    assert flags == [{"deletes": 2, "blank_inserts": 1, "inserts": 4}]
    assert feed.apply(changes, 0) is False and feed.apply(changes, 1) is True
    assert store.read("queue").where("normalized_value = 'att'").first()["source_frequency"] == 4
    drained = detect.drain(store.read("queue"), 1, 1)
    assert drained.count() == 1 and detect.dequeue(store.read("queue"), 1, drained.select(F.col("normalized_value").alias("nv"))).count() == 1
    assert normalize_value("ATT") == "att"


def test_signature(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    one = detect.signature(spark, f"{tmp_path}/t")
    assert one == detect.signature(spark, f"{tmp_path}/t")
    spark.range(5).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert one != detect.signature(spark, f"{tmp_path}/t")


def test_run_documents(spark):
    items = [grouping.Item(0, "a"), grouping.Item(1, "b"), grouping.Item(0, "c")]
    assert [i.id for i in grouping.numbered_items(items)] == [1, 2, 3]
    run = grouping.Run(1, 7, grouping.items_of([("a", 1), ("b", 1)]), [grouping.Group("A", (1, 1), "h")])
    assert [(r["name"], r["needs_review"], r["literals"]) for r in grouping.review_rows(run)] == [("A", False, ["a"]), ("b", True, ["b"])]
    log = spark.createDataFrame([], "literal_value string, run_id long, original_alias_name string, user_changed_to string, decided_at timestamp")
    new = spark.createDataFrame([("x" * 900, 1, "a", None)], "literal_value string, run_id long, original_alias_name string, user_changed_to string")
    assert len(mappings.audit_rows(log, new, F.current_timestamp()).first()["literal_value"]) == 800


def test_deferred_commit_and_manual_processing(spark, store, source):
    engine = Engine(store, lambda name: source, grouping.FoldingGrouper())
    p = engine.create("src", "carrier", {"description": "x"}, export_name="out2", export_kind="column")
    run = engine.initial_run(p, 2)
    engine.approve(p, run)
    assert run.status == "approved" and p.status == "paused" and store.read("literal_matches").count() == 0
    engine.commit(p, run)
    assert p.status == "active" and "carrier_STANDARDIZED" in store.read("out2").columns
    assert engine.process_now(p) == 3 and p.queue_size == 0
    before = store.ids("runs")
    assert engine.propose(p, tables.distinct_values(source, "carrier")).groups and store.ids("runs") == before
    assert engine.poll_table("SRC", "sig") == 0 and p.last_polled_at is not None

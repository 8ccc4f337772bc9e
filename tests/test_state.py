"""State that several drivers share: commits, leases, feeds and runs, with the interleavings that lost rows before."""

import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from canonry.operators import detect, grouping, leases
from canonry.operators.commits import CommitLog, Entry
from canonry.operators.store import Change, Conflict, Store
from canonry.plans.pipeline import STALE, Engine
from canonry.streaming.feed import ChangeLog, QueueFeed

ROWS = [(1, "ATT", "Bonn"), (2, "att", "Ulm"), (3, "VZW", "Jena"), (4, None, "Hof"), (5, " ", "Wien")]
SOURCE = "id int, carrier string, city string"


@pytest.fixture
def store(spark):
    store = Store(spark, f"t{datetime.now().timestamp():.6f}".replace(".", "_"))
    yield store
    spark.sql(f"DROP DATABASE IF EXISTS {store.schema} CASCADE")


@pytest.fixture
def other(spark, store):
    """The same store as another driver sees it."""
    return Store(spark.newSession(), store.schema, store.root)


def numbers(*values):
    return lambda spark: spark.createDataFrame([(v,) for v in values], "v long")


def adding(store, value, before=lambda: None):
    """Add a row to what the table holds; before: what happens between reading and committing."""

    def change(now):
        have = now.read("t") if now.version("t") else store.spark.createDataFrame([], "v long")
        before()
        return Change({"t": have.unionByName(numbers(value)(store.spark))})

    return change


def values(store):
    return sorted(r["v"] for r in store.read("t").collect())


class Once:
    def __init__(self, act):
        self.act, self.calls = act, 0

    def __call__(self):
        self.calls += 1
        if self.calls == 1:
            self.act()


# commits


@pytest.mark.parametrize("local", [True, False])
def test_one_of_two_gets_a_number(spark, tmp_path, local):
    log, other = CommitLog(spark, f"{tmp_path}/log"), CommitLog(spark, f"{tmp_path}/log")
    log.files.local = other.files.local = local
    assert log.head() == Entry() and log.put(Entry(), {"a": 1})
    first = log.head()
    assert other.put(first, {"a": 2}) and not log.put(first, {"a": 3})
    assert log.head().body == {"a": 2} and log.head().number == 2 and log.files.names().count("000000000002.json") == 1
    assert not [n for n in log.files.names() if n.startswith(".") and not n.endswith(".crc")]


def test_a_number_that_was_pruned_isnt_given_again(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    for i in range(5):
        assert log.put(log.head(), {"i": i})
    log.prune(2)
    assert log.numbers() == [4, 5]
    assert not log.put(Entry(1, {}, []), {"late": True})
    assert log.numbers() == [4, 5] and log.head().body == {"i": 4}


def test_two_writers_from_one_base(store, other):
    store.publish("t", numbers(1)(store.spark))
    store.transact(adding(store, 2, Once(lambda: other.transact(adding(other, 3)))))
    assert values(store) == values(other) == [1, 2, 3]
    assert store.spark.sql(f"SELECT count(*) AS n FROM {store.name('t')}").first()["n"] == 3


def test_a_commit_to_another_table_costs_nothing(store, other):
    calls = []
    store.publish("t", numbers(1)(store.spark))
    store.transact(adding(store, 2, lambda: calls.append(other.publish("elsewhere", numbers(9)(other.spark)))))
    assert len(calls) == 1 and values(store) == [1, 2] and store.read("elsewhere").count() == 1


def test_publishing_from_an_old_base_is_refused(store, other):
    base = store.publish("t", numbers(1)(store.spark))
    other.publish("t", numbers(2)(other.spark), base=base)
    with pytest.raises(Conflict):
        store.publish("t", numbers(3)(store.spark), base=base)
    assert values(store) == [2]


def test_many_writers_at_once(store, spark):
    store.publish("t", numbers()(spark))
    failed = []

    def work(n):
        try:
            own = Store(spark.newSession(), store.schema, store.root)
            for i in range(3):
                own.transact(adding(own, 10 * n + i))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed, [repr(str(e)) for e in failed]
    assert values(store) == sorted(10 * n + i for n in range(4) for i in range(3))


def test_a_failed_write_leaves_nothing(store, spark):
    store.publish("t", numbers(1)(spark))
    with pytest.raises(Exception):  # noqa: B017
        store.publish("t", numbers(1)(spark).withColumn("v", F.raise_error(F.lit("no")).cast("long")))
    assert values(store) == [1] and store.versions("t") == [1]
    files = CommitLog(spark, f"{store.root}/data/t").files.names()
    assert len([n for n in files if not n.startswith(".")]) == 1


def test_documents(store, other):
    first, second = store.new_id("runs"), other.new_id("runs")
    assert first != second and store.ids("runs") == sorted([first, second])
    rev = store.save("runs", first, {"a": 1}, 1)
    with pytest.raises(Conflict):
        other.save("runs", first, {"a": 2}, 1)
    assert other.load("runs", first) == (rev, {"a": 1})
    # a change is made again on what another driver saved meanwhile
    again = Once(lambda: other.save("runs", first, {"a": 5}, rev))
    store.update("runs", first, lambda d: (again(), {"a": d["a"] + 1})[1])
    assert store.load("runs", first)[1] == {"a": 6}


# leases


def test_a_stalled_holder_is_refused(store, other):
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    first = leases.take(store, "lease_1", "a", now, timedelta(minutes=30))
    assert leases.take(other, "lease_1", "b", now + timedelta(minutes=29), timedelta(minutes=30)) is None
    second = leases.take(other, "lease_1", "b", now + timedelta(minutes=31), timedelta(minutes=30))
    assert second.fence == first.fence + 1
    with pytest.raises(leases.Lost):
        store.transact(leases.holds(first, adding(store, 1)))
    other.transact(leases.holds(second, adding(other, 2)))
    leases.release(store, first)  # not its own any more
    assert values(store) == [2] and leases.take(store, "lease_1", "a", now + timedelta(minutes=32), timedelta(minutes=30)) is None
    leases.release(other, second)
    assert leases.take(store, "lease_1", "a", now + timedelta(minutes=32), timedelta(minutes=30)).fence == 3


def test_losing_the_lease_while_committing(store, other):
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    mine = leases.take(store, "lease_1", "a", now, timedelta(minutes=30))
    taken = Once(lambda: leases.take(other, "lease_1", "b", now + STALE + timedelta(minutes=1), STALE))
    with pytest.raises(leases.Lost):
        store.transact(leases.holds(mine, adding(store, 1, taken)))
    assert not store.exists("t")


# engines


class Interrupted(grouping.FoldingGrouper):
    """Groups, after something else has happened."""

    def __init__(self, act):
        super().__init__()
        self.act = Once(act)


def engine_of(store, data, clock=None, feeds=lambda t: None, grouper=None):
    return Engine(store, data.__getitem__, grouper or grouping.FoldingGrouper(), clock or (lambda: datetime(2024, 1, 1, 10, tzinfo=timezone.utc)), feeds)


def queue_of(store):
    return {r["normalized_value"]: (r["literal_value"], r["source_frequency"]) for r in store.read("queue").collect()}


def started(store, spark, rows=ROWS, **options):
    data = {"src": spark.createDataFrame(rows, SOURCE)}
    feeds = options.pop("feeds", lambda t: None)
    engine = engine_of(store, data, options.pop("clock", None), feeds)
    p = engine.create("src", "carrier", {"description": "carriers"}, **options)
    engine.commit(p, engine.initial_run(p))
    return engine, p, data


def changes(spark, *rows):
    return spark.createDataFrame(list(rows), "op string, carrier string")


def test_a_batch_between_a_drains_read_and_its_end_counts(store, other, spark, monkeypatch):
    engine, p, _ = started(store, spark)
    feed, late = QueueFeed(store, p.pipeline_id, "carrier"), QueueFeed(other, p.pipeline_id, "carrier")
    assert feed.apply(changes(spark, ("I", "Orange"), ("I", "Orange"), ("I", "Three")), 0)
    batch = Once(lambda: late.apply(other.spark.createDataFrame([("I", "orange"), ("I", "Vodafone")], "op string, carrier string"), 1))
    grouped = engine.grouped
    monkeypatch.setattr(engine, "grouped", lambda *a: (batch(), grouped(*a))[1])
    assert engine.drain(p) == 2
    assert queue_of(store) == {"orange": ("Orange", 1), "vodafone": ("Vodafone", 1)}
    assert late.apply(changes(spark, ("I", "Vodafone")), 1) is False and p.queue_size == 2
    assert engine.drain(p) == 2 and queue_of(store) == {}


def test_batches_of_two_feeds_at_once(store, other, spark):
    feed = QueueFeed(store, 1, "carrier")
    inside = Once(lambda: QueueFeed(other, 2, "carrier").apply(other.spark.createDataFrame([("I", "b")], "op string, carrier string"), 0))
    original = detect.merge_queue

    def merged(*a, **k):
        inside()
        return original(*a, **k)

    detect.merge_queue = merged
    try:
        assert feed.apply(changes(spark, ("I", "a")), 0)
    finally:
        detect.merge_queue = original
    assert sorted((r["pipeline_id"], r["literal_value"]) for r in store.read("queue").collect()) == [(1, "a"), (2, "b")]


def test_new_values_wait_for_the_drain(store, spark):
    engine, p, data = started(store, spark, export_name="out")
    built = store.versions("out")
    # mapped and unknown values are queued alike, and neither makes the export anew
    assert engine.poll_changes(p, changes(spark, ("I", "ATT")), 1) == 1 and store.versions("out") == built
    assert engine.poll_changes(p, changes(spark, ("I", "att"), ("I", "Orange"), ("I", "orange")), 2) == 2 and store.versions("out") == built
    assert queue_of(store) == {"att": ("ATT", 2), "orange": ("Orange", 2)}
    # a repeated call adds nothing
    assert engine.poll_changes(p, changes(spark, ("I", "att"), ("I", "Orange")), 2) == 0 and queue_of(store)["att"] == ("ATT", 2)
    for rows in ([("D", "x")], [("I", " ")], [("U", "att")]):
        before = store.versions("out")
        engine.poll_changes(p, changes(spark, *rows))
        assert store.versions("out") != before
    data["src"] = spark.createDataFrame([*ROWS, (6, "Orange", "Genf")], SOURCE)
    assert store.read("out").where("id = 6").count() == 0
    engine.drain(p)
    assert store.read("out").where("id = 6").first()["carrier"] == "Orange"


def test_raw_rows_pass_through_at_once(store, spark):
    engine, p, data = started(store, spark, export_name="out", unmapped_rows=True)
    data["src"] = spark.createDataFrame([*ROWS, (6, "Orange", "Genf")], SOURCE)
    engine.poll_changes(p, changes(spark, ("I", "Orange")), 1)
    assert store.read("out").where("id = 6").first()["carrier"] == "Orange" and queue_of(store) == {"orange": ("Orange", 1)}


LOG = "_version long, op string, id int, carrier string"


@pytest.mark.parametrize("case", ["read", "wait", "gone", "anew", "behind"])
def test_feeds_and_their_gaps(store, spark, case):
    state = {"rows": [(4, "I", 3, "VZW"), (5, "I", 4, None)], "table": "one", "since": 3}
    feed = ChangeLog(lambda: spark.createDataFrame(state["rows"], LOG), state["table"], since=state["since"])
    engine, p, data = started(store, spark, keys=["ID"], feeds=lambda t: feed)
    assert (p.mode, p.keys) == ("stream", ["id"]) and engine.poll(p) == 0 and queue_of(store) == {}
    synced = p.synced_at
    new = [(6, "Orange", "Genf"), (7, "orange", "Genf"), (8, "att", "Rom")]
    data["src"] = spark.createDataFrame([*ROWS, *new], SOURCE)
    fresh = [(6, "I", 6, "Orange"), (7, "I", 7, "orange"), (8, "I", 8, "att")]
    if case == "read":
        state["rows"] += fresh
    elif case == "gone":
        state["rows"], feed.since = fresh[2:], 7
    elif case == "anew":
        state["rows"], feed.table, feed.since = fresh, "two", 0
    elif case == "behind":
        state["rows"], feed.since = [(1, "I", 6, "Orange")], 0
    got = engine.poll(p)
    if case == "wait":
        assert got == 0 and queue_of(store) == {}
    elif case == "read":
        assert got == 2 and queue_of(store) == {"orange": ("Orange", 2), "att": ("att", 1)}
    else:  # what a scan of the source gives, and no claim that all is up to date
        assert got == 1 and queue_of(store) == {"orange": ("Orange", 2)} and p.synced_at == synced
    assert engine.poll(p) == 0 and int(store.marks("queue")[engine.position(p)]) == feed.bounds()[1]


def test_a_feed_that_cant_be_read_gives_way_to_scans(store, spark):
    broken = ChangeLog(lambda: (_ for _ in ()).throw(OSError("gone")))
    engine, p, data = started(store, spark, keys=["id"], feeds=lambda t: broken)
    assert (p.mode, p.mode_reason) == ("diff", "the change feed can't be read")
    data["src"] = spark.createDataFrame([*ROWS, (6, "Orange", "Genf")], SOURCE)
    assert engine.poll(p) == 1 and started(Store(spark, store.schema + "b"), spark)[1].mode_reason == "no key columns"
    spark.sql(f"DROP DATABASE {store.schema}b CASCADE")


def test_runs_are_written_once_and_used_again(store, other, spark):
    now = [datetime(2024, 1, 1, 10, tzinfo=timezone.utc)]
    engine, p, data = started(store, spark, clock=lambda: now[0], export_name="out")
    run = engine.run(1)
    assert run.status == "completed" and engine.commit(p, run) == {"items_written": 2, "aliases_updated": 2, "already_in_progress": True}
    engine.poll_changes(p, changes(spark, ("I", "Orange")))
    first = engine.open_run(p)
    engine.poll_changes(p, changes(spark, ("I", "Three")))
    again = engine.open_run(p)  # the attempt that was left, over the queue as it is now
    assert again.run_id == first.run_id and [i.literal for i in again.items] == ["Orange", "Three"]
    engine.step(again, "validating")
    assert engine.open_run(p).run_id != again.run_id
    fresh = engine.run(p.queue_run)
    engine.step(fresh, "failed")
    now[0] += STALE + timedelta(minutes=1)
    assert engine.open_run(p).run_id == fresh.run_id
    # of two drivers that commit a reviewed run the second is told
    second = engine_of(other, data, lambda: now[0])
    second.load_state()
    mine, theirs = engine.run(fresh.run_id), second.run(fresh.run_id)
    assert engine.commit(p, mine)["already_in_progress"] is False and second.commit(second.pipelines[p.pipeline_id], theirs)["already_in_progress"] is True


def test_a_failed_write_can_be_tried_again(store, spark, monkeypatch):
    engine, p, _ = started(store, spark)
    engine.poll_changes(p, changes(spark, ("I", "Orange")))
    confirm = engine.confirm
    monkeypatch.setattr(engine, "confirm", lambda *a: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        engine.drain(p)
    assert engine.run(p.queue_run).status == "failed" and p.failures == 1 and queue_of(store) == {"orange": ("Orange", 1)}
    run = engine.run(p.queue_run)
    monkeypatch.setattr(engine, "confirm", confirm)
    assert engine.commit(p, run)["already_in_progress"] is False and engine.run(p.queue_run).status == "completed"


def test_another_driver_carries_on(store, other, spark):
    engine, p, data = started(store, spark, export_name="out")
    engine.poll_changes(p, changes(spark, ("I", "Orange")))
    second = engine_of(other, data)
    second.load_state()
    q = second.pipelines[p.pipeline_id]
    assert q == p and second.drain(q) == 1 and queue_of(store) == {}
    engine.load_state()
    assert engine.pipelines[p.pipeline_id] is p and p.queue_size == 0
    assert engine.create("src", "city", {"description": "cities"}).pipeline_id == p.pipeline_id + 1
    with pytest.raises(ValueError):
        second.create("src", "Carrier", {"description": "again"})


def test_two_drains_of_a_pipeline(store, other, spark, monkeypatch):
    engine, p, data = started(store, spark)
    engine.poll_changes(p, changes(spark, ("I", "Orange")))
    second = engine_of(other, data)
    second.load_state()
    inside, grouped, got = Once(lambda: got.append(second.drain(second.pipelines[p.pipeline_id]))), engine.grouped, []
    monkeypatch.setattr(engine, "grouped", lambda *a: (inside(), grouped(*a))[1])
    assert engine.drain(p) == 1 and got == [0]


def test_one_time_sessions_outlive_their_driver(store, other, spark):
    from canonry.operators.onetime import OneTime
    from canonry.sources import files

    raw = b"Carrier,City\r\nATT,Bonn\r\natt,Ulm\r\n"
    first = OneTime(store)
    first.open("n1", files.grid_table(spark, files.csv_grid(raw)), ["Carrier"], raw)
    first.group("n1", grouping.FoldingGrouper())
    first.write("n1", "target")
    second = OneTime(other)
    assert second.status("n1")["Carrier"] == {"status": "grouped", "items": 1, "groups": 1} and second.session("n1").target == "target"
    assert second.patched_csv("n1") == first.patched_csv("n1") and second.standardized("n1").count() == 2
    second.open("n2", "target", ["City"])
    second.group("n2", grouping.FoldingGrouper())
    with pytest.raises(PermissionError):
        second.write("n2", "target", overwrite=True)
    second.write("n2", "target", overwrite=True, confirmed=True)
    assert first.archive() == ["n2", "n1"] and store.marks("target")["session"] == "n2"
    second.forget("n1")
    assert first.archive() == ["n2"] and store.read("target").count() == 2
    with pytest.raises(KeyError):
        first.status("n1")

"""The store: leases with fences, parts, cleaning, change feeds; the refresh cycle on them."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.operators import dashboard
from emberline.streaming import cycle
from emberline.streaming.store import Lease, Locked, Store, applied

DETECTION = "lat double, lon double, acq_date date, acq_time string, satellite string, frp double, daynight string"


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def test_one_writer_at_a_time(spark, tmp_path):
    store, clock = Store(spark, str(tmp_path)), Clock()
    with Lease(store, 60, "a", clock) as a:
        with pytest.raises(Locked):
            Lease(store, 60, "b", clock).acquire()
        clock.now += 50
        a.renew()
        clock.now += 50
        a.check()
    with Lease(store, 60, "b", clock) as b:
        assert b.number == a.number + 2 or b.number > 1


def test_an_expired_writer_publishes_nothing(spark, tmp_path):
    store, clock = Store(spark, str(tmp_path)), Clock()
    store.publish({}, 0)
    old = Lease(store, 60, "old", clock).acquire()
    late, after = {}, store.manifests()[-1]
    store.write("t", numbers(spark, 1), late, old)
    clock.now += 61
    new = Lease(store, 60, "new", clock).acquire()
    mine = {}
    store.write("t", numbers(spark, 2), mine, new)
    with pytest.raises(Locked):
        store.publish(late, after, old)
    with pytest.raises(Locked):
        store.publish(late, after)  # even without saying whose lease it is: the manifests have moved on
    with pytest.raises(Locked):
        old.renew()
    # the new writer's unpublished version is not removed by anyone; the old one's is, by the new writer
    assert store.clean() == 0
    store.publish(mine, store.manifests()[-1], new)
    assert store.clean(lease=new) == 1
    assert [r["v"] for r in store.read("t").collect()] == [2]
    old.release()
    new.check()  # what has been taken over can't be given back


def test_a_lease_that_expired_during_the_write_is_refused(spark, tmp_path):
    store, clock = Store(spark, str(tmp_path)), Clock()
    lease, pending = Lease(store, 60, "slow", clock).acquire(), {}
    store.write("t", numbers(spark, 1), pending, lease)
    clock.now += 61
    with pytest.raises(Locked):
        store.publish(pending, 0, lease)
    assert store.read("t") is None


def test_cleaning_keeps_what_another_writer_has_not_published(spark, tmp_path):
    mine, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    first: dict = {}
    other.write("t", numbers(spark, 0), first)
    other.publish(first, 0)
    pending: dict = {}
    mine.write("t", numbers(spark, 1), pending)
    assert other.clean() == 0
    mine.publish(pending, 1)
    assert [r["v"] for r in mine.read("t").collect()] == [1]
    assert mine.clean(now=4e9) == 0  # both manifests are kept
    assert mine.clean(keep=1) == 1 and [r["v"] for r in mine.read("t").collect()] == [1]


def test_parts_that_did_not_change_are_not_written(spark, tmp_path):
    store, pending = Store(spark, str(tmp_path)), {}
    rows = spark.createDataFrame([(date(2024, 1, d), d) for d in range(1, 6)], "day date, v int")
    assert store.write_parts("t", rows, "day", pending) == [f"2024-01-0{d}" for d in range(1, 6)]
    store.publish(pending, 0)
    again: dict = {}
    store.write_parts("t", spark.createDataFrame([(date(2024, 1, 5), 50), (date(2024, 1, 6), 6)], "day date, v int"), "day", again)
    store.publish(again, 1)
    assert sorted(r["v"] for r in store.read("t").collect()) == [1, 2, 3, 4, 6, 50]
    assert [r["v"] for r in store.read("t", parts=["2024-01-05"]).collect()] == [50] and store.read("t", parts=["2023-01-01"]) is None
    assert sorted(r["v"] for r in store.read("t", number=1).collect()) == [1, 2, 3, 4, 5]
    held = {p for p in tmp_path.rglob("*.parquet")}
    assert store.clean(keep=1) == 1  # the part of 5 January
    assert len(held) - len({p for p in tmp_path.rglob("*.parquet")}) >= 1
    assert sorted(r["v"] for r in store.read("t").collect()) == [1, 2, 3, 4, 6, 50]


@pytest.mark.parametrize("in_parts", [False, True])
def test_a_feed_makes_one_version_of_another(spark, tmp_path, in_parts):
    rng = random.Random(4)
    store, states = Store(spark, str(tmp_path)), []
    table = {}
    for number in range(4):
        for _ in range(30):
            k = rng.randrange(60)
            if rng.random() < 0.25:
                table.pop(k, None)
            else:
                table[k] = (k, f"d{k % 5}", rng.choice([None, 1.5, 2.5]), rng.choice(["x", None]))
        df, pending = spark.createDataFrame(sorted(table.values()), "k int, day string, v double, name string"), {}
        if in_parts:
            store.write_parts("t", df, "day", pending)
        else:
            store.write("t", df, pending)
        store.publish(pending, number)
        states.append(dict(table))
    for a, b in ((0, 1), (1, 2), (1, 4), (4, 2), (3, 3)):
        feed = store.changes("t", ["k"], a, b)
        old = store.read("t", number=a) if a else store.read("t").limit(0)
        assert {r["k"]: tuple(r) for r in applied(old, feed, ["k"]).collect()} == states[b - 1]
        before = states[a - 1] if a else {}
        want = {(k, "insert") for k in states[b - 1].keys() - before.keys()} | {(k, "delete") for k in before.keys() - states[b - 1].keys()}
        want |= {(k, "update") for k in before.keys() & states[b - 1].keys() if before[k] != states[b - 1][k]}
        assert {(r["k"], r["op"]) for r in feed.collect()} == want
    newest, feed = dashboard.poll(store, "t", ["k"], 3)
    assert newest == 4 and {r["op"] for r in feed.collect()} <= {"insert", "update", "delete"} and dashboard.poll(store, "t", ["k"], 4) == (4, None)
    store.clean(keep=1)
    with pytest.raises(LookupError):
        store.changes("t", ["k"], 2)
    newest, feed = dashboard.poll(store, "t", ["k"], 2)
    assert {r["op"] for r in feed.collect()} == {"reset"} and {r["k"] for r in feed.collect()} == set(states[-1])


def test_satellites_are_part_of_the_key(spark, tmp_path):
    rows = [(21.0, 72.0, date(2024, 1, 1), "0700", s, p, "D") for s, p in (("N", 5.0), ("1", 6.0), (None, 7.0), ("N", 5.0))]
    store, df = Store(spark, str(tmp_path / "s")), spark.createDataFrame(rows, DETECTION)
    assert cycle.run_cycle(store, df, date(2024, 1, 9))["n_detections"] == 3
    assert cycle.run_cycle(store, df, date(2024, 1, 9))["n_new"] == 0
    text = df.limit(1).select("*", F.lit("21.0").alias("latitude"), F.lit("72.00").alias("longitude"))
    assert cycle.run_cycle(store, text, date(2024, 1, 9))["n_detections"] == 4  # keys are compared as text


def test_a_cycle_writes_only_the_days_it_has_rows_for(spark, tmp_path):
    day = lambda k: date(2024, 1, 1) + timedelta(days=k)
    row = lambda k, p=5.0: (21.0 + k / 1000, 72.0, day(k), "0700", "N", p, "D")
    store = Store(spark, str(tmp_path / "s"))
    cycle.run_cycle(store, spark.createDataFrame([row(k) for k in range(12)], DETECTION), day(12))
    first = store.manifest()["detections"]
    cycle.run_cycle(store, spark.createDataFrame([row(k, 9.0) for k in range(8, 14)], DETECTION), day(14))
    second = store.manifest()["detections"]
    assert {k: v for k, v in second.items() if k in first} == first and set(second) - set(first) == {"2024-01-13", "2024-01-14"}
    assert {r["frp"] for r in store.read("detections").collect() if r["acq_date"] < day(12)} == {5.0}


def test_the_cycle_reports_who_holds_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with Lease(store, owner="elsewhere"):
        out = cycle.guarded_cycle(store, lambda: 1 / 0, date(2024, 1, 4))
    assert out["status"] == "skipped" and "elsewhere" in out["reason"]

"""Orphan references against a look at every target row."""

import random
from datetime import datetime, timedelta

from seqloom.operators import orphans
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
TARGET, REF = "key string, b timestamp, e timestamp, k string, t timestamp", "id long, key string, at timestamp, alive int, k string"


def brute(targets, refs):
    out = set()
    norm = lambda x: x.strip().lower() if x and x.strip() else None
    for i, key, at in refs:
        k = norm(key)
        if k is None:
            continue
        own = [(b, e) for key2, b, e in targets if norm(key2) == k]
        if at is not None and any(b is not None and b <= at and (e is None or at < e) for b, e in own):
            continue
        began = at is not None and any(b is not None and b <= at for b, _ in own)
        out.add((i, "missing" if not own else "deleted" if began else "late"))
    return out


def run(spark, targets, refs):
    t = spark.createDataFrame([(*x, "c", T0) for x in targets], TARGET)
    r = spark.createDataFrame([(*x, 9, "c") for x in refs], REF)
    found = orphans.orphans(orphans.target_deltas(t, "key", "b", "e", "f"), orphans.references(r, "key", "at", "id", "f"))
    return found


def test_against_brute_force(spark):
    rng = random.Random(3)
    at = lambda none=0.05: None if rng.random() < none else T0 + timedelta(hours=rng.randrange(0, 24 * 12, 6))
    keys = ["hot", " HOT ", "a", "b", "c", "d", "", None]
    targets = [(rng.choice(keys[:6] + [None]), at(), at(0.5)) for _ in range(80)]
    refs = [(i, rng.choice(["hot"] * 5 + keys + ["zz"]), at()) for i in range(600)]
    got = rows(run(spark, targets, refs).select("row_id", "orphan_kind"))
    assert len(got) == len(set(got))
    assert set(got) == brute(targets, refs)


def test_one_key_and_one_day(spark):
    rng = random.Random(4)
    at = lambda: T0 + timedelta(minutes=rng.randrange(1400))
    targets = [("hot", at(), rng.choice([None, at()])) for _ in range(25)]
    refs = [(i, "HOT ", at()) for i in range(800)]
    found = run(spark, targets, refs)
    assert set(rows(found.select("row_id", "orphan_kind"))) == brute(targets, refs)
    # References meet their day's steps by a join; no window and no sort holds them.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("row_id" not in line for line in plan.splitlines() if "Window" in line)


def test_edges_of_time(spark):
    d = lambda n: T0 + timedelta(days=n)
    targets = [("k", d(2), d(4)), ("k", d(6), None), ("never", d(5), d(5))]
    refs = [(1, "k", d(1)), (2, "k", d(2)), (3, "k", d(4)), (4, "k", d(6)), (5, "never", d(5)), (6, "never", d(4)), (7, "gone", d(1)), (8, " ", d(1)), (9, None, d(1))]
    assert set(rows(run(spark, targets, refs).select("row_id", "orphan_kind"))) == {(1, "late"), (3, "deleted"), (5, "deleted"), (6, "late"), (7, "missing")}


def test_empty(spark):
    assert run(spark, [], [(1, "a", T0)]).select("orphan_kind").collect()[0][0] == "missing"
    assert run(spark, [("a", T0, None)], []).count() == 0
    assert orphans.report(run(spark, [], [])).count() == 0
    cur = orphans.current(
        orphans.target_deltas(spark.createDataFrame([("a", T0, T0 + timedelta(1)), ("b", T0, None)], "key string, b timestamp, e timestamp"), "key", "b", "e", "f"),
        orphans.references(spark.createDataFrame([(1, "A", T0), (2, "b", T0), (3, "c", T0)], "id long, key string, at timestamp"), "key", "at", "id", "f"),
    )
    assert {r["k"] for r in cur.collect()} == {"a", "c"}

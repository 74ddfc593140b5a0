"""Golomb-coded sets: exact round trip, answers against a plain scan, audited errors."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import queries, seen
from tests.conftest import SMALL

SCHEMA, KNOWN = "visit_no long, key string, at long, gen int, h long", "key string, shard long"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=300), st.integers(0, 30))
def test_gap_code_round_trip(gaps, k):
    g = np.array(sorted(gaps), np.int64) if k > 8 else np.array([x % 5000 for x in gaps], np.int64)
    k = k if k > 8 else min(k + 4, 12)
    g = np.minimum(g, (1 << k) * 50)
    assert (seen.decode_gaps(*seen.encode_gaps(g, k), len(g), k) == g).all()


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(0, 1 << 30), st.integers(-1, 5000), min_size=1, max_size=3000))
def test_set_holds_its_members_and_their_generations(members):
    import pandas as pd

    h = np.array(sorted(members), np.int64)
    gen = np.array([members[x] for x in h.tolist()], np.int64)
    # A key that comes again later keeps its first generation.
    blocks = seen.encode_set(pd.DataFrame({"shard": 0, "h": np.tile(h, 2), "gen": np.concatenate((gen + 3, gen))}))
    asked = np.concatenate((h, h + 1, h - 1))
    assert (seen.contains(asked, blocks) == np.isin(asked, h)).all()
    assert (seen.first_generation(h, blocks) == gen).all()


def data(n=3000):
    rng = random.Random(1)
    keys = [None, "", "  ", "Hot", " hot\t", "HOT", "01", "1", "1.1"] + [f"k{i}" for i in range(900)]
    visits = [(i, rng.choice(["hot", " Hot "]) if rng.random() < 0.33 else rng.choice(keys), 0, 0, 0) for i in range(n)]
    known = [(k, 0) for k in ("K5 ", "k7", "K7", None, "", "01")]
    return visits, known


def brute(visits, known):
    norm = lambda x: x.strip().lower() if x and x.strip() else None
    before = {norm(k) for k, _ in known} - {None}
    out = set()
    for i, k, *_ in sorted(visits):
        k = norm(k)
        if k is None:
            continue
        if k in before:
            out.add(i)
        before.add(k)
    return out


def test_found_and_audit(spark):
    visits, known = data()
    kdf = spark.createDataFrame(known, KNOWN)
    keys = seen.SeenKeys(spark.createDataFrame(visits, SCHEMA), "visit_no", "key", kdf, "key")
    got = [r[0] for r in keys.found().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(visits, known)
    rough = seen.SeenKeys(spark.createDataFrame(visits, SCHEMA), "visit_no", "key", kdf, "key", fp_bits=3)
    audit = rough.audit(kdf, "key").collect()
    assert sum(r["n_missed"] for r in audit) == 0
    assert sum(r["n_false_seen"] for r in audit) > 0
    for r in audit:
        assert 0 <= r["theoretical_rate"] <= 2**-3


def test_most_answers_come_from_the_sets(spark):
    visits, known = data()
    keys = seen.SeenKeys(spark.createDataFrame(visits, SCHEMA), "visit_no", "key", spark.createDataFrame(known, KNOWN), "key")
    assert keys.answers.where("seen").count() > keys.repeated.count()


def test_more_keys_than_one_range_holds(spark):
    visits, known = data(400)
    kdf = spark.createDataFrame(known, KNOWN)
    keys = seen.SeenKeys(spark.createDataFrame(visits, SCHEMA), "visit_no", "key", kdf, "key", fp_bits=40, expected=1 << 33)
    assert keys.shards * keys.range > 1 << 63
    assert {r[0] for r in keys.found().collect()} == brute(visits, known)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([("a", 0)], KNOWN)
    assert seen.SeenKeys(none, "visit_no", "key", some, "key").found().count() == 0
    one = spark.createDataFrame([(5, "A", 0, 0, 0)], SCHEMA)
    assert seen.SeenKeys(one, "visit_no", "key", some.limit(0), "key").found().count() == 0
    assert seen.SeenKeys(one, "visit_no", "key", some, "key").found().count() == 1


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data")
def test_audit_covers_the_delivered_setting(spark):
    out = queries.p1_audit(spark, SMALL).collect()
    assert {r["fp_bits"] for r in out} == {30, 8}
    assert all(r["n_missed"] == 0 for r in out)
    assert sum(r["n_false_seen"] for r in out if r["fp_bits"] == 30) == 0
    assert max(r["theoretical_rate"] for r in out if r["fp_bits"] == 30) < 1e-6

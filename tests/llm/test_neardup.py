"""Near-duplicates against all pairs of a small set."""

import random
from itertools import combinations

import pytest

from seqloom.llm import neardup

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
SCHEMA = "rec_id long, seq string, cls long, a long, h long"


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        what = rng.randrange(3)
        if what == 0:
            s[i] = rng.choice(LETTERS)
        elif what == 1:
            s.insert(i, rng.choice(LETTERS))
        elif len(s) > 6:
            del s[i]
    return "".join(s)


def words(s):
    s = "".join(c for c in s.upper() if "A" <= c <= "Z")
    return s, {s[i : i + 5] for i in range(len(s) - 4)}


def brute(recs):
    w = {i: words(s) for i, s in recs if s is not None}
    out = set()
    for a, b in combinations(sorted(w), 2):
        (s, x), (t, y) = w[a], w[b]
        if s == t or (x and y and 2 * len(x & y) >= len(x | y)):
            out.add((a, b))
    return out


def data():
    rng = random.Random(5)
    recs = []
    for f in range(12):
        base = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(200, 600)))
        recs.append(base)
        for _ in range(12):
            recs.append(edit(rng, base, rng.choice([1, 3, 8, 15, 25, 40])))
        if f == 0:
            recs += [base] * 8 + [base.lower(), "\n".join(base[i : i + 60] for i in range(0, len(base), 60)) + "*"]
            recs.append(base[100:] + base[:100])
    recs += [None, "", "*", "ACD", "acd", "ACDE", "ACDEF", "A" * 30_000]
    return [(i + 1, s) for i, s in enumerate(recs)]


def test_pairs_and_groups(spark):
    recs = data()
    df = spark.createDataFrame([(i, s, 0, 0, 0) for i, s in recs], SCHEMA)
    near = neardup.NearDuplicates(df)
    got = [tuple(r) for r in near.pairs().collect()]
    assert len(got) == len(set(got))
    want = brute(recs)
    assert set(got) <= want
    assert len(set(got)) >= 0.995 * len(want)

    groups = {r["rec_id"]: r for r in near.groups().collect()}
    assert set(groups) == {i for i, s in recs if s is not None}
    for a, b in got:
        assert groups[a]["group_id"] == groups[b]["group_id"]
    parent = {i: i for i in groups}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in got:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert all(groups[i]["group_id"] == root(i) for i in groups)


def test_repeated_rows_and_null_ids(spark):
    recs = data()[:24]
    df = spark.createDataFrame(recs, "rec_id long, seq string")
    again = df.unionByName(df.where("rec_id % 3 = 0")).unionByName(spark.createDataFrame([(None, recs[0][1]), (None, None)], "rec_id long, seq string"))
    once, twice = neardup.NearDuplicates(df), neardup.NearDuplicates(again)
    assert sorted(map(tuple, once.pairs().collect())) == sorted(map(tuple, twice.pairs().collect()))
    assert sorted(map(tuple, once.groups().collect())) == sorted(map(tuple, twice.groups().collect()))


@pytest.mark.parametrize("similarity", [0.5, 0.05])
def test_short_sequences_lose_no_pair(spark, similarity):
    rng = random.Random(3)
    texts = ["A" * 40, "A" * 41, "AC" * 30, "CA" * 31]
    for n in [6, 8, 10, 14, 20, 30, 50, 90, 200, 290, 310, 420] * 2:
        base = "".join(rng.choice(LETTERS) for _ in range(n))
        texts += [base] + [edit(rng, base, rng.choice([1, 1, 2, 3])) for _ in range(6)] + [base + "".join(rng.choice(LETTERS) for _ in range(n - 5))]
    w = {i: words(s)[1] for i, s in enumerate(texts)}
    want = {(i, j) for i, j in combinations(w, 2) if texts[i] == texts[j] or len(w[i] & w[j]) >= similarity * len(w[i] | w[j])}
    df = spark.createDataFrame([(i, s, 0, 0, 0) for i, s in enumerate(texts)], SCHEMA)
    got = [tuple(r) for r in neardup.NearDuplicates(df, similarity).pairs().collect()]
    assert len(want) > 200 and sorted(got) == sorted(want)


def test_hot_stretches_meet_in_every_sub_key(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 3)
    texts = ["ACDEFGH" + a + b for a in "IKLMN" for b in "PQRS"]
    df = spark.createDataFrame([(i, s, 0, 0, 0) for i, s in enumerate(texts)], SCHEMA)
    w = [words(s)[1] for s in texts]
    want = {(i, j) for i, j in combinations(range(len(w)), 2) if len(w[i] & w[j]) >= 0.4 * len(w[i] | w[j])}
    assert want and {tuple(r) for r in neardup.NearDuplicates(df, 0.4).pairs().collect()} == want


def test_hot_bands_meet_in_every_sub_key(spark, monkeypatch):
    recs = data()
    df = spark.createDataFrame([(i, s, 0, 0, 0) for i, s in recs], SCHEMA)
    one = {tuple(r) for r in neardup.NearDuplicates(df).pairs().collect()}
    monkeypatch.setattr(neardup, "HOT", 4)
    assert {tuple(r) for r in neardup.NearDuplicates(df).pairs().collect()} == one


def test_filters_add_up(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice(LETTERS) for _ in range(500)) for _ in range(8)]
    texts = [edit(rng, b, rng.choice([2, 10, 30])) for b in base for _ in range(6)]
    r = neardup.NearDuplicates(spark.createDataFrame([(i, s, 0, 0, 0) for i, s in enumerate(texts)], SCHEMA)).filters().collect()[0]
    assert r["n_met"] == r["n_by_pivots"] + r["n_by_hamming"] + r["n_verified"] and r["n_alike"] == len({p for p in brute(list(enumerate(texts))) if texts[p[0]] != texts[p[1]]})


def test_bands_and_bound_follow_similarity():
    assert neardup.bands_of(0.5) == (32, 2) and neardup.HAMMING_BOUND == 95
    assert neardup.bands_of(0.3)[0] > 32 and neardup.hamming_bound(0.3) > 95 and neardup.bands_of(0.01) == (0, 0)


def test_fingerprints_follow_similarity():
    rng = random.Random(9)
    base = "".join(rng.choice(LETTERS) for _ in range(900))
    a = neardup.sketch(base.encode())[1]
    far = neardup.sketch("".join(rng.choice(LETTERS) for _ in range(900)).encode())[1]
    near = neardup.sketch(edit(rng, base, 20).encode())[1]
    diff = lambda x, y: sum(bin(p ^ q).count("1") for p, q in zip(x, y, strict=True))
    assert diff(a, near) < 60 < neardup.HAMMING_BOUND < diff(a, far)
    assert neardup.sketch(b"ACDE") is None


def test_empty(spark):
    near = neardup.NearDuplicates(spark.createDataFrame([], SCHEMA))
    assert near.pairs().count() == 0 and near.groups().count() == 0
    lone = neardup.NearDuplicates(spark.createDataFrame([(1, "ACDEFGHIK", 0, 0, 0), (2, None, 0, 0, 0)], SCHEMA))
    assert lone.pairs().count() == 0 and lone.groups().count() == 1


def test_unrelated_pairs_seldom_meet(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("ACDEFG") for _ in range(600)) for _ in range(800)]
    r = neardup.NearDuplicates(spark.createDataFrame([(i, s, 0, 0, 0) for i, s in enumerate(texts)], SCHEMA)).filters().collect()[0]
    assert r["n_met"] < 800 * 799 / 2 / 100

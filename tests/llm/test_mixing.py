"""Mixtures: shares, caps, whole permutations, and odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import mixing

DOC, TARGET = "doc_id long, source string, text string, block long, n int", "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def mix(spark):
    rng = random.Random(2)
    words = ["the", "guide", "cuts", "fusion", "reads", "sample"]
    docs = []
    for i in range(900):
        s = "big" if i % 3 else rng.choice(["Small ", "SMALL", "mid", "stray", None, "  "])
        docs.append((i, s, rng.choice([None, ""]) if i % 50 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))), 0, 0))
    docs.append((900, "big", "long " * 60_000, 0, 0))
    targets = [("big", 0.6, 1), ("small", 0.25, 3), (" MID", 0.1, 4), ("none there", 0.05, 9), (None, 0.1, 2)]
    return mixing.Mix(spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, TARGET), block_tokens=64, slots_per_shard=32)


def test_shares_and_caps(mix):
    shares = {r["source"]: r for r in mix.shares().collect()}
    for s, part in (("big", 0.6), ("small", 0.25), ("mid", 0.1)):
        assert abs(shares[s]["actual_share"] - part / 0.95) < 0.01
        assert shares[s]["most_uses"] <= shares[s]["max_repeats"]
    assert shares["none there"]["tokens_drawn"] == shares["stray"]["tokens_drawn"] == shares[None]["tokens_drawn"] == 0
    usage = mix.usage().collect()
    assert len(usage) == 901 and all(r["whole_uses"] <= r["uses"] for r in usage)
    assert sum(r["tokens_drawn"] for r in usage) == sum(r["tokens_drawn"] for r in shares.values())


def test_slots_are_permutations(mix):
    slots = mix.slots().collect()
    for source, k in mix.blocks_of.items():
        own = sorted((r["slot"], r["block"]) for r in slots if r["source"] == source)
        assert [s for s, _ in own] == list(range(len(own)))
        for at in range(0, len(own), k):
            part = [b for _, b in own[at : at + k]]
            assert len(set(part)) == len(part) and all(0 <= b < k for b in part)
    sizes = {}
    for r in slots:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + 1
    assert all(n == 32 for s, n in sizes.items() if s != max(sizes))


def test_permutations():
    for size in (1, 2, 3, 7, 64, 1000, 4097):
        seen = {k: mixing.permuted(np.arange(size), size, k).tolist() for k in (1, 2)}
        assert all(sorted(v) == list(range(size)) for v in seen.values())
    big = mixing.permuted(np.arange(20_000), 10**12, 5)
    assert len(set(big.tolist())) == 20_000
    # No fixed stride between neighbours, and no correlation with the order.
    steps = np.diff(big)
    assert len(set(steps.tolist())) > 19_000 and abs(np.corrcoef(np.arange(20_000), big)[0, 1]) < 0.05


def test_ten_million_shards_without_a_list(mix):
    import copy

    far = copy.copy(mix)
    far.wanted, far.shard_slots = [6 * 10**9, 3 * 10**9, 10**9], 1000
    out = far.draws().where("bucket in (0, 9765)").groupBy("shard").agg(F.sum("n").alias("n"), F.max(F.when(F.col("no") == 0, F.col("n"))).alias("a")).collect()
    assert len(out) == 1024 + 10**7 - 9765 * 1024 and {r["n"] for r in out} == {1000}
    of_first = [r["a"] for r in out]
    # Independent draws: mean and spread of a multinomial.
    assert abs(np.mean(of_first) - 600) < 3 and 12 < np.std(of_first) < 19


def test_blocks_hold_each_token_once(mix):
    parts = mix.parts().collect()
    per_block, per_doc = {}, {}
    for r in parts:
        per_block[r["source"], r["block"]] = per_block.get((r["source"], r["block"]), 0) + r["n"]
        per_doc[r["doc_id"]] = per_doc.get(r["doc_id"], 0) + r["n"]
    tokens = {r["doc_id"]: r["n_tokens"] for r in mix.docs.collect() if r["source"] and r["n_tokens"]}
    assert per_doc == tokens
    last = {}
    for s, b in per_block:
        last[s] = max(last.get(s, 0), b)
    assert all(n == 64 or b == last[s] for (s, b), n in per_block.items())


def test_shortfall_is_reported(spark):
    docs = spark.createDataFrame([(1, "a", "one two three four", 0, 0), (2, "b", "word " * 500, 0, 0)], DOC)
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], TARGET)
    shares = {r["source"]: r for r in mixing.Mix(docs, targets, block_tokens=8, total_tokens=400).shares().collect()}
    assert shares["a"]["most_uses"] == 2 and shares["a"]["actual_share"] < 0.1 < shares["b"]["actual_share"]


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOC), spark.createDataFrame([("a", 1.0, 2)], TARGET)
    empty = mixing.Mix(docs, targets)
    assert empty.usage().count() == 0 and empty.shares().collect()[0]["tokens_drawn"] == 0
    lone = mixing.Mix(spark.createDataFrame([(1, "a", "x y", 0, 0)], DOC), targets.limit(0))
    assert [r["uses"] for r in lone.usage().collect()] == [0]

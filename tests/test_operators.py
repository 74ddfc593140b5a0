"""Joins, histories, vectors, families and designs against plain Python."""

import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import design, expression, family, graph, history, matching, specificity, structure, vectorsearch
from tests.conftest import rows


def test_specificity(spark):
    long_ = spark.createDataFrame([("f1", "A", 3, 0), ("f1", "B", 3, 1), ("f1", None, 6, 2), ("f2", "A", 0, 0), ("f3", "B", 2, 1), ("f4", "A", 1, 0), ("f4", "B", 1, 1), ("f4", "C", 1, 2), ("f4", "D", 1, 3)], "fusion string, cancer string, n int, row_ord int")
    got = {r["fusion"]: tuple(r)[1:] for r in specificity.specificity(long_).collect()}
    assert got == {"f1": (None, 3, 12, 1 / 3), "f3": ("B", 1, 2, 1.0)}
    assert {r["fusion"]: r["primary_disease"] for r in specificity.specificity(long_, drop_null_cancer=True).collect()} == {"f1": "A", "f3": "B"}
    assert dict(rows(specificity.disease_map(long_))) == {"f1": "A, B", "f3": "B", "f4": "A, B, C, D"}
    wide = spark.createDataFrame([("A", "3", "x", "1"), ("B", "", "2", None)], "cancer string, `f.1` string, f2 string, `Unnamed: 3` string")
    assert sorted(rows(specificity.unpivoted(wide, "cancer"))) == [("A", "f.1", 0, 3.0), ("B", "f2", 1, 2.0)]


def test_matching(spark):
    t = spark.createDataFrame([("a", None, 1, None), ("b", "d", 2, "u" * 30), ("c", "d", 3, "ACG")], "fusion string, disease string, patients int, own_junction string")
    given = spark.createDataFrame([("a", " " + "acgu" * 8 + " "), ("a", "A" * 5), ("c", "x")], "fusion string, junction string")
    j = {r["fusion"]: (r["junction_source"], r["junction"]) for r in matching.junctions(t, given).collect()}
    assert j["a"] == ("fasta", "ACGT" * 8) and j["b"] == ("provided", "T" * 30) and j["c"][0] == "imputed"
    out = matching.match(matching.junctions(t, given), spark.createDataFrame([("e1",), ("e2",)], "enzyme string"))
    assert out.count() == 6
    assert matching.match(matching.junctions(t.limit(0)), spark.createDataFrame([], "enzyme string")).count() == 0


def test_streaks(spark, monkeypatch):
    monkeypatch.setattr(history, "BLOCK", 7)
    rng = random.Random(2)
    data = [(i, rng.choice("ab"), rng.choice([0, 0, 0, 1, None])) for i in range(400)] + [(i, "c", 0) for i in range(400, 460)]
    df = spark.createDataFrame(data, "o long, g string, hits int")
    got = {r["g"]: (r["n"], r["longest"]) for r in history.longest_streaks(df, "g", "o", F.col("hits") == 0).collect()}
    for g in "abc":
        own = [h == 0 for _, x, h in data if x == g]
        assert got[g] == (len(own), max((len(list(v)) for k, v in groupby(own) if k), default=0))


def test_histories(spark):
    v = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (3, "a"), (4, "c"), (5, "b")], "o long, k string")
    known = spark.createDataFrame([("b",), (None,), ("b",)], "k string")
    assert sorted(r["o"] for r in history.unseen(v, "k", known, "k").collect()) == [0, 2, 3, 4]
    assert sorted(rows(history.page_overlap(v, "k", "o", 3).select("page", "n_ids", "n_again"))) == [(0, 2, 0), (1, 3, 2)]
    assert sorted(rows(history.memberships({"x": v, "y": known}, "k"))) == [("a", True, False), ("b", True, True), ("c", True, False)]


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(1, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(5, 5), (1, 2), (2, 1)]
    parent = {n: n for e in edges if e[0] != e[1] for n in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = rows(graph.components(spark.createDataFrame(edges, "a long, b long")))
    assert len(got) == len(parent) and dict(got) == {n: root(n) for n in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("local", [500, 10, 0])
def test_average_linkage(spark, local):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((6, 16)) * 1.0
    v = np.concatenate([c + rng.standard_normal((8, 16)) * 0.55 for c in centers])
    v /= np.sqrt((v * v).sum(1))[:, None]
    n, cut = len(v), 0.7
    groups = [[i] for i in range(n)]
    while True:
        best = max(((np.mean([v[i] @ v[j] for i in a for j in b]), -x, -y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y), default=(-1, 0, 0))
        if best[0] < cut:
            break
        x, y = -best[1], -best[2]
        groups[x] += groups.pop(y)
    want = {i: min(g) for g in groups for i in g}
    points = spark.createDataFrame([(i, v[i].tolist()) for i in range(n)], "id long, v array<double>")
    links = spark.createDataFrame([(i, j) for i in range(n) for j in range(i + 1, n) if v[i] @ v[j] >= cut], "a long, b long")
    assert dict(rows(family.average_linkage(points, links, cut, local))) == want


def test_rounds_keep_no_expected_sizes(spark, monkeypatch):
    sizes = []

    def watched(df, *how, **named):
        out = cut(df, *how, **named)
        sizes.append(int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length())
        return out

    cut = family.cut
    monkeypatch.setattr(family, "cut", watched)
    near = [np.sqrt(np.array([1 - e, e])) for e in np.cumsum(np.linspace(0.001, 0.002, 32))]
    v = [(i, np.pad(x, (0, family.DIM - 2)).tolist()) for i, x in enumerate(near)]
    points = spark.createDataFrame(v, "id long, v array<double>")
    links = spark.createDataFrame([(i, j) for i in range(32) for j in range(i + 1, 32)], "a long, b long")
    assert {r["cluster"] for r in family.average_linkage(points, links, 0.7, local=0).collect()} == {0}
    assert len(sizes) > 20 and max(sizes[3:]) <= 64


def test_component_of_over_500_points_is_one_task(spark, monkeypatch):
    rng = np.random.default_rng(7)
    # A dense group that grows point by point, and copies, which tie: both merge one pair a round.
    v = np.concatenate([rng.standard_normal(family.DIM) + rng.standard_normal((500, family.DIM)) * np.linspace(0.1, 0.75, 500)[:, None], np.zeros((100, family.DIM))])
    v[500:] = v[3]
    v /= np.sqrt((v * v).sum(1))[:, None]
    sums, left, want = v @ v.T, list(range(600)), {i: i for i in range(600)}
    size = np.ones(600)
    while True:
        mean = np.triu(np.round(sums[np.ix_(left, left)] / np.outer(size[left], size[left]), 12) + 2, 1)
        x, y = divmod(int(mean.argmax()), len(left))
        if mean[x, y] < 0.7 + 2:
            break
        a, b = left[x], left[y]
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        size[a] += size[b]
        left.remove(b)
        want = {i: a if c == b else c for i, c in want.items()}
    assert 1 < len(set(want.values())) < 500
    points = spark.createDataFrame([(i, v[i].tolist()) for i in range(600)], "id long, v array<double>")
    links = spark.createDataFrame([(0, i) for i in range(1, 600)], "a long, b long")
    monkeypatch.setattr(family, "in_rounds", None)
    assert dict(rows(family.average_linkage(points, links, 0.7))) == want


def test_rounds_take_equal_vectors_as_one(spark, monkeypatch):
    cuts = []
    cut = family.cut
    monkeypatch.setattr(family, "cut", lambda *how, **named: cuts.append(1) or cut(*how, **named))
    v = np.zeros((42, family.DIM))
    v[:20, 0] = v[20:40, 1] = 1
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    links = spark.createDataFrame([(0, i) for i in range(1, 41)] + [(40, 41)], "a long, b long")
    got = dict(rows(family.average_linkage(points, links, 0.7, local=0)))
    assert got == {i: 0 if i < 20 else 20 if i < 40 else i for i in range(42)}
    assert len(cuts) < 15


def test_similar_recall_and_families(spark):
    rng = random.Random(6)
    seqs = []
    for _ in range(12):
        base = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(400))
        seqs += [base] + ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") if rng.random() < 0.06 else c for c in base) for _ in range(6)]
    seqs += ["M" * 10, "", seqs[0]]
    df = spark.createDataFrame([(i, 1, s) for i, s in enumerate(seqs)], "rec long, part long, seq string")
    prof = family.profiles(df, "rec", "seq").withColumnRenamed("rec", "id").withColumn("part", F.lit(1).cast("long"))
    v = {r["id"]: np.array(r["v"]) for r in prof.collect()}
    want = {(a, b) for a in v for b in v if a < b and v[a] @ v[b] >= 0.7 and not (a == 0 and b == len(seqs) - 1) and b != len(seqs) - 1}
    got = {(r["a"], r["b"]) for r in family.similar(prof.select("id", "part", "v"), 0.7).collect()}
    assert (0, len(seqs) - 1) in got
    assert len(got & want) >= 0.9 * len(want)
    out = family.families(df).collect()
    assert len(out) == len(seqs) and len({r["new_id"] for r in out}) == len(seqs)
    assert [r["family_no"] for r in sorted(out, key=lambda r: r["rec"]) if r["rec"] in (84, 85)] == [1, 2]


def test_profiles_read_whole_sequences(spark):
    rng = random.Random(8)
    head, *tails = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for n in (1000, 3000, 3000)]
    df = spark.createDataFrame([(i, 1, head + t) for i, t in enumerate(tails)] + [(2, 1, head)], "rec long, part long, seq string")
    v = {r["rec"]: np.array(r["v"]) for r in family.profiles(df, "rec", "seq").collect()}
    assert max(v[a] @ v[b] for a, b in ((0, 1), (0, 2), (1, 2))) < 0.7
    assert len({r["family_no"] for r in family.families(df).collect()}) == 3


@pytest.mark.parametrize("block", [2000, 40])
def test_similar_finds_every_link(spark, block):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, family.DIM))
    # Pairs just above and below the threshold, which a hash table would miss now and then.
    v = np.concatenate([base, base + rng.standard_normal(base.shape) * rng.uniform(0.9, 1.1, (150, 1))])
    v = np.concatenate([v / np.sqrt((v * v).sum(1))[:, None], np.eye(family.DIM)[:1]])
    part = [i % 150 % 2 for i in range(300)] + [0]
    points = spark.createDataFrame([(i, part[i], v[i].tolist()) for i in range(301)], "id long, part long, v array<double>")
    want = {(a, b) for a in range(301) for b in range(a + 1, 301) if part[a] == part[b] and v[a] @ v[b] >= 0.7}
    assert len(want) > 50
    assert sorted((r["a"], r["b"]) for r in family.similar(points, 0.7, *([block] if block != 2000 else [])).collect()) == sorted(want)


def test_similar_leaves_out_points_without_an_id(spark):
    x, y = ([1.0 if i == k else 0.0 for i in range(family.DIM)] for k in (0, 1))
    points = spark.createDataFrame([(1, 1, x), (None, 1, x), (2, 1, y), (None, 1, y), (3, 1, y)], "id long, part long, v array<double>")
    assert rows(family.similar(points, 0.7)) == [(2, 3)]


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 8))
    v[17] = v[5]
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(300)] + [(300, None), (301, [0.0] * 8), (None, v[5].tolist())], "id long, v array<double>")
    got = {}
    for r in vectorsearch.nearest(df.where("id % 20 = 5 or id is null"), df, "id", "v", 3).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["id"]
    u = v / np.sqrt((v * v).sum(1))[:, None]
    for q in range(5, 300, 20):
        sims = sorted(((round(-float(u[q] @ u[j]), 9), j) for j in range(300) if j != q))[:3]
        assert [got[q][k] for k in (1, 2, 3)] == [j for _, j in sims]


def test_expression(spark):
    s = spark.createDataFrame([("g", "Normal liver", 10.0), ("g", "liver tumor", 90.0), ("g", None, 5.0), ("g", "tumor", float("nan")), ("h", "x", None)], "gene string, tissue string, value double")
    stats = {r["gene"]: r for r in expression.context_stats(s.withColumn("context", expression.context("tissue", ["normal"], ["tumor"]))).collect()}
    assert (stats["g"]["normal_mean"], stats["g"]["cancer_max"], stats["g"]["cancer_n"]) == (10.0, 90.0, 1) and stats["h"]["normal_mean"] == 0.0
    checks = spark.createDataFrame([("a", 1, True, "x"), ("a", 2, False, "y"), ("a", 3, None, "z"), ("b", 1, True, "x")], "item string, ord int, ok boolean, reason string")
    assert sorted(rows(expression.first_failure(checks))) == [("a", False, "y"), ("b", True, None)]


def test_structure(spark):
    res = spark.createDataFrame([(1, p, float(p), 0.0, 0.0, 90.0 if p < 20 or p > 30 else 40.0) for p in range(60)], "structure long, pos int, x double, y double, z double, b double")
    spans = spark.createDataFrame([(1, [(0, 20), (31, 50)]), (2, [(0, 5)])], "structure long, spans array<struct<start:int,end:int>>")
    assert dict(rows(structure.catalytic_distance(res, spans))) == {1: 30.0, 2: None}
    got = {r["structure"]: r for r in structure.window_means(res, spans).collect()}
    assert got[1]["linker"] == 40.0 and got[1]["domain1"] < 90 and got[2]["dip"] is None
    tm = spark.createDataFrame([("q", "r1", 0.5), ("q", "r0", 0.5), ("q", "r2", None), ("p", "r1", None)], "structure string, ref string, tm double")
    assert sorted(rows(structure.best_scores(tm))) == [("p", 0.0, None, 0), ("q", 0.5, "r0", 2)]


def test_mutants(spark):
    seq = "ACDEFGHIKL" * 20 + "RAAAAH" + "MNPQSTVWY" * 20
    df = spark.createDataFrame([(1, seq), (2, "ACD"), (3, None)], "rec long, seq string")
    out = design.mutants(df).collect()
    assert [r["rec"] for r in out] == [1] * 5 and len({r["mutant"] for r in out}) == 5
    assert sorted(map(tuple, out)) == sorted(map(tuple, design.mutants(df).collect()))
    for r in out:
        changed = [i for i in range(len(seq)) if seq[i] != r["mutant"][i]]
        assert "_".join(f"{i}{seq[i]}{r['mutant'][i]}" for i in changed) == r["description"] and 1 <= len(changed) <= 3
        assert not set(changed) & set(range(195, 211))


def test_kept_variants(spark):
    v = spark.createDataFrame([("v1", "p1", 0.9, 0.5), ("v2", "p1", 0.4, 0.5), ("v3", "p2", 0.9, 0.9), ("v4", "p3", None, 0.1)], "id string, parent string, score double, identity double")
    p = spark.createDataFrame([("p1", 0.1), ("p2", 0.8), ("p3", 0.9)], "id string, identity double")
    assert sorted(rows(design.kept_variants(v, p))) == [("p2", "parent"), ("v1", "variant")]

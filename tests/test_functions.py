"""Column functions and row operators against plain Python."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import dna, protein, texts, vectors
from seqloom.operators import alignment, repeats
from tests.conftest import rows


def proteins(n=150, seed=0):
    rng = random.Random(seed)
    out = ["".join(rng.choice("RHAKDEM") for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    return out + ["", "RAAAAH", "RAAAAAAH", "RAAAARAAAAH", "RAAAH", "M" + "A" * 40 + "RAAAAH" + "A" * 14, "RAAAAH" * 4, "A" * 5000 + "RAAAAHRAAAAH"]


def test_motifs_and_spans(spark):
    texts_ = proteins()
    df = spark.createDataFrame(list(enumerate(texts_)) + [(9999, None)], "id long, seq string").withColumn("s", protein.motif_spans("seq")).withColumn("n", F.length("seq"))
    out = df.select(
        "id", "s", protein.motif_count("seq").alias("c"), protein.nuclease_spans("s", F.col("n"), 3).alias("m"), protein.protected("s", F.col("n")).alias("p"), protein.linker_charge("seq", "s").alias("q"),
        protein.complement(protein.nuclease_spans("s", F.col("n"), 3), F.col("n")).alias("r"), protein.tail_complete("seq", "s").alias("t"), protein.spaced("s", 5, 50).alias("far"),
    ).collect()
    for r in out:
        if r["id"] == 9999:
            assert r["s"] is None and r["c"] is None
            continue
        seq = texts_[r["id"]]
        spans = [(m.start(), m.end()) for m in re.finditer("R.{4,6}H", seq)]
        assert [tuple(x) for x in r["s"]] == spans and r["c"] == len(spans)
        merged = []
        for a, b in spans:
            a, b = max(a - 3, 0), min(b + 3, len(seq))
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        assert [list(x) for x in r["m"]] == merged
        covered = {i for a, b in merged for i in range(a, b)}
        assert {i for a, b in r["r"] for i in range(a, b)} == set(range(len(seq))) - covered
        assert r["p"] == sorted({i for a, b in spans for i in range(max(a - 5, 0), min(b + 5, len(seq)))})
        gap = seq[spans[0][1] : spans[1][0]] if len(spans) > 1 else None
        assert r["q"] == (None if gap is None else sum(c in "RK" for c in gap) - sum(c in "DE" for c in gap))
        assert r["t"] == (bool(spans) and len(seq) - spans[-1][1] >= 15)
        assert r["far"] == (2 <= len(spans) <= 3 and any(5 < b[0] - a[0] < 50 for a in spans for b in spans))


def translate(s):
    code = {"".join(c): a for c, a in zip(__import__("itertools").product("TCAG", repeat=3), dna.AMINO_ACIDS, strict=True)}
    return "".join(code.get(s[i : i + 3], "X") for i in range(0, len(s) - 2, 3))


def test_frames(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 30, 301, 1000)] + ["TAATAATAA", "ATGTAAATG"]
    df = spark.createDataFrame(list(enumerate(seqs)), "contig_id long, dna string").withColumn("contig_len", F.length("dna"))
    for r in dna.six_frames(df).collect():
        s = seqs[r["contig_id"]]
        if r["frame"] >= 3:
            s = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert r["prot"] == translate(s[r["frame"] % 3 :])
    for r in dna.reading_frames(dna.six_frames(df)).collect():
        s = seqs[r["contig_id"]]
        if r["frame"] >= 3:
            s = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert translate(s[r["start_nt"] : r["end_nt"]]) == r["orf"] and "*" not in r["orf"]
    amb = spark.createDataFrame([("ACNTAR",), ("NNNATG",), ("AC",)], "s string").select(dna.translated("s").alias("t"))
    assert [r[0] for r in amb.collect()] == ["T*", "XM", ""]
    assert len(dna.codon_table()) > 64


def test_junctions(spark):
    import hashlib

    names = ["A-B", "", "fusion--x", "é"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", dna.imputed_junction("n").alias("j")).withColumn("c", dna.cut_sites("j"))
    for r in df.collect():
        half = "".join("ACTG"[b % 4] for b in hashlib.sha256(r["n"].encode()).digest()[:30])
        assert r["j"] == half * 2 and r["c"] == sum(r["j"][i + 22] != "G" for i in range(60 - 22))
    short = spark.createDataFrame([("G" * 22,), ("G" * 22 + "A",), ("",), ("G" * 40,)], "j string").select(dna.cut_sites("j"))
    assert [r[0] for r in short.collect()] == [0, 1, 0, 0]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ACDX", max_size=14), st.text(alphabet="ACDX", max_size=14), st.integers(0, 3))
def test_alignment_is_optimal(a, b, gap):
    def best(i, j, memo={}):  # noqa: B006
        key = (a[i:], b[j:], gap)
        if key not in memo:
            if i == len(a) or j == len(b):
                memo[key] = -gap * (len(a) - i + len(b) - j)
            else:
                s = int(alignment.SCORES[ord(a[i]) - 65, ord(b[j]) - 65])
                memo[key] = max(best(i + 1, j + 1) + s, best(i + 1, j) - gap, best(i, j + 1) - gap)
        return memo[key]

    v = alignment.identity(a, b, gap)
    assert 0 <= v <= 1
    if a and a == b:
        assert v == 1 or "X" in a
    if a and b:
        # Identity times columns is the number of equal pairs of some best alignment.
        columns = [c for c in range(max(len(a), len(b)), len(a) + len(b) + 1) if abs(v * c - round(v * c)) < 1e-9]
        assert columns
    assert best(0, 0) >= -gap * (len(a) + len(b))


def test_blosum_is_symmetric():
    m = alignment.SCORES
    assert (m == m.T).all() and m[ord("W") - 65, ord("W") - 65] == 11 and m[ord("A") - 65, ord("R") - 65] == -1


def brute_repeats(s, k):
    if len(s) < 400:
        return set()
    at = {}
    for i in range(len(s) - k):
        at.setdefault(s[i : i + k], []).append(i)
    need = 2 if len(s) < 1500 else 3
    return {(w, p[0], p[-1], len(p), p[need - 1]) for w, p in at.items() if len(p) >= need}


@pytest.mark.parametrize("n", [399, 400, 1499, 1500, 2500])
def test_repeats(n):
    rng = random.Random(n)
    unit = "".join(rng.choice("ACGT") for _ in range(36))
    s = "".join(rng.choice("ACGT") for _ in range(n))
    for at in (10, 100, 300, n - 36):
        s = (s[:at] + unit + s[at + 36 :])[:n]
    for k in repeats.KS:
        got = repeats.repeats_of(s, k)
        assert set(got) == brute_repeats(s, k) and [r[4] for r in got] == sorted(r[4] for r in got)


def test_tandem():
    unit = "ACGTTGCAACGGTATCCGATA"
    s = "TTGAC" + unit * 3 + "GGATC"
    brute = [s[i : i + size] for size in range(20, 48) for i in range(len(s) - 2 * size + 1) if s[i : i + size] == s[i + size : i + 2 * size]]
    assert repeats.tandem_of(s) == list(dict.fromkeys(brute)) and unit in repeats.tandem_of(s)
    assert repeats.tandem_of("") == [] and repeats.tandem_of("AC" * 5) == []


def test_texts(spark):
    df = spark.createDataFrame([(" a; b,,c ", "AB--CDE-FGH", "r1.2", 'said {"k": 1} end'), (None, None, None, None), ("Unknown", "x", "r/1", "none"), ("", "", "", "")], "d string, f string, r string, j string")
    out = rows(df.select(texts.disease_list("d"), texts.fusion_genes("f"), texts.read_base("r"), texts.json_block("j", "{}"), texts.valid_disease("d")))
    assert out == [(["a", "b", "c"], ["CDE", "FGH"], "r1", '{"k": 1}', True), ([], None, None, None, False), ([], [], "r", "", False), ([], [], "", "", False)]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    out = rows(df.select(vectors.cosine("a", "b"), vectors.l2("a", "b"), vectors.lerp("a", "b", F.lit(0.5)), vectors.mean_of(F.array("a", "b"))))
    assert out[0] == (0.0, 5**0.5, [0.5, 1.0], [0.5, 1.0]) and out[1][:2] == (1.0, 0.0) and out[2][0] is None and out[3][:3] == (None, None, None)

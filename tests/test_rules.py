"""Rules of choice, lobes, reads and long contigs on small and odd inputs."""

import random

from pyspark.sql import functions as F

from seqloom.functions import dna, protein
from seqloom.operators import expression, matching, vectorsearch
from seqloom.sources import files
from tests.conftest import rows


def test_disease_rule(spark):
    t = spark.createDataFrame([("a",), ("b",), (None,)], "fusion string")
    known = spark.createDataFrame([("a", "LUAD")], "fusion string, diseases string")
    assert {r["fusion"]: r["disease"] for r in matching.with_disease(t, known).collect()} == {"a": "LUAD", "b": "Unknown", None: "Unknown"}
    assert {r["disease"] for r in matching.with_disease(t).collect()} == {"Unknown"}
    # A column of its own wins, even where it is null.
    own = t.withColumn("primary_disease", F.when(F.col("fusion") == "b", "X"))
    assert {r["fusion"]: r["disease"] for r in matching.with_disease(own, known).collect()} == {"a": None, "b": "X", None: None}


def test_first_of_list_and_cap(spark):
    t = spark.createDataFrame([(1, 5, "x"), (1, 2, "y"), (1, 9, "y"), (1, 3, None), (1, 4, "z"), (2, 1, "x")], "f long, o long, fusion string")
    assert sorted(rows(matching.first_of_list(t, "f", 2, "o"))) == [(1, "y", 1), (1, "z", 2), (2, "x", 1)]
    leads = spark.createDataFrame([(3, "A"), (1, None), (2, " unknown "), (4, "B"), (5, "")], "id long, d string")
    assert [r["id"] for r in matching.first_candidates(leads, "d", 1, "id").collect()] == [3]
    assert [r["id"] for r in matching.first_candidates(leads, "d", None, "id").collect()] == [3, 4]


def test_tissue_risks(spark):
    s = spark.createDataFrame([("g", "Brain cortex", 300.0), ("g", "brain stem", 0.0), ("g", "LIVER", 101.0), ("h", "liver", 50.0), ("g", None, 999.0), ("h", "liver", None)], "gene string, tissue string, value double")
    m = spark.createDataFrame([("f", "g"), ("f", "h"), ("f", "g"), ("e", "none"), ("e", None)], "item string, gene string")
    got = {r["item"]: (r["n_risks"], r["score"], r["risks"]) for r in expression.tissue_risks(s, m, ["brain", "liver"]).collect()}
    assert got == {"f": (2, 50, ["g in brain", "g in liver"]), "e": (0, 100, [])}
    assert expression.tissue_risks(s, m, ["brain", "liver"], cost=60).where("item = 'f'").collect()[0]["score"] == 0
    assert expression.tissue_risks(s.limit(0), m, ["brain"]).count() == 2 and expression.tissue_risks(s, m.limit(0), ["brain"]).count() == 0


def test_fusion_checks(spark):
    #        item ord gene by_organ normal_n mean max cancer_n mean
    data = [(1, 0, "a", True, 2, 1.0, 9.0, 2, 5.0), (1, 1, "b", True, 2, 3.0, 9.0, 2, 5.0), (2, 0, "c", True, 0, 0.0, 0.0, 1, 0.5), (3, 0, "d", True, 1, 0.0, 0.0, 0, 0.0), (4, 0, "e", True, 0, 0.0, 0.0, 0, 0.0),
            (5, 0, "f", False, 3, 0.5, 0.9, 2, 0.5), (6, 0, "g", False, 3, 0.5, 2.0, 2, 9.0), (7, 0, "h", False, 1, 0.1, 0.1, 0, 0.0), (8, 0, "i", True, 2, 0.0, 0.0, 2, 0.1)]
    df = spark.createDataFrame(data, "item int, ord int, gene string, by_organ boolean, normal_n long, normal_mean double, normal_max double, cancer_n long, cancer_mean double")
    got = {r["item"]: r["reason"] for r in expression.first_failure(expression.fusion_checks(df)).collect()}
    assert got == {
        1: "b: not enriched in organ", 2: "c: cancer mean too low in organ, no normal", 3: "d: no cancer samples in organ", 4: "e: no normal-tissue data",
        5: "f: not expressed in cancer", 6: "g: expressed in normal", 7: None, 8: "i: cancer mean too low in organ",
    }


def test_lobes(spark):
    df = spark.createDataFrame([(1, "A" * 120 + "RAAAAH" + "A" * 100, [("N.1", 5, 20), ("N", 10, 30), ("R", 90, 99), ("R", 95, 120)]), (2, "A" * 120 + "RAAAAH" + "A" * 100, None), (3, "", [])], "id int, seq string, d array<struct<signature:string,start:int,end:int>>")
    nuc, rec = protein.lobes("d", protein.motif_spans("seq"), F.length("seq"), ["N"], ["R"])
    got = {r[0]: (r[1], r[2]) for r in df.select("id", protein.span_summary(nuc), protein.span_summary(rec)).collect()}
    assert got == {1: ("6-20, 11-30", "91-120"), 2: ("71-176", "1-70, 177-226"), 3: ("-", "-")}


def test_fastq_in_splits(spark, tmp_path):
    rng = random.Random(3)
    reads = [(f"r{i}.{1 + i % 2}", "".join(rng.choice("ACGT") for _ in range(60))) for i in range(400)]
    (tmp_path / "a.fastq").write_text("".join(f"@{n} x\n{s}\n+\n{'@' * 60}\n" for n, s in reads) + "@cut\nACG\n")
    (tmp_path / "empty.fastq").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = files.fastq(spark, str(tmp_path))
        got = sorted(df.collect(), key=lambda r: r["read_no"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["id"], r["seq"]) for r in got] == reads and {r["base_id"] for r in got} == {n[:-2] for n, _ in reads}


def test_frames_of_a_long_contig(spark):
    rng = random.Random(1)
    prot = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY*") for _ in range(400_000))
    df = spark.createDataFrame([(1, 0, prot), (2, 1, ""), (3, 2, "*"), (4, 0, None)], "contig_id int, frame int, prot string")
    out = dna.reading_frames(df).where("contig_id = 1").agg(F.count("*"), F.sum("start_nt"), F.max("end_nt")).collect()[0]
    parts, at, total = prot.split("*"), 0, 0
    for p in parts:
        total += 3 * at
        at += len(p) + 1
    assert tuple(out) == (len(parts), total, 3 * len(prot))
    assert sorted((r["contig_id"], r["start_nt"], r["end_nt"]) for r in dna.reading_frames(df).where("contig_id in (2, 3)").collect()) == [(2, 1, 1), (3, 2, 2), (3, 5, 5)]


def test_search_in_several_slabs(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(200)] + [(200, None), (201, [0.0] * 4)], "id long, v array<double>")
    one = sorted(map(tuple, vectorsearch.nearest(df.where("id % 20 = 0"), df, "id", "v", 3).collect()))
    ref = sorted(map(tuple, vectorsearch.closest_reference(df, "id", "v", df.where("id < 30")).collect()))
    monkeypatch.setattr(vectorsearch, "SLAB_BYTES", 100)
    assert sorted(map(tuple, vectorsearch.nearest(df.where("id % 20 = 0"), df, "id", "v", 3).collect())) == one
    assert sorted(map(tuple, vectorsearch.closest_reference(df, "id", "v", df.where("id < 30")).collect())) == ref
    assert vectorsearch.nearest(df.limit(0), df, "id", "v", 3).count() == 0 and vectorsearch.nearest(df.where("id = 1"), df.limit(0), "id", "v", 3).count() == 0
    none = {r["id"]: (r["sim"], r["ref"]) for r in vectorsearch.closest_reference(df, "id", "v", df.limit(0)).collect()}
    assert set(none.values()) == {(0.0, None)} and len(none) == 202

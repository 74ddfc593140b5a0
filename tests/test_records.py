"""Fallbacks, settings and the mining chain."""

import json

from pyspark.sql import functions as F

from seqloom.config import MiningConfig
from seqloom.functions.texts import stripped_of
from seqloom.operators import mining, records
from tests.conftest import rows


def ids(spark, *xs, name="id"):
    return spark.createDataFrame([(x,) for x in xs], f"{name} string")


def test_config():
    c = MiningConfig.from_env({"MIN_ORF": "x", "REQUIRE_START_M": "no", "FILTER_MOTIFS": "Yes", "SIMILARITY_CEILING": "0.9", "SCORE_THRESHOLD": "high"})
    assert (c.min_orf, c.require_start_m, c.filter_motifs, c.similarity_ceiling, c.score_threshold) == (600, False, True, 0.9, 0.75)


def test_by_id_or_place(spark):
    assert sorted(rows(records.by_id_or_place(ids(spark, "a", "b", name="rid"), ids(spark, "b", "c")))) == [("b", "b")]
    many = [f"x{i:03d}" for i in range(50)]
    got = sorted(rows(records.by_id_or_place(ids(spark, *many, name="rid"), ids(spark, *[f"y{m}" for m in many]))))
    assert got == [(m, f"y{m}") for m in many]
    assert records.by_id_or_place(ids(spark, "a", "b", name="rid"), ids(spark, "c")).count() == 0


def test_fallbacks(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"k": 1}]))
    (tmp_path / "a.json").write_text("[]")
    got = records.first_readable_json(spark, [str(tmp_path / n) for n in ("none.json", "a.json", "b.json")], "k int")
    assert rows(got) == [(1,)]
    assert records.first_readable_json(spark, [str(tmp_path / "none.json")], "k int").count() == 0
    df = spark.createDataFrame([('take ["1", "22", "1", "3"] please',), ("ids 5, 66 and 7",), ("only 5",), (None,)], "r string")
    assert [r[0] for r in df.select(records.chosen_ids("r")).collect()] == [["1", "22", "3"], ["5", "66", "7"], None, None]


def test_query_suffixes(spark):
    df = spark.createDataFrame([(" marine WGS[prop] ",), ("x[title][Title]",), ("plain",), ("a[All Fields]",)], "q string")
    assert [r[0] for r in df.select(stripped_of("q", records.QUERY_SUFFIXES)).collect()] == ["marine", "x", "plain", "a"]


def test_small_joins(spark):
    a = spark.createDataFrame([("a", "AA"), ("a", "AB")], "id string, seq string")
    assert sorted(rows(records.with_parents(a, spark.createDataFrame([("a", "X"), ("b", "Y")], "id string, seq string")))) == [("a", "AA"), ("a", "AB"), ("b", "Y")]
    labels = records.reference_labels(spark.createDataFrame([("1ABC",), ("2XYZ",)], "pdb_id string"), spark.createDataFrame([("1ABC", "Sub1")], "pdb_id string, subtype string"))
    assert sorted(r["label"] for r in labels.collect()) == ["2xyz", "sub1_1abc"]
    words = records.organ_words(spark.createDataFrame([("f", "C1"), ("f", "C2"), ("g", "C9")], "fusion string, code string"), spark.createDataFrame([("C1", "lung"), ("C2", "lung"), ("C2", "airway")], "code string, word string"))
    assert rows(words) == [("f", ["airway", "lung"])]
    best = records.best_domains(spark.createDataFrame([("s", 0.1, None), ("s", 0.05, 0.3), ("t", None, None)], "structure string, tm1 double, tm2 double"))
    assert sorted(rows(best)) == [("s", 0.1, 0.3), ("t", None, None)]
    fold = records.to_fold(spark.createDataFrame([("a", "AAAA"), ("b", "A"), ("c", "AA")], "id string, seq string"), ids(spark, "b"), 3)
    assert [r["id"] for r in fold.collect()] == ["c"]
    ok = spark.createDataFrame([(0.3, 2), (0.3, 4), (None, 2), (0.1, 3)], "b double, n int").select(records.structure_passes(F.col("b"), F.col("n")))
    assert [r[0] for r in ok.collect()] == [True, False, False, False]
    reads = ids(spark, "A", "B", "C")
    assert records.spot_check(reads, F.col("id") == "B", 3) and not records.spot_check(reads, F.col("id") == "Z", 3) and records.spot_check(reads, F.col("nothing") == 1, 3)
    links = spark.createDataFrame([("p", "1", 1), ("p", "2", 2), ("p", "3", 3), ("q", "1", 1)], "project string, id string, o int")
    assert sorted(r["id"] for r in records.capped_per_group(links, "project", "o", 2).collect()) == ["1", "2"]


def test_mining_chain(spark):
    unit = "GATTACAGATTACCAGGATCCATTGCAACGTTGCA"
    orf = "ATG" + "GCTGAACGT" * 12 + "CGTGCTGCTGCTGCTCAT" + "GAAGCT" * 4 + "TAA"
    filler = ("ACGTTGACCTGAATCGGATTCCAGTTACGCTAGG" * 8)[:220]
    contigs = spark.createDataFrame([(1, filler + unit + "TTC" * 9 + unit + "GGA" * 8 + "TAA" + orf + filler), (2, orf), (3, None), (4, "")], "contig_id long, dna string")
    cfg = MiningConfig(min_orf=30, max_orf=400, require_full_structure=True, min_cterm_tail=5, contig_boundary_margin=10)
    got = mining.candidates(contigs, cfg).collect()
    assert any(r["contig_id"] == 1 and r["orf"].startswith("M") and "RAAAAH" in r["orf"] for r in got)
    assert {r["contig_id"] for r in got} == {1}
    far = MiningConfig(min_orf=30, max_orf=400, crispr_flank_bp=0, min_repeat_count=10**6)
    assert mining.candidates(contigs, far).count() == 0
    loose = MiningConfig(min_orf=30, max_orf=400, require_crispr=False)
    assert 2 in {r["contig_id"] for r in mining.candidates(contigs, loose).collect()}
    st = {r["contig_id"]: r for r in mining.stats(contigs, mining.candidates(contigs, cfg)).collect()}
    assert st[1]["n_candidates"] >= 1 and st[1]["has_repeats"] and not st[3]["has_repeats"] and st[4]["longest"] == 0
    scored = spark.createDataFrame([(0.75,), (0.76,), (0.95,)], "score double")
    assert mining.hits(scored, MiningConfig()).count() == 2 and mining.hits(scored, MiningConfig(similarity_ceiling=0.9, similarity_floor=0.1)).count() == 1

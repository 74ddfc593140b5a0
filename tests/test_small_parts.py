"""Smaller functions of several modules."""

from datetime import datetime

from pyspark.sql import functions as F

from seqloom.functions import protein, texts
from seqloom.operators import alignment, design
from seqloom.sources import sinks
from tests.conftest import rows


def test_closest_reference_of_alignments(spark):
    pairs = spark.createDataFrame(
        [("q1", "MKVLA", "r1", 0, "MKVLA"), ("q1", "MKVLA", "r0", 1, "MKVLA"), ("q2", "MKVLA", "r1", 0, "WWWW"), ("q2", "MKVLA", "r2", 1, None), ("q3", None, "r1", 0, "MK")],
        "id string, seq string, ref string, o int, rseq string",
    )
    out = {r["id"]: tuple(r)[1:] for r in alignment.closest(alignment.with_identity(pairs, "seq", "rseq"), "id", "ref", "o").collect()}
    assert out == {"q1": (1.0, "r1"), "q2": (0.0, ""), "q3": (0.0, "")}


def test_suggestions(spark):
    seq = "MKVLARAAAAHGG"
    df = spark.createDataFrame([(2, "K", "R"), (2, "V", "R"), (0, "M", "R"), (14, "G", "R"), (6, "R", "K"), (2, "K", "K"), (2, "K", "RR"), (None, "K", "R")], "p int, w string, m string")
    ok = protein.suggestion_holds(F.lit(seq), F.col("p"), F.col("w"), F.col("m"), F.array(*[F.lit(i) for i in range(5, 11)]))
    assert [r[0] for r in df.select(ok).collect()] == [True] + [False] * 7


def test_names_and_lines(spark):
    one = spark.range(1)
    assert one.select(design.variant_name(F.lit("p"), F.lit("3AV"), F.lit(0.456), F.lit(0.5))).collect()[0][0] == "p_mut_3AV_id0.46_esm0.500"
    assert one.select(texts.stamp(F.lit(datetime(2024, 1, 2, 3, 4, 5)))).collect()[0][0] == "20240102_030405"
    assert one.select(protein.wrapped(F.lit("A" * 120)), protein.wrapped(F.lit("A" * 61))).collect()[0][:] == ("A" * 60 + "\n" + "A" * 60, "A" * 60 + "\nA")
    assert one.select(texts.preview(F.lit("ACGTACGTACGTACGTACGT"))).collect()[0][0] == "ACGTACGTACGTACG..."


def test_ordered_csv(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None), (3, "c")], "a int, b string")
    sinks.write_csv(df, str(tmp_path / "out"), F.desc("a"), single=True)
    files = list((tmp_path / "out").glob("part-*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines()[0] == "a,b"
    assert [int(line.split(",")[0]) for line in files[0].read_text().splitlines()[1:]] == [3, 2, 1]
    sinks.write_json(df, str(tmp_path / "json"))
    assert sorted(rows(spark.read.json(str(tmp_path / "json")).select("a"))) == [(1,), (2,), (3,)]

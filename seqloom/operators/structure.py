"""Measures on residues of predicted structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.protein import let

#: Widening of a motif for the means of its domain.
PAD = 45


def first_residues(atoms: DataFrame) -> DataFrame:
    """One row per structure, chain and residue number: the first by file order. atoms: structure, chain, resseq, ord, resname, x, y, z, b."""
    kept = F.struct("ord", "resname", "x", "y", "z", "b")
    return atoms.groupBy("structure", "chain", "resseq").agg(F.min_by(kept, "ord").alias("r")).select("structure", "chain", "resseq", "r.*")


def longest_chain(residues: DataFrame) -> DataFrame:
    """structure, chain, n: the chain with the most residues, the first in the file if several."""
    per = residues.groupBy("structure", "chain").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = per.groupBy("structure").agg(F.max_by(F.struct("chain", "n"), F.struct("n", -F.col("first"))).alias("c"))
    return best.select("structure", "c.chain", "c.n")


def positions(residues: DataFrame) -> DataFrame:
    """Adds pos, from 0, by residue number within the structure."""
    return residues.withColumn("pos", F.row_number().over(Window.partitionBy("structure").orderBy("resseq")) - 1)


def catalytic_distance(residues: DataFrame, spans: DataFrame) -> DataFrame:
    """structure, distance: between the last residues (H) of the first two motifs; null if there are fewer or a residue is missing.

    residues: structure, pos, x, y, z; spans: structure, spans.
    """
    ends = spans.select("structure", (F.get("spans", F.lit(0))["end"] - 1).alias("p1"), (F.get("spans", F.lit(1))["end"] - 1).alias("p2"))
    at = residues.select("structure", "pos", F.struct("x", "y", "z").alias("c"))
    a, b = at.select("structure", F.col("pos").alias("p1"), F.col("c").alias("a")), at.select("structure", F.col("pos").alias("p2"), F.col("c").alias("b"))
    sq = lambda k: F.pow(F.col(f"a.{k}") - F.col(f"b.{k}"), 2)
    return ends.join(a, ["structure", "p1"], "left").join(b, ["structure", "p2"], "left").select("structure", F.sqrt(sq("x") + sq("y") + sq("z")).alias("distance"))


def window_means(residues: DataFrame, spans: DataFrame) -> DataFrame:
    """structure, linker, domain1, domain2 (means of b, two places) and dip: a weak linker between two firm domains; null without two motifs."""
    two = spans.where("size(spans) >= 2").select("structure", F.get("spans", F.lit(0)).alias("s1"), F.get("spans", F.lit(1)).alias("s2"))
    rows = residues.select("structure", "pos", "b").join(two, "structure")
    inside = lambda lo, hi: F.when((F.col("pos") >= lo) & (F.col("pos") < hi), F.col("b"))
    means = rows.groupBy("structure").agg(
        F.round(F.avg(inside(F.col("s1.end"), F.col("s2.start"))), 2).alias("linker"),
        F.round(F.avg(inside(F.col("s1.start") - PAD, F.col("s1.end") + PAD)), 2).alias("domain1"),
        F.round(F.avg(inside(F.col("s2.start") - PAD, F.col("s2.end") + PAD)), 2).alias("domain2"),
    )
    dip = (F.col("linker") < 60) & (F.col("domain1") > 80) & (F.col("domain2") > 80)
    return spans.select("structure").join(means.withColumn("dip", dip), "structure", "left")


def chains(residues: DataFrame) -> DataFrame:
    """structure, atoms: the residues of each structure as one array in order of pos, from 0. residues: structure, pos, x, y, z, b.

    A structure is one molecule, so its array is bounded by nature. All measures below look into
    the array of their own row and shuffle nothing.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.struct(*[F.col(c).cast("double").alias(c) for c in "xyzb"]).alias("a"))))
    return residues.groupBy("structure").agg(F.transform(ordered, lambda r: r["a"]).alias("atoms"))


def distance_in(atoms: Column, spans: Column) -> Column:
    """Distance between the last residues (H) of the first two motifs; null if there are fewer or a residue is missing."""
    at = lambda i: F.get(atoms, F.get(spans, F.lit(i))["end"] - 1)
    return F.sqrt(sum((F.pow(at(0)[k] - at(1)[k], 2) for k in "yz"), F.pow(at(0)["x"] - at(1)["x"], 2)))


def mean_in(atoms: Column, lo: Column, hi: Column) -> Column:
    """Mean of b over the positions from lo to before hi, to two places; null if there is none."""
    lo = F.greatest(lo, F.lit(0))
    part = F.filter(F.slice(atoms, lo + 1, F.greatest(hi - lo, F.lit(0))), lambda a: a["b"].isNotNull())
    return let(part, lambda p: F.when(F.size(p) > 0, F.round(F.aggregate(p, F.lit(0.0), lambda s, a: s + a["b"]) / F.size(p), 2)))


def means_in(atoms: Column, spans: Column) -> Column:
    """linker, domain1, domain2 and dip as window_means has them, from the arrays of a row; null without two motifs."""
    s1, s2 = F.get(spans, F.lit(0)), F.get(spans, F.lit(1))
    means = F.struct(
        mean_in(atoms, s1["end"], s2["start"]).alias("linker"), mean_in(atoms, s1["start"] - PAD, s1["end"] + PAD).alias("domain1"), mean_in(atoms, s2["start"] - PAD, s2["end"] + PAD).alias("domain2")
    )
    dip = lambda m: F.struct(m["linker"].alias("linker"), m["domain1"].alias("domain1"), m["domain2"].alias("domain2"), ((m["linker"] < 60) & (m["domain1"] > 80) & (m["domain2"] > 80)).alias("dip"))
    return F.when(F.size(spans) >= 2, let(means, dip))


def best_scores(scores: DataFrame) -> DataFrame:
    """structure, best, best_ref, n_refs of scores (structure, ref, tm): null scores are left out, best is at least 0; the first name wins ties."""
    s = scores.where("tm is not null").groupBy("structure").agg(F.max("tm").alias("m"), F.min_by("ref", F.struct(-F.col("tm"), "ref")).alias("best_ref"), F.count("*").alias("n_refs"))
    all_ = scores.select("structure").distinct().join(s, "structure", "left")
    return all_.select("structure", F.round(F.greatest(F.coalesce("m", F.lit(0.0)), F.lit(0.0)), 4).alias("best"), "best_ref", F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


def functional_rank(checks: list[Column], tie: Column) -> Column:
    """Orderable pair of the number of checks that hold and a tie breaker; a null check does not hold."""
    n = sum((F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0) for c in checks), F.lit(0))
    return F.struct(n.cast("int").alias("n_passed"), tie.alias("tie"))

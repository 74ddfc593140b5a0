"""Targets matched with enzymes by the places where a guide can cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import dna, texts
from seqloom.operators.specificity import top_per_group

#: Shortest junction that is used as given.
LEAST_JUNCTION = 30
#: Targets of one screening run at most.
MAX_TARGETS = 1000


def junctions(targets: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Adds junction and junction_source: the target's own column, else a row of given, else imputed from the name.

    targets: fusion and maybe own_junction; given: fusion, junction (a fusion given twice counts
    with the first text in order). A text under 30 nucleotides counts as none.
    """
    valid = lambda c: F.when(F.length(dna.normalised(c)) >= LEAST_JUNCTION, dna.normalised(c))
    own = valid("own_junction") if "own_junction" in targets.columns else F.lit(None).cast("string")
    rows = targets.withColumn("_own", own)
    if given is None:
        rows = rows.withColumn("_given", F.lit(None).cast("string"))
    else:
        rows = rows.join(given.groupBy("fusion").agg(F.min(valid("junction")).alias("_given")), "fusion", "left")
    return rows.select(
        *targets.columns,
        F.coalesce("_own", "_given", dna.imputed_junction("fusion")).alias("junction"),
        F.when(F.col("_own").isNotNull(), "provided").when(F.col("_given").isNotNull(), "fasta").otherwise("imputed").alias("junction_source"),
    )


def top_targets(targets: DataFrame, n: int, *order) -> DataFrame:
    """The first n targets in the given order: the list of a screening run, n rows at most."""
    return targets.orderBy(*order).limit(n)


def with_disease(targets: DataFrame, disease_map: DataFrame | None = None) -> DataFrame:
    """Adds disease: the target's own primary_disease, even a null one, if there is such a column; else that of the map; else Unknown.

    disease_map: fusion, diseases, a row per fusion.
    """
    if "primary_disease" in targets.columns:
        return targets.withColumn("disease", F.col("primary_disease"))
    if disease_map is None:
        return targets.withColumn("disease", F.lit("Unknown"))
    return targets.join(disease_map.select("fusion", F.col("diseases").alias("_d")), "fusion", "left").withColumn("disease", F.coalesce("_d", F.lit("Unknown"))).drop("_d")


def first_of_list(targets: DataFrame, group: str, n: int, order: str) -> DataFrame:
    """The first n distinct fusions of each list in its own order, with their place: group, fusion, rank."""
    once = targets.where("fusion is not null").groupBy(group, "fusion").agg(F.min(order).alias("_o"))
    return top_per_group(once, group, n, F.asc("_o"), F.asc("fusion")).select(group, "fusion", "rank")


def first_candidates(leads: DataFrame, disease: str, n: int | None, order: str) -> DataFrame:
    """Leads with a named disease, in the given order, the first n of them if a cap is set."""
    rows = leads.where(texts.valid_disease(disease)).orderBy(order)
    return rows if n is None else rows.limit(n)


def match(targets: DataFrame, enzymes: DataFrame) -> DataFrame:
    """Each target that can be cut with each enzyme.

    targets: fusion, disease, patients, junction, junction_source, the list of one screening run
    (see top_targets), sent to all enzymes and refused beyond MAX_TARGETS; enzymes: enzyme. The
    count of cut sites depends on the target alone and is made before the join. A null disease
    stays null.
    """
    if targets.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets in a run; take the first of them with top_targets")
    scored = targets.withColumn("valid_cut_sites", dna.cut_sites("junction")).where("valid_cut_sites > 0").withColumn("junction_preview", texts.preview("junction"))
    return enzymes.select("enzyme").crossJoin(F.broadcast(scored)).select("fusion", "disease", "patients", "enzyme", "valid_cut_sites", "junction_preview", "junction_source")


def lead_order() -> list:
    return [F.asc_nulls_last("disease"), F.desc("valid_cut_sites"), F.asc("fusion"), F.asc("enzyme")]

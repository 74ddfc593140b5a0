"""Variants of a sequence: seeded substitutions outside protected places, and which variants to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import protein

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
LEAST = 300


def mutants(rows: DataFrame, n: int = 5, sites: int = 3, seed: int = 0) -> DataFrame:
    """rec, mutant_no, mutant, description (0-based `12AV_40GL`): up to n distinct mutants of each sequence.

    rows: rec, seq. Places and residues come from hashes of the seed, the record, the mutant and the
    site, so a run repeats exactly and needs no random state. Places within 5 of a motif and
    letters outside the twenty stay. Sequences under 300 letters are skipped; a sequence with
    too few free places gives fewer substitutions.
    """
    spans = protein.motif_spans("seq")
    ready = rows.where(f"length(seq) >= {LEAST}").withColumn("_p", protein.protected(spans, F.length("seq")))
    each = ready.withColumn("mutant_no", F.explode(F.sequence(F.lit(0), F.lit(2 * n - 1))))
    tries = F.transform(F.sequence(F.lit(0), F.lit(4 * sites - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), "rec", "mutant_no", i), F.length("seq").cast("long")).cast("int"))
    free = each.withColumn("_at", tries).withColumn("_at", F.expr(f"array_sort(slice(array_distinct(filter(array_except(_at, _p), i -> instr('{ALPHABET}', substr(seq, i + 1, 1)) > 0)), 1, {sites}))"))
    # Not the wild residue: the alphabet without it has 19 letters.
    swap = F.expr(f"transform(_at, i -> named_struct('i', i, 'w', substr(seq, i + 1, 1), 'm', substr(replace('{ALPHABET}', substr(seq, i + 1, 1), ''), cast(pmod(xxhash64({seed}, rec, mutant_no, i, 'to'), 19) as int) + 1, 1)))")
    made = free.where("size(_at) > 0").withColumn("_s", swap)
    mutant = F.aggregate("_s", F.col("seq"), lambda s, x: F.overlay(s, x["m"], x["i"] + 1, F.lit(1)))
    done = made.select("rec", "mutant_no", mutant.alias("mutant"), F.array_join(F.transform("_s", lambda x: F.concat(x["i"].cast("string"), x["w"], x["m"])), "_").alias("description"))
    once = done.groupBy("rec", "mutant").agg(F.min(F.struct("mutant_no", "description")).alias("x")).select("rec", "x.*", "mutant")
    kept = once.groupBy("rec").agg(F.slice(F.array_sort(F.collect_list(F.struct("mutant_no", "description", "mutant"))), 1, n).alias("ms"))
    return kept.select("rec", F.explode("ms").alias("m")).select("rec", "m.mutant_no", "m.mutant", "m.description")


def kept_variants(variants: DataFrame, parents: DataFrame, least_score: float = 0.5, most_identity: float = 0.85) -> DataFrame:
    """id, kind: variants that score enough and are novel; for a parent none of whose variants is kept, the parent if it is novel itself.

    variants: id, parent, score, identity; parents: id, identity. Nulls do not pass.
    """
    good = variants.where((F.col("score") >= least_score) & (F.col("identity") < most_identity))
    alone = parents.join(good.select(F.col("parent").alias("id")).distinct(), "id", "left_anti").where(F.col("identity") < most_identity)
    return good.select("id", F.lit("variant").alias("kind")).unionByName(alone.select("id", F.lit("parent").alias("kind")))


def variant_name(parent: Column, description: Column, identity: Column, score: Column) -> Column:
    return F.format_string("%s_mut_%s_id%.2f_esm%.3f", parent, description, identity, score)

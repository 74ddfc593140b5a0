"""References to records that do not exist, from signed counts per key.

Every target row is one delta of +1 to its key's existence when it comes into force and one of
-1 when it leaves; every reference is a delta of +1 to the key's reference count. The counts
are summed per key and day before anything else, and along the days of a key. The changes of a
key within one day become a short list of steps, which a plain join brings to the references of
that day: no reference is sorted or gathered, however many share a key and a day, and a join with
a hot key is one that the adaptive planner splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.runtime import key_of

FAR_PAST = "0001-01-01 00:00:00"


def target_deltas(targets: DataFrame, key: str, begins: str, ends: str, ref_field: str) -> DataFrame:
    """ref_field, k, t, alive (+1/-1), began (1/0). A row that ends no later than it begins never is in force but did begin.

    A row without a begin never comes into force; it counts as one that begins after everything.
    """
    rows = targets.select(key_of(key).alias("k"), F.col(begins).alias("b"), F.col(ends).alias("e")).where("k is not null")
    lasts = F.col("e").isNull() | (F.col("e") > F.col("b"))
    deltas = F.array(
        F.struct(F.col("b").alias("t"), F.when(lasts & F.col("b").isNotNull(), 1).otherwise(0).alias("alive"), F.when(F.col("b").isNotNull(), 1).otherwise(0).alias("began")),
        F.struct(F.col("e").alias("t"), F.when(lasts & F.col("b").isNotNull() & F.col("e").isNotNull(), -1).otherwise(0).alias("alive"), F.lit(0).alias("began")),
    )
    return (
        rows.select("k", F.explode(deltas).alias("d"))
        .where("d.began = 1 or d.alive <> 0 or d.t is null")
        .groupBy("k", F.col("d.t").alias("t"))
        .agg(F.sum("d.alive").alias("alive"), F.sum("d.began").alias("began"))
        .select(F.lit(ref_field).alias("ref_field"), "k", "t", "alive", "began")
    )


def references(refs: DataFrame, key: str, at: str, row_id: str, ref_field: str) -> DataFrame:
    """ref_field, k, t, row_id; null and blank keys are no references."""
    return refs.select(F.lit(ref_field).alias("ref_field"), key_of(key).alias("k"), F.col(at).alias("t"), F.col(row_id).alias("row_id")).where("k is not null")


def orphans(deltas: DataFrame, refs: DataFrame) -> DataFrame:
    """ref_field, k, t, row_id, orphan_kind of each reference whose key has no target in force at its time.

    missing: the key has no target at all; deleted: one began by then; late: all begin after.
    A reference without a time sees only what has no begin: it is missing, or else late.
    Repeated rows each count; empty inputs give an empty result.
    """
    nil = F.to_timestamp(F.lit(FAR_PAST))
    own = ["ref_field", "k", "day"]
    at = F.coalesce("t", nil)
    nothing = F.lit(0).cast("long")

    # Counts per key and day. Changes of one instant are one step already, so a day's steps are as many as its instants of change.
    step = F.struct(at.alias("t"), "alive", "began")
    changed = deltas.withColumn("day", F.date_trunc("day", at)).groupBy(*own).agg(
        F.sum("alive").alias("alive"), F.sum("began").alias("began"), F.count("*").alias("targets"), nothing.alias("refs"), F.array_sort(F.collect_list(step)).alias("steps")
    )
    uses = refs.withColumn("day", F.date_trunc("day", at))
    used = uses.groupBy(*own).agg(nothing.alias("alive"), nothing.alias("began"), nothing.alias("targets"), F.count("*").alias("refs"), F.lit(None).cast(changed.schema["steps"].dataType).alias("steps"))
    sums = [F.sum(c).alias(c) for c in ("alive", "began", "targets", "refs")]
    days = changed.unionByName(used).groupBy(*own).agg(*sums, F.first("steps", ignorenulls=True).alias("steps"))
    per_key = Window.partitionBy("ref_field", "k")
    before = per_key.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opening = days.select(
        *own, "refs", "steps", F.coalesce(F.sum("alive").over(before), nothing).alias("alive0"), F.coalesce(F.sum("began").over(before), nothing).alias("began0"), F.sum("targets").over(per_key).alias("all_targets")
    ).where("refs > 0 and (steps is not null or alive0 <= 0)")

    # Target changes of the same instant come first.
    upto = F.filter("steps", lambda x: x["t"] <= at)
    after = lambda c: F.col(f"{c}0") + F.coalesce(F.aggregate(upto, nothing, lambda n, x: n + x[c]), nothing)
    held = uses.join(opening.drop("refs"), own).withColumn("alive1", after("alive")).where("alive1 <= 0")
    kind = F.when(F.col("all_targets") == 0, "missing").when(after("began") > 0, "deleted").otherwise("late")
    return held.select("ref_field", "k", "t", "row_id", kind.alias("orphan_kind"))


def report(found: DataFrame) -> DataFrame:
    """Orphans per reference field, month and kind; the month of a reference without a time is null."""
    return found.groupBy("ref_field", F.date_format("t", "yyyy-MM").alias("month"), "orphan_kind").agg(F.count("*").alias("n_refs"), F.countDistinct("k").alias("n_keys"))


def current(deltas: DataFrame, refs: DataFrame) -> DataFrame:
    """Keys with a positive reference count and no existence once all deltas are in: ref_field, k, n_refs, n_targets_seen."""
    moves = deltas.select("ref_field", "k", "alive", "began", F.lit(0).alias("refs"))
    uses = refs.select("ref_field", "k", F.lit(0).cast("long").alias("alive"), F.lit(0).cast("long").alias("began"), F.lit(1).alias("refs"))
    sums = moves.unionByName(uses).groupBy("ref_field", "k").agg(F.sum("alive").alias("alive"), F.sum("began").alias("n_targets_seen"), F.sum("refs").alias("n_refs"))
    return sums.where("n_refs > 0 and alive <= 0").select("ref_field", "k", "n_refs", "n_targets_seen")

"""State and order of a mining history: first arrivals, overlaps of pages, streaks, sets of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 10_000
#: Blocks folded into one at each of LEVELS levels: enough for BLOCK * FAN ** LEVELS rows of a group, and never more than FAN in one row.
FAN, LEVELS = 1000, 4


def unseen(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key is not known; a null key is never known."""
    return rows.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti").select(*rows.columns)


def first_arrivals(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, first_at, n: where each key first came, and how often; nulls left out."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_at"), F.count("*").alias("n"))


def page_overlap(rows: DataFrame, key: str, order: str, page: int) -> DataFrame:
    """page, n_ids, n_again, ratio: the part of a page's ids that were on the page before."""
    on = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.floor(F.col(order) / page).alias("page")).distinct()
    before = on.select("k", (F.col("page") + 1).alias("page"), F.lit(1).alias("again"))
    return on.join(before, ["k", "page"], "left").groupBy("page").agg(F.count("*").alias("n_ids"), F.count("again").alias("n_again")).withColumn("ratio", F.col("n_again") / F.col("n_ids"))


def longest_streaks(rows: DataFrame, group: str, order: str, holds: Column) -> DataFrame:
    """group, n, longest: the longest run of rows in a row for which holds is true (null: false).

    Streaks are found within blocks of the order, each with its leading, trailing and longest
    run, and the blocks of a group are then folded in order, in levels: no group is sorted in one
    task and no row holds more than FAN blocks.
    """
    flagged = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(holds, F.lit(False)).alias("x"), F.floor(F.col(order) / BLOCK).alias("b"))
    within = Window.partitionBy("g", "b").orderBy("o")
    island = flagged.withColumn("i", F.sum(F.when(F.col("x"), 0).otherwise(1)).over(within))
    runs = island.groupBy("g", "b", "i").agg(F.count_if("x").alias("run"), F.count("*").alias("n"), F.max("o").alias("last"))
    blocks = runs.groupBy("g", "b").agg(
        F.sum("n").alias("n"), F.max("run").alias("best"), F.coalesce(F.max(F.when(F.col("i") == 0, F.col("run"))), F.lit(0)).alias("lead"),
        F.max_by("run", "i").alias("tail"), (F.count_if(F.col("i") > 0) == 0).alias("whole"),
    )
    zero, yes = F.lit(0).cast("long"), F.lit(True)
    parts = ("best", "lead", "tail", "whole", "n")
    nothing = F.struct(zero.alias("best"), zero.alias("lead"), zero.alias("tail"), yes.alias("whole"), zero.alias("n"))

    def fold(s: Column, x: Column) -> Column:
        """Two neighbouring stretches as one; whole: all of it is one run."""
        return F.struct(
            F.greatest(s["best"], x["best"], s["tail"] + x["lead"]).alias("best"), F.when(s["whole"], s["n"] + x["lead"]).otherwise(s["lead"]).alias("lead"),
            F.when(x["whole"], s["tail"] + x["n"]).otherwise(x["tail"]).alias("tail"), (s["whole"] & x["whole"]).alias("whole"), (s["n"] + x["n"]).alias("n"),
        )

    for level in range(LEVELS):
        ordered = F.array_sort(F.collect_list(F.struct("b", *parts)))
        up = F.floor(F.col("b") / FAN) if level < LEVELS - 1 else F.lit(0)
        blocks = blocks.groupBy("g", up.alias("_up")).agg(F.aggregate(ordered, nothing, fold).alias("x")).select("g", F.col("_up").alias("b"), *[F.col(f"x.{c}").alias(c) for c in parts])
    return blocks.select(F.col("g").alias(group), "n", F.col("best").alias("longest"))


def memberships(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """key and one boolean column for each set: union, intersection and difference of ids in one pass."""
    every = None
    for name, df in sets.items():
        one = df.select(F.col(key).alias("k"), F.lit(name).alias("s")).where("k is not null")
        every = one if every is None else every.unionByName(one)
    return every.groupBy("k").agg(*[F.bool_or(F.col("s") == n).alias(n) for n in sets]).withColumnRenamed("k", key)

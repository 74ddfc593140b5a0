"""Specificity of fusions over diseases, from wide or long matrices of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpivoted(matrix: DataFrame, label: str, row_ord: str | None = None, skip: str = "Unnamed") -> DataFrame:
    """Long form of a wide matrix: label, (row_ord,) fusion, col_ord, n. Cells that are no number are dropped."""
    keep = [label] + ([row_ord] if row_ord else [])
    cols = [c for c in matrix.columns if c not in keep and not c.startswith(skip)]
    quoted = [F.col(f"`{c}`").cast("string").alias(c) for c in cols]
    long_ = matrix.select(*keep, *quoted).unpivot(keep, [F.col(f"`{c}`") for c in cols], "fusion", "raw")
    at = F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (c, i)]) if cols else F.lit(None)
    return long_.withColumn("n", F.expr("try_cast(raw as double)")).where("n is not null").select(*keep, "fusion", F.element_at(at, F.col("fusion")).alias("col_ord"), "n")


def specificity(long_: DataFrame, max_tissues: int = 3, drop_null_cancer: bool = False) -> DataFrame:
    """fusion, primary_disease, tissue_types_count, total_patients, specificity_score of the specific fusions.

    long_: fusion, cancer, n, and row_ord for ties. The primary disease is the first cancer with
    the most patients; a total row with a null label counts as a cancer unless dropped. A fusion
    without positive counts is left out; an empty matrix gives an empty table.
    """
    rows = long_.where("n > 0")
    if drop_null_cancer:
        rows = rows.where("cancer is not null")
    order = F.struct("n", -F.col("row_ord"))
    out = rows.groupBy("fusion").agg(
        F.max_by(F.struct("cancer"), order)["cancer"].alias("primary_disease"), F.count("*").alias("tissue_types_count"), F.sum("n").alias("total_patients")
    )
    return out.where(F.col("tissue_types_count").between(1, max_tissues)).withColumn("specificity_score", 1 / F.col("tissue_types_count"))


def ranked(df: DataFrame, *ties: str | Column) -> DataFrame:
    """Highest score first, then most patients, then the given ties."""
    return df.orderBy(F.desc("specificity_score"), F.desc("total_patients"), *ties)


def disease_map(long_: DataFrame) -> DataFrame:
    """fusion, diseases: its cancers with a positive count in row order, joined by ', '. Null labels are left out."""
    rows = long_.where("n > 0 and cancer is not null")
    # Sums first: one row per fusion and cancer, so the list is as long as there are cancers.
    once = rows.groupBy("fusion", "cancer").agg(F.min("row_ord").alias("row_ord"))
    return once.groupBy("fusion").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "cancer"))), lambda x: x["cancer"])).alias("diseases"))


def known_cancers(long_: DataFrame, codes: DataFrame) -> DataFrame:
    """fusion, cancers: sorted distinct known codes (code, upper case) with a positive count."""
    rows = long_.where("n > 0").withColumn("code", F.upper(F.trim("cancer")))
    return rows.join(codes.select("code").distinct(), "code").groupBy("fusion").agg(F.array_sort(F.collect_set("code")).alias("cancers"))


def top_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; only the leading rows of each partition are shuffled."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)

"""Expression of genes in normal and cancer samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.protein import col


def mentions(text: str | Column, words: list[str]) -> Column:
    """Holds any of the words, case ignored; a null text holds none."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | t.contains(w.lower())
    return out


def context(text: str | Column, normal: list[str], cancer: list[str]) -> Column:
    """normal, cancer or unknown; a label of both counts as normal."""
    return F.when(mentions(text, normal), "normal").when(mentions(text, cancer), "cancer").otherwise("unknown")


def context_stats(samples: DataFrame) -> DataFrame:
    """Per gene: mean, most and number of values of normal and of cancer samples; 0 where there are none.

    samples: gene, context, value. NaN counts as no value.
    """
    v = F.when(~F.isnan("value"), F.col("value"))
    aggs = []
    for c in ("normal", "cancer"):
        own = F.when(F.col("context") == c, v)
        aggs += [F.coalesce(F.avg(own), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.max(own), F.lit(0.0)).alias(f"{c}_max"), F.count(own).alias(f"{c}_n")]
    return samples.groupBy("gene").agg(*aggs)


def tissue_mean(samples: DataFrame) -> DataFrame:
    """Per gene: the mean over tissues of the mean in each. samples: gene, tissue, value."""
    return samples.groupBy("gene", "tissue").agg(F.avg("value").alias("m")).groupBy("gene").agg(F.avg("m").alias("mean_of_means"), F.count("*").alias("n_tissues"))


def label_counts(samples: DataFrame, normal: list[str], cancer: list[str], top: int | None = None) -> DataFrame:
    """label, n, context of the trimmed labels, most frequent first; top: a report of so many."""
    out = samples.groupBy(F.trim("tissue").alias("label")).agg(F.count("*").alias("n")).withColumn("context", context("label", normal, cancer))
    out = out.orderBy(F.desc("n"), "label")
    return out.limit(top) if top else out


def first_failure(checks: DataFrame) -> DataFrame:
    """item, ok, reason: the reason of the first check that fails, by order. checks: item, ord, ok, reason; a null ok fails."""
    bad = ~F.coalesce("ok", F.lit(False))
    return checks.groupBy("item").agg((~F.bool_or(bad)).alias("ok"), F.min_by(F.when(bad, F.col("reason")), F.when(bad, F.col("ord"))).alias("reason"))


def tissue_risks(samples: DataFrame, members: DataFrame, organs: list[str], most: float = 100.0, cost: int = 25) -> DataFrame:
    """item, n_risks, score, risks (sorted): organs in which a gene of the item is expressed above `most`, 100 less `cost` for each, 0 at least.

    samples: gene, tissue, value; members: item, gene. The expression of a gene in an organ is the
    mean over the tissues whose label holds the organ's name, case ignored, of the mean in each.
    """
    means = samples.groupBy("gene", "tissue").agg(F.avg("value").alias("m"))
    organ = F.explode(F.filter(F.array(*[F.lit(o) for o in organs]), lambda o: F.contains(F.lower("tissue"), F.lower(o))))
    high = means.select("gene", "m", organ.alias("organ")).groupBy("gene", "organ").agg(F.avg("m").alias("m")).where(F.col("m") > most)
    found = members.distinct().join(high, "gene").groupBy("item").agg(F.count("*").alias("n_risks"), F.array_sort(F.collect_list(F.concat(F.col("gene").cast("string"), F.lit(" in "), "organ"))).alias("risks"))
    n = F.coalesce("n_risks", F.lit(0))
    return members.select("item").distinct().join(found, "item", "left").select("item", n.alias("n_risks"), F.greatest(F.lit(0), 100 - cost * n).alias("score"), F.coalesce("risks", F.array().cast("array<string>")).alias("risks"))


def fusion_checks(genes: DataFrame, normal_most: float = 1.0, cancer_least: float = 1.0, factor: float = 2.0) -> DataFrame:
    """item, ord, ok, reason of each gene of a fusion: low in normal, present in cancer; for first_failure.

    genes: item, ord, gene, by_organ, and the statistics of context_stats, taken from the organs of
    the fusion's cancers where by_organ holds. With samples of both kinds there, enrichment counts
    instead of absence; with none of either the strict rule does.
    """
    has_normal, has_cancer = F.col("normal_n") > 0, F.col("cancer_n") > 0
    low = F.col("cancer_mean") < cancer_least
    by_organ = F.col("by_organ") & (has_normal | has_cancer)
    reason = (
        F.when(by_organ & has_normal & has_cancer, F.when(low, "cancer mean too low in organ").when((F.col("cancer_mean") < factor * F.col("normal_mean")) & (F.col("normal_mean") > 0), "not enriched in organ"))
        .when(by_organ & has_cancer, F.when(low, "cancer mean too low in organ, no normal"))
        .when(by_organ, F.lit("no cancer samples in organ"))
        .when(~has_normal, F.lit("no normal-tissue data"))
        .when(F.col("normal_max") > normal_most, F.lit("expressed in normal"))
        .when(has_cancer & low, F.lit("not expressed in cancer"))
    )
    return genes.select("item", "ord", reason.isNull().alias("ok"), F.concat_ws(": ", F.col("gene").cast("string"), reason).alias("reason"))

"""Joins and fallbacks between the record sets of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import texts
from seqloom.operators.specificity import top_per_group
from seqloom.runtime import cut, small_or_none

#: Endings that a search term loses, in this order, once each. Fixed values.
QUERY_SUFFIXES = [" wgs[Prop]", " wgs[prop]", "[Prop]", "[prop]", "[Title]", "[title]", "[All Fields]"]


def with_parents(records: DataFrame, parents: DataFrame) -> DataFrame:
    """records first, then the parents whose id is not among them. Both: id, seq."""
    return records.select("id", "seq").unionByName(parents.select("id", "seq").join(records.select("id").distinct(), "id", "left_anti"))


def by_id_or_place(results: DataFrame, records: DataFrame) -> DataFrame:
    """rid, id of results matched to records by id; if no id matches and both are equally many, by their places in order of id.

    results: rid; records: id. The places come from range-partitioned numbering, see numbered_in_order.
    """
    by_id = results.join(records, F.col("rid") == F.col("id")).select("rid", "id")
    if by_id.limit(1).count() or results.count() != records.count():
        return by_id
    a, b = numbered_in_order(results.select("rid"), "rid"), numbered_in_order(records.select("id"), "id")
    return a.join(b, "place").select("rid", "id")


def numbered_in_order(rows: DataFrame, by: str) -> DataFrame:
    """Adds place, from 0, in order of a column, by counts per range partition."""
    spark = rows.sparkSession
    part = rows.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    part = cut(part)
    # One row per partition: as many as the session's shuffle has parts.
    counts = sorted((r["_p"], r["n"], r["i0"]) for r in part.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("i0")).collect())
    before, starts = 0, []
    for p, n, i0 in counts:
        starts.append((p, before - i0))
        before += n
    offsets = spark.createDataFrame(starts, "_p int, _o long")
    return part.join(F.broadcast(offsets), "_p").withColumn("place", F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")


def first_readable_json(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of several JSON files that has any row; an empty table if none has."""
    for p in paths:
        try:
            df = spark.read.schema(schema).json(p, multiLine=True)
            if df.limit(1).count():
                return df
        except Exception:  # noqa: S112 - a file that is not there is passed over
            continue
    return spark.createDataFrame([], schema)


def reference_labels(structures: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds label: lower case of subtype and id joined by _, the id alone for one outside the catalog. structures: pdb_id; catalog: pdb_id, subtype."""
    return structures.join(catalog.groupBy("pdb_id").agg(F.min("subtype").alias("subtype")), "pdb_id", "left").withColumn("label", F.lower(F.concat_ws("_", "subtype", "pdb_id"))).drop("subtype")


def chosen_ids(reply: str | Column, least: int = 3, cap: int = 15) -> Column:
    """Ids named in a free text: those of its JSON list, or all runs of digits if there is no list; at most cap. Fewer than least: null, for the caller's fallback."""
    block = texts.json_block(reply)
    listed = F.from_json(block, "array<string>")
    digits = F.regexp_extract_all(reply if isinstance(reply, Column) else F.col(reply), F.lit(r"(\d+)"), F.lit(1))
    ids = F.slice(F.array_distinct(F.coalesce(listed, digits)), 1, cap)
    return F.when(F.size(ids) >= least, ids)


def structure_passes(best: Column, n_motifs: Column, least: float = 0.25) -> Column:
    """Good enough a fold and two or three motifs; nulls do not pass."""
    return F.coalesce((best >= least) & n_motifs.between(2, 3), F.lit(False))


def best_domains(scores: DataFrame) -> DataFrame:
    """structure, domain1, domain2: the best score of each domain over all references, each on its own. scores: structure, tm1, tm2."""
    return scores.groupBy("structure").agg(F.max("tm1").alias("domain1"), F.max("tm2").alias("domain2"))


def organ_words(fusions: DataFrame, words: DataFrame) -> DataFrame:
    """fusion, words: sorted distinct keywords of all its cancer codes. fusions: fusion, code; words: code, word."""
    return fusions.join(words, "code").groupBy("fusion").agg(F.array_sort(F.collect_set("word")).alias("words"))


def capped_per_group(links: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """At most cap links of each group, by order, each target once: the feature of a paged lookup."""
    return top_per_group(links, group, cap, F.asc(order)).drop("rank").dropDuplicates(["id"])


def spot_check(reads: DataFrame, holds: Column, n: int) -> bool:
    """Whether any of the first n reads holds; true if that cannot be told."""
    try:
        return small_or_none(reads.limit(n).where(holds), 0) is None
    except Exception:
        return True


def to_fold(records: DataFrame, done: DataFrame, longest: int = 0) -> DataFrame:
    """Records without a result yet, shortest first, those over `longest` letters left out if that is set. records: id, seq; done: id."""
    rows = records.join(done.select("id").distinct(), "id", "left_anti")
    return (rows.where(F.length("seq") <= longest) if longest else rows).orderBy(F.length("seq"), "id")

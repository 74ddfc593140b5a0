"""Queries that run as streams, and round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import protein
from seqloom.runtime import key_of, table
from seqloom.sources import files, sinks
from seqloom.streaming import loop


def st_distinct_ids(spark, d):
    visits = loop.stream(spark, f"{d}/visited_ids.parquet").select(key_of("nucleotide_id").alias("k"))
    return loop.distinct_keys(visits, "k", loop.new_folder(spark, "ids"))


def st_new_ids(spark, d):
    visits = loop.stream(spark, f"{d}/visited_ids.parquet", 4).select(key_of("nucleotide_id").alias("k"), "visit_no")
    known = table(spark, d, "visited_before").select(key_of("nucleotide_id").alias("k"))
    return loop.mine(visits, "k", "visit_no", known, loop.new_folder(spark, "mine")).select("k", "visit_no")


def st_tumbling(spark, d):
    return loop.windowed(loop.stream(spark, f"{d}/events.parquet"), "ts", "event_type", "value", "1 hour", "10 minutes", loop.new_folder(spark, "windows")).select("start", "event_type", "n", F.round("total", 2).alias("total"))


def fasta_round_trip(spark, d):
    """Proteins written as FASTA and read again; ids as made of the record's number."""
    folder = loop.new_folder(spark, "fasta")
    rows = table(spark, d, "mined_proteins").select(F.concat(F.lit("r"), F.col("rec_id").cast("string")).alias("id"), protein.letters("seq").alias("seq"))
    sinks.write_fasta(rows, folder, 60)
    return files.fasta(spark, folder).select("id", F.md5("seq").alias("seq_md5"), F.length("seq").alias("n"))


QUERIES = {f.__name__: f for f in (st_distinct_ids, st_new_ids, st_tumbling, fasta_round_trip)}

_K = "nullif(lower(regexp_replace(nucleotide_id, '^\\s+|\\s+$', '', 'g')), '')"
ORACLE = {
    "st_distinct_ids": f"select distinct {_K} as k from visited_ids where {_K} is not null",
    "st_new_ids": f"select k, min(visit_no) as visit_no from (select {_K} as k, visit_no from visited_ids) where k is not null and k not in (select k from (select {_K} as k from visited_before) where k is not null) group by 1",
    "st_tumbling": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2",
    "fasta_round_trip": "select 'r' || rec_id as id, md5(s) as seq_md5, len(s) as n from (select rec_id, regexp_replace(upper(seq), '[^A-Z]', '', 'g') as s from mined_proteins where seq is not null)",
}

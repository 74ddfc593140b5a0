"""Queries of the training-data problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import leakage, mixing, neardup, seen, subjects
from seqloom.runtime import table


def _seen(spark: SparkSession, sf_dir: str, fp_bits: int) -> tuple[seen.SeenKeys, DataFrame]:
    known = table(spark, sf_dir, "visited_before")
    return seen.SeenKeys(table(spark, sf_dir, "visited_ids"), "visit_no", "nucleotide_id", known, "nucleotide_id", fp_bits), known


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir, 30)[0].found().select(F.col("at").alias("visit_no"))


def p1_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At 30 bits, as p1_found answers, and at 8 bits, where wrong answers are frequent enough to be counted."""
    reports = []
    for bits in (30, 8):
        keys, known = _seen(spark, sf_dir, bits)
        reports.append(keys.audit(known, "nucleotide_id").withColumn("fp_bits", F.lit(bits)))
    return reports[0].unionByName(reports[1])


def p1_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of what p1_found answers, in the columns that exact arrivals alone decide: no seen key missed, no unseen one taken for seen."""
    keys, known = _seen(spark, sf_dir, 30)
    return keys.audit(known, "nucleotide_id").select("period", "n_probes", "n_said_seen", "n_truly_seen", "n_false_seen", "n_missed")


def p1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir, 30)[0].sizes()


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mined_proteins").select("rec_id", "seq").unionByName(table(spark, sf_dir, "drift_variants").select("rec_id", "seq"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.NearDuplicates(_sequences(spark, sf_dir)).pairs()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.NearDuplicates(_sequences(spark, sf_dir)).groups()


def p4_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fingerprints that met, and how many the pivot table, the Hamming bound and the exact check dropped."""
    return neardup.NearDuplicates(_sequences(spark, sf_dir)).filters()


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("part = 'question'").select("doc_id", "item_id").distinct()


def p6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents, stretches, the longest one, and in how many documents its answer stands too."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.count_if(F.col("part") != "short answer").alias("n_stretches"),
        F.max("n_words").alias("most_words"), F.countDistinct(F.when(F.col("part") == "short answer", F.col("doc_id"))).alias("n_with_answer"),
    )


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.Mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).usage()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).shares()


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source with a target: whether no document is used too often, and whether its share is within 0.01 of the target among sources with text."""
    shares = _mix(spark, sf_dir).shares().where("target_share is not null").withColumn("wanted", F.when(F.col("source_tokens") > 0, F.col("target_share")).otherwise(0.0))
    total = shares.agg(F.sum("wanted").alias("all_wanted"))
    near = F.abs(F.coalesce("actual_share", F.lit(0.0)) - F.col("wanted") / F.col("all_wanted")) < 0.01
    return shares.join(F.broadcast(total)).select("source", "n_docs", "max_repeats", (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"), near.alias("on_target"))


def p7_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).blocks()


#: The ten subjects of the hand labels.
SUBJECTS = ["cooking", "finance", "gardening", "law", "medicine", "music", "science", "software", "sport", "travel"]


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "subject_labels"), SUBJECTS)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by subject; a document of two subjects counts half for each; null: no subject."""
    found = _subjects(spark, sf_dir).select("doc_id", "subject")
    n = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(found.join(n, "doc_id"), "doc_id", "left")
    part = 1 / F.coalesce("n", F.lit(1))
    return docs.groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum(part).alias("doc_weight"), F.sum(F.coalesce("n_chars", F.lit(0)) * part).alias("char_weight"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_audit, p1_truth, p1_sizes, p4_found, p4_groups, p4_filters, p6_found, p6_spans, p6_items, p7_usage, p7_shares, p7_limits, p7_blocks, p8_found, p8_composition)
}

_KEY = "nullif(lower(regexp_replace(nucleotide_id, '^\\s+|\\s+$', '', 'g')), '')"
_WORDS = "list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w))"

_ALIKE = """with recursive r as (select rec_id, regexp_replace(upper(seq), '[^A-Z]', '', 'g') as s from (select rec_id, seq from mined_proteins union all select rec_id, seq from drift_variants) where seq is not null),
    w as (select distinct rec_id, s[i:i+4] as w from r, lateral (select unnest(range(1, len(s) - 3)) as i) where len(s) >= 5),
    n as (select rec_id, count(*) as n from w group by 1),
    b as (select x.rec_id as a, y.rec_id as b, count(*) as c from w x join w y on x.w = y.w and x.rec_id < y.rec_id group by 1, 2),
    alike as (select a, b from b join n na on na.rec_id = a join n nb on nb.rec_id = b where 2 * c >= na.n + nb.n - c)
    """

# Stretches from all runs of 13 words: runs that overlap or adjoin are one; then every place of short answers beside them; then characters.
_STRETCHES = f"""with q as (select item_id, part, w from (select item_id, 'question' as part, {_WORDS.format("question")} as w from eval_items union all select item_id, 'answer', {_WORDS.format("answer")} from eval_items)),
    d as (select doc_id, {_WORDS.format("text")} as w, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') as raw, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+') as gaps from documents where text <> ''),
    qg as (select distinct item_id, part, array_to_string(w[i:i+12], ' ') as g from q, lateral (select unnest(range(1, len(w) - 11)) as i) where len(w) >= 13),
    dg as (select doc_id, i, array_to_string(w[i:i+12], ' ') as g from d, lateral (select unnest(range(1, len(w) - 11)) as i) where len(w) >= 13),
    m as (select distinct doc_id, item_id, part, i from qg join dg using (g)),
    isle as (select *, sum(case when i - p <= 13 then 0 else 1 end) over (partition by doc_id, item_id, part order by i) as n from (select *, lag(i) over (partition by doc_id, item_id, part order by i) as p from m)),
    runs as (select doc_id, item_id, part, min(i) as a, max(i) + 12 as z from isle group by doc_id, item_id, part, n),
    shorts as (select doc_id, item_id, 'short answer' as part, i as a, i + len(aw) - 1 as z from (select distinct doc_id, item_id from runs) join (select item_id, w as aw from q where part = 'answer' and len(w) between 1 and 12) using (item_id)
        join d using (doc_id), lateral (select unnest(range(1, len(w) - len(aw) + 2)) as i) where w[i:i+len(aw)-1] = aw),
    spans as (select * from runs union all select * from shorts),
    placed as (select s.*, len(array_to_string(list_concat(gaps[1:a], raw[1:a-1]), '')) as start_char, len(array_to_string(list_concat(gaps[1:z], raw[1:z]), '')) as end_char from spans s join d using (doc_id))
    """

ORACLE = {
    "p6_spans": _STRETCHES + "select doc_id, item_id, part, cast(start_char as integer) as start_char, cast(end_char as integer) as end_char, cast(z - a + 1 as integer) as n_words from placed",
    "p6_items": _STRETCHES + """select item_id, count(distinct doc_id) as n_docs, count(*) filter (where part <> 'short answer') as n_stretches, cast(max(z - a + 1) as integer) as most_words,
        count(distinct doc_id) filter (where part = 'short answer') as n_with_answer from placed group by 1""",
    "p1_found": f"""with v as (select visit_no, {_KEY} as k from visited_ids), b as (select distinct {_KEY} as k from visited_before)
        select visit_no from (select visit_no, k, row_number() over (partition by k order by visit_no) as n from v where k is not null) where n > 1 or k in (select k from b where k is not null)""",
    "p1_truth": f"""with v as (select visit_no, {_KEY} as k from visited_ids), b as (select distinct {_KEY} as k from visited_before),
        m as (select min(visit_no) as low, cast(floor(sqrt(count(*))) as bigint) as g, max(visit_no) - min(visit_no) + 1 as width from visited_ids),
        f as (select visit_no, k, (visit_no - low) // ((width + g - 1) // g) as gen, g, min(visit_no) over (partition by k) as first_of_all from v, m where k is not null),
        p as (select gen * 16 // g as period, first_of_all < min(visit_no) or k in (select k from b where k is not null) as truly from f group by gen, g, k, first_of_all)
        select cast(period as integer) as period, count(*) as n_probes, count(*) filter (where truly) as n_said_seen, count(*) filter (where truly) as n_truly_seen, 0 as n_false_seen, 0 as n_missed from p group by 1""",
    "p4_found": _ALIKE + "select a as rec_id_1, b as rec_id_2 from alike",
    "p4_groups": _ALIKE + """, c as (select rec_id, min(rec_id) over (partition by s) as class_id, count(*) over (partition by s) as n_copies from r),
        e as (select distinct x.class_id as a, y.class_id as b from alike p join c x on x.rec_id = p.a join c y on y.rec_id = p.b where x.class_id <> y.class_id),
        both_ways as (select a, b from e union select b, a from e),
        reach as (select class_id as a, class_id as b from c union select reach.a, w.b from reach join both_ways w on w.a = reach.b)
        select rec_id, class_id, n_copies, (select min(b) from reach where reach.a = class_id) as group_id, (select count(*) from both_ways w where w.a = class_id) as n_links from c""",
    "p7_limits": """select t.source, count(d.doc_id) as n_docs, t.max_repeats, true as within_repeats, true as on_target
        from (select lower(trim(source)) as source, min(max_repeats) as max_repeats from mix_targets where target_share is not null and trim(source) <> '' group by 1) t
        left join documents d on lower(trim(d.source)) = t.source group by 1, 3""",
    "p6_found": f"""with q as (select item_id, {_WORDS.format("question")} as w from eval_items), d as (select doc_id, {_WORDS.format("text")} as w from documents),
        qg as (select distinct item_id, array_to_string(w[i:i+12], ' ') as g from q, lateral (select unnest(range(1, len(w) - 11)) as i) where len(w) >= 13),
        dg as (select distinct doc_id, array_to_string(w[i:i+12], ' ') as g from d, lateral (select unnest(range(1, len(w) - 11)) as i) where len(w) >= 13)
        select distinct doc_id, item_id from qg join dg using (g)""",
}

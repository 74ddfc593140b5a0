"""Queries over histories, ids, structures and designs."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import protein, texts
from seqloom.operators import design, history, structure
from seqloom.runtime import key_of, spread, table


def _visits(spark, d):
    return table(spark, d, "visited_ids").select("visit_no", key_of("nucleotide_id").alias("k"), "strategy", "hits", "visited_at")


def _known(spark, d):
    return table(spark, d, "visited_before").select(key_of("nucleotide_id").alias("k"))


def anti_visited(spark, d):
    return history.unseen(_visits(spark, d), "k", _known(spark, d).where("k is not null"), "k").select("visit_no", "k")


def first_arrivals(spark, d):
    return history.first_arrivals(_visits(spark, d), "k", "visit_no")


def page_overlap(spark, d):
    return history.page_overlap(_visits(spark, d), "k", "visit_no", 1000)


def dry_streaks(spark, d):
    """Per strategy the longest run of its visits without a hit."""
    rows = _visits(spark, d).withColumn("strategy", F.coalesce(F.lower("strategy"), F.lit("none")))
    return history.longest_streaks(rows, "strategy", "visit_no", F.col("hits") == 0)


def id_sets(spark, d):
    return history.memberships({"visited": _visits(spark, d), "known": _known(spark, d)}, "k")


def mate_rescue(spark, d):
    """Visits whose id, apart from a version 1 or 2, is known."""
    known = _known(spark, d).where("k is not null").select(texts.read_base("k").alias("base")).distinct()
    return _visits(spark, d).where("k is not null").withColumn("base", texts.read_base("k")).join(known, "base", "left_semi").select("visit_no", "base")


def recent_history(spark, d):
    """The five latest visits."""
    return table(spark, d, "visited_ids").select("visit_no", "nucleotide_id", "hits").orderBy(F.desc("visit_no")).limit(5)


def query_cycle(spark, d):
    """Visits by their place in a round robin of 52 queries, and how often the round began anew."""
    rows = table(spark, d, "visited_ids").select(F.pmod("visit_no", F.lit(52)).alias("idx"), (F.pmod(F.col("visit_no") + 1, F.lit(52)) == 0).alias("wraps"), "hits")
    return rows.groupBy("idx").agg(F.count("*").alias("n"), F.count_if("wraps").alias("n_wraps"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def mining_stats(spark, d):
    return table(spark, d, "visited_ids").groupBy("strategy").agg(F.count("*").alias("n_scanned"), F.count_if(F.col("hits") > 0).alias("n_with_hits"), F.greatest(F.max("hits"), F.lit(0)).alias("best"))


def members_of_family(spark, d):
    """Manifest entries by the family their id names, beside the family they state."""
    rows = table(spark, d, "family_manifest").withColumn("named", texts.parent_of("new_id"))
    return rows.groupBy("named").agg(F.count("*").alias("n"), F.count_if(F.col("named") == F.col("family_id")).alias("n_agree"))


def key_outer_join(spark, d):
    """Every id of proteins, manifest and variants, with the rows of each."""
    one = lambda name, col, n: table(spark, d, name).where(F.col(col).isNotNull()).groupBy(F.trim(col).alias("id")).agg(F.count("*").alias(n))
    out = one("mined_proteins", "sequence_id", "n_proteins").join(one("family_manifest", "original_id", "n_manifest"), "id", "full_outer").join(one("drift_variants", "parent_id", "n_variants"), "id", "full_outer")
    return out.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_proteins", "n_manifest", "n_variants")])


def metadata_join(spark, d):
    """Manifest entries with the accession of their protein (the last record of the id), '' if there is none."""
    meta = table(spark, d, "mined_proteins").where("sequence_id is not null").groupBy(F.trim("sequence_id").alias("id")).agg(F.max_by(F.coalesce("sra_accession", F.lit("")), "rec_id").alias("accession"))
    rows = table(spark, d, "family_manifest").select("manifest_row", F.trim("original_id").alias("id"))
    return rows.join(meta, "id", "left").select("manifest_row", F.coalesce("accession", F.lit("")).alias("accession"))


def json_fields(spark, d):
    """A value out of a JSON object inside a text."""
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("Result: "), "props", F.lit(" (end)")).alias("said"))
    return rows.select("event_id", F.from_json(texts.json_block("said", "{}"), "k int")["k"].alias("k"))


def verdict_counts(spark, d):
    return table(spark, d, "lead_candidates_filtered").groupBy(F.lower(F.trim("ai_verdict")).alias("verdict")).agg(F.count("*").alias("n"), F.count_if(F.col("safety_score") >= 75).alias("n_safe"))


def _structures(spark, d):
    """Mined proteins as structures: an atom per residue, its place and factor made from position and letter, and the motifs."""
    rows = spread(table(spark, d, "mined_proteins").select("rec_id", "seq")).select(F.col("rec_id").alias("structure"), protein.letters("seq").alias("seq")).where("seq is not null")
    letters = F.filter(F.split("seq", ""), lambda c: c != "")

    def atom(c, i):
        return F.struct((i % 50 * 1.5).alias("x"), (F.floor(i / 50) * 3.8).alias("y"), (F.ascii(c) % 7).cast("double").alias("z"), (50 + (F.ascii(c) * i) % 50).cast("double").alias("b"))

    return rows.select("structure", F.transform(letters, atom).alias("atoms"), protein.motif_spans("seq").alias("spans"))


def catalytic_distance(spark, d):
    return _structures(spark, d).select("structure", F.round(structure.distance_in(F.col("atoms"), F.col("spans")), 4).alias("distance"))


def window_means(spark, d):
    return _structures(spark, d).select("structure", structure.means_in(F.col("atoms"), F.col("spans")).alias("m")).select("structure", "m.*")


def functional_scores(spark, d):
    """Structures by the number of checks they pass, the distance of their catalytic residues, and the best score of a variant."""
    both = _structures(spark, d).select("structure", structure.distance_in(F.col("atoms"), F.col("spans")).alias("distance"), structure.means_in(F.col("atoms"), F.col("spans")).alias("m")).select("structure", "distance", "m.*")
    rank = structure.functional_rank([F.col("distance") < 25, F.col("linker") < 75, F.col("domain1") > 70, F.col("domain2") > 70], -F.coalesce("distance", F.lit(1e9)))
    # Equal ranks: the best score of a variant first, then the smallest number.
    best = best_scores(spark, d).select(F.col("structure").alias("id"), "best")
    ids = table(spark, d, "mined_proteins").select(F.col("rec_id").alias("structure"), F.trim("sequence_id").alias("id"))
    ordered = both.withColumn("rank", rank).join(ids, "structure").join(best, "id", "left").orderBy(F.desc("rank"), F.desc(F.coalesce("best", F.lit(0.0))), "structure")
    return ordered.select("structure", "rank.n_passed", F.round(F.col("rank.tie"), 4).alias("tie"))


def best_scores(spark, d):
    """Best score and number of variants of each parent."""
    rows = table(spark, d, "drift_variants").select(F.trim("parent_id").alias("structure"), F.col("variant_id").alias("ref"), F.expr("try_cast(regexp_extract(variant_id, '_esm([0-9.]+)$', 1) as double)").alias("tm"))
    return structure.best_scores(rows.where("structure is not null"))


def seeded_mutants(spark, d):
    rows = spread(table(spark, d, "mined_proteins").select("rec_id", "seq")).select(F.col("rec_id").alias("rec"), protein.letters("seq").alias("seq")).where("seq is not null")
    return design.mutants(rows).select("rec", "mutant_no", "description", F.md5("mutant").alias("mutant_md5"))


def kept_variants(spark, d):
    """Variants whose name gives enough score and little identity, else their parents."""
    part = lambda tag: F.expr(f"try_cast(regexp_extract(variant_id, '_{tag}([0-9.]+)', 1) as double)")
    variants = table(spark, d, "drift_variants").select(F.col("variant_id").alias("id"), F.trim("parent_id").alias("parent"), part("esm").alias("score"), part("id").alias("identity"))
    parents = table(spark, d, "mined_proteins").where("sequence_id is not null").groupBy(F.trim("sequence_id").alias("id")).agg(F.expr("try_cast(max(score) as double)").alias("identity"))
    return design.kept_variants(variants, parents, 0.9, 0.85)


QUERIES = {
    f.__name__: f
    for f in (anti_visited, first_arrivals, page_overlap, dry_streaks, id_sets, mate_rescue, recent_history, query_cycle, mining_stats, members_of_family, key_outer_join, metadata_join, json_fields,
              verdict_counts, catalytic_distance, window_means, functional_scores, best_scores, seeded_mutants, kept_variants)
}

_K = "nullif(lower(regexp_replace(nucleotide_id, '^\\s+|\\s+$', '', 'g')), '')"
_V = f"(select visit_no, {_K} as k, strategy, hits from visited_ids)"
_B = f"(select {_K} as k from visited_before)"
_BASE = "regexp_replace(k, '[./][12]$', '')"
_P = "(select rec_id as structure, regexp_replace(upper(seq), '[^A-Z]', '', 'g') as seq from mined_proteins where seq is not null)"
_RES = f"""(select structure, cast(i - 1 as integer) as pos, (i - 1) % 50 * 1.5 as x, floor((i - 1) / 50) * 3.8 as y, cast(ascii(seq[i]) % 7 as double) as z, cast(50 + (ascii(seq[i]) * (i - 1)) % 50 as double) as b
    from {_P}, lateral (select unnest(range(1, len(seq) + 1)) as i))"""
_ENDS = f"""(select structure, list_transform(ends, lambda e, i: e - len(ms[i])) as starts, ends from (select structure, ms, list_transform(range(1, len(ms) + 1), lambda i: cast(list_sum(list_transform(parts[1:i], lambda p: len(p))) + list_sum(list_transform(ms[1:i], lambda p: len(p))) as integer)) as ends
    from (select *, regexp_extract_all(seq, 'R[^\\n]{{4,6}}H') as ms, string_split(regexp_replace(seq, 'R[^\\n]{{4,6}}H', chr(1), 'g'), chr(1)) as parts from {_P})))"""
_DIST = f"""(select e.structure, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) as distance from {_ENDS} e left join r a on a.structure = e.structure and a.pos = e.ends[1] - 1 left join r b on b.structure = e.structure and b.pos = e.ends[2] - 1)"""
# Rounded half up on the written number.
_TWO = lambda cond: f"cast(round(cast(cast(avg(b) filter (where {cond}) as varchar) as decimal(20, 10)), 2) as double)"
_MEANS = f"""(select e.structure, m.linker, m.domain1, m.domain2, m.linker < 60 and m.domain1 > 80 and m.domain2 > 80 as dip from {_ENDS} e left join (
    select e.structure, {_TWO('pos >= ends[1] and pos < starts[2]')} as linker, {_TWO('pos >= starts[1] - 45 and pos < ends[1] + 45')} as domain1,
    {_TWO('pos >= starts[2] - 45 and pos < ends[2] + 45')} as domain2 from {_ENDS} e join r on r.structure = e.structure where len(ends) >= 2 group by 1) m using (structure))"""
_PASS = "(case when coalesce(distance < 25, false) then 1 else 0 end + case when coalesce(linker < 75, false) then 1 else 0 end + case when coalesce(domain1 > 70, false) then 1 else 0 end + case when coalesce(domain2 > 70, false) then 1 else 0 end)"

ORACLE = {
    "anti_visited": f"select visit_no, k from {_V} v where not exists (select 1 from {_B} b where b.k = v.k)",
    "first_arrivals": f"select k, min(visit_no) as first_at, count(*) as n from {_V} where k is not null group by 1",
    "page_overlap": f"with p as (select distinct k, visit_no // 1000 as page from {_V} where k is not null) select a.page, count(*) as n_ids, count(b.k) as n_again, count(b.k) / count(*) as ratio from p a left join p b on a.k = b.k and b.page = a.page - 1 group by 1",
    "dry_streaks": f"""with f as (select coalesce(lower(strategy), 'none') as strategy, visit_no, coalesce(hits = 0, false) as x from {_V}),
        g as (select *, sum(case when x then 0 else 1 end) over (partition by strategy order by visit_no) as i from f),
        r as (select strategy, i, count(*) filter (where x) as run, count(*) as n from g group by 1, 2) select strategy, sum(n) as n, max(run) as longest from r group by 1""",
    "id_sets": f"select k, bool_or(s = 1) as visited, bool_or(s = 2) as known from (select k, 1 as s from {_V} union all select k, 2 from {_B}) where k is not null group by 1",
    "mate_rescue": f"select visit_no, {_BASE} as base from {_V} where k is not null and {_BASE} in (select {_BASE} from {_B} where k is not null)",
    "recent_history": "select visit_no, nucleotide_id, hits from visited_ids order by visit_no desc limit 5",
    "query_cycle": "select visit_no % 52 as idx, count(*) as n, count(*) filter (where (visit_no + 1) % 52 = 0) as n_wraps, coalesce(sum(hits), 0) as hits from visited_ids group by 1",
    "mining_stats": "select strategy, count(*) as n_scanned, count(*) filter (where hits > 0) as n_with_hits, greatest(max(hits), 0) as best from visited_ids group by 1",
    "members_of_family": "select regexp_replace(new_id, '_[^_]*$', '') as named, count(*) as n, count(*) filter (where regexp_replace(new_id, '_[^_]*$', '') = family_id) as n_agree from family_manifest group by 1",
    "key_outer_join": """select id, count(*) filter (where s = 1) as n_proteins, count(*) filter (where s = 2) as n_manifest, count(*) filter (where s = 3) as n_variants from (select trim(sequence_id) as id, 1 as s from mined_proteins
        union all select trim(original_id), 2 from family_manifest union all select trim(parent_id), 3 from drift_variants) where id is not null group by 1""",
    "metadata_join": "select manifest_row, coalesce(a, '') as accession from family_manifest f left join (select trim(sequence_id) as id, arg_max(coalesce(sra_accession, ''), rec_id) as a from mined_proteins where sequence_id is not null group by 1) p on p.id = trim(f.original_id)",
    "json_fields": "select event_id, cast(json_extract(props, '$.k') as integer) as k from events",
    "verdict_counts": "select lower(trim(ai_verdict)) as verdict, count(*) as n, count(*) filter (where safety_score >= 75) as n_safe from lead_candidates_filtered group by 1",
    "catalytic_distance": f"with r as materialized {_RES} select structure, round(distance, 4) as distance from {_DIST}",
    "window_means": f"with r as materialized {_RES} select structure, linker, domain1, domain2, dip from {_MEANS}",
    "functional_scores": f"with r as materialized {_RES} select structure, {_PASS} as n_passed, round(-coalesce(distance, 1e9), 4) as tie from {_DIST} join {_MEANS} using (structure)",
    "best_scores": """with s as (select trim(parent_id) as structure, variant_id as ref, try_cast(nullif(regexp_extract(variant_id, '_esm([0-9.]+)$', 1), '') as double) as tm from drift_variants where trim(parent_id) is not null),
        b as (select structure, max(tm) as m, arg_min(ref, struct_pack(t := -tm, r := ref)) as best_ref, count(*) as n_refs from s where tm is not null group by 1)
        select structure, round(greatest(coalesce(m, 0), 0), 4) as best, best_ref, coalesce(n_refs, 0) as n_refs from (select distinct structure from s) left join b using (structure)""",
    "kept_variants": """with v as (select variant_id as id, trim(parent_id) as parent, try_cast(nullif(regexp_extract(variant_id, '_esm([0-9.]+)', 1), '') as double) as score, try_cast(nullif(regexp_extract(variant_id, '_id([0-9.]+)', 1), '') as double) as identity from drift_variants),
        g as (select * from v where score >= 0.9 and identity < 0.85),
        p as (select trim(sequence_id) as id, try_cast(max(score) as double) as identity from mined_proteins where sequence_id is not null group by 1)
        select id, 'variant' as kind from g union all select id, 'parent' from p where identity < 0.85 and not exists (select 1 from g where g.parent = p.id)""",
}

"""Queries over fusions, diseases, enzymes and expression."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import dna, texts
from seqloom.operators import expression, matching, specificity
from seqloom.runtime import table


def _patients(spark, d, fusion):
    """fusion, cancer, n: customers by order priority over all lines, for fusions named by the columns of a line."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.concat(*fusion).alias("fusion"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("cancer"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("fusion", "cancer").agg(F.countDistinct("o_custkey").alias("n"))


def _counts(spark, d):
    """A fusion is a part at a place of the order: in few enough orders to miss some priorities."""
    return _patients(spark, d, [F.lit("F"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")]).withColumn("row_ord", F.substring("cancer", 1, 1).cast("int"))


def fusion_specificity(spark, d):
    return specificity.ranked(specificity.specificity(_counts(spark, d)), "fusion")


#: Order priorities. Fixed values of the tables.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _matrix(spark, d):
    """Wide matrix: one row per part, return flag and line status, one column per order priority; empty where nobody ordered."""
    counts = _patients(spark, d, [F.lit("M"), F.col("l_partkey").cast("string"), F.lit("-"), "l_returnflag", "l_linestatus"])
    return counts.groupBy(F.col("fusion").alias("part")).pivot("cancer", PRIORITIES).agg(F.first("n"))


def _unpivoted(spark, d):
    # The columns of this matrix are the cancers, its rows the fusions.
    return specificity.unpivoted(_matrix(spark, d), "part").select(F.col("part").alias("fusion"), F.col("fusion").alias("cancer"), F.col("n").cast("long").alias("n"), (F.col("col_ord") + 1).alias("row_ord"))


def matrix_unpivot(spark, d):
    return _unpivoted(spark, d).select("cancer", "fusion", "n")


def matrix_specificity(spark, d):
    return specificity.specificity(_unpivoted(spark, d))


def disease_map(spark, d):
    return specificity.disease_map(_counts(spark, d))


def known_cancers(spark, d):
    """Codes known from the targets table that a fusion's leads name, by fusion."""
    leads = table(spark, d, "lead_candidates_filtered").select(F.trim("target_fusion").alias("fusion"), F.explode(texts.disease_list("associated_disease")).alias("cancer")).where("fusion <> ''")
    codes = table(spark, d, "high_specificity_targets").select(F.upper(F.trim("primary_disease")).alias("code")).where("code is not null")
    found = specificity.known_cancers(leads.withColumn("n", F.lit(1)), codes)
    return found.select("fusion", F.concat_ws(",", "cancers").alias("cancers"), F.size("cancers").alias("n_cancers"))


def _fusions(spark, d):
    return table(spark, d, "novel_fusions").select(F.col("fusionsss").alias("fusion")).unionByName(table(spark, d, "high_specificity_targets").select(F.col("fusion_name").alias("fusion"))).where("fusion is not null").distinct()


def junction_impute(spark, d):
    return matching.junctions(_fusions(spark, d))


def cut_sites(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey"), dna.imputed_junction(F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).alias("junction"))
    return rows.select("p_partkey", "junction", dna.cut_sites("junction").alias("n_sites"))


def fusion_partners(spark, d):
    return _fusions(spark, d).select("fusion", F.posexplode(texts.fusion_genes("fusion")).alias("place", "gene"))


def _targets(spark, d):
    rows = table(spark, d, "high_specificity_targets").where("fusion_name is not null")
    once = rows.groupBy(F.col("fusion_name").alias("fusion")).agg(
        F.max_by("primary_disease", F.struct("total_patients", "primary_disease")).alias("disease"), F.max("total_patients").alias("patients"), F.max("specificity_score").alias("specificity_score")
    )
    return matching.top_targets(once, 50, F.desc_nulls_last("specificity_score"), F.desc_nulls_last("patients"), F.asc("fusion"))


def leads_ranked(spark, d):
    """The 50 most specific targets with every enzyme of the manifest, in order of disease and cut sites."""
    targets = matching.junctions(_targets(spark, d)).drop("specificity_score")
    enzymes = table(spark, d, "family_manifest").select(F.col("new_id").alias("enzyme")).distinct()
    return matching.match(targets, enzymes).orderBy(*matching.lead_order())


def leads_summary(spark, d):
    """All fusions by number of cut sites."""
    return matching.junctions(_fusions(spark, d)).groupBy(dna.cut_sites("junction").alias("n_sites")).agg(F.count("*").alias("n_fusions"), F.min("fusion").alias("first_fusion"))


#: Stand-ins for sample labels of the two contexts.
NORMAL, CANCER = ["view", "click"], ["purchase", "signup"]


def _samples(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("gene"), F.col("event_type").alias("tissue"), F.col("value"))


def expression_stats(spark, d):
    stats = expression.context_stats(_samples(spark, d).withColumn("context", expression.context("tissue", NORMAL, CANCER)))
    return stats.withColumns({c: F.round(c, 6) for c in ("normal_mean", "cancer_mean")})


def tissue_means(spark, d):
    return expression.tissue_mean(_samples(spark, d)).withColumn("mean_of_means", F.round("mean_of_means", 6))


def tissue_labels(spark, d):
    return expression.label_counts(_samples(spark, d), NORMAL, CANCER)


def first_failures(spark, d):
    """Per gene the first of three checks that fails."""
    stats = expression_stats(spark, d)
    checks = F.array(
        F.struct(F.lit(1).alias("ord"), (F.col("cancer_n") > 0).alias("ok"), F.lit("no cancer samples").alias("reason")),
        F.struct(F.lit(2).alias("ord"), (F.col("normal_mean") < 20).alias("ok"), F.lit("high in normal").alias("reason")),
        F.struct(F.lit(3).alias("ord"), (F.col("cancer_max") > 100).alias("ok"), F.lit("low in cancer").alias("reason")),
    )
    return expression.first_failure(stats.select(F.col("gene").alias("item"), F.explode(checks).alias("c")).select("item", "c.*"))


def valid_diseases(spark, d):
    return table(spark, d, "lead_candidates_filtered").where(texts.valid_disease("associated_disease")).select("lead_id", F.trim("associated_disease").alias("disease"))


def lead_groups(spark, d):
    """Leads by fusion and disease: members, and the first of them as representative."""
    rows = table(spark, d, "lead_candidates_filtered").where(texts.valid_disease("associated_disease"))
    return rows.groupBy("target_fusion", "associated_disease").agg(F.count("*").alias("n_members"), F.min("lead_id").alias("first_lead"), F.min_by("enzyme_variant", "lead_id").alias("first_enzyme"))


def rationale_fanout(spark, d):
    """One text per fusion and disease (that of the first lead), carried to all members."""
    rows = table(spark, d, "lead_candidates_filtered").where(texts.valid_disease("associated_disease"))
    keys = ["target_fusion", "associated_disease"]
    first = rows.groupBy(*[F.coalesce(k, F.lit("")).alias(k) for k in keys]).agg(F.min_by(F.struct(F.coalesce("ai_rationale", F.lit("N/A")).alias("text")), "lead_id")["text"].alias("group_rationale"))
    return rows.select("lead_id", *[F.coalesce(k, F.lit("")).alias(k) for k in keys]).join(first, keys).select("lead_id", "group_rationale")


def distinct_pairs(spark, d):
    return table(spark, d, "lead_candidates_filtered").select("target_fusion", "associated_disease").distinct().orderBy("associated_disease", "target_fusion")


def leads_sorted(spark, d):
    """Leads by disease, nulls last, then most cut sites, then id; with the place in their disease."""
    rows = table(spark, d, "lead_candidates_filtered").select("lead_id", F.col("associated_disease").alias("disease"), "valid_cut_sites")
    return rows.orderBy(F.asc_nulls_last("disease"), F.desc_nulls_last("valid_cut_sites"), "lead_id")


QUERIES = {
    f.__name__: f
    for f in (leads_ranked, fusion_specificity, matrix_unpivot, matrix_specificity, disease_map, known_cancers, junction_impute, cut_sites, fusion_partners, leads_summary,
              expression_stats, tissue_means, tissue_labels, first_failures, valid_diseases, lead_groups, rationale_fanout, distinct_pairs, leads_sorted)
}


def _counts_sql(fusion):
    return f"""(select {fusion} as fusion, o_orderpriority as cancer, count(distinct o_custkey) as n, cast(o_orderpriority[1] as integer) as row_ord
        from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"""


_SPARSE = _counts_sql("'F' || l_partkey || '-' || l_linenumber")
_LONG = _counts_sql("'M' || l_partkey || '-' || l_returnflag || l_linestatus")
_FUSIONS = "(select distinct fusion from (select fusionsss as fusion from novel_fusions union all select fusion_name from high_specificity_targets) where fusion is not null)"


def _junction_sql(name):
    base = lambda i: f"'ACTG'[cast(('0x' || sha256({name})[{2 * i + 1}:{2 * i + 2}]) as integer) % 4 + 1]"
    return "repeat(" + " || ".join(base(i) for i in range(30)) + ", 2)"


_SITES = "len(replace(junction[23:], 'G', ''))"
_VALID = "associated_disease is not null and lower(trim(associated_disease)) not in ('', 'unknown', 'nan')"
_CONTEXT = "case when event_type in ('view', 'click') then 'normal' when event_type in ('purchase', 'signup') then 'cancer' else 'unknown' end"
_STATS = f"""(select user_id as gene, round(coalesce(avg(value) filter (where c = 'normal'), 0), 6) as normal_mean, coalesce(max(value) filter (where c = 'normal'), 0) as normal_max, count(value) filter (where c = 'normal') as normal_n,
    round(coalesce(avg(value) filter (where c = 'cancer'), 0), 6) as cancer_mean, coalesce(max(value) filter (where c = 'cancer'), 0) as cancer_max, count(value) filter (where c = 'cancer') as cancer_n
    from (select *, {_CONTEXT} as c from events) group by 1)"""

ORACLE = {
    "leads_ranked": f"""with t as (select fusion_name as fusion, arg_max(struct_pack(d := primary_disease), struct_pack(p := total_patients, d := primary_disease)).d as disease, max(total_patients) as patients, max(specificity_score) as s
            from (select * from high_specificity_targets where primary_disease is not null and fusion_name is not null) group by 1),
        a as (select fusion_name as fusion, max(total_patients) as patients, max(specificity_score) as s from high_specificity_targets where fusion_name is not null group by 1),
        top as (select a.fusion, t.disease, a.patients, a.s from a left join t using (fusion) order by a.s desc nulls last, a.patients desc nulls last, a.fusion limit 50),
        j as (select *, {_junction_sql("fusion")} as junction from top)
        select fusion, disease, patients, enzyme, {_SITES} as valid_cut_sites, junction[1:15] || '...' as junction_preview, 'imputed' as junction_source
        from j, (select distinct new_id as enzyme from family_manifest) where {_SITES} > 0""",
    "fusion_specificity": f"""select fusion, arg_max(cancer, struct_pack(n := n, o := -row_ord)) as primary_disease, count(*) as tissue_types_count, sum(n) as total_patients, 1 / count(*) as specificity_score
        from {_SPARSE} group by 1 having count(*) <= 3""",
    "matrix_unpivot": f"select cancer, fusion, n from {_LONG}",
    "matrix_specificity": f"""select fusion, arg_max(cancer, struct_pack(n := n, o := -row_ord)) as primary_disease, count(*) as tissue_types_count, sum(n) as total_patients, 1 / count(*) as specificity_score from {_LONG} group by 1 having count(*) <= 3""",
    "disease_map": f"select fusion, string_agg(cancer, ', ' order by row_ord) as diseases from {_SPARSE} group by 1",
    "known_cancers": """with l as (select trim(target_fusion) as fusion, upper(trim(unnest(string_split(translate(associated_disease, ';', ','), ',')))) as code from lead_candidates_filtered where trim(target_fusion) <> '' and lower(trim(associated_disease)) <> 'unknown'),
        k as (select distinct upper(trim(primary_disease)) as code from high_specificity_targets where primary_disease is not null)
        select fusion, string_agg(code, ',' order by code) as cancers, count(*) as n_cancers from (select distinct fusion, code from l join k using (code)) group by 1""",
    "junction_impute": f"select fusion, {_junction_sql('fusion')} as junction, 'imputed' as junction_source from {_FUSIONS}",
    "cut_sites": f"select p_partkey, junction, {_SITES} as n_sites from (select p_partkey, {_junction_sql(chr(39) + 'P' + chr(39) + ' || p_partkey')} as junction from part)",
    "fusion_partners": f"select fusion, i - 1 as place, g[i] as gene from (select fusion, list_filter(string_split(replace(fusion, '--', '-'), '-'), lambda x: len(x) > 2) as g from {_FUSIONS}), lateral (select unnest(range(1, len(g) + 1)) as i)",
    "leads_summary": f"select {_SITES} as n_sites, count(*) as n_fusions, min(fusion) as first_fusion from (select fusion, {_junction_sql('fusion')} as junction from {_FUSIONS}) group by 1",
    "expression_stats": f"select * from {_STATS}",
    "tissue_means": "select gene, round(avg(m), 6) as mean_of_means, count(*) as n_tissues from (select user_id as gene, event_type, avg(value) as m from events group by 1, 2) group by 1",
    "tissue_labels": f"select trim(event_type) as label, count(*) as n, any_value({_CONTEXT}) as context from events group by 1",
    "first_failures": f"""select gene as item, cancer_n > 0 and normal_mean < 20 and cancer_max > 100 as ok,
        case when not cancer_n > 0 then 'no cancer samples' when not normal_mean < 20 then 'high in normal' when not cancer_max > 100 then 'low in cancer' end as reason from {_STATS}""",
    "valid_diseases": f"select lead_id, trim(associated_disease) as disease from lead_candidates_filtered where {_VALID}",
    "lead_groups": f"""select target_fusion, associated_disease, count(*) as n_members, min(lead_id) as first_lead, arg_min(struct_pack(e := enzyme_variant), lead_id).e as first_enzyme from lead_candidates_filtered where {_VALID} group by 1, 2""",
    "rationale_fanout": f"select lead_id, first_value(coalesce(ai_rationale, 'N/A')) over (partition by coalesce(target_fusion, ''), associated_disease order by lead_id) as group_rationale from lead_candidates_filtered where {_VALID}",
    "distinct_pairs": "select distinct target_fusion, associated_disease from lead_candidates_filtered",
    "leads_sorted": "select lead_id, associated_disease as disease, valid_cut_sites from lead_candidates_filtered",
}

"""Queries over record sets, rules of choice, and formats that Spark writes from the tables and reads again."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.config import MiningConfig
from seqloom.functions import protein, texts
from seqloom.operators import expression, matching, mining, records
from seqloom.plans import targets as target_plans
from seqloom.plans.sequences import _PROT, _SPANS, contigs, proteins, with_spans
from seqloom.runtime import table
from seqloom.sources import files
from seqloom.streaming.loop import new_folder


def vcf_samples(spark, d):
    """Parts as variant records of two samples, written as VCF files and read again: calls of one gene with enough depth."""
    folder = new_folder(spark, "vcf")
    call = lambda k: F.when(F.col("p_size") % k == 0, "0/1").otherwise("0/0")
    line = F.concat_ws("\t", F.lit("chr1"), F.col("p_partkey").cast("string"), F.lit("."), F.lit("A"), F.lit("T,G"), F.lit("."), F.lit("PASS"), F.concat(F.lit("X=1;GENE="), "p_type", F.lit(",OTHER")), F.lit("GT:DP"),
                       F.concat(call(2), F.lit(":"), "p_size"), F.concat(call(3), F.lit(":"), "p_size"))
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"
    body = table(spark, d, "part").select(F.expr("p_partkey div 5000").alias("file"), line.alias("line")).groupBy("file").agg(F.concat(F.lit(head), F.array_join(F.collect_list("line"), "\n")).alias("value"))
    body.write.partitionBy("file").text(folder)
    return files.vcf_calls(spark, folder, "PROMO", 10)


def domain_round_trip(spark, d):
    """Motifs as a tab-separated domain scan, written and read again."""
    folder = new_folder(spark, "domains")
    line = lambda s: F.concat_ws("\t", F.concat(F.lit("r"), F.col("rec_id")), F.lit("-"), F.col("n"), F.lit("Pfam"), F.lit("PF1"), F.lit("motif"), s["start"], s["end"], F.lit("1e-5"))
    with_spans(spark, d).where("size(spans) > 0").select(F.array_join(F.transform("spans", line), "\n").alias("value")).write.text(folder)
    return files.domain_table(spark, folder).select("seq_id", F.size("domains").alias("n_domains"), F.get("domains", F.lit(0))["domain"].alias("domain"), F.get("domains", F.lit(0))["start"].alias("first_start"), F.element_at("domains", -1)["end"].alias("last_end"))


def fastq_round_trip(spark, d):
    """Contigs as reads of both mates, written as FASTQ and read again."""
    folder = new_folder(spark, "fastq")
    mate = F.explode(F.array(F.lit(".1"), F.lit(".2")))
    reads = contigs(spark, d).where("dna <> ''").select("contig_id", "dna", mate.alias("mate"))
    reads.select(F.concat(F.lit("@r"), "contig_id", "mate", F.lit(" x\n"), "dna", F.lit("\n+\n"), F.repeat(F.lit("@"), F.length("dna"))).alias("value")).write.text(folder)
    return files.fastq(spark, folder).select("id", "base_id", F.md5("seq").alias("seq_md5"), F.length("qual").alias("n"))


def matrix_round_trip(spark, d):
    """The wide matrix of patients as CSV, read again as text columns and unpivoted."""
    from seqloom.operators import specificity

    folder = new_folder(spark, "matrix")
    target_plans._matrix(spark, d).write.csv(folder, header=True)
    wide = files.wide_matrix(spark, folder)
    return specificity.unpivoted(wide, "cancer", "row_ord").select(F.col("cancer").alias("fusion"), F.col("fusion").alias("cancer"), "n")


def variants_with_parents(spark, d):
    """Variants first, then the proteins whose id no variant has."""
    v = table(spark, d, "drift_variants").select(F.trim("parent_id").alias("id"), protein.letters("seq").alias("seq"))
    p = table(spark, d, "mined_proteins").select(F.trim("sequence_id").alias("id"), protein.letters("seq").alias("seq"))
    return records.with_parents(v, p).groupBy("id").agg(F.count("*").alias("n"), F.count("seq").alias("n_seqs"))


def results_by_place(spark, d):
    """Results that name no record by its id, matched by place."""
    ids = table(spark, d, "mined_proteins").where("trim(sequence_id) <> ''").select(F.trim("sequence_id").alias("id")).distinct()
    return records.by_id_or_place(ids.select(F.concat(F.lit("~"), "id").alias("rid")), ids)


def reference_names(spark, d):
    """Labels of the proteins in the catalog that the manifest is."""
    structures = table(spark, d, "mined_proteins").where("sequence_id is not null").select(F.trim("sequence_id").alias("pdb_id")).distinct()
    catalog = table(spark, d, "family_manifest").where("family_id is not null").select(F.trim("original_id").alias("pdb_id"), F.col("family_id").alias("subtype"))
    return records.reference_labels(structures, catalog)


def organ_keywords(spark, d):
    """Words of each fusion's diseases, from the table of what was screened for which disease."""
    fusions = table(spark, d, "high_specificity_targets").select(F.col("fusion_name").alias("fusion"), F.upper(F.trim("primary_disease")).alias("code")).where("fusion is not null").distinct()
    words = table(spark, d, "lead_candidates_filtered").select(F.upper(F.trim("associated_disease")).alias("code"), F.lower("screening_strategy").alias("word")).where("word is not null").distinct()
    return records.organ_words(fusions, words).select("fusion", F.concat_ws(",", "words").alias("words"))


def passing_structures(spark, d):
    """Proteins whose best variant scores enough and that have two or three motifs."""
    tm = table(spark, d, "drift_variants").select(F.trim("parent_id").alias("id"), F.expr("try_cast(regexp_extract(variant_id, '_esm([0-9.]+)$', 1) as double)").alias("tm")).groupBy("id").agg(F.max("tm").alias("best"))
    rows = proteins(spark, d).select("rec_id", F.trim("sequence_id").alias("id"), protein.motif_count("seq").alias("n")).join(tm, "id", "left")
    return rows.select("rec_id", records.structure_passes(F.col("best"), F.col("n"), 0.5).alias("passes"))


def best_of_domains(spark, d):
    """Best of two scores over all references, each on its own: discounts and taxes of a part's lines stand for them."""
    return records.best_domains(table(spark, d, "lineitem").select(F.col("l_partkey").alias("structure"), F.col("l_discount").alias("tm1"), F.col("l_tax").alias("tm2")))


def to_be_folded(spark, d):
    """Proteins no variant names as its parent, up to 900 letters, shortest first."""
    rows = table(spark, d, "mined_proteins").where("trim(sequence_id) <> ''").select(F.trim("sequence_id").alias("id"), protein.letters("seq").alias("seq"))
    return records.to_fold(rows, table(spark, d, "drift_variants").select(F.trim("parent_id").alias("id")), 900).select("id", F.length("seq").alias("n"))


def capped_links(spark, d):
    """The first five leads of each fusion."""
    return records.capped_per_group(table(spark, d, "lead_candidates_filtered").select("target_fusion", F.col("lead_id").alias("id")), "target_fusion", "id", 5).select("target_fusion", "id")


def chosen_from_reply(spark, d):
    """Ids out of free texts that a reply might be: a JSON list, or else all numbers; none from fewer than three."""
    reply = F.when(F.col("event_id") % 3 == 0, F.format_string('take ["%d", "7", "%d"] (of 9)', "event_id", "user_id")).when(F.col("event_id") % 3 == 1, F.format_string("ids %d, %d and 12", "event_id", "user_id")).otherwise("only 5")
    return table(spark, d, "events").select("event_id", F.array_join(records.chosen_ids(reply), ",").alias("ids"))


def query_terms(spark, d):
    """Strategies as search terms that lose their endings."""
    rows = table(spark, d, "visited_ids").where("trim(strategy) <> ''").select("strategy").distinct()
    return rows.select("strategy", texts.stripped_of(F.concat(F.lit(" "), "strategy", F.lit(" WGS[prop][TITLE] ")), records.QUERY_SUFFIXES).alias("term"))


def visit_stamps(spark, d):
    return table(spark, d, "visited_ids").select("visit_no", texts.stamp("visited_at").alias("stamp"))


def scored_hits(spark, d):
    """Proteins above the threshold, and those inside the diversity band."""
    rows = table(spark, d, "mined_proteins").select("rec_id", F.expr("try_cast(score as double)").alias("score"))
    out = mining.hits(rows, MiningConfig(score_threshold=0.5))
    band = mining.hits(rows, MiningConfig(score_threshold=0.5, similarity_floor=0.6, similarity_ceiling=0.9)).select("rec_id", F.lit(True).alias("in_band"))
    return out.join(band, "rec_id", "left").select("rec_id", F.coalesce("in_band", F.lit(False)).alias("in_band"))


def substitutions(spark, d):
    """Whether A for M may be set at a place of each protein that its number names."""
    rows = with_spans(spark, d).withColumn("pos1", (F.col("rec_id") % 40 + 1).cast("int"))
    return rows.select("rec_id", protein.suggestion_holds("seq", F.col("pos1"), F.lit("M"), F.lit("A"), protein.protected("spans", F.col("n"))).alias("holds"))


def enzymes_in_manifest(spark, d):
    return table(spark, d, "lead_candidates_filtered").select("lead_id", "enzyme_variant").join(table(spark, d, "family_manifest").select(F.col("new_id").alias("enzyme_variant")), "enzyme_variant", "left_semi").select("lead_id")


def junction_sources(spark, d):
    """Own junction, else a given one, else imputed: texts under 30 nucleotides count as none."""
    names = target_plans._fusions(spark, d)
    n = F.length("fusion") % 4
    given = names.where(n.isin(1, 2)).select("fusion", F.repeat(F.lit("gu"), F.when(n == 1, 16).otherwise(14)).alias("junction"))
    rows = names.withColumn("own_junction", F.when(n == 0, F.repeat(F.lit("acgu"), F.lit(8))).when(n == 1, F.lit("ACG")))
    return matching.junctions(rows, given).select("fusion", "junction_source", "junction")


def targets_in_file_order(spark, d):
    """The first 50 fusions of each delivered list in its own order, with the disease the targets table has for them, else Unknown."""
    lines = table(spark, d, "fusion_files").select("file_id", "line_no", F.get_json_object("payload", "$.fusionsss").alias("fusion"))
    known = table(spark, d, "high_specificity_targets").where("primary_disease is not null").groupBy(F.col("fusion_name").alias("fusion")).agg(F.min("primary_disease").alias("diseases"))
    return matching.with_disease(matching.first_of_list(lines, "file_id", 50, "line_no"), known).select("file_id", "fusion", "rank", "disease")


def candidate_cap(spark, d):
    """The first 500 leads with a named disease, in order of their number."""
    return matching.first_candidates(table(spark, d, "lead_candidates_filtered").select("lead_id", "associated_disease"), "associated_disease", 500, "lead_id")


ORGANS = ["view", "CLICK", "purchase"]


def expression_risks(spark, d):
    """Pairs of genes and the organs in which one of them is high."""
    samples = target_plans._samples(spark, d)
    members = samples.select(F.expr("gene div 2").alias("item"), "gene")
    return expression.tissue_risks(samples, members, ORGANS, 25.0).select("item", "n_risks", "score", F.array_join("risks", ",").alias("risks"))


def fusion_verdicts(spark, d):
    """Pairs of genes: the first one that is not low in normal and present in cancer samples; every third pair is judged within its organ."""
    stats = target_plans.expression_stats(spark, d)
    genes = stats.withColumn("item", F.expr("gene div 2")).withColumn("ord", F.col("gene") % 2).withColumn("by_organ", F.col("item") % 3 == 0)
    return expression.first_failure(expression.fusion_checks(genes, 150.0, 20.0, 1.0))


def lobe_summaries(spark, d):
    """Nuclease and recognition spans: from domains for every other protein, else from motifs and the rest."""
    rows = with_spans(spark, d)
    domain = F.array(F.struct(F.lit("NUC1.2").alias("signature"), F.lit(9).alias("start"), F.lit(60).alias("end")), F.struct(F.lit("REC1").alias("signature"), F.lit(50).alias("start"), F.lit(80).alias("end")))
    domains = F.when(F.col("rec_id") % 2 == 0, domain)
    nuc, rec = protein.lobes(domains, "spans", F.col("n"), ["NUC1"], ["REC1"])
    return rows.select("rec_id", protein.span_summary(nuc).alias("nuc"), F.when(F.col("rec_id") % 2 == 0, protein.span_summary(rec)).alias("rec"))


QUERIES = {
    f.__name__: f
    for f in (vcf_samples, domain_round_trip, fastq_round_trip, matrix_round_trip, variants_with_parents, results_by_place, reference_names, organ_keywords, passing_structures, best_of_domains, to_be_folded,
              capped_links, chosen_from_reply, query_terms, visit_stamps, scored_hits, substitutions, enzymes_in_manifest, junction_sources, targets_in_file_order, candidate_cap, expression_risks, fusion_verdicts, lobe_summaries)
}

_IDS = "(select distinct trim(sequence_id) as id from mined_proteins where trim(sequence_id) <> '')"
_TM = "try_cast(nullif(regexp_extract(variant_id, '_esm([0-9.]+)$', 1), '') as double)"
_DNA = """(select contig_id, concat(b[1:200], d, b[201:240], d, b[241:280], d, b[281:]) as dna from (select rec_id as contig_id,
    translate(regexp_replace(upper(seq), '[^A-Z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTTGCAACGTGGCATACGTTCAGA') as b, regexp_replace(upper(coalesce(repeat_domains, '')), '[^ACGT]', '', 'g') as d from mined_proteins where seq is not null))"""

ORACLE = {
    "vcf_samples": """select s as sample, cast(p_partkey as integer) as position, 'A' as ref, 'T' as alt, p_size as depth from part, (values ('S1', 2), ('S2', 3)) t(s, k) where p_type = 'PROMO' and p_size % k = 0 and p_size >= 10""",
    "domain_round_trip": f"select 'r' || rec_id as seq_id, len(starts) as n_domains, 'PF1 (motif)' as domain, starts[1] as first_start, ends[-1] as last_end from {_SPANS} where len(starts) > 0",
    "fastq_round_trip": f"select 'r' || contig_id || m as id, 'r' || contig_id as base_id, md5(dna) as seq_md5, len(dna) as n from {_DNA}, (values ('.1'), ('.2')) t(m) where dna <> ''",
    "matrix_round_trip": f"select fusion, cancer, n from {target_plans._LONG}",
    "variants_with_parents": """select id, count(*) as n, count(s) as n_seqs from (select trim(parent_id) as id, seq as s from drift_variants union all select trim(sequence_id), seq from mined_proteins
        where trim(sequence_id) not in (select trim(parent_id) from drift_variants where parent_id is not null) or sequence_id is null) group by 1""",
    "results_by_place": f"select '~' || id as rid, id from {_IDS}",
    "reference_names": """select s.pdb_id, lower(case when c.subtype is null then s.pdb_id else c.subtype || '_' || s.pdb_id end) as label from (select distinct trim(sequence_id) as pdb_id from mined_proteins where sequence_id is not null) s
        left join (select trim(original_id) as pdb_id, min(family_id) as subtype from family_manifest where family_id is not null group by 1) c using (pdb_id)""",
    "organ_keywords": """select fusion, string_agg(word, ',' order by word) as words from (select distinct fusion, word from (select fusion_name as fusion, upper(trim(primary_disease)) as code from high_specificity_targets where fusion_name is not null)
        join (select upper(trim(associated_disease)) as code, lower(screening_strategy) as word from lead_candidates_filtered where screening_strategy is not null) using (code)) group by 1""",
    "passing_structures": f"""select rec_id, coalesce(best >= 0.5, false) and len(regexp_extract_all(seq, 'R[^\\n]{{4,6}}H')) between 2 and 3 as passes from {_PROT} p
        left join (select trim(parent_id) as id, max({_TM}) as best from drift_variants group by 1) t on t.id = trim(p.sequence_id)""",
    "best_of_domains": "select l_partkey as structure, max(l_discount) as domain1, max(l_tax) as domain2 from lineitem group by 1",
    "to_be_folded": """select trim(sequence_id) as id, len(regexp_replace(upper(seq), '[^A-Z]', '', 'g')) as n from mined_proteins where trim(sequence_id) <> '' and len(regexp_replace(upper(seq), '[^A-Z]', '', 'g')) <= 900
        and trim(sequence_id) not in (select trim(parent_id) from drift_variants where parent_id is not null)""",
    "capped_links": "select target_fusion, lead_id as id from (select *, row_number() over (partition by target_fusion order by lead_id) as n from lead_candidates_filtered) where n <= 5",
    "chosen_from_reply": """select event_id, case event_id % 3 when 0 then case when event_id <> user_id and event_id <> 7 and user_id <> 7 then event_id || ',7,' || user_id end
        when 1 then case when event_id <> user_id and event_id <> 12 and user_id <> 12 then event_id || ',' || user_id || ',12' end end as ids from events""",
    "query_terms": "select distinct strategy, ltrim(strategy) || ' WGS[prop]' as term from visited_ids where trim(strategy) <> ''",
    "visit_stamps": "select visit_no, strftime(visited_at, '%Y%m%d_%H%M%S') as stamp from visited_ids",
    "scored_hits": "select rec_id, try_cast(score as double) between 0.6 and 0.9 as in_band from mined_proteins where try_cast(score as double) > 0.5",
    "substitutions": f"select rec_id, n >= p and seq[p:p] = 'M' and len(list_filter(starts, lambda s, i: p - 1 >= s - 5 and p - 1 < ends[i] + 5)) = 0 as holds from (select *, cast(rec_id % 40 + 1 as integer) as p from {_SPANS})",
    "enzymes_in_manifest": "select lead_id from lead_candidates_filtered where enzyme_variant in (select new_id from family_manifest where new_id is not null)",
    "junction_sources": f"""select fusion, case len(fusion) % 4 when 0 then 'provided' when 1 then 'fasta' else 'imputed' end as junction_source,
        case len(fusion) % 4 when 0 then repeat('ACGT', 8) when 1 then repeat('GT', 16) else {target_plans._junction_sql("fusion")} end as junction from {target_plans._FUSIONS}""",
    "targets_in_file_order": """with l as (select file_id, json_extract_string(payload, '$.fusionsss') as fusion, min(line_no) as o from fusion_files group by 1, 2 having fusion is not null),
        k as (select fusion_name as fusion, min(primary_disease) as disease from high_specificity_targets where primary_disease is not null group by 1)
        select file_id, fusion, rank, coalesce(disease, 'Unknown') as disease from (select *, row_number() over (partition by file_id order by o, fusion) as rank from l) left join k using (fusion) where rank <= 50""",
    "candidate_cap": f"select lead_id, associated_disease from lead_candidates_filtered where {target_plans._VALID} order by lead_id limit 500",
    "expression_risks": """with m as (select user_id as gene, event_type as tissue, avg(value) as m from events group by 1, 2), h as (select gene, o as organ, avg(m) as m from m, (values ('view'), ('CLICK'), ('purchase')) t(o) where contains(lower(tissue), lower(o)) group by 1, 2 having avg(m) > 25),
        r as (select gene // 2 as item, count(*) as n, string_agg(gene || ' in ' || organ, ',' order by gene || ' in ' || organ) as risks from h group by 1)
        select item, coalesce(n, 0) as n_risks, greatest(0, 100 - 25 * coalesce(n, 0)) as score, coalesce(risks, '') as risks from (select distinct user_id // 2 as item from events) left join r using (item)""",
    "fusion_verdicts": f"""with g as (select *, gene // 2 as item, gene % 2 as ord, (gene // 2) % 3 = 0 and (normal_n > 0 or cancer_n > 0) as o from {target_plans._STATS}),
        c as (select item, ord, gene, case when o and normal_n > 0 and cancer_n > 0 then case when cancer_mean < 20 then 'cancer mean too low in organ' when cancer_mean < normal_mean and normal_mean > 0 then 'not enriched in organ' end
            when o and cancer_n > 0 then case when cancer_mean < 20 then 'cancer mean too low in organ, no normal' end when o then 'no cancer samples in organ' when normal_n = 0 then 'no normal-tissue data'
            when normal_max > 150 then 'expressed in normal' when cancer_n > 0 and cancer_mean < 20 then 'not expressed in cancer' end as r from g)
        select item, count(r) = 0 as ok, arg_min(gene || ': ' || r, ord) filter (where r is not null) as reason from c group by 1""",
    "lobe_summaries": f"""select rec_id, case when rec_id % 2 = 0 then '10-60' when len(starts) = 0 then '-' else array_to_string(list_transform(starts, lambda s, i: (greatest(s - 50, 0) + 1) || '-' || least(ends[i] + 50, n)), ', ') end as nuc,
        case when rec_id % 2 = 0 then '51-80' end as rec from {_SPANS}""",
}

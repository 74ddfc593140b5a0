"""Queries over protein and nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import dna, protein, texts
from seqloom.config import MiningConfig
from seqloom.operators import mining, repeats
from seqloom.runtime import spread, table


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mined_proteins").select("rec_id", "sequence_id", protein.letters("seq").alias("seq")).where("seq is not null")


def with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins(spark, sf_dir).withColumn("spans", protein.motif_spans("seq")).withColumn("n", F.length("seq"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nucleotide contigs derived from the mined records: residues as bases around three copies of the repeats."""
    base = F.translate(protein.letters("seq"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTTGCAACGTGGCATACGTTCAGA")
    d = F.regexp_replace(F.upper(F.coalesce("repeat_domains", F.lit(""))), "[^ACGT]", "")
    rows = spread(table(spark, sf_dir, "mined_proteins").select("rec_id", "seq", "repeat_domains")).where("seq is not null").select(F.col("rec_id").alias("contig_id"), base.alias("b"), d.alias("d"))
    return rows.select("contig_id", F.expr("concat(substr(b, 1, 200), d, substr(b, 201, 40), d, substr(b, 241, 40), d, substr(b, 281))").alias("dna"))


_PROT = "(select rec_id, sequence_id, regexp_replace(upper(seq), '[^A-Z]', '', 'g') as seq from mined_proteins where seq is not null)"
_MOTIF = "'R[^\\n]{4,6}H'"
# Places of the matches: the text before each is what the earlier matches and the parts between them add up to.
_SPANS = f"""(select rec_id, sequence_id, seq, len(seq) as n, list_transform(ends, lambda e, i: e - len(ms[i])) as starts, ends from (
    select rec_id, sequence_id, seq, ms, list_transform(range(1, len(ms) + 1), lambda i: cast(list_sum(list_transform(parts[1:i], lambda p: len(p))) + list_sum(list_transform(ms[1:i], lambda p: len(p))) as integer)) as ends
    from (select *, regexp_extract_all(seq, {_MOTIF}) as ms, string_split(regexp_replace(seq, {_MOTIF}, chr(1), 'g'), chr(1)) as parts from {_PROT})))"""
_DNA = """(select contig_id, concat(b[1:200], d, b[201:240], d, b[241:280], d, b[281:]) as dna from (select rec_id as contig_id,
    translate(regexp_replace(upper(seq), '[^A-Z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTTGCAACGTGGCATACGTTCAGA') as b,
    regexp_replace(upper(coalesce(repeat_domains, '')), '[^ACGT]', '', 'g') as d from mined_proteins where seq is not null))"""
_CODONS = "map([" + ", ".join(f"'{c}'" for c in dna.codon_table()) + "], [" + ", ".join(f"'{a}'" for a in dna.codon_table().values()) + "])"
_REV = "reverse(translate(dna, 'ACGT', 'TGCA'))"
_FRAMES = f"""(select contig_id, len(dna) as contig_len, frame, array_to_string(list_transform(range(0, cast(floor(len(s) / 3) as integer)), lambda i: coalesce({_CODONS}[s[i*3+1:i*3+3]], 'X')), '') as prot
    from (select contig_id, dna, f as frame, case when f < 3 then dna[f+1:] else ({_REV})[f-2:] end as s from {_DNA}, range(6) t(f)))"""
_ORFS = f"""(select contig_id, contig_len, frame, i - 1 as orf_index, parts[i] as orf, cast(frame % 3 + 3 * (coalesce(list_sum(list_transform(parts[1:i-1], lambda p: len(p) + 1)), 0)) as integer) as start_nt
    from (select *, string_split(prot, '*') as parts from {_FRAMES}), lateral (select unnest(range(1, len(parts) + 1)) as i))"""


def motif_count(spark, d):
    return proteins(spark, d).select("rec_id", protein.motif_count("seq").alias("n_motifs"))


def motif_band(spark, d):
    return motif_count(spark, d).where("n_motifs between 2 and 3")


def motif_spans(spark, d):
    return with_spans(spark, d).select("rec_id", F.posexplode("spans").alias("i", "s")).select("rec_id", "i", "s.start", "s.end")


def motif_topology(spark, d):
    return with_spans(spark, d).select("rec_id", protein.spaced("spans").alias("spaced"))


def full_protein(spark, d):
    rows = with_spans(spark, d)
    return rows.select("rec_id", protein.starts_complete("seq").alias("starts"), protein.tail_length("seq", "spans").alias("tail"), protein.tail_complete("seq", "spans").alias("tail_ok"), F.length("seq").between(600, 1400).alias("length_ok"))


def protected_positions(spark, d):
    rows = with_spans(spark, d)
    return rows.select("rec_id", protein.protected("spans", F.col("n")).alias("p")).select("rec_id", F.size("p").alias("n_protected"), F.coalesce(F.array_min("p"), F.lit(-1)).alias("first"), F.coalesce(F.array_max("p"), F.lit(-1)).alias("last"))


def domain_spans(spark, d):
    rows = with_spans(spark, d)
    return rows.select("rec_id", F.posexplode(protein.padded_domain("spans", F.col("n"))).alias("i", "s")).select("rec_id", "i", "s.start", "s.end")


def linker_charge(spark, d):
    return with_spans(spark, d).select("rec_id", protein.linker_charge("seq", "spans").alias("charge"))


def span_merge(spark, d):
    rows = with_spans(spark, d).withColumn("nuc", protein.nuclease_spans("spans", F.col("n")))
    return rows.select("rec_id", F.explode("nuc").alias("s")).select("rec_id", "s.start", "s.end")


def span_complement(spark, d):
    rows = with_spans(spark, d).withColumn("nuc", protein.nuclease_spans("spans", F.col("n")))
    return rows.select("rec_id", F.explode(protein.complement("nuc", F.col("n"))).alias("s")).select("rec_id", "s.start", "s.end")


def first_by_sequence(spark, d):
    """The first record of each sequence in order of file and record."""
    return proteins(spark, d).withColumn("seq_md5", F.md5("seq")).groupBy("seq_md5").agg(F.min("rec_id").alias("rec_id"), F.count("*").alias("n_copies"))


def last_by_id(spark, d):
    """Of records with the same id the last one holds."""
    rows = table(spark, d, "mined_proteins").where(F.trim("sequence_id") != "")
    return rows.groupBy(F.trim("sequence_id").alias("id")).agg(F.max("rec_id").alias("rec_id"), F.max_by("score", "rec_id").alias("score"))


def fasta_lines(spark, d):
    """Records as FASTA text in lines of 60."""
    return proteins(spark, d).select("rec_id", F.md5(F.concat(F.lit(">"), "sequence_id", F.lit("\n"), protein.wrapped("seq"))).alias("text_md5"))


def reverse_complement(spark, d):
    return contigs(spark, d).select("contig_id", F.md5(dna.reverse_complement("dna")).alias("rc_md5"), F.length("dna").alias("n"))


def six_frame(spark, d):
    return dna.six_frames(contigs(spark, d)).select("contig_id", "frame", F.md5("prot").alias("prot_md5"), (F.length("prot") - F.length(F.replace("prot", F.lit("*"), F.lit("")))).alias("n_stops"))


def _orfs(spark, d):
    return dna.reading_frames(dna.six_frames(contigs(spark, d).withColumn("contig_len", F.length("dna"))).drop("dna"))


def orf_bounds(spark, d):
    return _orfs(spark, d).where("length(orf) >= 30").select("contig_id", "frame", "orf_index", "start_nt", "end_nt", "orf")


def full_orf(spark, d):
    """Reading frames of at least 30 residues that begin with M and do not touch the contig's edge."""
    rows = _orfs(spark, d).where("length(orf) >= 30")
    cut_off = protein.touches_edge(F.col("start_nt"), F.col("end_nt"), F.col("frame"), F.col("contig_len"))
    return rows.select("contig_id", "frame", "orf_index", protein.starts_complete("orf").alias("starts"), cut_off.alias("cut_off"))


def orf_stats(spark, d):
    """Per contig: reading frames, the longest, and how many are long enough to be kept."""
    return _orfs(spark, d).groupBy("contig_id").agg(F.count("*").alias("n_orfs"), F.max(F.length("orf")).alias("longest"), F.count_if(F.length("orf") >= 30).alias("n_kept"))


def kmer_repeats(spark, d):
    return repeats.domains(contigs(spark, d)).select("contig_id", "place", "k", "kmer")


def repeat_regions(spark, d):
    return repeats.regions(contigs(spark, d))


def crispr_flag(spark, d):
    return repeats.flags(contigs(spark, d))


def flank_join(spark, d):
    """Reading frames within 50 nucleotides of a repeat region, frames 3 to 5 mapped back to the contig."""
    orfs = _orfs(spark, d).where("length(orf) >= 30")
    lo, hi = dna.back_mapped(F.col("start_nt"), F.col("end_nt"), F.col("frame"), F.col("contig_len"))
    regions = repeats.regions(contigs(spark, d)).groupBy("contig_id").agg(F.collect_list(F.struct("lo", "hi")).alias("regions"))
    return orfs.withColumn("lo", lo).withColumn("hi", hi).join(regions, "contig_id").where(dna.near_any(F.col("lo"), F.col("hi"), F.col("regions"), 50)).select("contig_id", "frame", "orf_index", "lo", "hi")


def tandem_repeats(spark, d):
    return repeats.tandem(contigs(spark, d)).select("contig_id", F.posexplode("motifs").alias("place", "motif"))


def family_size(spark, d):
    """Members of each family of the manifest, families in order of the length of their name."""
    rows = table(spark, d, "family_manifest").withColumn("family", texts.family_of("new_id"))
    return rows.groupBy("family").agg(F.countDistinct("new_id").alias("n_members"), F.max("hepn_count").alias("most_motifs")).orderBy(F.length("family"), "family")


#: Frames of the derived contigs are short.
SHORT = MiningConfig(min_orf=30, filter_motifs=False, crispr_flank_bp=300)


def mined_candidates(spark, d):
    return mining.candidates(contigs(spark, d), SHORT).select("contig_id", "frame", "orf_index", "start_nt", "end_nt", "n_repeats")


def contig_stats(spark, d):
    c = contigs(spark, d)
    return mining.stats(c, mining.candidates(c, SHORT))


def structured_frames(spark, d):
    """Frames that pass the whole predicate, with one motif at least and a short tail."""
    rows = mining.frames_of(contigs(spark, d)).where("length(orf) >= 30")
    return rows.withColumn("ok", mining.complete(MiningConfig(min_cterm_tail=2))).groupBy("contig_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


QUERIES = {
    f.__name__: f
    for f in (motif_count, motif_band, motif_spans, motif_topology, full_protein, protected_positions, domain_spans, linker_charge, span_merge, span_complement, first_by_sequence, last_by_id, fasta_lines,
              reverse_complement, six_frame, orf_bounds, full_orf, orf_stats, kmer_repeats, repeat_regions, crispr_flag, flank_join, tandem_repeats, family_size, mined_candidates, contig_stats, structured_frames)
}

_WIDE = f"select rec_id, n, list_sort(list_transform(starts, lambda s, i: {{'start': greatest(s - 50, 0), 'end': least(ends[i] + 50, n)}})) as w from {_SPANS}"
_ISLANDS = f"""select rec_id, n, min(s) as start, max(e) as end from (
    select rec_id, n, s, e, sum(case when pe is null or s > pe then 1 else 0 end) over (partition by rec_id order by s, e rows unbounded preceding) as island from (
        select rec_id, n, s, e, max(e) over (partition by rec_id order by s, e rows between unbounded preceding and 1 preceding) as pe from (
            select rec_id, n, greatest(starts[i] - 50, 0) as s, least(ends[i] + 50, n) as e from {_SPANS}, lateral (select unnest(range(1, len(starts) + 1)) as i))))
    group by rec_id, n, island"""
_KMERS = f"select contig_id, len(dna) as n, k, i as pos, dna[i+1:i+k] as kmer from {_DNA}, (values (24), (28), (32)) t(k), lateral (select unnest(range(0, len(dna) - k)) as i) where len(dna) >= 400"
_NEEDED = "case when n < 1500 then 2 else 3 end"
_REGIONS = f"select contig_id, k, kmer, cast(min(pos) as integer) as lo, cast(max(pos) + k as integer) as hi, count(*) as n_copies from ({_KMERS}) group by contig_id, n, k, kmer having count(*) >= {_NEEDED}"

_CANDIDATES = f"""select o.contig_id, frame, orf_index, start_nt, end_nt, n_repeats from (select *, start_nt + 3 * len(orf) as end_nt, case when frame < 3 then start_nt else contig_len - 1 - start_nt - 3 * len(orf) end as lo,
        case when frame < 3 then start_nt + 3 * len(orf) else contig_len - 1 - start_nt end as hi from {_ORFS} where len(orf) between 30 and 1400 and orf like 'M%') o
    join (select contig_id, count(*) as n_repeats from ({_REGIONS}) group by 1) n using (contig_id)
    where exists (select 1 from ({_REGIONS}) r where r.contig_id = o.contig_id and greatest(r.lo - o.hi, o.lo - r.hi, 0) <= 300)"""

ORACLE = {
    "motif_count": f"select rec_id, len(regexp_extract_all(seq, {_MOTIF})) as n_motifs from {_PROT}",
    "motif_band": f"select rec_id, len(regexp_extract_all(seq, {_MOTIF})) as n_motifs from {_PROT} where len(regexp_extract_all(seq, {_MOTIF})) between 2 and 3",
    "motif_spans": f"""select rec_id, i - 1 as i, starts[i] as start, ends[i] as "end" from {_SPANS}, lateral (select unnest(range(1, len(starts) + 1)) as i)""",
    "motif_topology": f"select rec_id, len(starts) between 2 and 3 and len(list_filter(starts, lambda a: len(list_filter(starts, lambda b: b - a > 100 and b - a < 1200)) > 0)) > 0 as spaced from {_SPANS}",
    "full_protein": f"select rec_id, seq = '' or seq like 'M%' as starts, n - ends[len(ends)] as tail, coalesce(n - ends[len(ends)] >= 15, false) as tail_ok, n between 600 and 1400 as length_ok from {_SPANS}",
    "protected_positions": f"select rec_id, len(p) as n_protected, coalesce(list_min(p), -1) as first, coalesce(list_max(p), -1) as last from (select rec_id, list_distinct(flatten(list_transform(starts, lambda s, i: range(greatest(s - 5, 0), least(ends[i] + 5, n))))) as p from {_SPANS})",
    "domain_spans": f"""select rec_id, i - 1 as i, greatest(starts[i] - 40, 0) as start, least(ends[i] + 60, n - 1) as "end" from {_SPANS}, lateral (select unnest(range(1, len(starts) + 1)) as i)""",
    "linker_charge": f"select rec_id, case when len(starts) >= 2 then len(regexp_replace(seq[ends[1]+1:starts[2]], '[^RK]', '', 'g')) - len(regexp_replace(seq[ends[1]+1:starts[2]], '[^DE]', '', 'g')) end as charge from {_SPANS}",
    "span_merge": f'select rec_id, start, "end" from ({_ISLANDS})',
    "span_complement": f"""with m as ({_ISLANDS}), e as (select rec_id, n, start, "end" from m union all select rec_id, n, n, n from {_SPANS} union all select rec_id, n, 0, 0 from {_SPANS})
        select rec_id, prev as start, start as "end" from (select rec_id, start, lag("end") over (partition by rec_id order by start, "end") as prev from e) where prev < start""",
    "first_by_sequence": f"select md5(seq) as seq_md5, min(rec_id) as rec_id, count(*) as n_copies from {_PROT} group by 1",
    "last_by_id": "select trim(sequence_id) as id, max(rec_id) as rec_id, arg_max(coalesce(score, chr(1)), rec_id) as score from mined_proteins where trim(sequence_id) <> '' group by 1",
    "fasta_lines": f"select rec_id, md5('>' || sequence_id || chr(10) || array_to_string(list_transform(range(0, cast(ceil(len(seq) / 60) as integer)), lambda i: seq[i*60+1:i*60+60]), chr(10))) as text_md5 from {_PROT}",
    "reverse_complement": f"select contig_id, md5({_REV}) as rc_md5, len(dna) as n from {_DNA}",
    "six_frame": f"select contig_id, frame, md5(prot) as prot_md5, len(prot) - len(replace(prot, '*', '')) as n_stops from {_FRAMES}",
    "orf_bounds": f"select contig_id, frame, orf_index, start_nt, start_nt + 3 * len(orf) as end_nt, orf from {_ORFS} where len(orf) >= 30",
    "full_orf": f"""select contig_id, frame, orf_index, orf like 'M%' as starts, case when frame < 3 then start_nt < 30 or start_nt + 3 * len(orf) > contig_len - 30 else start_nt + 3 * len(orf) > contig_len - 31 or start_nt < 30 end as cut_off
        from {_ORFS} where len(orf) >= 30""",
    "orf_stats": f"select contig_id, count(*) as n_orfs, max(len(orf)) as longest, count(*) filter (where len(orf) >= 30) as n_kept from {_ORFS} group by 1",
    "kmer_repeats": f"""select contig_id, row_number() over (partition by contig_id order by k, reached, kmer) - 1 as place, k, kmer from (
        select contig_id, k, kmer, pos as reached from (select *, row_number() over (partition by contig_id, k, kmer order by pos) as c, {_NEEDED} as needed from ({_KMERS})) where c = needed)""",
    "repeat_regions": f"select contig_id, k, kmer, lo, hi, n_copies from ({_REGIONS})",
    "crispr_flag": f"select d.contig_id, len(d.dna) >= 400 and r.contig_id is not null as has_repeats from {_DNA} d left join (select distinct contig_id from ({_REGIONS})) r using (contig_id)",
    "flank_join": f"""select distinct o.contig_id, frame, orf_index, o.lo, o.hi from (select contig_id, frame, orf_index, case when frame < 3 then start_nt else contig_len - 1 - start_nt - 3 * len(orf) end as lo,
        case when frame < 3 then start_nt + 3 * len(orf) else contig_len - 1 - start_nt end as hi from {_ORFS} where len(orf) >= 30) o join ({_REGIONS}) r using (contig_id) where greatest(r.lo - o.hi, o.lo - r.hi, 0) <= 50""",
    "mined_candidates": f"select contig_id, frame, orf_index, start_nt, end_nt, n_repeats from ({_CANDIDATES})",
    "contig_stats": f"""select d.contig_id, len(d.dna) as n, coalesce(c.n, 0) as n_candidates, coalesce(c.longest, 0) as longest, r.contig_id is not null as has_repeats from {_DNA} d
        left join (select contig_id, count(*) as n, max((end_nt - start_nt) // 3) as longest from ({_CANDIDATES}) group by 1) c using (contig_id) left join (select distinct contig_id from ({_REGIONS})) r using (contig_id)""",
    "structured_frames": f"""select contig_id, count(*) as n, count(*) filter (where orf like 'M%' and regexp_matches(orf, '^.*R[^\\n]{{4,6}}H.{{2,}}$') and tail >= 2 and not
        case when frame < 3 then start_nt < 30 or start_nt + 3 * len(orf) > contig_len - 30 else start_nt + 3 * len(orf) > contig_len - 31 or start_nt < 30 end) as n_ok
        from (select *, len(string_split(regexp_replace(orf, {_MOTIF}, chr(1), 'g'), chr(1))[-1]) as tail from {_ORFS} where len(orf) >= 30) group by 1""",
    "tandem_repeats": f"""select contig_id, cast(row_number() over (partition by contig_id order by k, i) - 1 as integer) as place, motif from (
        select contig_id, k, dna[i:i+k-1] as motif, min(i) as i from {_DNA}, range(20, 48) s(k), lateral (select unnest(range(1, len(dna) - 2 * k + 2)) as i) where dna[i:i+k-1] = dna[i+k:i+2*k-1] group by 1, 2, 3)""",
    "family_size": "select split_part(new_id, '_', 1) as family, count(distinct new_id) as n_members, max(hepn_count) as most_motifs from family_manifest group by 1",
}

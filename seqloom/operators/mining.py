"""From contigs to candidates: reading frames through all filters, cheap ones first, and what is counted on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.config import MiningConfig
from seqloom.functions import dna, protein
from seqloom.operators import repeats


def frames_of(contigs: DataFrame) -> DataFrame:
    """All reading frames with contig_len. contigs: contig_id, dna."""
    return dna.reading_frames(dna.six_frames(contigs.select("contig_id", "dna", F.length("dna").alias("contig_len"))).drop("dna"))


def complete(config: MiningConfig) -> Column:
    """The full-frame predicate: begins with M, ends far enough behind its last motif, is not cut off by its contig."""
    return (
        protein.starts_complete("orf", config.require_start_m)
        & protein.tail_complete("orf", protein.motif_spans("orf"), config.min_cterm_tail)
        & ~protein.touches_edge(F.col("start_nt"), F.col("end_nt"), F.col("frame"), F.col("contig_len"), config.contig_boundary_margin)
    )


def candidates(contigs: DataFrame, config: MiningConfig) -> DataFrame:
    """contig_id, frame, orf_index, orf, start_nt, end_nt, n_repeats of the reading frames that pass.

    Length first; then the full-frame predicate if wanted, the band of motif counts if wanted,
    and, if repeats are required, enough of them in the contig and one within the flank. Contigs
    without dna have no candidates.
    """
    rows = frames_of(contigs).where(F.length("orf").between(config.min_orf, config.max_orf))
    if config.require_start_m:
        rows = rows.where(F.col("orf").startswith("M"))
    if config.require_full_structure:
        rows = rows.where(complete(config))
    if config.filter_motifs:
        rows = rows.where(protein.motif_count("orf").between(config.min_motifs, config.max_motifs))
    lo, hi = dna.back_mapped(F.col("start_nt"), F.col("end_nt"), F.col("frame"), F.col("contig_len"))
    found = repeats.repeats(contigs).groupBy("contig_id").agg(F.count("*").alias("n_repeats"), F.collect_list(F.struct("lo", "hi")).alias("regions"))
    rows = rows.join(found, "contig_id", "inner" if config.require_crispr or config.require_full_structure else "left")
    if config.require_crispr or config.require_full_structure:
        rows = rows.where((F.col("n_repeats") >= config.min_repeat_count) & dna.near_any(lo, hi, F.col("regions"), config.crispr_flank_bp))
    return rows.select("contig_id", "frame", "orf_index", "orf", "start_nt", "end_nt", F.coalesce("n_repeats", F.lit(0)).alias("n_repeats"))


def hits(scored: DataFrame, config: MiningConfig) -> DataFrame:
    """Scored candidates above the threshold (strictly) and, if a ceiling is set, inside the diversity band. scored: score and other columns."""
    rows = scored if config.score_threshold is None else scored.where(F.col("score") > config.score_threshold)
    if config.similarity_ceiling is not None:
        rows = rows.where(F.col("score").between(config.similarity_floor or 0.0, config.similarity_ceiling))
    return rows


def stats(contigs: DataFrame, kept: DataFrame) -> DataFrame:
    """Per contig: length, candidates, longest candidate (0 without any), and whether it has repeats."""
    per = kept.groupBy("contig_id").agg(F.count("*").alias("n_candidates"), F.max(F.length("orf")).alias("longest"))
    return (
        contigs.select("contig_id", F.length("dna").alias("n")).join(per, "contig_id", "left").join(repeats.flags(contigs), "contig_id", "left")
        .select("contig_id", "n", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("longest", F.lit(0)).alias("longest"), "has_repeats")
    )

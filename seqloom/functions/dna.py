"""Nucleotide sequences: reverse complement, six-frame translation, reading frames, guide sites."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.protein import col, let, running_sums

#: Standard genetic code, codons in the order T, C, A, G of each place. Fixed value.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Ambiguity codes of nucleotides. Fixed value.
AMBIGUITY = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def codon_table() -> dict[str, str]:
    """Residue of every codon, ambiguous ones too if all they stand for agree; all others are X."""
    exact = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), AMINO_ACIDS, strict=True)}
    out = {}
    for codon in product(AMBIGUITY, repeat=3):
        residues = {exact["".join(c)] for c in product(*(AMBIGUITY[x] for x in codon))}
        if len(residues) == 1:
            out["".join(codon)] = residues.pop()
    return out


def normalised(c: str | Column) -> Column:
    """RNA or DNA as upper-case DNA without outer blanks."""
    return F.translate(F.upper(F.trim(col(c))), "U", "T")


def reverse_complement(c: str | Column) -> Column:
    return F.reverse(F.translate(col(c), "ACGTRYKMBVDH", "TGCAYRMKVBHD"))


def translated(c: str | Column) -> Column:
    """Residues of the whole codons, stops as *, unknown codons as X; a rest of one or two is dropped.

    A text of plain bases is read as numbers to base 4 that index the code; only one with
    other letters goes through the map of ambiguous codons.
    """
    c = col(c)
    # The argument of a transform is made once; its function sees three letters, never the whole text.
    codons = lambda text: F.regexp_extract_all(text, F.lit("(?s)..."), F.lit(0))
    code = F.array(*[F.lit(a) for a in AMINO_ACIDS])
    plain = F.transform(codons(F.translate(c, "TCAG", "0123")), lambda x: F.get(code, F.conv(x, 4, 10).cast("int")))
    table = F.create_map(*[F.lit(x) for kv in codon_table().items() for x in kv])
    mixed = F.transform(codons(c), lambda x: F.coalesce(F.element_at(table, x), F.lit("X")))
    return F.when(F.length(c) < 3, "").when(c.rlike("[^ACGT]"), F.array_join(mixed, "")).otherwise(F.array_join(plain, ""))


def six_frames(contigs: DataFrame, dna: str = "dna") -> DataFrame:
    """One row per contig and frame (0-2 forward, 3-5 of the reverse complement): adds frame and prot."""
    strands = F.explode(F.expr(f"array(named_struct('s', {dna}, 'o', 0), named_struct('s', reverse(translate({dna}, 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')), 'o', 3))"))
    both = contigs.withColumn("_x", strands)
    frames = both.withColumn("_f", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("frame", F.col("_x.o") + F.col("_f"))
    return frames.withColumn("prot", translated(F.substring(F.col("_x.s"), F.col("_f") + 1, F.length("_x.s")))).drop("_x", "_f")


def reading_frames(frames: DataFrame, contig: str = "contig_id") -> DataFrame:
    """One row per stretch between stops, empty ones too: adds orf_index, orf, start_nt, end_nt (without the stop).

    The offset of a stretch is the running length, with one stop each, of those before it in
    its frame; it is folded inside the row, so no window and no shuffle is needed.
    """
    parts = F.split("prot", "\\*", -1)
    rows = frames.withColumn("_o", running_sums(F.transform(parts, lambda p: F.length(p) + 1))).select("*", F.posexplode(parts).alias("orf_index", "orf"))
    start = F.pmod(F.col("frame"), F.lit(3)) + 3 * F.get("_o", F.col("orf_index"))
    return rows.withColumn("start_nt", start.cast("int")).withColumn("end_nt", (start + 3 * F.length("orf")).cast("int")).drop("_o", "prot")


def imputed_junction(name: str | Column) -> Column:
    """60 nucleotides made from a name: the first 30 bytes of its SHA-256, each modulo 4 as A, C, T, G, twice."""
    h = F.sha2(col(name).cast("binary"), 256)
    base = lambda h, i: F.substring(F.lit("ACTG"), (F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % 4) + 1, F.lit(1))
    half = let(h, lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: base(h, i)), ""))
    return F.repeat(half, F.lit(2))


def cut_sites(junction: str | Column, guide: int = 22) -> Column:
    """Places of a guide whose following nucleotide is not G: the nucleotides behind the first guide, without the Gs. 0 where the text is too short."""
    behind = F.substring(col(junction), F.lit(guide + 1), F.length(col(junction)))
    return F.when(F.length(col(junction)) > guide, F.length(F.replace(behind, F.lit("G"), F.lit("")))).otherwise(0)


def back_mapped(start: Column, end: Column, frame: Column, contig_len: Column) -> tuple[Column, Column]:
    """Frame coordinates on the contig: frames 3 to 5 run backwards (half-open ends count as places)."""
    return F.when(frame < 3, start).otherwise(contig_len - 1 - end), F.when(frame < 3, end).otherwise(contig_len - 1 - start)


def gap_to(start: Column, end: Column, region: Column) -> Column:
    """Nucleotides between a stretch and a region (lo, hi); 0 if they overlap."""
    return F.greatest(region["lo"] - end, start - region["hi"], F.lit(0))


def near_any(start: Column, end: Column, regions: Column, flank: int) -> Column:
    return F.exists(regions, lambda r: gap_to(start, end, r) <= flank)



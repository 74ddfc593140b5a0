"""Repeats in contigs: direct repeats by k-mer counts, and tandem repeats.

All words of a contig are in its own row, so they are counted there, on arrays, and only
repeats leave the task: nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (24, 28, 32)
LEAST_CONTIG = 400
SHORT_CONTIG = 1500


def needed(n: int) -> int:
    """Copies that make a repeat: three, or two in a short contig."""
    return 2 if n < SHORT_CONTIG else 3


def repeats_of(dna: str, k: int) -> list[tuple[str, int, int, int, int]]:
    """(kmer, lo, last, n_copies, reached) of the k-mers with enough copies, by the place at which the needed copy begins.

    The last place of a contig is not looked at, and contigs under 400 have no repeats.
    """
    n = len(dna) - k
    if len(dna) < LEAST_CONTIG or n <= 0:
        return []
    c = np.frombuffer(dna.encode("ascii", "replace"), np.uint8).astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : n + i] + np.uint64(1)
    order = np.argsort(h, kind="stable")
    again = h[order][1:] == h[order][:-1]
    if not again.any():
        return []
    some = np.zeros(n, bool)
    some[order[1:][again]] = some[order[:-1][again]] = True
    found: dict[str, list[int]] = {}
    for i in np.flatnonzero(some).tolist():  # spelled out, so equal hashes of different words do no harm
        found.setdefault(dna[i : i + k], []).append(i)
    least = needed(len(dna))
    return sorted(((w, at[0], at[-1], len(at), at[least - 1]) for w, at in found.items() if len(at) >= least), key=lambda r: (r[4], r[0]))


REPEATS = "contig_id long, k int, kmer string, lo int, hi int, n_copies long, place int"


def repeats(contigs: DataFrame) -> DataFrame:
    """contig_id, k, kmer, lo, hi, n_copies, place: repeated k-mers and their place in the order in which they reach the needed count, shorter k first. A null contig has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                place = 0
                for k in KS:
                    for w, lo, last, copies, _ in repeats_of(s or "", k):
                        rows.append((i, k, w, lo, last + k, copies, place))
                        place += 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["contig_id", "k", "kmer", "lo", "hi", "n_copies", "place"])

    return contigs.select(F.col("contig_id").cast("long"), "dna").mapInArrow(run, REPEATS)


def regions(contigs: DataFrame) -> DataFrame:
    """contig_id, k, kmer, lo, hi, n_copies of each k-mer that repeats often enough."""
    return repeats(contigs).drop("place")


def domains(contigs: DataFrame) -> DataFrame:
    """contig_id, place, k, kmer in the order of reaching the needed count."""
    return repeats(contigs).select("contig_id", "place", "k", "kmer")


def flags(contigs: DataFrame) -> DataFrame:
    """contig_id, has_repeats for every contig: one pass, the first repeat decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has = [any(repeats_of(s or "", k) for k in KS) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(has, pa.bool_())], names=["contig_id", "has_repeats"])

    return contigs.select(F.col("contig_id").cast("long"), "dna").mapInArrow(run, "contig_id long, has_repeats boolean")


def tandem_of(seq: str, shortest: int = 20, longest: int = 47, copies: int = 2) -> list[str]:
    """Motifs of a length from shortest to longest that stand at least `copies` times in a row, shorter ones first, then by place, each once."""
    c = np.frombuffer(seq.encode("ascii", "replace"), np.uint8)
    out: dict[str, None] = {}
    for size in range(shortest, longest + 1):
        if len(c) < size * copies:
            break
        # A run of letters that equal those `size` further on, long enough from a place on, is a tandem repeat there.
        ends = np.append(np.flatnonzero(c[:-size] != c[size:]), len(c) - size)
        at = np.arange(len(c) - size)
        for i in np.flatnonzero(ends[np.searchsorted(ends, at)] - at >= size * (copies - 1)).tolist():
            out.setdefault(seq[i : i + size])
    return list(out)


def tandem(contigs: DataFrame) -> DataFrame:
    """contig_id, motifs: distinct tandem motifs, shorter ones first, then by place. A null contig gives no motif."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            motifs = [tandem_of(s or "") for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(motifs, pa.list_(pa.string()))], names=["contig_id", "motifs"])

    return contigs.select(F.col("contig_id").cast("long"), "dna").mapInArrow(run, "contig_id long, motifs array<string>")

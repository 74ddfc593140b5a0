"""Protein sequences: motif places, predicates on complete reading frames, spans and domains.

All are column expressions; a null sequence gives null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The catalytic motif: R, four to six residues, H. Fixed value.
MOTIF = "R[^\\n]{4,6}H"
SPAN = "array<struct<start:int,end:int>>"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with value made once, however often use refers to it inside other functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(numbers: Column) -> Column:
    """For each number of an array the sum of those before it.

    Appending copies an array, so sums run within blocks of about the square root of the length,
    and over the blocks' totals.
    """
    upto = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))

    def of(xs: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))

        def blocks(w: Column) -> Column:
            inner = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(xs) / w).cast("int") - 1)), lambda j: upto(F.slice(xs, j * w + 1, w)))
            return let(inner, lambda i: let(upto(F.transform(i, lambda x: F.element_at(x, -1))), lambda t: F.flatten(F.transform(i, lambda x, j: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda v: v + F.get(t, j))))))

        return let(width, blocks)

    return let(numbers, of)


def letters(c: str | Column) -> Column:
    """Only the letters of a sequence, in upper case."""
    return F.regexp_replace(F.upper(col(c)), "[^A-Z]+", "")


def motif_count(seq: str | Column, motif: str = MOTIF) -> Column:
    """Number of non-overlapping matches from left to right."""
    return F.regexp_count(col(seq), F.lit(motif))


def motif_spans(seq: str | Column, motif: str = MOTIF) -> Column:
    """Half-open spans [start, end), from 0, of the non-overlapping matches.

    The texts of the matches are placed one by one behind the end of the one before: an earlier
    place of the same text there would have been the match itself.
    """

    def spans_in(seq: Column) -> Column:
        def put(done: Column, m: Column) -> Column:
            at = F.call_function("locate", m, seq, F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0)) + 1)
            return F.array_append(done, F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(m)).cast("int").alias("end")))

        return F.aggregate(F.regexp_extract_all(seq, F.lit(f"({motif})"), F.lit(1)), F.array().cast(SPAN), put)

    return let(col(seq), spans_in)


def starts_complete(seq: str | Column, required: bool = True, empty_passes: bool = True) -> Column:
    """Begins with M, if that is required; an empty sequence passes or fails as told."""
    seq = col(seq)
    if not required:
        return F.lit(True)
    return F.when(seq == "", F.lit(empty_passes)).otherwise(seq.startswith("M"))


def tail_length(seq: str | Column, spans: str | Column) -> Column:
    """Residues behind the last motif; null without a motif."""
    return F.length(col(seq)) - F.get(col(spans), F.size(col(spans)) - 1)["end"]


def tail_complete(seq: str | Column, spans: str | Column, least: int = 15) -> Column:
    """At least so many residues behind the last motif; false without a motif."""
    return F.coalesce(tail_length(seq, spans) >= least, F.lit(False))


def touches_edge(start: Column, end: Column, frame: Column, contig_len: Column, margin: int = 30) -> Column:
    """A reading frame that may be cut off by its contig; frames 3 to 5 are compared in their own coordinates."""
    forward = (start < margin) | (end > contig_len - margin)
    backward = (end > contig_len - 1 - margin) | (start < margin)
    return F.when(frame < 3, forward).otherwise(backward)


def spaced(spans: str | Column, least: int = 100, most: int = 1200, counts: tuple[int, int] = (2, 3)) -> Column:
    """Two or three motifs, of which some pair starts more than least and less than most apart."""
    spans = col(spans)
    far = F.exists(spans, lambda a: F.exists(spans, lambda b: (b["start"] - a["start"] > least) & (b["start"] - a["start"] < most)))
    return F.size(spans).between(*counts) & far


def protected(spans: str | Column, seq_len: Column, pad: int = 5) -> Column:
    """Sorted distinct positions within pad residues of any motif."""
    near = F.transform(col(spans), lambda s: F.sequence(F.greatest(s["start"] - pad, F.lit(0)), F.least(s["end"] + pad, seq_len) - 1))
    return F.array_sort(F.array_distinct(F.flatten(near)))


def padded_domain(spans: str | Column, seq_len: Column, before: int = 40, after: int = 60) -> Column:
    """Each motif's domain, clamped to the sequence; `end` is the last residue."""
    return F.transform(
        col(spans), lambda s: F.struct(F.greatest(s["start"] - before, F.lit(0)).cast("int").alias("start"), F.least(s["end"] + after, seq_len - 1).cast("int").alias("end"))
    )


def merged(spans: str | Column) -> Column:
    """Spans in order, those that overlap or touch as one."""

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.array_append(F.slice(done, 1, F.size(done) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), longer).otherwise(F.array_append(done, F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))

    return F.aggregate(F.array_sort(col(spans)), F.array().cast(SPAN), add)


def complement(spans: str | Column, seq_len: Column) -> Column:
    """The stretches of [0, seq_len) between merged spans."""
    spans = col(spans)
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(seq_len.cast("int")))
    return F.filter(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda s: s["start"] < s["end"])


def nuclease_spans(spans: str | Column, seq_len: Column, pad: int = 50) -> Column:
    """Motifs widened on both sides, clamped and merged."""
    return merged(F.transform(col(spans), lambda s: F.struct(F.greatest(s["start"] - pad, F.lit(0)).cast("int").alias("start"), F.least(s["end"] + pad, seq_len).cast("int").alias("end"))))


def count_of(seq: Column, residues: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, residues, ""))


def linker_charge(seq: str | Column, spans: str | Column) -> Column:
    """(R + K) - (D + E) between the first two motifs; null with fewer."""
    spans, seq = col(spans), col(seq)
    a, b = F.get(spans, F.lit(0))["end"], F.get(spans, F.lit(1))["start"]
    part = F.substring(seq, a + 1, F.greatest(b - a, F.lit(0)))
    return F.when(F.size(spans) >= 2, count_of(part, "RK") - count_of(part, "DE"))


def wrapped(seq: str | Column, width: int = 60) -> Column:
    """The text in lines of a fixed width."""
    return F.regexp_replace(col(seq), f"(.{{{width}}})(?!$)", "$1\n")


def suggestion_holds(seq: str | Column, pos1: Column, wild: Column, mutant: Column, protected_: Column) -> Column:
    """A substitution at a position from 1: single letters, the wild one stands there, the place is not protected."""
    seq = col(seq)
    return (
        F.coalesce((pos1 >= 1) & (pos1 <= F.length(seq)), F.lit(False))
        & wild.rlike("^[A-Z]$") & mutant.rlike("^[A-Z]$") & (wild != mutant)
        & (F.substring(seq, pos1, F.lit(1)) == wild) & ~F.array_contains(protected_, pos1 - 1)
    )


def span_summary(spans: str | Column) -> Column:
    """Spans as `100-250, 400-550`, first and last residue from 1; `-` without any."""
    text = F.array_join(F.transform(col(spans), lambda s: F.concat((s["start"] + 1).cast("string"), F.lit("-"), s["end"].cast("string"))), ", ")
    return F.when(F.size(col(spans)) > 0, text).otherwise("-")


def lobes(domains: str | Column, spans: str | Column, seq_len: Column, nuclease: list[str], recognition: list[str], pad: int = 50) -> tuple[Column, Column]:
    """Nuclease spans, in order and not merged, and recognition spans.

    domains: array of (signature, start, end); the part of a signature before a dot counts. Without a
    nuclease domain the motifs, widened, stand for them; without a recognition domain the rest of
    the sequence does.
    """
    pick = lambda names: F.transform(
        F.filter(col(domains), lambda d: F.substring_index(d["signature"], ".", 1).isin(names)), lambda d: F.struct(d["start"].cast("int").alias("start"), d["end"].cast("int").alias("end"))
    )
    wide = F.transform(col(spans), lambda s: F.struct(F.greatest(s["start"] - pad, F.lit(0)).cast("int").alias("start"), F.least(s["end"] + pad, seq_len).cast("int").alias("end")))
    named = lambda names: F.coalesce(pick(names), F.array().cast(SPAN))
    nuc = let(named(nuclease), lambda n: F.array_sort(F.when(F.size(n) > 0, n).otherwise(wide)))
    rec = let(named(recognition), lambda r: F.when(F.size(r) > 0, merged(r)).when(F.size(nuc) > 0, complement(merged(nuc), seq_len)).otherwise(r))
    return nuc, rec

"""Near-duplicate sequences: fingerprints, pivot distance tables, exact verification.

1. Equal sequences (letters only, upper case) are one class, compared once.
2. The distinct 5-letter stretches of a class are hashed once; the smallest hash in each of 256
   parts of the hash range is a min-hash, its lowest bit one bit of the fingerprint. Two sets of
   similarity s differ in about 256 * (1 - s) / 2 bits.
3. The pivot table holds the Hamming distances of each fingerprint to 32 reference fingerprints; it
   is made once for each class and kept beside its fingerprint.
   By the triangle inequality two fingerprints differ in at least the largest difference of
   their coordinates; pairs for which that exceeds the bound are dropped unseen.
4. Survivors within the Hamming bound are verified on the sequences themselves.

Pivot tables alone cannot find candidates here: the distances of unrelated 256-bit fingerprints
to any reference gather around 128 +- 8, closer together than the bound of 95 that similarity
0.5 asks for. Pairs are therefore first met on equal triples of min-hashes (69 of them; a pair of
similarity 0.5 shares none with probability 0.875**69 = 0.0001).

That holds only if most parts are filled. Sequences with few distinct stretches share parts, so
they take an exact path instead of 2. to 4.: two sets of similarity s have a stretch in common
among the n - ceil(s * n) + 1 rarest of each, so they meet on those and are then verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.graph import components
from seqloom.runtime import cut

K = 5
PARTS = 256
PIVOTS = 32
#: Min-hashes in a band, where the parts allow it: unrelated pairs that meet grow with the square of the classes, and each further min-hash divides them by hundreds.
WIDEST = 3
#: A sequence with fewer distinct stretches is held against others by its rarest stretches, without fingerprints.
EXACT = 300
#: Sequences of one stretch that meet in one sub-key.
HOT = 1000

_SALT = 0x9E3779B97F4A7C15


def bands_of(similarity: float, widest: int = 2) -> tuple[int, int]:
    """Bands, and min-hashes in each (at most `widest`), so that a pair of this similarity shares none with probability 0.0001; (0, 0) if the parts are too few for that."""
    for width in range(widest, 0, -1):
        bands = max(1, round(math.log(1e-4) / math.log1p(-min(similarity, 0.99) ** width))) if similarity > 0 else PARTS + 1
        if bands * width <= PARTS:
            return bands, width
    return 0, 0


def hamming_bound(similarity: float) -> int:
    """Bits in which a pair of this similarity may differ: the mean and 4.5 deviations (0.5: 64 and 7, so 95; loses one in 200,000)."""
    p = (1 - similarity) / 2
    return int(PARTS * p + 4.5 * math.sqrt(PARTS * p * (1 - p)))


HAMMING_BOUND = hamming_bound(0.5)


def _words_of(data: np.ndarray) -> np.ndarray:
    """The codes of all 5-letter stretches of one sequence (upper-case letters as bytes), with repetitions."""
    c = data.astype(np.int32) - 65
    n = len(c) - K + 1
    code = c[:n].copy()
    for i in range(1, K):
        code *= 26
        code += c[i : n + i]
    return code


def _hash(code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(_SALT)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_EDGES = (np.arange(PARTS, dtype=np.uint64) << np.uint64(56)).astype(np.uint64)


def sketch(seq: bytes) -> tuple[np.ndarray, bytes, int] | None:
    """The min-hash of each part, the fingerprint, and the number of distinct stretches. An empty part takes the min-hash of the next filled one, mixed with its own number."""
    data = np.frombuffer(seq, np.uint8)
    if len(data) < K:
        return None
    h = np.sort(_hash(_words_of(data)))
    at = np.searchsorted(h, _EDGES)
    at_end = at == len(h)
    at[at_end] = 0
    low = h[at]
    own = (low >> np.uint64(56)) == np.arange(PARTS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        low = np.where(own, low, (low ^ np.arange(PARTS, dtype=np.uint64)) * np.uint64(_SALT))
    return low, np.packbits(((low >> np.uint64(17)) & np.uint64(1)).astype(np.uint8)).tobytes(), 1 + int((h[1:] != h[:-1]).sum())


def sketcher(bands: int, width: int):
    """A mapInArrow function from (cls, seq) to bands, fingerprint and number of distinct stretches."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, prints, counts = [], [], [], []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = sketch(s.encode())
                if made:
                    with np.errstate(over="ignore"):
                        part = made[0][: width * bands].reshape(bands, width) if bands else np.zeros((0, 1), np.uint64)
                        key = np.arange(bands, dtype=np.uint64)
                        for column in part.T:
                            key = (key * np.uint64(31) + column) * np.uint64(_SALT)
                    ids.append(i)
                    keys.append(key.view(np.int64))
                    prints.append(made[1])
                    counts.append(made[2])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            offsets = np.arange(len(ids) + 1, dtype=np.int32) * bands
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(prints, pa.binary()), pa.array(counts, pa.int32())], names=["cls", "bands", "print", "n"])

    return make


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, seq) to cls and the codes of its distinct stretches."""
    for batch in batches:
        made = [np.unique(_words_of(np.frombuffer(s.encode(), np.uint8))) for s in batch.column(1).to_pylist()]
        offsets = np.cumsum([0, *map(len, made)]).astype(np.int32)
        flat = np.concatenate(made) if made else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=["cls", "codes"])


def _bits(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), PARTS // 8)


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def tabled(pivots: list[bytes]):
    """A mapInArrow function from (cls, print): adds the row of the pivot table, a byte per distance (256 is kept as 255, which only narrows differences)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = _bits(pivots)
        for batch in batches:
            prints = _bits(batch.column(1).to_pylist())
            rows = np.stack([np.minimum(_ONES[prints ^ r].sum(1, dtype=np.int16), 255) for r in refs], 1).astype(np.uint8) if len(refs) else np.zeros((len(prints), 0), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in rows], pa.binary())], names=["cls", "print", "row"])

    return add


#: What became of a pair that met: dropped by the pivot table, by the Hamming bound, or kept for the exact check.
BY_PIVOTS, BY_HAMMING, KEPT = 0, 1, 2


def judged(bound: int):
    """A mapInArrow function from (a, b, pa, pb, ra, rb): a, b and what became of the pair."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pa_, pb, ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3, 4, 5))
            far = np.abs(ra.astype(np.int16) - rb).max(1, initial=0) > bound
            what = np.where(far, BY_PIVOTS, KEPT).astype(np.int8)
            near = ~far
            what[near] = np.where(_ONES[pa_[near] ^ pb[near]].sum(1, dtype=np.int16) > bound, BY_HAMMING, KEPT)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(what)], names=["a", "b", "what"])

    return judge


def verifier(similarity: float):
    """A mapInArrow function from (a, b, seq_a, seq_b) to the pairs that are alike, with their similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}

            def words(i: int, s: str) -> np.ndarray:
                if i not in sets:
                    sets[i] = np.unique(_words_of(np.frombuffer(s.encode(), np.uint8)))
                return sets[i]

            out: tuple[list, list, list] = ([], [], [])
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                p, q = words(a, x), words(b, y)
                both = np.concatenate((p, q))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                of_all = len(p) + len(q) - shared
                if shared >= similarity * of_all:
                    for o, v in zip(out, (a, b, shared / of_all), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["a", "b", "similarity"])

    return verify


class NearDuplicates:
    """Pairs and groups of alike sequences. records: rec_id (a key), seq.

    Only the letters A to Z of seq count, in upper case. A null seq is alike to nothing; one
    without letters equals others without letters; sequences shorter than five letters are alike
    only if equal. A row delivered twice counts once, and one without an id is left out. Ids may
    repeat over the tables joined to records only if the caller made them distinct; other columns
    are not read.
    """

    def __init__(self, records: DataFrame, similarity: float = 0.5):
        letters = F.regexp_replace(F.upper("seq"), "[^A-Z]+", "")
        self.similarity = similarity
        rows = records.where("rec_id is not null and seq is not null").select("rec_id", letters.alias("seq"))
        # The SHA-256 of a text stands for it: no two texts with the same one are known, so equal classes are equal texts.
        # Distinct by id and hash, so that copies of a hot text stay spread over all tasks.
        hashed = rows.select("rec_id", F.unhex(F.sha2("seq", 256)).alias("h")).distinct()
        # Only classes of several copies are joined back, and those are summed before the shuffle.
        copied = hashed.groupBy("h").agg(F.min("rec_id").alias("cls"), F.count("*").alias("n")).where("n > 1").drop("n")
        members = cut(hashed.join(copied, "h", "left").select("rec_id", F.coalesce("cls", "rec_id").alias("cls")))
        self.members = members
        self.texts = rows.join(members.where("rec_id = cls").select("rec_id"), "rec_id").select(F.col("rec_id").alias("cls"), "seq").dropDuplicates(["cls"])

    def rare_meetings(self, sizes: DataFrame, most: int, least: int = EXACT) -> DataFrame:
        """a, b: classes, one of them with fewer than `least` stretches, that can be alike. sizes: cls, n; most: the largest n below `least`.

        Exact: alike classes share one of their rarest stretches. Hot stretches are dealt to sub-keys.
        """
        # A class alike to one of `most` stretches has at most most / similarity.
        able = sizes.where(F.col("n") * self.similarity <= most + 1e-6)
        codes = self.texts.join(able.select("cls"), "cls", "left_semi").select("cls", "seq").mapInArrow(_stretches, "cls long, codes array<int>")
        each = cut(codes.join(able, "cls").select("cls", "n", F.explode("codes").alias("code")))
        frequent = each.groupBy("code").agg(F.count("*").alias("f"))
        place = F.row_number().over(Window.partitionBy("cls").orderBy("f", "code"))
        prefix = F.col("n") - F.ceil(F.col("n") * self.similarity - 1e-6) + 1
        # A stretch of one class only keeps its place but meets nothing.
        rare = each.join(frequent, "code").withColumn("place", place).where(F.col("place") <= prefix).where("f > 1")
        rare = cut(rare.select("cls", "n", "code", F.ceil(F.col("f") / HOT).cast("int").alias("salts")))
        left = rare.select(F.col("cls").alias("a"), F.col("n").alias("na"), "code", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("salt"))
        right = rare.select(F.col("cls").alias("b"), F.col("n").alias("nb"), "code", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        near = (F.least("na", "nb") < least) & (F.least("na", "nb") >= F.greatest("na", "nb") * self.similarity - 1e-6)
        return left.join(right, ["code", "salt"]).where(F.col("a") < F.col("b")).where(near).select("a", "b").distinct()

    def sketched(self) -> tuple[DataFrame, DataFrame, int | None, int]:
        """Sketches of the classes; those that take fingerprints; the most stretches of a class that does not; and the stretches from which one does."""
        bands, width = bands_of(self.similarity, WIDEST)
        sketches = cut(self.texts.where(f"length(seq) >= {K}").mapInArrow(sketcher(bands, width), "cls long, bands array<long>, print binary, n int"))
        # Without enough bands every sequence takes the exact path.
        least = EXACT if bands else 2**31 - 1
        return sketches, sketches.where(F.col("n") >= least), sketches.where(F.col("n") < least).agg(F.max("n")).first()[0], least

    def met(self, filled: DataFrame) -> DataFrame:
        """a, b: classes that share a band, each pair once. Bands of more than HOT classes are dealt to sub-keys."""
        of_band = F.count("*").over(Window.partitionBy("band"))
        banded = filled.select("cls", F.explode("bands").alias("band")).withColumn("f", of_band).where("f > 1")
        cold, hot = banded.where(f"f <= {HOT}"), banded.where(f"f > {HOT}").withColumn("salts", F.ceil(F.col("f") / HOT).cast("int"))
        side = lambda df, c: df.select(F.col("cls").alias(c), "band")
        pairs = side(cold, "a").join(side(cold, "b"), "band").where("a < b").select("a", "b")
        left = hot.select(F.col("cls").alias("a"), "band", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int").alias("salt"))
        right = hot.select(F.col("cls").alias("b"), "band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        return pairs.unionByName(left.join(right, ["band", "salt"]).where("a < b").select("a", "b")).distinct()

    def judged(self, filled: DataFrame) -> DataFrame:
        """a, b, what: the pairs that met, and whether the pivot table or the Hamming bound dropped them."""
        pivots = [bytes(r[0]) for r in filled.orderBy(F.xxhash64("cls")).limit(PIVOTS).select("print").collect()]
        table = cut(filled.select("cls", "print").mapInArrow(tabled(pivots), "cls long, print binary, row binary"))
        side = lambda c: table.select(F.col("cls").alias(c), F.col("print").alias(f"p{c}"), F.col("row").alias(f"r{c}"))
        both = self.met(filled).join(side("a"), "a").join(side("b"), "b")
        return both.select("a", "b", "pa", "pb", "ra", "rb").mapInArrow(judged(hamming_bound(self.similarity)), "a long, b long, what byte")

    def verified(self, near: DataFrame) -> DataFrame:
        """a, b, similarity of those pairs that are alike, on the sequences themselves."""
        return (
            near.join(self.texts.select(F.col("cls").alias("a"), F.col("seq").alias("sa")), "a")
            .join(self.texts.select(F.col("cls").alias("b"), F.col("seq").alias("sb")), "b")
            .select("a", "b", "sa", "sb")
            .mapInArrow(verifier(self.similarity), "a long, b long, similarity double")
        )

    def links(self) -> DataFrame:
        """a, b, similarity: alike classes, a < b, each pair once."""
        sketches, filled, few, least = self.sketched()
        near = self.judged(filled).where(F.col("what") == KEPT).select("a", "b")
        if few is not None:
            near = near.unionByName(self.rare_meetings(sketches.select("cls", "n"), few, least))
        return self.verified(near)

    def filters(self) -> DataFrame:
        """n_met, n_by_pivots, n_by_hamming, n_verified, n_alike: how many pairs of fingerprints each step was left with; one row."""
        _, filled, _, _ = self.sketched()
        pairs = cut(self.judged(filled))
        n = lambda what, name: F.count_if(F.col("what") == what).alias(name)
        alike = self.verified(pairs.where(F.col("what") == KEPT).select("a", "b")).agg(F.count("*").alias("n_alike"))
        return pairs.agg(F.count("*").alias("n_met"), n(BY_PIVOTS, "n_by_pivots"), n(BY_HAMMING, "n_by_hamming"), n(KEPT, "n_verified")).join(F.broadcast(alike))

    def pairs(self) -> DataFrame:
        """rec_id_1, rec_id_2: all alike records, smaller id first, equal sequences among them."""
        links = self.links().select("a", "b")
        left = self.members.select(F.col("cls").alias("a"), F.col("rec_id").alias("x"))
        right = self.members.select(F.col("cls").alias("b"), F.col("rec_id").alias("y"))
        alike = links.join(left, "a").join(right, "b").select("x", "y")
        equal = left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
        return alike.unionByName(equal).select(F.least("x", "y").alias("rec_id_1"), F.greatest("x", "y").alias("rec_id_2"))

    def groups(self) -> DataFrame:
        """rec_id, class_id, n_copies, group_id, n_links: one row per record with a sequence.

        class_id is the smallest id with the same sequence, group_id the smallest class
        reachable by links, n_links the number of other classes its class is alike to.
        """
        links = cut(self.links().select("a", "b"))
        label = components(links).withColumnRenamed("node", "cls")
        degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
        copies = self.members.groupBy("cls").agg(F.count("*").alias("n_copies"))
        per_class = copies.join(label, "cls", "left").join(degree, "cls", "left").select("cls", "n_copies", F.coalesce("label", "cls").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return self.members.join(per_class, "cls").select("rec_id", F.col("cls").alias("class_id"), "n_copies", "group_id", "n_links")

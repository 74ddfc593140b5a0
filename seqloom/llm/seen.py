"""Has this key been seen before? A Golomb-coded set of keys with the generation of their first arrival.

The records are cut by order of arrival into generations of about the square root of their
number. The keys are hashed to shards, and within a shard to a range of (keys of a shard) *
2**fp_bits; the shard's set keeps the sorted hashes as Golomb-coded gaps, in blocks of unary
quotients and packed remainders, and beside each hash, in as many bits as the block needs, the
generation in which it first came. One set per shard thus answers for every prefix of the
arrivals: a record's key was seen before its generation if its hash is in the set with an
earlier generation. Only the blocks into whose range a probed hash falls are decoded.

Repeats within a generation are told exactly before that; the first record of each key there is
probed. An unseen key is taken for a seen one with probability (earlier keys of its shard) /
range, at most 2**-fp_bits on average; a seen one is never missed.

Hashes of distinct keys are uniform, so shards hold equally many keys; a key however frequent
comes to its shard once per generation, so the square root bounds both that and the rows of a key
that meet within a generation. The range is per shard: shards are added as keys are, without limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.runtime import key_of

BLOCK_KEYS = 512
SHARD_KEYS = 1 << 16
#: The generation of keys known before the first record.
BASE = -1
#: Parts of the arrivals that a report tells apart.
PERIODS = 16


def encode_gaps(gaps: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Golomb code of parameter 2**k: unary quotients (that many ones, then a zero), and remainders of k bits."""
    quotients = gaps >> k
    ends = np.cumsum(quotients + 1) - 1
    bits = np.ones(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    bits[ends] = 0
    rest = (gaps & ((1 << k) - 1)).astype(np.uint64)
    packed = ((rest[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).tobytes(), np.packbits(packed.ravel()).tobytes()


def decode_gaps(unary: bytes, rest: bytes, n: int, k: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k).astype(np.int64)
    return (quotients.astype(np.int64) << k) + bits @ (np.int64(1) << np.arange(k, dtype=np.int64))


def pack(values: np.ndarray, k: int) -> bytes:
    """Numbers of k bits each."""
    bits = ((values.astype(np.uint64)[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.ravel()).tobytes()


def unpack(data: bytes, n: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * k).reshape(n, k).astype(np.int64)
    return bits @ (np.int64(1) << np.arange(k, dtype=np.int64))


BLOCKS = "shard long, block int, lo long, hi long, n int, k int, unary binary, rest binary, gen0 int, gen_bits int, gens binary"


def encode_set(pdf: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one shard: its distinct hashes h, each with its smallest gen."""
    shard = int(pdf["shard"].iloc[0])
    h, gen = pdf["h"].to_numpy(np.int64), pdf["gen"].to_numpy(np.int64)
    order = np.lexsort((gen, h))
    h, gen = h[order], gen[order]
    first = np.append(True, h[1:] != h[:-1])
    h, gen = h[first], gen[first]
    mean_gap = max(1, int(h[-1] - h[0]) // len(h))
    k = max(0, int(np.log2(mean_gap * 0.7)) if mean_gap > 1 else 0)
    rows = []
    for b, at in enumerate(range(0, len(h), BLOCK_KEYS)):
        part, of = h[at : at + BLOCK_KEYS], gen[at : at + BLOCK_KEYS]
        unary, rest = encode_gaps(np.diff(part), k)
        gen0 = int(of.min())
        bits = int(of.max() - gen0).bit_length()
        rows.append((shard, b, int(part[0]), int(part[-1]), len(part), k, unary, rest, gen0, bits, pack(of - gen0, bits)))
    return pd.DataFrame(rows, columns=["shard", "block", "lo", "hi", "n", "k", "unary", "rest", "gen0", "gen_bits", "gens"])


#: The answer for a hash that is not in the set.
NEVER = np.iinfo(np.int64).max


def first_generation(h: np.ndarray, blocks: pd.DataFrame) -> np.ndarray:
    """The generation under which each hash is in the set of these blocks, NEVER if it is not; decodes only blocks into whose range a hash falls."""
    blocks = blocks.sort_values("block")
    lo, hi = blocks["lo"].to_numpy(np.int64), blocks["hi"].to_numpy(np.int64)
    at = np.searchsorted(lo, h, "right") - 1
    could = (at >= 0) & (h <= hi[at])
    out = np.full(len(h), NEVER)
    held, gens = [], []
    for b in np.unique(at[could]).tolist():
        r = blocks.iloc[b]
        n = int(r["n"])
        gaps = decode_gaps(r["unary"], r["rest"], n - 1, int(r["k"])) if n > 1 else np.zeros(0, np.int64)
        held.append(np.concatenate(([r["lo"]], r["lo"] + np.cumsum(gaps))))
        gens.append(int(r["gen0"]) + unpack(r["gens"], n, int(r["gen_bits"])))
    if held:
        keys, of = np.concatenate(held), np.concatenate(gens)
        where = np.minimum(np.searchsorted(keys, h[could]), len(keys) - 1)
        out[could] = np.where(keys[where] == h[could], of[where], NEVER)
    return out


def contains(h: np.ndarray, blocks: pd.DataFrame) -> np.ndarray:
    """Which hashes are in the set of these blocks, whenever they came."""
    return first_generation(h, blocks) != NEVER


def probe(probes: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """The probes of one shard with the answer of its set, and the number of keys that came before their generation."""
    seen, earlier = np.zeros(len(probes), bool), np.zeros(len(probes), np.int64)
    if len(probes) and len(blocks):
        gen = probes["gen"].to_numpy(np.int64)
        seen = first_generation(probes["h"].to_numpy(np.int64), blocks) < gen
        of = np.sort(np.concatenate([g0 + unpack(g, n, bits) for g0, g, n, bits in zip(blocks["gen0"], blocks["gens"], blocks["n"], blocks["gen_bits"], strict=True)]))
        earlier = np.searchsorted(of, gen, "left")
    return pd.DataFrame({"at": probes["at"], "gen": probes["gen"], "seen": seen, "earlier": earlier})


class SeenKeys:
    """The plan of one run: records in order of arrival, and keys known before.

    Keys are equal if their trimmed texts are, ignoring case; a null or blank key is never seen
    and matches nothing. The order column is a key of records. Empty inputs give empty answers;
    repeated rows and copies of a key each count; other columns are not read. expected: the number
    of keys for which the sets are laid out, by default that of all records and known keys.
    """

    def __init__(self, records: DataFrame, order: str, key: str, known: DataFrame, known_key: str, fp_bits: int = 30, expected: int | None = None):
        if not 0 <= fp_bits <= 46:
            raise ValueError("fp_bits is from 0 to 46")
        rows = records.select(F.col(order).alias("at"), key_of(key).alias("key"))
        low, high, n = records.agg(F.min(order), F.max(order), F.count(order)).first()
        expected = max(1, expected if expected is not None else n + known.count())
        self.shards = -(-expected // SHARD_KEYS)
        self.range = -(-expected // self.shards) << fp_bits
        self.generations = max(1, int(n**0.5))
        low, high = (low, high) if n else (0, 0)
        span = max(1, -(-(high - low + 1) // self.generations))
        self.rows = rows.where("at is not null and key is not null").withColumn("gen", F.expr(f"cast((at - {low}) div {span} as int)"))

        # Two hashes of their own: the shard, and the place in the shard's range.
        places = [F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(self.shards)).alias("shard"), F.pmod(F.xxhash64("key"), F.lit(self.range)).alias("h")]
        own = F.min("at").over(Window.partitionBy("gen", "key"))
        told = self.rows.withColumn("first_at", own)
        self.repeated = told.where("at > first_at").select("at")
        self.first = told.where("at = first_at").select("at", "gen", "key", *places)
        base = known.select(key_of(known_key).alias("key")).where("key is not null").distinct().select(F.lit(BASE).alias("gen"), *places)
        members = self.first.select("shard", "h", "gen").unionByName(base.select("shard", "h", "gen"))
        self.blocks = members.groupBy("shard").applyInPandas(encode_set, BLOCKS)
        self.answers = (
            self.first.select("shard", "at", "gen", "h").groupBy("shard").cogroup(self.blocks.groupBy("shard")).applyInPandas(probe, "at long, gen int, seen boolean, earlier long")
        )

    def found(self) -> DataFrame:
        """at: the records whose key came before: repeats within a generation, and what the sets have seen."""
        return self.answers.where("seen").select("at").unionByName(self.repeated)

    def audit(self, known: DataFrame, known_key: str) -> DataFrame:
        """Per period of the arrivals: probes, answers, the theoretical and the audited rate of wrong ones.

        The audit holds each answer against the exact first arrival of its key. theoretical_rate is
        the mean over the unseen probes of (keys in the set from before) / range; audited_rate is
        null in a period without unseen probes.
        """
        exact = self.rows.groupBy("key").agg(F.min("at").alias("first_of_all"))
        before = known.select(key_of(known_key).alias("key")).where("key is not null").distinct().withColumn("known", F.lit(True))
        truth = self.first.select("key", "at").join(exact, "key").join(before, "key", "left").select("at", (F.coalesce("known", F.lit(False)) | (F.col("first_of_all") < F.col("at"))).alias("truly"))
        period = F.expr(f"cast(gen * {PERIODS} div {self.generations} as int)")
        unseen = F.count_if(~F.col("truly"))
        return self.answers.join(truth, "at").groupBy(period.alias("period")).agg(
            F.count("*").alias("n_probes"), F.count_if("seen").alias("n_said_seen"), F.count_if("truly").alias("n_truly_seen"),
            F.count_if(F.expr("seen and not truly")).alias("n_false_seen"), F.count_if(F.expr("truly and not seen")).alias("n_missed"),
            F.coalesce(F.avg(F.when(~F.col("truly"), F.col("earlier"))) / F.lit(float(self.range)), F.lit(0.0)).alias("theoretical_rate"),
            F.when(unseen > 0, F.count_if(F.expr("seen and not truly")) / unseen).alias("audited_rate"),
        )

    def sizes(self) -> DataFrame:
        """Per shard: keys, blocks, bytes and bits per key, and how many of the bits are generations."""
        bytes_ = F.length("unary") + F.length("rest") + F.length("gens") + 40
        return self.blocks.groupBy("shard").agg(
            F.sum("n").alias("n_keys"), F.count("*").alias("n_blocks"), F.sum(bytes_).alias("n_bytes"), (F.sum(bytes_) * 8 / F.sum("n")).alias("bits_per_key"),
            (F.sum(F.length("gens")) * 8 / F.sum("n")).alias("gen_bits_per_key"),
        )

"""Mixing sources to target weights by drawing fixed-length blocks of tokens.

The documents of a source, in pseudorandom order, make one stream of tokens, cut into blocks.
Each output shard draws its counts per source as one multinomial, in the task that holds the
shard, from a seed of its own; nothing per shard is kept on the driver. The number a source is
drawn in all differs from its exact part by about a square root, so the slots that are too many, a
pseudorandom choice of them, are given to the sources that have too few. Slot i of a source
stands for block perm_e(i mod K) of pass e = i div K, with another keyed permutation of its K
blocks for each pass, so no block, and no document, is used more often than there are passes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.runtime import cut, key_of, small_or_none

#: Ranks of a public byte-level vocabulary, one `base64 rank` a line, and its pattern of words. Fixed value.
TOKENIZER = os.environ.get("SEQLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The table of targets is a parameter of the run; a larger one is refused.
MAX_SOURCES = 100_000
DOCS_PER_BUCKET = 20_000
#: Shards whose counts come from one seed and are summed in one task.
SHARDS_PER_BUCKET = 1024

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number (the finaliser of splitmix64). Fixed values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def permuted(i: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of each i in [0, size) under the pseudorandom permutation of [0, size) that belongs to key.

    Four Feistel rounds on the next even number of bits, repeated for what falls outside.
    """
    i, size, key = np.broadcast_arrays(np.asarray(i, _U), np.asarray(size, _U), np.asarray(key, _U))
    sizes, at = np.unique(size, return_inverse=True)
    half = np.array([max(1, (int(n - 1).bit_length() + 1) // 2) if n else 1 for n in sizes.tolist()], _U)[at]
    mask = (_U(1) << half) - _U(1)
    out, todo = i.copy(), np.arange(len(i))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (_mixed(right + _mixed(key[todo] + _U(r))) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def token_counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            n = [len(encode(x)) if x else 0 for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source (trimmed, lower case; null if blank), n_tokens; a null text has no tokens."""
    return docs.select(F.col("doc_id").cast("long"), key_of("source").alias("source"), F.col("text").cast("string")).mapInArrow(token_counter(tokenizer), "doc_id long, source string, n_tokens long")


class Mix:
    """One mixture. docs: doc_id (a key), source, text; targets: source, target_share, max_repeats.

    total_tokens: the size wanted; None takes the largest at which every source that has tokens
    reaches its target within max_repeats. A source that cannot give its part is drawn
    max_repeats times and the shortfall shows in the shares. Sources without documents, documents
    without a target (a null or blank source among them), and empty texts are not drawn. A null
    share or max_repeats counts as 0; targets that name a source twice count with the sum of
    shares and the smaller max_repeats. Empty tables give an empty mixture.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, block_tokens: int = 256, slots_per_shard: int = 4096, total_tokens: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER):
        self.spark, self.block = docs.sparkSession, block_tokens
        self.docs = cut(count_tokens(docs, tokenizer))
        self.targets = targets.groupBy(key_of("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")).where("source is not null")
        sizes = self.docs.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
        rows = small_or_none(self.targets.join(sizes, "source").select("source", "target_share", "max_repeats", "tokens", "n").orderBy("source"), MAX_SOURCES)
        if rows is None:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        rows = [r for r in rows if (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
        self.seed, self.shard_slots = seed, slots_per_shard
        self.plan(rows, total_tokens)

    def plan(self, rows: list, total_tokens: int | None) -> None:
        """The blocks and slots of each source: numbers per source only."""
        if total_tokens is None:
            total_tokens = min((r["tokens"] * r["max_repeats"] / r["target_share"] for r in rows), default=0)
        self.names = [r["source"] for r in rows]
        self.k = [-(-r["tokens"] // self.block) for r in rows]
        self.wanted = [min(k * r["max_repeats"], round(total_tokens * r["target_share"] / (r["tokens"] / k))) for r, k in zip(rows, self.k, strict=True)]
        self.blocks_of = dict(zip(self.names, self.k, strict=True))

    def draws(self) -> DataFrame:
        """bucket, shard, no, n, inside: how often each shard draws source `no`, and the draws of it by earlier shards of its bucket."""
        wanted, m, seed, per = np.array(self.wanted, np.int64), self.shard_slots, self.seed, SHARDS_PER_BUCKET
        total = int(wanted.sum())
        n_shards = -(-total // m)

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = max(1, 1_000_000 // max(1, len(wanted)))
            for bucket in (int(b) for f in frames for b in f["id"]):
                rng = np.random.default_rng([seed, bucket])
                upto = np.zeros(len(wanted), np.int64)
                end = min((bucket + 1) * per, n_shards)
                for at in range(bucket * per, end, step):
                    shards = np.arange(at, min(at + step, end))
                    n = rng.multinomial(np.minimum(m, total - shards * m), wanted / total)
                    inside = upto + n.cumsum(0) - n
                    upto = upto + n.sum(0)
                    i, j = np.nonzero(n)
                    yield pd.DataFrame({"bucket": bucket, "shard": shards[i], "no": j, "n": n[i, j], "inside": inside[i, j]})

        return self.spark.range(-(-n_shards // per)).mapInPandas(draw, "bucket long, shard long, no int, n long, inside long")

    def slots(self) -> DataFrame:
        """shard, source, slot, block: which block of its source each slot holds."""
        draws = self.draws()
        of_source = Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = draws.groupBy("bucket", "no").agg(F.sum("n").alias("t"))
        drawn = np.zeros(len(self.names), np.int64)
        for r in sums.groupBy("no").agg(F.sum("t").alias("t")).collect():  # a row per source
            drawn[r["no"]] = r["t"]
        offsets = sums.select("bucket", "no", F.coalesce(F.sum("t").over(of_source), F.lit(0)).alias("offset"))
        names, k, wanted, seed = np.array(self.names, object), np.array(self.k, np.int64), np.array(self.wanted, np.int64), self.seed
        # Ranks of the slots that are too many, by source, and of the places to which they go.
        spare, lack = np.maximum(drawn - wanted, 0), np.maximum(wanted - drawn, 0)
        spare_from, lack_from = spare.cumsum() - spare, lack.cumsum() - lack

        def key(*parts) -> np.ndarray:
            out = np.full(1, seed, np.int64).astype(_U)
            for x in parts:
                out = _mixed(out + np.asarray(x).astype(_U) + _U(0x9E3779B97F4A7C15))
            return out

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                n = f["n"].to_numpy(np.int64)
                no, shard = np.repeat(f["no"].to_numpy(np.int64), n), np.repeat(f["shard"].to_numpy(np.int64), n)
                slot = np.repeat(f["first"].to_numpy(np.int64) - (n.cumsum() - n), n) + np.arange(n.sum())
                many = spare[no] > 0
                slot[many] = permuted(slot[many], drawn[no[many]], key(no[many], 0))
                over = np.flatnonzero(slot >= wanted[no])
                rank = spare_from[no[over]] + slot[over] - wanted[no[over]]
                to = np.searchsorted(lack_from + lack, rank, "right")
                no[over], slot[over] = to, drawn[to] + rank - lack_from[to]
                of_pass, i = np.divmod(slot, k[no])
                yield pd.DataFrame({"shard": shard, "source": names[no], "slot": slot, "block": permuted(i, k[no], key(no, of_pass + 1))})

        return draws.join(offsets, ["bucket", "no"]).select("shard", "no", "n", (F.col("offset") + F.col("inside")).alias("first")).mapInPandas(place, "shard long, source string, slot long, block long")

    def parts(self) -> DataFrame:
        """source, block, doc_id, from_token (of the document), n: the tokens of each document in each block.

        The place of a document in its source's stream is a running sum in two levels, over
        buckets of its pseudorandom order and within them.
        """
        docs = self.docs.where("n_tokens > 0 and source is not null").withColumn("r", F.xxhash64(F.lit(self.seed), "doc_id"))
        bits = max(4, (max(1, docs.count()) // DOCS_PER_BUCKET).bit_length() + 2)
        docs = docs.withColumn("bucket", F.shiftrightunsigned("r", 64 - bits))
        of_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t")).withColumn("offset", F.coalesce(F.sum("t").over(of_source), F.lit(0))).drop("t")
        inside = Window.partitionBy("source", "bucket").orderBy("r", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = docs.withColumn("upto", F.sum("n_tokens").over(inside)).join(offsets, ["source", "bucket"]).withColumn("z", F.col("offset") + F.col("upto")).withColumn("a", F.col("z") - F.col("n_tokens"))
        b = self.block
        return placed.select("source", "doc_id", "a", "z", F.explode(F.expr(f"sequence(a div {b}, (z - 1) div {b})")).alias("block")).select(
            "source", "block", "doc_id", F.expr(f"greatest(a, block * {b}) - a").alias("from_token"), F.expr(f"least(z, (block + 1) * {b}) - greatest(a, block * {b})").alias("n")
        )

    def usage(self) -> DataFrame:
        """doc_id, source, n_tokens, uses, whole_uses, tokens_drawn of every document.

        uses counts how often any part of it is drawn, whole_uses how often all of it is.
        """
        draws = self.slots().groupBy("source", "block").agg(F.count("*").alias("draws"))
        used = self.parts().join(draws, ["source", "block"], "left").withColumn("draws", F.coalesce("draws", F.lit(0))).groupBy("doc_id").agg(
            F.max("draws").alias("uses"), F.min("draws").alias("whole_uses"), F.sum(F.col("draws") * F.col("n")).alias("tokens_drawn")
        )
        nil = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return self.docs.join(used, "doc_id", "left").select("doc_id", "source", "n_tokens", nil("uses"), nil("whole_uses"), nil("tokens_drawn"))

    def shares(self) -> DataFrame:
        """Per source of the targets or the documents: target and reached share, tokens, documents, and the most uses of one document."""
        got = self.usage().groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("source_tokens"), F.sum("tokens_drawn").alias("tokens_drawn"), F.max("uses").alias("most_uses"))
        both = self.targets.withColumnRenamed("source", "s").join(got, F.col("s").eqNullSafe(F.col("source")), "full_outer").withColumn("source", F.coalesce("s", "source")).drop("s")
        total = both.agg(F.sum("tokens_drawn").alias("total"))
        return both.join(F.broadcast(total)).select(
            "source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "source_tokens", "tokens_drawn", "most_uses")],
            F.when(F.col("total") > 0, F.coalesce("tokens_drawn", F.lit(0)) / F.col("total")).alias("actual_share"),
        )

    def blocks(self) -> DataFrame:
        """shard, source, slot, block, doc_id, from_token, n: what to write, slot by slot."""
        return self.slots().join(self.parts(), ["source", "block"]).select("shard", "source", "slot", "block", "doc_id", "from_token", "n")

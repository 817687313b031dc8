"""Problem 9: mixing sources to target weights.

Each source's tokens are laid end to end and cut into blocks of a fixed length. The output is a row of slots in shards. The
counts of the sources in each shard are drawn as a multinomial whose totals are given: free draws would overshoot what scarce
sources may give, as their shares bind the size of the whole. The totals are split down a binary tree of shards, each split a
hypergeometric draw seeded by its node, so a task finds the counts of its own shards, and how many slots of each source come
before them, from the root, without state from other tasks. A shard's slots are dealt to its counts by a keyed permutation; a
source's k-th slot takes block perm(k mod blocks), with another keyed permutation for every round, so a block is used once a
round; slots and blocks meet in one join by (source, block).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graindeck.session import cut, parallelism


def source_name(c: str | Column) -> Column:
    """A source's name without case, white space and signs: fund-report is fund_report."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), "[^0-9a-z가-힣]", "")


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permute(x: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of range(size), entry by entry: a Feistel network on the next power of 4, walked until inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & mask
        for r in range(rounds):
            a, b = b, a ^ (_scramble(b, key * 1_000_003 + r) & mask)
        return (a << np.uint64(half)) | b

    out = once(x.astype(np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def plan(targets: list[tuple[str, float, int]], tokens: dict[str, int], block_tokens: int) -> list[tuple[str, int, int]]:
    """(source, blocks, slots) of each source that has tokens and a share: the largest mix in which no block is used more than
    its source's max_repeats times. Sources without tokens are left out and the other shares keep their proportions."""
    able = [(s, w, r, tokens[s], -(-tokens[s] // block_tokens)) for s, w, r in targets if w > 0 and r > 0 and tokens.get(s, 0) > 0]
    if not able:
        return []
    total = sum(w for _, w, *_ in able)
    size = min(t * r / (w / total) for _, w, r, t, _ in able)
    return [(s, n, max(1, min(n * r, round(size * w / total / (t / n))))) for s, w, r, t, n in able]


def draw(counts: np.ndarray, n: int, rng: np.random.Generator, exact_below: int = 10**8) -> np.ndarray:
    """How many of each source are among ``n`` of ``sum(counts)`` slots taken at random: a multivariate hypergeometric, source by source.

    From ``exact_below`` slots on a draw is the normal of the same mean and variance, rounded and kept within what is there.
    """
    left, out = int(counts.sum()), np.zeros(len(counts), np.int64)
    for i, good in enumerate(int(c) for c in counts):
        bad = left - good
        if left < exact_below:
            out[i] = rng.hypergeometric(good, bad, n) if left and n else 0
        else:
            mean = n * good / left
            spread = (mean * bad / left * max(left - n, 0) / max(left - 1, 1)) ** 0.5
            out[i] = min(max(round(rng.normal(mean, spread)), 0, n - bad), good, n)
        left, n = bad, n - int(out[i])
    return out


def shard_counts(totals: np.ndarray, shard_slots: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source in it, slots of each source before it) of the shards from ``first`` up to ``last``."""
    size = int(totals.sum())

    def walk(lo: int, hi: int, counts: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, counts, before
            return
        mid = (lo + hi) // 2
        left = draw(counts, min(mid * shard_slots, size) - lo * shard_slots, np.random.default_rng([seed, lo, hi]))
        yield from walk(lo, mid, left, before)
        yield from walk(mid, hi, counts - left, before + left)

    yield from walk(0, max(1, -(-size // shard_slots)), np.asarray(totals, np.int64), np.zeros(len(totals), np.int64))


def mix(docs: DataFrame, targets: DataFrame, source: str = "source", doc: str = "doc_id", size: str = "n_tokens", block_tokens: int = 512, shard_slots: int = 2_048,
        seed: int = 20_240_117, bucket_docs: int = 20_000, bound: int = 10_000) -> DataFrame:
    """(shard_id, slot, source, block_id, use_no, <doc>, token_from, n_tokens): what stands in each slot of the mix.

    ``docs`` holds one row per document with its size; those without source or size, or of a source without a target, take no
    part. ``targets`` (source, target_share, max_repeats) is a small table of at most ``bound`` rows. A source's last block may be
    short. use_no counts the rounds of a source from 0 and stays below its max_repeats. Nothing to mix gives no rows.
    """
    spark = docs.sparkSession
    goals = [(n, float(w), int(r)) for n, w, r in targets.select(source_name("source"), "target_share", "max_repeats").dropDuplicates().limit(bound + 1).collect() if n and w and r]
    if len(goals) > bound:
        raise ValueError(f"more than {bound} sources")
    names = {n: s for s, n in targets.select("source", source_name("source")).limit(bound).collect()}
    d = docs.select(source_name(source).alias("name"), F.col(doc).alias("doc"), F.col(size).cast("bigint").alias("n")).where((F.col("n") > 0) & F.col("name").isin([g[0] for g in goals]))
    buckets = max(1, -(-docs.count() // bucket_docs))
    d = cut(d.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int")), "mix-documents")
    sums = d.groupBy("name", "bucket").agg(F.sum("n").alias("t"))  # sources times buckets of documents
    ahead = Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("name", "bucket", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("start"))
    tokens = {n: t for n, t in sums.groupBy("name").agg(F.sum("t").alias("t")).collect()}
    goals = sorted(goals)
    chosen = plan(goals, tokens, block_tokens)
    n_slots = sum(k for *_, k in chosen)
    inside = Window.partitionBy("name", "bucket").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts) if buckets * len(goals) < 100_000 else starts, ["name", "bucket"])
    first = F.col("start") + F.col("inner")
    block = lambda at: F.floor(at / F.lit(block_tokens)).cast("bigint")
    pieces = placed.select("name", "doc", "n", first.alias("first"), F.explode(F.sequence(block(first), block(first + F.col("n") - 1))).alias("block_id"))
    edge = F.col("block_id") * block_tokens
    pieces = pieces.select("name", "block_id", "doc", F.greatest(edge - F.col("first"), F.lit(0)).alias("token_from"),
                           (F.least(edge + block_tokens, F.col("first") + F.col("n")) - F.greatest(edge, F.col("first"))).alias("n_tokens"))
    totals, blocks = np.array([k for *_, k in chosen], np.int64), [n for _, n, _ in chosen]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            slot = b["id"].to_numpy()
            which, at, use = (np.zeros(len(slot), np.int64) for _ in range(3))
            for shard, counts, before in shard_counts(totals, shard_slots, int(slot[0]) // shard_slots, int(slot[-1]) // shard_slots + 1, seed):
                here = slot // shard_slots == shard
                place = permute(slot[here] % shard_slots, int(counts.sum()), seed + 104_729 * (shard + 1))
                ends = np.cumsum(counts)
                own = np.searchsorted(ends, place, "right")
                which[here], at[here] = own, before[own] + place - (ends - counts)[own]
            for s in np.unique(which):
                mine = which == s
                k = at[mine]
                turns, index = k // blocks[s], np.empty(len(k), np.int64)
                for u in np.unique(turns):
                    turn = turns == u
                    index[turn] = permute(k[turn] % blocks[s], blocks[s], seed + 7919 * (int(s) + 1) + int(u))
                use[mine], at[mine] = turns, index
            yield pd.DataFrame({"shard_id": slot // shard_slots, "slot": slot % shard_slots, "name": [chosen[s][0] for s in which], "block_id": at, "use_no": use})

    slots = spark.range(0, n_slots, 1, max(1, min(parallelism(spark), n_slots // 10_000 + 1))).mapInPandas(deal, "shard_id bigint, slot bigint, name string, block_id bigint, use_no bigint")
    spelt = F.create_map(*[F.lit(x) for pair in names.items() if pair[0] for x in pair]) if names else F.create_map().cast("map<string,string>")
    # both sides grow with the data: never broadcast
    return slots.join(pieces.hint("merge"), ["name", "block_id"]).select("shard_id", "slot", spelt[F.col("name")].alias("source"), "block_id", "use_no", F.col("doc").alias(doc), "token_from", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per source: target and reached share of the tokens, tokens, documents and the most uses of one document's tokens."""
    uses = mixed.groupBy("source", doc, "token_from").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("uses"))
    docs = uses.groupBy("source", doc).agg(F.sum("n").alias("n"), F.max("uses").alias("uses"))
    per = docs.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    total = per.agg(F.sum("n_tokens").alias("t"))
    out = targets.select("source", "target_share", "max_repeats").join(F.broadcast(per), "source", "left")
    return out.select("source", "target_share", (F.coalesce("n_tokens", F.lit(0)) / total.scalar()).alias("reached_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
                      F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats")

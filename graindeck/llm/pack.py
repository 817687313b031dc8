"""Problem 8: filling containers of fixed capacity with items that aren't split.

Bounded-space online best fit: a fixed number of open bins, kept in a bitset whose bit f is set where some open bin has f free.
An item goes to the bin with the least free space that holds it (the lowest set bit from its size up); if none does and all
bins are open, the fullest closes. Items are sharded by hash so that each shard is packed alone, streaming in order of id; a
shard's last open bins are packed again together, largest item first, so a shard ends without half-empty bins.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graindeck.session import parallelism


class Packer:
    """Best fit over at most ``bins`` open bins. ``closed`` gets (bin number, [(item, piece, size)])."""

    def __init__(self, capacity: int, bins: int):
        self.capacity, self.bins = capacity, bins
        self.bits, self.by_free, self.open, self.made = 0, {}, 0, 0
        self.closed: list[tuple[int, list]] = []

    def _put(self, free: int, one: tuple[int, list]) -> None:
        self.by_free.setdefault(free, []).append(one)
        self.bits |= 1 << free

    def _take(self, free: int) -> tuple[int, list]:
        stack = self.by_free[free]
        one = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        return one

    def add(self, item, piece: int, size: int) -> None:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            one = self._take(free)
            self.open -= 1
        else:
            if self.open == self.bins:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
                self.open -= 1
            one, free = (self.made, []), self.capacity
            self.made += 1
        one[1].append((item, piece, size))
        if free == size:
            self.closed.append(one)
        else:
            self._put(free - size, one)
            self.open += 1

    def finish(self) -> None:
        """Pack what the open bins hold again, largest first, and close them."""
        rest = [x for stack in self.by_free.values() for _, items in stack for x in items]
        numbers = sorted(number for stack in self.by_free.values() for number, _ in stack)
        last = Packer(self.capacity, len(rest) + 1)
        for item, piece, size in sorted(rest, key=lambda x: (-x[2], x[0] is None, 0 if x[0] is None else x[0], x[1])):
            last.add(item, piece, size)
        done = last.closed + [one for stack in last.by_free.values() for one in stack]
        numbers += range(self.made, self.made + len(done))  # best fit decreasing seldom needs more bins; if it does, new numbers
        self.closed += [(numbers[i], items) for i, (_, items) in enumerate(sorted(done))]
        self.bits, self.by_free, self.open = 0, {}, 0


def pack(items: DataFrame, key: str, size: str, specs: DataFrame, bins: int = 64, shard_items: int = 50_000, bound: int = 1_000) -> DataFrame:
    """(spec_id, container_id, <key>, piece_no, token_from, n_tokens, capacity_tokens): every item in a container of every spec.

    An item larger than the capacity is cut at multiples of it; all others stay whole. Items of size 0 (or null) join whatever
    bin is fullest. Items with equal keys are items of their own. An empty table gives no rows. ``specs`` is a small table of
    at most ``bound`` rows (spec_id, capacity_tokens); specs without a positive capacity are refused.

    The number of shards follows the number of items, not the cluster, so a result doesn't depend on where it is made.
    """
    found = specs.select("spec_id", F.col("capacity_tokens").cast("int")).dropDuplicates().orderBy("spec_id").limit(bound + 1).collect()
    if len(found) > bound or any(c is None or c < 1 for _, c in found):
        raise ValueError("specs must be few and have positive capacities")
    spec = [(str(s), int(c)) for s, c in found]
    shards = max(1, -(-items.count() // shard_items))
    rows = items.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    # a task packs its range of shards one after the other: no more tasks than the session works with
    rows = rows.repartitionByRange(min(shards, parallelism(items.sparkSession)), "shard").sortWithinPartitions("shard", "k", "n")
    kind = items.schema[key].dataType

    def out(name: str, capacity: int, shard: int, packer: Packer) -> pa.RecordBatch:
        flat = [(f"{name}-{shard}-{number}", k, piece, n) for number, content in packer.closed for k, piece, n in content]
        packer.closed.clear()
        ids, ks, pieces, ns = zip(*flat) if flat else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(ks, key_type), pa.array(pieces, pa.int32()),
             pa.array([p * capacity for p in pieces], pa.int64()), pa.array(ns, pa.int64()), pa.array([capacity] * len(ids), pa.int32())],
            names=["spec_id", "container_id", "k", "piece_no", "token_from", "n_tokens", "capacity_tokens"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packers = None, []
        for b in batches:
            for s, k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if s != shard:
                    for (name, capacity), p in zip(spec, packers):
                        p.finish()
                        yield out(name, capacity, shard, p)
                    shard, packers = s, [Packer(capacity, bins) for _, capacity in spec]
                for (_, capacity), p in zip(spec, packers):
                    whole, rest = divmod(n, capacity)
                    for piece in range(whole):
                        p.closed.append((p.made, [(k, piece, capacity)]))
                        p.made += 1
                    if rest or not whole:
                        p.add(k, whole, rest)
            for (name, capacity), p in zip(spec, packers):
                yield out(name, capacity, shard, p)
        for (name, capacity), p in zip(spec, packers):
            p.finish()
            yield out(name, capacity, shard, p)

    done = rows.mapInArrow(run, f"spec_id string, container_id string, k {kind.simpleString()}, piece_no int, token_from bigint, n_tokens bigint, capacity_tokens int")
    return done.withColumnRenamed("k", key)


def fill(packed: DataFrame) -> DataFrame:
    """Per spec: containers, tokens and the share of their space that is used."""
    per = packed.groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"))
    return per.groupBy("spec_id", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("used_share"), F.max("used").alias("fullest"))

"""Problems 8 and 9."""
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graindeck.llm import mix, pack, tokens


@given(st.lists(st.integers(0, 40), max_size=120), st.integers(1, 40), st.integers(1, 8))
@settings(max_examples=150, deadline=None)
def test_packer_keeps_every_item_once(sizes, capacity, bins):
    p = pack.Packer(capacity, bins)
    for i, s in enumerate(sizes):
        if s <= capacity:
            p.add(i, 0, s)
    p.finish()
    items = [x for _, content in p.closed for x in content]
    assert sorted(items) == [(i, 0, s) for i, s in enumerate(sizes) if s <= capacity]
    assert all(sum(x[2] for x in c) <= capacity for _, c in p.closed) and len({n for n, _ in p.closed}) == len(p.closed)


def test_best_fit_and_fullest_first():
    p = pack.Packer(10, 2)
    for i, s in enumerate([6, 7, 3, 4]):
        p.add(i, 0, s)
    assert [c for _, c in p.closed] == [[(1, 0, 7), (2, 0, 3)], [(0, 0, 6), (3, 0, 4)]]
    p = pack.Packer(10, 2)
    for i, s in enumerate([5, 8, 6]):  # no room, both bins open: the fuller one closes
        p.add(i, 0, s)
    assert [c for _, c in p.closed] == [[(1, 0, 8)]]


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, None, 3, 50, 99, 100, 101, 250, 200]) if i % 3 else rng.randrange(1, 60)) for i in range(500)] + [(None, 5), (None, 5), (7, 20)]
    items = spark.createDataFrame(rows, "id bigint, n bigint").selectExpr("*", "'x' AS shard", "1 AS k")
    specs = spark.createDataFrame([("a", 100), ("b", 64)], "spec_id string, capacity_tokens int")
    out = pack.pack(items, "id", "n", specs, shard_items=200).collect()
    for spec, cap in (("a", 100), ("b", 64)):
        mine = [r for r in out if r.spec_id == spec]
        used, pieces = Counter(), defaultdict(list)
        for r in mine:
            used[r.container_id] += r.n_tokens
            pieces[r.id].append(r)
        assert max(used.values()) <= cap
        assert sum(used.values()) == sum(n or 0 for _, n in rows) and set(pieces) == {i for i, _ in rows}
        for i, n in rows:
            if i is not None and i != 7:
                assert len(pieces[i]) == max(1, -(-(n or 0) // cap)) and sorted(r.token_from for r in pieces[i]) == [k * cap for k in range(len(pieces[i]))]
                assert len(pieces[i]) == 1 or (n or 0) > cap  # only what exceeds the capacity is cut
    fill = {r.spec_id: r.used_share for r in pack.fill(spark.createDataFrame(out)).collect()}
    assert fill["a"] > 0.95


def test_pack_is_the_same_anywhere(spark):
    items = spark.createDataFrame([(i, i * 7 % 50) for i in range(300)], "id bigint, n bigint")
    specs = spark.createDataFrame([("a", 64)], "spec_id string, capacity_tokens int")
    one, other = (sorted(map(tuple, pack.pack(items.repartition(n), "id", "n", specs, shard_items=100).collect())) for n in (1, 5))
    assert one == other


def test_pack_edges(spark):
    specs = spark.createDataFrame([("a", 64)], "spec_id string, capacity_tokens int")
    assert pack.pack(spark.createDataFrame([], "id bigint, n bigint"), "id", "n", specs).count() == 0
    with pytest.raises(ValueError):
        pack.pack(spark.createDataFrame([(1, 1)], "id bigint, n bigint"), "id", "n", spark.createDataFrame([("a", 0)], "spec_id string, capacity_tokens int"))
    by_name = pack.pack(spark.createDataFrame([("x", 3), ("y", 4)], "id string, n bigint"), "id", "n", specs).collect()
    assert {r.id for r in by_name} == {"x", "y"} and len({r.container_id for r in by_name}) == 1


def test_tokens(spark):
    import os

    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary here")
    texts = ["hello world", "", None, "<|endoftext|>", "한국어 문장", "a" * 50_000]
    got = [r.n_tokens for r in tokens.with_token_count(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), ["id"]).orderBy("id").collect()]
    enc = tokens.encoding(tokens.VOCABULARY)
    assert got == [len(enc.encode_ordinary(t or "")) for t in texts] and enc.decode(enc.encode_ordinary("한국어 <|x|>\n")) == "한국어 <|x|>\n"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    for key in (0, 1, 99):
        assert np.array_equal(np.sort(mix.permute(np.arange(n), n, key)), np.arange(n))
    if n > 60:
        assert not np.array_equal(mix.permute(np.arange(n), n, 1), mix.permute(np.arange(n), n, 2))


def _mix(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").selectExpr("*", "'x' AS name", "1 AS bucket", "2 AS first")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    out = mix.mix(d, t, **kw)
    return out, mix.shares(out, t)


def test_mix(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["big"] * 8 + ["Big ", "mid_one", "MID-ONE", "tiny", None, "stranger", " "]), rng.choice([0, None, 5, 37, 120, 400])) for i in range(3000)]
    targets = [("big", 0.5, 1), ("mid_one", 0.3, 2), ("tiny", 0.15, 4), ("absent", 0.05, 4)]
    out, shares = _mix(spark, docs, targets, block_tokens=32, shard_slots=100, bucket_docs=300)
    rows = out.collect()
    size, names = dict((i, n) for i, _, n in docs), {"big": "big", "Big ": "big", "mid_one": "mid_one", "MID-ONE": "mid_one", "tiny": "tiny"}
    by_slot, uses = defaultdict(list), Counter()
    for r in rows:
        by_slot[(r.shard_id, r.slot)].append(r)
        assert names[dict((i, s) for i, s, _ in docs[r.doc_id:r.doc_id + 1])[r.doc_id]] == r.source
        assert 0 <= r.token_from and r.token_from + r.n_tokens <= size[r.doc_id] and r.n_tokens > 0
        for t in range(r.token_from, r.token_from + r.n_tokens):
            uses[(r.doc_id, t)] += 1
    assert all(sum(x.n_tokens for x in v) <= 32 and len({(x.source, x.block_id, x.use_no) for x in v}) == 1 for v in by_slot.values())
    cap = {"big": 1, "mid_one": 2, "tiny": 4}
    assert all(n <= cap[names[docs[d][1]]] for (d, _), n in uses.items())
    got = {r.source: r for r in shares.collect()}
    assert got["absent"].n_tokens == 0 and sum(r.reached_share for r in got.values()) == pytest.approx(1)
    for s, w in (("big", 0.5), ("mid_one", 0.3), ("tiny", 0.15)):
        assert got[s].reached_share == pytest.approx(w / 0.95, abs=0.01) and got[s].most_uses <= cap[s]
    per_shard = Counter((k[0], v[0].source) for k, v in by_slot.items())
    assert len({k[0] for k in per_shard}) > 5 and len({n for (_, s), n in per_shard.items() if s == "big"}) > 1  # drawn, not dealt evenly
    assert max(r.n_tokens for r in got.values()) / sum(n or 0 for _, s, n in docs if names.get(s) == "big") > 0.1


def test_mix_is_the_same_anywhere(spark):
    docs, targets = [(i, "ab"[i % 2], 30 + i) for i in range(200)], [("a", 0.7, 1), ("b", 0.3, 1)]
    one, other = (sorted(map(tuple, _mix(spark, docs, targets, block_tokens=64)[0].collect())) for _ in range(2))
    assert one == other


def test_mix_of_nothing(spark):
    for docs, targets in (([], [("a", 1.0, 1)]), ([(1, "a", 5)], []), ([(1, None, 5), (2, "a", 0)], [("a", 1.0, 1)])):
        out, shares = _mix(spark, docs, targets)
        assert out.count() == 0 and all(r.n_tokens == 0 for r in shares.collect())


def test_counts_per_shard_add_up():
    """Shares of every shard are drawn, their totals are given, and a task finds its own shards without the others."""
    totals = np.array([700, 250, 49, 1])
    every = list(mix.shard_counts(totals, 64, 0, 99, 5))
    assert [s for s, *_ in every] == list(range(16)) and (sum(c for _, c, _ in every) == totals).all()
    assert all(c.sum() == (64 if s < 15 else 40) and (c >= 0).all() for s, c, _ in every)
    before = np.zeros(4, int)
    for _, c, b in every:
        assert (b == before).all()
        before = before + c
    assert [(s, c.tolist()) for s, c, _ in mix.shard_counts(totals, 64, 7, 9, 5)] == [(s, c.tolist()) for s, c, _ in every[7:9]]
    assert len({tuple(c) for _, c, _ in every[:15]}) > 3  # drawn, not dealt evenly


@pytest.mark.parametrize("exact_below", [1, 10**8])
def test_draws_are_hypergeometric(exact_below):
    counts = np.array([6_000, 3_000, 1_000])
    got = np.array([mix.draw(counts, 2_500, np.random.default_rng(i), exact_below) for i in range(400)])
    assert (got.sum(1) == 2_500).all() and (got >= 0).all() and (got <= counts).all()
    assert np.allclose(got.mean(0), counts / 4, rtol=0.02) and 0.8 < got[:, 0].std() / (2_500 * 0.6 * 0.4 * 0.75) ** 0.5 < 1.2


def test_shards_of_more_items_than_tasks(spark):
    items = spark.createDataFrame([(i, i * 7 % 50) for i in range(900)], "id bigint, n bigint")
    specs = spark.createDataFrame([("a", 64)], "spec_id string, capacity_tokens int")
    out = pack.pack(items, "id", "n", specs, shard_items=20)  # 45 shards, 4 tasks
    assert out.rdd.getNumPartitions() <= 4 and out.select("container_id").distinct().count() > 300
    assert out.groupBy("container_id").sum("n_tokens").where("`sum(n_tokens)` > 64").count() == 0 and out.count() == 900

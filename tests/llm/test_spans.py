"""Problem 10 against brute force."""
import random

import numpy as np
import pytest

from graindeck.llm import spans

DOC = "doc_id bigint, text string"


def brute(docs, wanted):
    """Pairs of ids that share a window, and the shared code points of each."""
    where = {}
    for i, t in docs:
        for p in range(len(t or "") - wanted + 1):
            where.setdefault(t[p:p + wanted], set()).add(i)
    pairs = {(a, b) for s in where.values() for a in s for b in s if a < b}
    parts = {}
    for i, t in docs:
        hit = np.zeros(len(t or "") + 1, bool)
        for p in range(len(t or "") - wanted + 1):
            if len(where[t[p:p + wanted]]) > 1:
                hit[p:p + wanted] = True
        parts[i] = int(hit.sum())
    return pairs, parts


def texts(seed, n=60, alphabet="ab가나 😀", long=900):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.choice([19, 20, 21, 25, 40, 70])) for _ in range(12)]
    out = []
    for i in range(n):
        t = word(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(0, max(1, len(s) - 15))
            t += s[a:] + word(rng.randrange(0, 30))
        out.append((i, t))
    out += [(n, None), (n + 1, ""), (n + 2, "=" * 50), (n + 3, "=" * 45 + "x"), (n + 4, out[3][1]), (n + 5, out[3][1]), (n + 6, "ab" * 30), (n + 7, word(long)), (n + 8, shared[5][:19])]
    return out


@pytest.mark.parametrize("seed, first", [(1, None), (2, 5), (3, 20), (4, 3)])
def test_pairs_and_parts(spark, seed, first):
    docs = texts(seed)
    df = spark.createDataFrame(docs + docs[:3], DOC).selectExpr("*", "'x' AS print", "1 AS copies", "2 AS class_id")  # three re-delivered
    pairs, parts = brute(docs, 20)
    got = spans.document_pairs(df, wanted=20, first_length=first).collect()
    assert {tuple(r) for r in got} == pairs and len(got) == len(pairs)
    out = spans.shared_parts(df, wanted=20, first_length=first).collect()
    assert {r.doc_id: r.shared_chars for r in out} == parts
    assert all(r.shared_part == (r.shared_chars / r.n_chars if r.n_chars else 0) for r in out)


def test_join_instead_of_broadcast(spark):
    docs = texts(7)
    df = spark.createDataFrame(docs, DOC)
    rows, _ = spans.shared_windows(df, wanted=20, small_rows=0)
    more, _ = spans.shared_windows(df, wanted=20)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, more.collect()))


def test_very_long_text(spark):
    rng = random.Random(1)
    big = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    docs = [(1, big), (2, "zz" + big[700_000:700_300]), (3, big[-250:]), (4, big[:199])]
    assert {tuple(r) for r in spans.document_pairs(spark.createDataFrame(docs, DOC)).collect()} == {(1, 2), (1, 3)}


def test_nothing(spark):
    for docs in ([], [(1, None)], [(1, "short")], [(1, "x" * 300)], [(None, "x" * 300), (2, "x" * 300)]):
        assert spans.document_pairs(spark.createDataFrame(docs, DOC)).count() == 0
    assert spans.shared_parts(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("length", [1, 2, 3, 7, 8, 100, 200])
def test_hash_of_a_window_is_its_own(length):
    rng = np.random.default_rng(length)
    a = rng.integers(0, 5, 500).astype(np.uint32)
    h = spans.window_hashes(a, length)
    b = np.concatenate([rng.integers(0, 5, 37).astype(np.uint32), a])
    assert len(h) == 501 - length and np.array_equal(spans.window_hashes(b, length)[37:], h)
    assert len(set(h.tolist())) == len({a[i:i + length].tobytes() for i in range(len(h))})


@pytest.mark.parametrize("span", [1, 2, 3, 5, 16, 101])
def test_winnow_picks_in_every_span(span):
    h = np.random.default_rng(span).integers(0, 50, 400).astype(np.uint64)
    got = set(spans.winnow(h, span).tolist())
    assert got == {j + int(np.argmin(h[j:j + span])) for j in range(len(h) - span + 1)}


@pytest.mark.parametrize("bits", [4, 10])
def test_short_hashes_only_make_more_to_confirm(spark, bits):
    """With hashes of a few bits nearly every window collides: the text itself decides."""
    docs = texts(5)
    df = spark.createDataFrame(docs, DOC)
    pairs, parts = brute(docs, 20)
    assert {tuple(r) for r in spans.document_pairs(df, wanted=20, bits=bits).collect()} == pairs
    rows, _ = spans.shared_windows(df, wanted=20, bits=bits)
    more, _ = spans.shared_windows(df, wanted=20)
    assert sorted((r.class_id, r.pos) for r in rows.collect()) == sorted((r.class_id, r.pos) for r in more.collect())


def test_a_passage_of_many_texts_is_kept_as_a_set(spark):
    rng = random.Random(3)
    word = lambda k: "".join(chr(0x4E00 + rng.randrange(2_000)) for _ in range(k))
    passage = word(60)
    docs = [(i, word(30) + passage + word(30)) for i in range(300)]
    df = spark.createDataFrame(docs, DOC)
    windows, texts_, _ = spans.windows_of(df, "doc_id", "text", 20, None, 2_000_000, 64)
    sets = spans.passage_sets(windows, texts_, 20)
    assert sets.where("size = 300").count() == 300 and sets.count() < 1_000
    assert {r.largest_set for r in spans.document_classes(df, wanted=20).collect()} == {300}
    members = spark.createDataFrame([(1, i, 2_500) for i in range(2_500)], "g int, id int, n int")
    assert spans._expanded(members, ["g"], "id", "n").distinct().count() == 2_500 * 2_499 // 2  # three parts


def test_longest_levels(spark):
    """Doublings of the wanted length that shared runs reach, against brute force."""
    docs = texts(11, n=30)
    long = "".join(random.Random(2).choice("xyz ") for _ in range(500))
    docs += [(200, "q" + long[:170]), (201, long[5:165] + "w"), (202, long[:45])]
    want = {}
    for i, t in docs:
        others = [o for j, o in docs if j != i and o]
        level, n = 0, 20
        while any(t[p:p + n] in o for o in others for p in range(len(t or "") - n + 1)):
            level, n = n, 2 * n
        want[i] = level
    got = {r.doc_id: r.longest_level for r in spans.shared_parts(spark.createDataFrame(docs, DOC), wanted=20).collect()}
    assert got == want and max(want.values()) >= 160

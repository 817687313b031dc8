"""Problems 4 and 7 against brute force."""
import datetime as dt
import random
from collections import defaultdict

import pytest

from graindeck.llm import golden, topn

ITEM = "g string, h string, score double, tie string, extra int, rank int"


@pytest.mark.parametrize("heavy, parts", [(0, 3), (50, 5), (10**9, 4)])
def test_top_n(spark, heavy, parts):
    rng = random.Random(heavy)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice(["x", None]), rng.choice([None, float("inf"), float(rng.randrange(12)), -0.5]), f"t{rng.randrange(400):03}", 1, 7) for _ in range(900)]
    rows += rows[:40]  # re-delivered
    got = defaultdict(list)
    for r in topn.top_n(spark.createDataFrame(rows, ITEM), ["g", "h"], "score", "tie", 7, heavy, parts).collect():
        got[(r.g, r.h)].append((r["rank"], r.score, r.tie))
    want = defaultdict(set)
    for g, h, s, t, *_ in rows:
        if s is not None:
            want[(g, h)].add((-s, t))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(i, -s, t) for i, (s, t) in enumerate(sorted(v)[:7], 1)] for k, v in want.items()}


def test_top_n_of_nothing(spark):
    assert topn.top_n(spark.createDataFrame([], ITEM), ["g"], "score", "tie", 3).count() == 0
    assert topn.top_n(spark.createDataFrame([("g", None, None, "t", 1, 1)], ITEM), ["g"], "score", "tie", 3).count() == 0


METRIC = "subject_key string, metric_id string, source_row_id string, numeric_value double, raw_text_value string, unit_code string, currency_code string, value_status string, effective_as_of date, source_id string"


def _rows(seed):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(pick("S:A", "s:a\t", " S:A ", "S:B", "S:C", None), pick("m1", "m2", None), f"r{rng.randrange(60)}" if rng.random() > 0.05 else None, pick(None, float("nan"), float("inf"), 0.0, 1.5, 2.5), pick(None, "", "t" * 5000, "x", "X "), pick(None, "%", "bp"), pick(None, None, "KRW"),
             pick("valid", "Valid", None, "parse_failed"), pick(None, dt.date(1900, 1, 1), dt.date(9999, 12, 31), dt.date(2026, 1, 1), dt.date(2026, 5, 5), dt.date(2026, 12, 31)), pick("s1", "s2", "s9", None)) for _ in range(160)]


def _tables(spark, rows):
    src = spark.createDataFrame([("s1", 1), ("s2", 2)], "source_id string, source_precedence int")
    return spark.createDataFrame(rows, METRIC).selectExpr("*", "9 AS precedence", "'z' AS subject", "0 AS vote"), src, spark.createDataFrame([("S:A",), ("S:B",)], "subject_key string")


@pytest.mark.parametrize("seed", range(3))
def test_golden(spark, seed):
    rows = [r for r in {(x[0], x[1], x[2]): x for x in _rows(seed)}.values()]  # one row per key
    rows += rows[:10]
    got = {(r.subject_key, r.metric_id, r.field_name): r.source_row_id for r in golden.found(*_tables(spark, rows)).collect()}
    groups, prec = defaultdict(list), {"s1": 1, "s2": 2}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            k = r[0].strip().lower()
            groups[({"s:a": "S:A", "s:b": "S:B"}.get(k, k), r[1])].append(r)
    want = {}
    for (s, m), rs in groups.items():
        if len({r[2] for r in rs} - {None}) < 2:
            continue
        for i, f in enumerate(golden.FIELDS, 3):
            ok = [r for r in rs if r[2] is not None and r[i] is not None and (i > 3 or abs(r[i]) < float("inf"))]
            if ok:
                order = lambda r: (r[7] != "valid", -(r[8].toordinal() if r[8] and dt.date(2000, 1, 1) <= r[8] <= dt.date(2026, 12, 31) else -1), prec.get(r[9], 10**9), r[2])
                want[(s, m, f)] = min(ok, key=order)[2]
    assert got == want


def test_golden_record_and_support(spark):
    d = dt.date(2026, 12, 31)
    rows = [("S:A", "m", "r1", 1.0, "one", "%", None, "valid", d, "s1"), ("S:A", "m", "r2", 2.0, "two", "%", "KRW", "valid", d, "s2"), ("S:A", "m", "r3", 1.0, None, None, None, "valid", None, "s2"), ("S:B", "m", "r4", 1.0, "x", "%", None, "valid", d, "s1")]
    out = golden.golden(*_tables(spark, rows)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.subject_key, r.numeric_value, r.numeric_value_row, r.unit_code, r.currency_code, r.currency_code_row) == ("S:A", 1.0, "r1", "%", "KRW", "r2")
    assert r.unit_code_support == 1.0 and 0.6 < r.numeric_value_support < 0.7


def test_golden_of_nothing(spark):
    assert golden.found(*_tables(spark, [])).count() == 0 and golden.golden(*_tables(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_heavy_subjects_give_the_same(spark, seed):
    rows = [r for r in {(x[0], x[1], x[2]): x for x in _rows(seed)}.values()]
    rows += rows[:20]
    m, src, _ = _tables(spark, rows)
    a, b = (sorted(map(str, golden.records(m, src, n).collect())) for n in (10**9, 3))
    assert a == b and len(a) > 2


def test_more_entries_than_ranks(spark):
    """Two hundred rows of one pair: the first in the order wins, though all later ones agree on another value."""
    d = dt.date(2026, 1, 1)
    rows = [("S:A", "m", f"r{i:03}", 7.0 if i else 1.0, "x", None, None, "valid", d, "s1") for i in range(200)]
    r = golden.golden(*_tables(spark, rows)).first()
    assert (r.numeric_value, r.numeric_value_row) == (1.0, "r000") and r.numeric_value_support == pytest.approx(1 / 200)

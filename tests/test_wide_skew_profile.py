"""Problems 2, 3 and 6."""
import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graindeck.functions import values as V
from graindeck.functions.identifiers import isin_valid
from graindeck.operators import profile, skew, wide

ATT = "subject_key string, attribute_id string, label_value string, effective_as_of date, source_row_id string"


@pytest.mark.parametrize("kind, a, b", [("string", " Equity  Growth", "equity growth"), ("string", "국내  주식형", "국내 주식형"), ("integer", "1,000", "1000.0"), ("decimal", "5.30 %", "5.3"), ("decimal", "-0", "0"), ("boolean", "예", "Y"), ("boolean", "부", "false"), ("date", "20240203", "2024년 2월 3일"), ("date", "2024/2/3", "2024-02-03")])
def test_equal_in_meaning(spark, kind, a, b):
    x, y = spark.createDataFrame([(a, b)], "a string, b string").select(V.by_type(F.col("a"), kind), V.by_type(F.col("b"), kind)).first()
    assert x is not None and x == y


@pytest.mark.parametrize("kind, text", [("string", " - "), ("string", ""), ("string", "미정"), ("integer", "TBD"), ("integer", "1,2a"), ("decimal", "NaN"), ("decimal", "Infinity"), ("decimal", "1e999"), ("boolean", "?"), ("boolean", "maybe"), ("date", "99991231"), ("date", "20240230"), ("date", "00000000"), ("date", "2024"), ("string", None), ("date", None)])
def test_no_value(spark, kind, text):
    assert spark.createDataFrame([(text,)], "a string").select(V.by_type(F.col("a"), kind)).first()[0] is None


def _wide(spark, rows, metrics=()):
    cat = spark.createDataFrame([("att:x", "string"), ("att:n", "integer"), ("att:d", "date"), ("att:b", "boolean")], "attribute_id string, value_type string")
    mcat = spark.createDataFrame([("met:c", "count")], "metric_id string, dimension string")
    subj = spark.createDataFrame([("F:A",), ("F:B",)], "subject_key string")
    a = wide.attribute_cells(spark.createDataFrame(rows, ATT).selectExpr("*", "'clash' AS value_type", "'clash' AS entity", "1 AS value"), cat)
    m = wide.metric_cells(spark.createDataFrame(list(metrics), "subject_key string, metric_id string, numeric_value double, value_status string, effective_as_of date, source_row_id string"), mcat)
    pairs = wide.resolved_pairs(a.unionByName(m))
    fields = wide.catalog_fields(cat, mcat)
    return wide.widen(pairs, fields, subj), wide.found(pairs, fields, subj)


def test_wide(spark):
    d1, d2 = dt.date(2026, 1, 1), dt.date(2026, 2, 1)
    rows = [("F:A", "att:x", "Alpha", d1, "1"), ("f:a\t", "att:x", " ALPHA ", d2, "2"), ("F:A", "att:n", "1,000", d1, "3"), ("F:A", "att:n", "2000", d2, "4"), ("F:A", "att:n", "2000", d2, "4"), ("F:A", "att:d", "20240230", d1, "5"), ("F:A", "att:b", "예", d1, "6"),
            (None, "att:x", "z", d1, "7"), ("F:A", None, "z", d1, "8"), ("F:B", "att:x", None, d1, "9"), ("F:B", "att:x", "", d1, "10"), ("F:B", "att:other", "v" * 200_000, None, "11"), ("F:Z", "att:b", "1", None, None)]
    metrics = [("F:A", "met:c", 5.0, "valid", d1, "m1"), ("F:A", "met:c", 6.0, "valid ", d2, "m2"), ("F:A", "met:c", float("nan"), "valid", d2, "m3"), ("F:B", "met:c", 1.0, "valid", d1, "m4"), ("F:B", "met:c", 2.0, "valid", d1, "m5")]
    w, found = _wide(spark, rows, metrics)
    got = {r.subject_key: r for r in w.collect()}
    a = got["F:A"]
    assert (a.att_x, a.att_n, a.att_b, a.att_d, a.met_c) == ("ALPHA", 2000, True, None, 5.0)
    assert a.cast_failures == {"att:d": "20240230", "met:c": "NaN"} and a.competing == ["att:n"]
    assert got["F:B"].others["att:other"] == "v" * 200_000 and got["F:B"].att_x is None
    assert got["f:z"].att_b is True  # not listed: its folded key
    assert {tuple(r) for r in found.collect()} == {("F:A", "att:n"), ("F:B", "met:c")}


def test_wide_empty(spark):
    w, found = _wide(spark, [])
    assert w.count() == 0 and found.count() == 0


@pytest.mark.parametrize("salts, share", [(1, 2.0), (8, 0.05), (64, 0.0)])
def test_per_key_is_exact(spark, salts, share):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 60 + ["warm"] * 20 + [f"k{i}" for i in range(20)] + [None]), f"r{i}", rng.choice([None, 1.5, 2.0]), rng.choice([None, *"abcdef"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "key string, id string, w double, item string")
    got = {r["key"]: (r["n_rows"], r["total_weight"], r["n_items"]) for r in skew.per_key(df, "key", "id", "w", "item", salts, share).collect()}
    want = defaultdict(lambda: [0, None, set()])
    for k, _, w, it in rows:
        want[k][0] += 1
        want[k][1] = (want[k][1] or 0) + w if w is not None else want[k][1]
        want[k][2] |= {it} - {None}
    assert got == {k: (n, s, len(i)) for k, (n, s, i) in want.items()}
    share_of = {r["key"] for r in skew.found(skew.per_key(df, "key", "id"), "key", 0.1).collect()}
    assert share_of == {k for k, n in Counter(r[0] for r in rows).items() if k and n >= 200}


def test_heavy_keys_are_spread(spark):
    df = spark.createDataFrame([("hot" if i < 900 else f"k{i}", f"r{i}") for i in range(1000)], "key string, id string")
    s = skew.salted(df, "key", F.col("id"), 16, 0.05)
    assert s.where("key = 'hot'").select("__salt").distinct().count() == 16 and s.where("key <> 'hot' AND __salt <> 0").count() == 0


def test_per_key_empty(spark):
    df = spark.createDataFrame([], "key string, id string")
    assert skew.per_key(df, "key", "id").count() == 0 and skew.found(skew.per_key(df, "key", "id"), "key", 0.1).count() == 0


def test_isin(spark):
    texts = ["US0378331005", "US0378331006", "KR7005930003", "us0378331005", "", None, "US03783310050"]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(isin_valid(F.col("x"))).collect()] == [True, False, True, False, False, False, False]


def _loads(spark):
    rng = random.Random(9)
    rows = []
    for load, status, mu in (("a1", ["ok"] * 9 + ["bad"], 0), ("a2", ["ok"] * 5 + ["bad"] * 5, 1), ("b1", ["ok", None], 0)):
        rows += [(load, rng.choice(status), rng.choice([None, float("nan"), float("inf"), round(rng.gauss(mu, 1), 1)]), rng.choice(["", "x", None, "y" * 1000]), dt.date(2026, 1, 1 + rng.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame(rows, "source_id string, status string, v double, text string, day date")
    src = spark.createDataFrame([("a1", "A", "2026-01-01"), ("a2", "A", "2026-02-01"), ("a0", "A", "2025-12-01"), ("b1", "B", "2026-01-01")], "source_id string, source_name string, collected_at string")
    return rows, df, src


def test_column_profile_is_exact(spark):
    rows, df, _ = _loads(spark)
    got = {r.column_name: r for r in profile.column_profile(profile.value_counts(df, "source_id"), partitions=5).collect()}
    for i, c in enumerate(df.columns):
        have = [r[i] for r in rows if r[i] is not None]
        keys = sorted({str(x): x for x in have}.items(), key=lambda kv: (kv[1] != kv[1], kv[1]) if c == "v" else kv[0])
        r = got[c]
        assert (r.n_rows, r.n_null, r.n_distinct) == (len(rows), len(rows) - len(have), len(keys))
        if c == "day":
            ordered = sorted(have)
            assert r.minimum == str(ordered[0]) and r.maximum == str(ordered[-1])
            assert {p: r.quantiles[p] for p in ("0.25", "0.5", "0.99")} == {p: str(ordered[-(-int(float(p) * 100) * len(ordered) // 100) - 1]) for p in ("0.25", "0.5", "0.99")}
        if c == "v":
            ordered = sorted(have, key=lambda x: (x != x, x))
            assert float(r.quantiles["0.5"]) == ordered[-(-len(ordered) // 2) - 1] and r.maximum == "NaN"


def test_load_shifts_are_exact(spark):
    rows, df, src = _loads(spark)
    got = {(r.column_name, r.load): r for r in profile.load_shifts(profile.value_counts(df, "source_id"), src, partitions=5).collect()}
    assert {k[1] for k in got} == {"a2"}  # b1 has no load before it, a0 has no rows
    for i, c in enumerate(df.columns[1:], 1):
        a, b = ([r[i] for r in rows if r[0] == load] for load in ("a1", "a2"))
        ca, cb = (Counter("NaN" if x != x else x for x in s if x is not None) for s in (a, b))
        share = max(abs(cb[k] / len(b) - ca[k] / len(a)) for k in {*ca, *cb})
        assert got[(c, "a2")].share_change == pytest.approx(share)
        assert got[(c, "a2")].null_change == pytest.approx(abs(b.count(None) / len(b) - a.count(None) / len(a)))
        order = sorted({*ca, *cb}, key=lambda x: (x == "NaN", 0 if x == "NaN" else x) if c == "v" else x)
        na, nb, fa, fb, ks = sum(ca.values()), sum(cb.values()), 0, 0, 0
        for k in order:
            fa, fb = fa + ca[k] / na, fb + cb[k] / nb
            ks = max(ks, abs(fa - fb))
        assert got[(c, "a2")].ks == pytest.approx(ks)


def test_violations(spark):
    m = spark.createDataFrame([("m", "1", "valid", 1.0, "1"), ("m", "2", "valid", 0.0, "0"), ("m", "3", "Valid", 1.0, "1"), ("m", "4", "zero_excluded", 0.0, "none"), ("m", "5", "parse_failed", None, "x"), ("m", "6", "parse_failed", 2.0, None), ("m", "7", None, 2.0, ""), ("m", "2", "valid", 0.0, "0"), ("m", "8", "valid", float("nan"), "9"), ("m", "9", "date_parse_failed", None, None)],
                              "metric_id string, source_row_id string, value_status string, numeric_value double, raw_text_value string")
    got = sorted((r.column_name, r.item_key) for r in profile.metric_violations(m).collect())
    assert got == [("raw_text_value", "m@4"), ("raw_text_value", "m@7"), ("value_status", "m@2"), ("value_status", "m@3"), ("value_status", "m@6"), ("value_status", "m@7"), ("value_status", "m@8")]
    h = spark.createDataFrame([("a", "absent", None), ("b", "absent", "X"), ("c", "format_matched", None), ("d", "checksum_verified", "US0378331005"), ("e", "checksum_verified", "US0378331006"), ("f", "odd", "X"), ("g", None, None)], "holding_key string, identifier_status string, held_security_id_raw string")
    assert sorted(r.item_key for r in profile.holding_violations(h).collect()) == ["b", "c", "e", "f", "g"]


def test_profile_of_nothing(spark):
    df = spark.createDataFrame([], "source_id string, v double, load string")
    src = spark.createDataFrame([], "source_id string, source_name string, collected_at string")
    assert profile.column_profile(profile.value_counts(df, "source_id")).count() == 0 and profile.load_shifts(profile.value_counts(df, "source_id"), src).count() == 0
    nulls = spark.createDataFrame([("a", None)], "source_id string, v double")
    r = {x.column_name: x for x in profile.column_profile(profile.value_counts(nulls, "source_id")).collect()}["v"]
    assert (r.n_null, r.n_distinct, r.minimum, r.quantiles) == (1, 0, None, {})

"""Projection, rules, joins, aggregates and selection on literal rows."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graindeck.operators import aggregate as A
from graindeck.operators import observe as O
from graindeck.operators import relate as R
from graindeck.operators import select as S


def _one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_typed(spark):
    t = [("1.5",), (" 2 ",), ("1e3",), ("x",), ("",), (None,), ("-1.5",)]
    assert _one(spark, t, "x string", O.typed("x", "bigint")) == [(2,), (2,), (1000,), (None,), (None,), (None,), (-2,)]
    assert _one(spark, t, "x string", O.typed("x", "double precision"))[:4] == [(1.5,), (2.0,), (1000.0,), (None,)]
    with pytest.raises(ValueError):
        O.typed("x", "money")
    assert O.role_of("numeric(10,0)") == "integer_unverified_zero_semantics" and O.role_of("numeric(10,2)") == "measure" and O.role_of("text") == "label_or_code"


def test_dates(spark):
    rows = [("20240203",), ("2024-02-03",), ("20240231",), ("2024",), ("",), (None,)]
    got = _one(spark, rows, "x string", O.strict_date("x"), O.date_status(F.col("x"), O.strict_date("x")))
    assert got == [(dt.date(2024, 2, 3), "valid"), (dt.date(2024, 2, 3), "valid"), (None, "date_parse_failed"), (None, "date_parse_failed"), (None, "valid"), (None, "valid")]


def test_statuses(spark):
    assert _one(spark, [(None,), (0.0,), (1.0,)], "x double", O.metric_status(F.col("x"))) == [("parse_failed",), ("zero_excluded",), ("valid",)]
    d = dt.date(2024, 1, 1)
    assert _one(spark, [(True, d), (True, None), (False, d)], "f boolean, d date", O.as_of_status(F.col("f"), F.col("d"))) == [("effective_declared",), ("unknown",), ("not_declared",)]


def test_rules(spark):
    raw = [("US0378331005",), ("005930",), ("AB12CD",), ("x y",), (" ",), (None,)]
    got = _one(spark, raw, "x string", *O.classify_identifier(F.col("x")))
    assert [g[1] for g in got] == ["format_matched", "format_matched", "unverified_scheme", "unverified_scheme", "absent", "absent"] and [g[2] for g in got] == [True, True, False, False, False, False]
    assert _one(spark, [("F000",), ("A1",), ("",), (None,)], "x string", O.official_status(F.col("x"))) == [("placeholder",), ("declared_by_source",), ("absent",), ("absent",)]
    k, p = O.relation_kind(F.col("f"), F.col("s"))
    rows = [("public_fund", "[level1:direct]"), ("public_fund", "[level2:lookthrough parent=M1]"), ("public_fund", "other"), ("domestic_etp", "a"), ("domestic_etp", None), ("x", "a")]
    assert _one(spark, rows, "f string, s string", k, p) == [("direct_holding", None), ("look_through_exposure", "M1"), ("unclassified", None), ("direct_holding", None), ("unclassified", None), ("unclassified", None)]


def test_unpivot_keeps_every_cell(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0), (2, None, 3.0)], "k int, a double, b double")
    got = {(r.k, r.metric_id): r.value_status for r in O.unpivot_metrics(df, ["k"], {"m:a": ("a", "u"), "m:b": ("b", "u")}).collect()}
    assert got == {(1, "m:a"): "valid", (1, "m:b"): "zero_excluded", (2, "m:a"): "parse_failed", (2, "m:b"): "valid"}
    df = spark.createDataFrame([(1, "20240101", " "), (2, "bad", "L")], "k int, d string, l string")
    got = {(r.k, r.attribute_id): (r.label_value, r.date_value, r.value_status) for r in O.unpivot_attributes(df, ["k"], {"d": {"date": "d"}, "l": {"label": "l"}}).collect()}
    assert got == {(1, "d"): ("20240101", dt.date(2024, 1, 1), "valid"), (2, "d"): ("bad", None, "date_parse_failed"), (2, "l"): ("L", None, "valid")}


def test_guards():
    for bad in ("a b", "a;drop", "1a", ""):
        with pytest.raises(ValueError):
            O.safe_column(bad)
    with pytest.raises(ValueError):
        O.compare(F.col("x"), "gt", 1, "label_or_code")
    for bad in (0, -1, 1.5, True, "3", None):
        with pytest.raises(ValueError):
            S.positive_limit(bad)


def test_anti_joins(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (None,)], "k int")
    assert [tuple(r) for r in R.null_aware_anti(a, b, "k").collect()] == [(1,)]
    assert [tuple(r) for r in R.dangling(a, "k", b.withColumnRenamed("k", "p"), "p").collect()] == [(1,)]
    assert sorted((r.k or 0, r.matched) for r in R.with_match_flag(a, b, "k").collect()) == [(0, False), (1, False), (2, True)]


def test_relation_does_not_multiply(spark):
    m = spark.createDataFrame([("s1", "f", "p1"), ("s1", "f", "p1"), ("s1", "f", "p2"), ("s2", "f", None)], "subject_key string, family_id string, portfolio_key string")
    h = spark.createDataFrame([("p1", "direct", "x"), ("p1", "direct", "x"), ("p2", "direct", "x"), ("p2", "other", "y"), (None, "direct", "z"), ("p1", "direct", None)], "portfolio_key string, relation_kind string, security_key string")
    assert {(r.subject_key, r.relation_kind): r.n_securities for r in R.forward(m, h).collect()} == {("s1", "direct"): 1, ("s1", "other"): 1}
    fwd = {tuple(r) for r in R.relation(m, h).select("subject_key", "relation_kind", "security_key").collect()}
    assert sum(r.n_subjects for r in R.inverse(m, h).collect()) == len(fwd)  # both directions see the same edges
    assert R.holding_any(spark.createDataFrame([("s1",), ("s2",)], "subject_key string"), m, h, F.lit(True)).count() == 1


def test_closure_with_cycles(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (None, 1)], "a int, b int")
    got = {tuple(r) for r in R.closure(e, "a", "b").collect()}
    want = {(i, j) for i in range(41) for j in range(i + 1, 41)} | {(100, 101), (101, 100), (100, 100), (101, 101)}
    assert got == want
    assert R.closure(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_containment(spark):
    t = spark.createDataFrame([(1, "a fund of funds"), (2, "bond"), (3, None), (4, "")], "id int, text string")
    f = spark.createDataFrame([("fund",), ("of funds",), ("on",)], "form string")
    assert {(r.id, r.form) for r in R.containment(t, "text", f, "form").collect()} == {(1, "fund"), (1, "of funds"), (2, "on")}
    assert {(r.id, r.form) for r in R.containment_of_words(t, "text", f, "form", 2).collect()} == {(1, "fund"), (1, "of funds")}
    with pytest.raises(ValueError):
        R.containment(t, "text", f, "form", bound=2)


@pytest.mark.parametrize("seed, most", [(1, 12), (2, 2), (3, 1)])
def test_containment_of_any_vocabulary(spark, seed, most):
    import random

    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("ab가 ") for _ in range(rng.randrange(a, b)))
    texts, forms = [(i, word(0, 25)) for i in range(80)] + [(99, None)], [word(1, 6) for _ in range(40)] + ["", "no such"]
    got = R.containment_any(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame([(f,) for f in forms + forms[:3]], "form string"), "form", most).collect()
    assert sorted(map(tuple, got)) == sorted({(i, f) for i, t in texts for f in forms if f and t and f in t})
    assert R.containment_any(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame([], "form string"), "form").count() == 0


def test_mismatches(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string"), spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k int, v string")
    assert {tuple(r) for r in R.mismatches(a, b, "k", ["v"]).collect()} == {(1, "missing_right"), (4, "missing_left"), (2, "v")}


def test_aggregates(spark):
    df = spark.createDataFrame([("g", None, 1, 3.0), ("g", "b", 2, 1.0), ("g", "a", 3, 2.0), ("g", "a", 4, 9.0), ("h", None, 1, None)], "g string, x string, o int, v double")
    assert {r.g: r.f for r in df.groupBy("g").agg(A.first_by("x", "o").alias("f")).collect()} == {"g": "b", "h": None}
    assert {r.g: r.upper_median for r in A.upper_median(df, ["g"], "v").collect()} == {"g": 3.0}
    vals = [random.Random(1).randrange(50) for _ in range(101)]
    big = spark.createDataFrame([("g", float(v)) for v in vals], "g string, v double")
    assert A.upper_median(big, ["g"], "v").first().upper_median == sorted(vals)[len(vals) // 2]
    assert df.agg(A.percentile_linear("v", 0.5), A.percentile_nearest_rank("v", 0.5)).first()[:] == (2.5, 2.0)
    u = A.uniqueness(df, ["g", "x"]).first()
    assert (u.n_rows, u.n_keys, u.n_null_keys, u.is_unique) == (5, 4, 2, False)
    s = {r.column_name: r for r in A.column_statistics(spark.createDataFrame([(" 1",), ("0",), ("x",), ("",), (None,)], "c string"), ["c"]).collect()}["c"]
    assert (s.n_rows, s.n_nonblank, s.n_castfail, s.n_padded, s.n_zero) == (5, 3, 1, 1, 1)


def test_latest(spark):
    d = [dt.date(2024, 1, 1), dt.date(2024, 2, 1)]
    o = spark.createDataFrame([("s", d[0], "r1", 1.0), ("s", d[1], "r3", 3.0), ("s", d[1], "r2", 2.0), ("s", None, "r0", 9.0), ("t", None, "r9", 4.0), (None, d[0], "r8", 5.0)], "subject_key string, effective_as_of date, source_row_id string, v double")
    assert {r.subject_key: r.v for r in S.latest_per_subject(o, ["v"]).collect()} == {"s": 2.0, "t": 4.0}


def test_selection(spark):
    df = spark.createDataFrame([(i % 3, i, None if i == 4 else float(i)) for i in range(12)], "g int, k int, v double")
    assert [r.k for r in S.top_k(df, "v", "k", 3).collect()] == [11, 10, 9] and S.top_k(df, "v", "k", 12, False).collect()[-1].k == 4
    assert S.bounded_sample(df, ["g"], [F.col("k")], 2).count() == 6
    up, down = ([r.k for r in S.top_k(df.where("v is not null"), "v", "k", 11, x).collect()] for x in (True, False))
    assert up == down[::-1]
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank int")
    assert {(r.id, r.path) for r in S.ordered_union([a, b], "id").collect()} == {(1, 0), (2, 0), (3, 1)}
    c = spark.createDataFrame([(0, 5, 1, "ds", None), (1, 4, 1, "f1", "ds"), (1, 3, 1, "f2", "gone"), (1, 2, 1, "f3", "ds")], "tier int, longest int, matches int, term string, owner string")
    assert {r.term: r.reason for r in S.admit(c, 2).collect()} == {"ds": "admitted", "f1": "admitted", "f2": "owner_not_admitted", "f3": "over_budget"}


def test_words_of_long_texts_in_one_split(spark):
    """A text is split once, not once for each of its words; forms are broadcast, or joined where they are many."""
    import time

    n = 30_000
    t = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)) + " Fund, of FUNDS"), (2, "no"), (3, None), (4, "")], "id int, text string")
    f = spark.createDataFrame([("fund",), ("Of funds",), ("w7 w8 w9",), ("w7 w9",), ("no",)], "form string")
    for words, bound in ((3, 10), (3, 2), (1, 10)):
        began = time.time()
        got = {(r.id, r.form) for r in R.containment_of_words(t, "text", f, "form", words, bound).select("id", "form").collect()}
        assert got == {(1, "fund"), (2, "no")} | ({(1, "Of funds"), (1, "w7 w8 w9")} if words == 3 else set())
        assert time.time() - began < 40


@pytest.mark.parametrize("reach, bound", [(64, 100), (3, 100), (64, 2), (2, 2)])
def test_containment_joins_only_beginnings_of_forms(spark, reach, bound):
    """Long forms, characters beyond the first plane, few and many forms; stretches that begin no form aren't joined."""
    texts = [(1, "가나다라마" * 40 + "끝"), (2, "x😀y😀z"), (3, "ab" * 30 + "c"), (4, ""), (5, None), (6, "none")]
    forms = ["나다라마가나다라마", "다라마가나다라마끝", "😀y", "ababc", "abc" * 9, "ab" * 29 + "abc", "마끝", "no such"]
    got = R.containment_any(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame([(f,) for f in forms], "form string"), "form", 12, reach, bound)
    assert sorted(map(tuple, got.collect())) == sorted((i, f) for i, x in texts for f in forms if x and f in x)
    some = spark.createDataFrame(texts, "key int, text string").where("length(text) > 1")
    assert R._proposed(some, 2, 2, np.sort(R._stretch_hashes(R._points("😀yb"), 2))).count() == 1

"""Registered queries over small tables against brute force: the whole job, not a part of it."""
import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graindeck.operators import evaluate as E
from graindeck.operators import relate
from graindeck.operators import retrieve as R

NAMES = ["large widget", "red widget", "red wide", "Large Widget", "blue bolt"]


def _fragment(form, question):
    """The longest proper fragment that stands in the question, of at least two characters and 0.6 of the form."""
    for size in range(len(form) - 1, max(2, -(-len(form) * 6 // 10)) - 1, -1):
        for i in range(len(form) - size + 1):
            if form[i : i + size] in question:
                return form[i : i + size]
    return None


def _matches():
    """(question_id, form_id, semantic_id, normal, tier, starts and reach) of every question and form."""
    forms = {("label", n) for n in NAMES} | {("alias", w) for n in NAMES for w in n.split(" ")}
    out = []
    for q, question in enumerate(NAMES, 1):
        qn = question.lower().replace(" ", "")
        for role, text in forms:
            n = text.lower().replace(" ", "")
            part = _fragment(n, qn)
            tier = "exact" if question == text else "normalized" if qn == n else "phrase" if n in qn else "substring" if part else None
            if tier:
                span = part if tier == "substring" else n
                starts = [i for i in range(len(qn)) if qn.startswith(span, i)]
                out.append((q, f"{role}:{text}", "t:" + text.lower(), n, tier, starts, len(span)))
    return out


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("parts"))
    spark.createDataFrame(list(enumerate(NAMES, 1)), "p_partkey bigint, p_name string").write.parquet(f"{d}/part.parquet")
    return d


def test_four_tiers_reach_the_queries(spark, parts):
    want = _matches()
    assert {m[4] for m in want} == {"exact", "normalized", "phrase", "substring"}
    run = lambda name: entry.queries()[name](spark, parts).collect()
    assert Counter((r.question_id, r.form_id, r.tier) for r in run("i3_tiers")) == Counter((m[0], m[1], m[4]) for m in want)
    # every phrase here is a word or name inside the longer whole name
    assert Counter((r.question_id, r.form_id, r.tier) for r in run("i4_shadowed")) == Counter((m[0], m[1], "substring" if m[4] == "phrase" else m[4]) for m in want)
    order = ["exact", "normalized", "phrase", "substring"]
    best = {}
    for q, _, term, _, tier, *_ in want:
        best[q, term] = min(best.get((q, term), tier), tier, key=order.index)
    assert {(r.question_id, r.semantic_id): r.tier for r in run("i5_best_per_term")} == best


def test_probe_and_ledger_scan_for_whole_forms(spark, parts):
    want = [m for m in _matches() if m[4] != "substring"]
    probe = {}
    for q, _, term, normal, *_ in want:
        longest, n = probe.get((q, term), (0, 0))
        probe[q, term] = (max(longest, len(normal)), n + 1)
    run = lambda name: entry.queries()[name](spark, parts).collect()
    assert {(r.question_id, r.semantic_id): (r.longest, r.matches) for r in run("i17_lexical_probe")} == probe
    assert Counter((r.question_id, r.form_id, r.start, r.length) for r in run("m18_span_ledger")) == Counter((m[0], m[1], s, m[6]) for m in want for s in m[5])


def test_every_stated_query_is_searched(spark, tmp_path):
    v = np.random.default_rng(7).normal(size=(130, 6)).astype(np.float32)
    label = [i * 7 % 11 for i in range(130)]
    spark.createDataFrame([(i, [float(y) for y in x], label[i]) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    queries = [0, 50, 100]
    s = v.astype(float) @ v[queries].astype(float).T
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.vec_id): r.score for r in run("h16_dot_product")} == pytest.approx({(q, i): s[i, k] for k, q in enumerate(queries) for i in range(130)}, abs=1e-5)
    ranked = {q: sorted(range(130), key=lambda i: (-s[i, k], i)) for k, q in enumerate(queries)}
    assert sorted((r.query_id, r.vec_id) for r in run("f4_vector_topk")) == sorted((q, i) for q in queries for i in ranked[q][:20])
    first = {q: list({label[i]: i for i in reversed(ranked[q])}.items()) for q in queries}
    want = [(q, x, i) for k, q in enumerate(queries) for x, i in sorted(first[q], key=lambda p: (-s[p[1], k], p[0]))[:5]]
    assert sorted((r.query_id, r.label, r.vec_id) for r in run("f5_topk_after_dedup")) == sorted(want)


def _write(spark, d, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")


def test_wide_keeps_values_of_unknown_unit(spark, tmp_path):
    day = dt.date(2026, 3, 1)
    metric = lambda s, m, v, unit, cur, row: (s, m, v, None, unit, cur, day, "src", row, "valid")
    rows = [metric("A", "met:fee", 2.5, None, None, "r1"), metric("A", "met:aum", 7.0, "million", None, "r2"), metric("B", "met:fee", 30.0, "bp", None, None), metric("B", "met:fee", 30.0, "bp", None, None),
            metric("B", "met:aum", float("nan"), "KRW", None, "r3"), metric("C", "met:fee", 4.0, None, None, None), metric("C", "met:aum", 2.0, "thousand", "KRW", None)]
    _write(spark, tmp_path, metric_observation=(rows, "subject_key string, metric_id string, numeric_value double, raw_text_value string, unit_code string, currency_code string, effective_as_of date, source_id string, source_row_id string, value_status string"),
           metric_catalog=([("met:fee", "share"), ("met:aum", "amount")], "metric_id string, dimension string"), attribute_catalog=([("att:x", "string")], "attribute_id string, value_type string"),
           attribute_observation=([("A", "att:x", "word", day, "a1")], "subject_key string, attribute_id string, label_value string, effective_as_of date, source_row_id string"), subject=([("A",), ("B",), ("C",)], "subject_key string"),
           data_source=([("src", None)], "source_id string, note string"), currency_rate=([("KRW", 1.0), ("USD", 1400.0)], "currency_code string, krw_per_unit double"),
           unit_reference=([("percent_observed", "share", 1.0), ("basis_point", "share", 0.01), ("currency_amount", "amount", 1.0), ("thousand", "amount", 1e3), ("million", "amount", 1e6)], "unit_id string, dimension string, factor_to_common double"))
    got = {r.subject_key: r for r in entry.queries()["p2_wide"](spark, str(tmp_path)).collect()}
    assert got["A"].cast_failures == {"met:fee": "2.5", "met:aum": "7.0 million"} and got["A"].met_fee is None
    assert got["B"].met_fee == pytest.approx(0.3) and got["B"].cast_failures == {"met:aum": "NaN KRW"} and got["B"].competing == []
    assert got["C"].met_aum == pytest.approx(2000.0) and got["C"].cast_failures == {"met:fee": "4.0"}


def test_spellings_of_a_subject_are_one(spark, tmp_path):
    day = dt.date(2026, 8, 3)
    row = lambda s, m, v, d, r: (s, "overseas_etp", "product", m, v, f"{v}", d, "valid", "src", r)
    rows = [row("AB 1", "met:return_3m", 1.0, dt.date(2026, 8, 1), "r1"), row("ab1", "met:return_3m", 5.0, day, "r2"), row("AB1", "met:nav_per_unit", 9.0, day, "r3"), row("CD2", "met:return_3m", 4.0, day, "r4"),
            row("cd2", "met:nav_per_unit", 8.0, day, "r5"), row("ab1 ", "met:holder_count", 3.0, day, "r6"), row("AB1", "met:holder_count", 2.0, dt.date(2026, 8, 1), "r7")]
    _write(spark, tmp_path, metric_observation=(rows, "subject_key string, family_id string, subject_grain string, metric_id string, numeric_value double, raw_text_value string, effective_as_of date, value_status string, source_id string, source_row_id string"),
           subject=([("AB1", "overseas_etp", "product"), ("CD2", "overseas_etp", "product")], "subject_key string, family_id string, subject_grain string"), data_source=([("src", True, "aa")], "source_id string, hash_matches boolean, sha256 string"))
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    for name in ("j5_governed_topk", "j6_snapshot_check"):
        assert [(r.subject_key, r.order_value, r.display_value, r.universe, r.population, r.duplicates) for r in sorted(run(name))] == [("AB1", 5.0, 9.0, 2, 2, 0), ("CD2", 4.0, 8.0, 2, 2, 0)]
    assert sorted((r.subject_key, r.value) for r in run("j4_selected_observations")) == [("AB1", 5.0), ("CD2", 4.0)]
    assert [(r.subject_key, r.numeric_value) for r in run("j14_metric_rank")] == [("AB1", 3.0)]
    assert sorted((r.subject_key, r.source_row_id) for r in run("e1_latest_per_subject")) == [("AB1", "r2"), ("CD2", "r4")]
    assert [(r.universe, r.lo) for r in run("e5_window_evidence")] == [(2, day)]
    assert sorted((r.subject_key, r.n_rows, r.n_sources) for r in run("d1_entity_rollup")) == [("AB1", 5, 1), ("CD2", 2, 1)]
    assert sorted((r.subject_key, r.first_text) for r in run("d2_arg_min_first")) == [("AB1", "1.0"), ("CD2", "4.0")]
    assert {r.metric_id: r.n_valid for r in run("d5_status_distincts")} == {"met:return_3m": 2, "met:nav_per_unit": 2, "met:holder_count": 1}
    assert {r.metric_id: (r.n_subjects, r.max_rows_per_subject, r.missing_subjects) for r in run("d6_semantic_coverage")} == {"met:return_3m": (2, 2, 0), "met:nav_per_unit": (2, 1, 0), "met:holder_count": (1, 2, 1)}
    assert {r.metric_id: r.state for r in run("j9_l9_coverage_state")} == {"met:return_3m": "observed", "met:nav_per_unit": "observed", "met:holder_count": "observed"}


def test_closure_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a int, b int")
    assert relate.closure(chain, "a", "b").count() == 300 * 301 // 2


@pytest.fixture(scope="module")
def many_parts(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("many")
    _write(spark, d, part=([(i, ["red bolt", "old red rod", "gear"][i % 3]) for i in range(90)] + [(90, None)], "p_partkey bigint, p_name string"))
    return str(d)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bound, kind", [(100_000, "BroadcastHashJoin"), (2, "SortMergeJoin")])
def test_case_ledger_never_broadcasts_places(spark, many_parts, bound, kind):
    """The places of a question are many times the question, which Spark's estimate doesn't know."""
    q = spark.read.parquet(f"{many_parts}/part.parquet").select(F.col("p_partkey").alias("question_id"), F.col("p_name").alias("question"))
    s = E.scan_forms(q, spark.createDataFrame([(w, w) for w in ("red", "red rod", "bolt", "gear")], "form_id string, text string"), bound)
    assert "BuildLeft" not in _plan(s) and kind in _plan(s)
    got = {r.question_id: sorted((x.start, x.form_id) for x in r.spans) for r in s.collect()}
    want = {0: [(0, "red"), (4, "bolt")], 1: [(4, "red"), (4, "red rod")], 2: [(0, "gear")]}
    assert got == {i: want[i % 3] for i in range(90)}
    cases = {r.question_id: (r.n_anchors, r.n_found, r.n_swallowed, r.collapsed) for r in entry.queries()["m26_case_ledger"](spark, many_parts).collect()}
    assert cases == {i: (3, 3, 0, "comparison") if i % 3 == 2 else (3, 2, 1, "comparison") for i in range(90)}


def test_question_ledger_of_repeated_names(spark, many_parts):
    """Every part gets the ledger of its name, and what is joined to it is no broadcast."""
    df = entry.queries()["m18_question_ledger"](spark, many_parts)
    assert "BuildLeft" not in _plan(df)
    got = {}
    for r in df.collect():
        got.setdefault(r.question_id, []).append((r.place, r.text, r.state, r.frame))
    want = lambda n: [(0, n, "form", 1), (1, "top", "direction", 1), (2, "5", "number", 1), (3, "zzz", "unknown", 1), (4, "highest,", "direction", 1), (5, n.split()[0], "form", 2)]
    assert {k: sorted(v) for k, v in got.items()} == {i: want(["red bolt", "old red rod", "gear"][i % 3]) for i in range(90)}


@pytest.mark.parametrize("few, kind", [(100_000, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_candidates_of_whole_forms(spark, many_parts, few, kind):
    """Without fragments exactly the forms that stand in a question whole are candidates, and no stretches of questions are broadcast."""
    q = spark.read.parquet(f"{many_parts}/part.parquet").where("p_name IS NOT NULL").select(F.col("p_partkey").alias("question_id"), F.col("p_name").alias("question"), F.regexp_replace("p_name", " ", "").alias("question_normal"))
    f = spark.createDataFrame([(w, w, r, w, w) for w, r in (("red", "alias"), ("rodd", "label"), ("bolt", "id"), ("gear", "label"), ("dr", "definition"))], "form_id string, semantic_id string, role string, text string, normal string")
    pairs = R.candidate_pairs(q, f, fragments=False, few=few)
    assert "BuildLeft" not in _plan(pairs) and kind in _plan(pairs)
    want = {0: {"red", "bolt"}, 1: {"red", "dr"}, 2: {"gear"}}
    assert sorted((r.question_id, r.form_id) for r in pairs.collect()) == sorted((i, w) for i in range(90) for w in want[i % 3])
    got = {}
    for r in entry.queries()["i4_shadowed_or_free"](spark, many_parts).collect():
        got.setdefault(r.question_id, []).append((r.form_id, r.tier))
    tiers = {0: [("alias:bolt", "substring"), ("alias:red", "phrase"), ("label:red bolt", "phrase")], 1: [("alias:old", "phrase"), ("alias:red", "substring"), ("alias:rod", "substring"), ("label:old red rod", "phrase")], 2: [("alias:gear", "phrase"), ("label:gear", "phrase")]}
    assert {k: sorted(v) for k, v in got.items()} == {i: tiers[i % 3] for i in range(90)}

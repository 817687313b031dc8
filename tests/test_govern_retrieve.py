"""Governed execution, retrieval, spans, records, evaluation, quality."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from graindeck.functions import records as Rec
from graindeck.functions import references as Ref
from graindeck.functions import spans as K
from graindeck.functions import text as T
from graindeck.functions.vectors import dot, unit
from graindeck.operators import evaluate as E
from graindeck.operators import govern as G
from graindeck.operators import quality as Q
from graindeck.operators import retrieve as R

D = dt.date(2026, 8, 21)
ORDER = G.Binding("rank", "family_a", "product", "obs", "field_id", "rank", "numeric_value", zero_semantics="excluded", coverage="full", selection="unique_per_subject")
SHOW = G.Binding("display", "family_a", "product", "obs", "field_id", "display", "label_value", coverage="full", selection="unique_per_subject")


def _obs(spark, change=None):
    rows = [[f"p{i}", "display", None, n, D, "valid", "source_a", f"d{i}"] for i, n in enumerate(["One", "Two", "Three", "Four"], 1)]
    rows += [[f"p{i}", "rank", v, None, D, "zero_excluded" if v == 0 else "valid", "source_a", f"r{i}"] for i, v in enumerate([1.0, 3.0, 2.0, 0.0], 1)]
    if change:
        change(rows)
    o = spark.createDataFrame([tuple(r) for r in rows], "subject_key string, field_id string, numeric_value double, label_value string, effective_as_of date, value_status string, source_id string, source_row_id string")
    subjects = spark.createDataFrame([(f"p{i}", "family_a", "product") for i in range(1, 5)], "subject_key string, family_id string, subject_grain string")
    return o, subjects


def _run(spark, change=None, sources=(("source_a", True, "aa"),), n=2, as_of=None, order=ORDER):
    o, s = _obs(spark, change)
    src = spark.createDataFrame(list(sources), "source_id string, hash_matches boolean, sha256 string")
    return G.execute(G.governed_top_k(o, o, order, SHOW, src, s, n, as_of))


def test_top_k_with_evidence(spark):
    status, rows = _run(spark)
    assert status == "ok" and [(r.order_value, r.display_value) for r in rows] == [(3.0, "Two"), (2.0, "Three")]
    assert rows[0].universe == 3 and rows[0].population == 4 and rows[0].coverage == "observed" and not rows[0].global_ranking_claim_allowed


def test_full_coverage_may_claim(spark):
    status, rows = _run(spark, lambda r: r[7].__setitem__(slice(2, 6), [4.0, None, D, "valid"]))
    assert status == "ok" and rows[0].coverage == "full" and rows[0].global_ranking_claim_allowed


@pytest.mark.parametrize("change, sources, code", [
    (lambda r: r.append(["p1", "rank", 9.0, None, D, "valid", "source_a", "r9"]), (("source_a", True, "aa"),), "duplicate_subjects"),
    (lambda r: r[4].__setitem__(4, None), (("source_a", True, "aa"),), "snapshot_incompatible"),
    (lambda r: r[4].__setitem__(4, dt.date(2026, 1, 1)), (("source_a", True, "aa"),), "snapshot_incompatible"),
    (None, (("source_a", False, "aa"),), "source_not_verified"), (None, (("other", True, "aa"),), "source_not_verified"), (None, (("source_a", True, ""),), "source_not_verified")])
def test_fails_closed(spark, change, sources, code):
    assert _run(spark, change, sources) == (code, [])


def test_requested_date(spark):
    assert _run(spark, as_of="2026-08-21")[0] == "ok" and _run(spark, as_of="2026-08-20") == ("as_of_unavailable_or_empty", [])


def test_limit_is_monotone(spark):
    assert [r.subject_key for r in _run(spark, n=3)[1]][:2] == [r.subject_key for r in _run(spark, n=2)[1]]


@pytest.mark.parametrize("args, code", [(("x", "family_a", "product", "order"), "unknown_field"), (("rank", "b", "product", "order"), "family_not_bound"), (("rank", "family_a", "class", "order"), "grain_not_bound"), (("rank", "family_a", "product", "sum"), "operation_not_permitted")])
def test_resolution_codes(args, code):
    with pytest.raises(G.Refused) as e:
        G.resolve([ORDER, SHOW], *args)
    assert e.value.code == code
    assert G.resolve([ORDER], "rank", "family_a", "product", "order") is ORDER
    with pytest.raises(G.Refused):
        G.resolve([ORDER, ORDER], "rank", "family_a", "product", "order")


def test_tiers(spark):
    forms = spark.createDataFrame([("f1", "t1", "label", "총 보수", "총보수"), ("f2", "t2", "alias", "보수", "보수"), ("f3", "t3", "id", "보수율표", "보수율표"), ("f4", "t4", "label", "Total Return", "totalreturn")], "form_id string, semantic_id string, role string, text string, normal string")
    q = spark.createDataFrame([(1, "총 보수"), (2, "총보수 낮은 펀드"), (3, "total RETURN"), (4, "보수율 도표"), (5, ""), (6, "tal retur")], "question_id int, question string").withColumn("question_normal", T.retrieval_normal(F.col("question")))
    m = R.match_pairs(R.candidate_pairs(q, forms))
    got = {(r.question_id, r.form_id): r.tier for r in m.collect()}
    assert got[(1, "f1")] == "exact" and got[(2, "f1")] == "phrase" and got[(3, "f4")] == "normalized" and got[(6, "f4")] == "substring" and (4, "f3") not in got and not [k for k in got if k[0] == 5]
    shadow = {(r.question_id, r.form_id): r.tier for r in R.downgrade_shadowed(m).collect()}
    assert shadow[(2, "f2")] == "substring" and shadow[(4, "f2")] == "phrase" and shadow[(1, "f2")] == "substring"
    best = {(r.question_id, r.rank): r.semantic_id for r in R.best_per_term(R.downgrade_shadowed(m)).collect()}
    assert best[(2, 1)] == "t1"
    cutoff = R.best_per_term(R.downgrade_shadowed(m), settings=R.Settings(max_candidates=1)).where("question_id = 2").first()
    assert cutoff.truncated == 1


def test_paths_merge_and_isolate(spark):
    rule = spark.createDataFrame([(1, "a", "exact", 1, 1.0), (1, "b", "substring", 2, 0.7)], "question_id int, semantic_id string, tier string, rank int, score double")
    vec = spark.createDataFrame([(1, "b", 0.9, 1), (1, "c", 0.8, 2)], "question_id int, semantic_id string, score double, rank int")
    both = [(r.semantic_id, r.paths) for r in R.merge_paths(rule, vec).orderBy("position").collect()]
    assert both == [("a", ["rule"]), ("b", ["rule", "embedding"]), ("c", ["embedding"])]
    alone = R.merge_paths(rule, None)
    assert alone.count() == 2 and alone.first().vector_path == "unavailable"


def test_vector_search_is_exhaustive(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8)).round(3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, e array<float>")
    got = {(r.id, r.query_id) for r in R.search_blocks(df, df.where("id % 10 = 0"), "id", "e", top_k=5, block=2).collect()}
    s = v.astype(np.float32).astype(float) @ v[::10].astype(np.float32).astype(float).T
    assert got == {(int(i), q * 10) for q in range(6) for i in np.lexsort((np.arange(60), -s[:, q]))[:5]}
    assert R.search_blocks(df, df.limit(0), "id", "e").count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<float>")
    assert [None if r[0] is None else [round(x, 6) for x in r[0]] for r in df.select(unit(F.col("v"))).collect()] == [[0.6, 0.8], None, None, None]
    assert df.select(dot(F.col("v"), F.col("v"))).first()[0] == 25.0


def test_text_functions(spark):
    rows = [("ＡＢ c_d",), ("Straße",), ("가·나 다",), (" ",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "x string").select(T.retrieval_normal(F.col("x"))).collect()] == ["abcd", "strasse", "가나다", "", None]
    assert [r[0] for r in spark.createDataFrame([("aaaa", "aa"), ("abc", ""), ("a", "bb")], "a string, b string").select(T.occurrences(F.col("a"), F.col("b"))).collect()] == [[0, 1, 2], [], []]
    assert [r[0] for r in spark.createDataFrame([("abcdef", "xxbcdexx"), ("abc", "abc"), ("abcdef", "zz")], "a string, b string").select(T.longest_fragment(F.col("a"), F.col("b"), 2, 0.6)).collect()] == ["bcde", "ab", None]
    assert spark.createDataFrame([("가나 abcd",)], "x string").select(T.token_estimate(F.col("x"))).first()[0] == 4


@pytest.mark.parametrize("table, read", [(K.DIRECTIONS, K.read_direction), (K.COMPARISONS, K.read_comparison), (K.AGGREGATES, K.read_aggregate)])
def test_every_form_means_what_the_table_says(spark, table, read):
    rows = [(m, f) for m, forms in table.items() for f in forms]
    got = spark.createDataFrame(rows, "m string, f string").select("m", "f", read(F.col("f")).alias("r")).collect()
    assert [(r.f, r.m) for r in got if (r.r.value, r.r.refusal) != (r.m, None)] == []


@pytest.mark.parametrize("read, text, value, refusal", [
    (K.read_direction, "높지 않은", None, "negated_expression_unsupported"), (K.read_direction, "안 높은", None, "negated_expression_unsupported"), (K.read_direction, "상위험", None, "direction_unsupported"), (K.read_direction, "높은 또는 낮은", None, "direction_ambiguous"), (K.read_direction, "", None, "direction_unsupported"),
    (K.read_comparison, "<=", "lte", None), (K.read_comparison, "< 또는 <=", None, "comparison_ambiguous"), (K.read_comparison, "이상한", None, "comparison_unsupported"), (K.read_aggregate, "가중 평균", None, "aggregation_function_unsupported"), (K.read_aggregate, "평균이 아니", None, "negated_expression_unsupported"),
    (K.read_limit, "상위 10개", 10, None), (K.read_limit, "top 12,000", 12000, None), (K.read_limit, "top 1,000", None, "limit_unsupported"), (K.read_limit, "2024", None, "limit_unsupported"), (K.read_limit, "2024개", 2024, None), (K.read_limit, "10%", None, "limit_is_proportion"), (K.read_limit, "-3개", None, "limit_not_positive"), (K.read_limit, "5.5개", None, "limit_not_positive"),
    (K.read_limit, "3 5", None, "limit_ambiguous"), (K.read_limit, "etf 200", None, "limit_unsupported"), (K.read_limit, "0개", None, "limit_not_positive")])
def test_span_refusals(spark, read, text, value, refusal):
    r = spark.createDataFrame([(text,)], "x string").select(read(F.col("x")).alias("r")).first().r
    assert (r.value, r.refusal) == (value, refusal)


@pytest.mark.parametrize("text, unit_code, value, refusal", [("3%", "percent_observed", 3, None), ("1만 개", "count", 10_000, None), ("-2.5배", "multiplier", -2.5, None), ("3일", "percent_observed", None, "value_unit_mismatch"), ("3x", "count", None, "value_unsupported"), ("1조 5000억", "count", None, "value_unsupported"), ("5", "currency_amount", None, "unit_not_canonicalizable")])
def test_values(spark, text, unit_code, value, refusal):
    r = spark.createDataFrame([(text,)], "x string").select(K.read_value(F.col("x"), F.lit(unit_code)).alias("r")).first().r
    assert (None if r.value is None else float(r.value), r.refusal) == (value, refusal)


def test_permission(spark):
    df = spark.createDataFrame([("높은", ["order"]), ("높은", ["count"]), ("높은", None), ("x", ["order"])], "x string, ops array<string>")
    got = [tuple(r.r) for r in df.select(K.permitted(K.read_direction(F.col("x")), F.col("ops"), "order").alias("r")).collect()]
    assert got == [("desc", None), (None, "operation_not_allowed_by_registry"), (None, "field_metadata_unavailable"), (None, "direction_unsupported")]


def test_records(spark):
    df = spark.createDataFrame([("A|x=1|y=a=b",), ("A|x",), ("A|x=1|x=2",), ("|x=1",), ("A",)], "l string").select(Rec.parse_line(F.col("l")).alias("p"))
    got = [(r.p.token, r.p.fields, r.p.problem) for r in df.collect()]
    assert got == [("A", {"x": "1", "y": "a=b"}, None), ("A", None, "missing_value"), ("A", None, "duplicate_key"), ("", None, "empty_token"), ("A", {}, None)]
    back = df.where("p.problem is null").select(Rec.render_line(F.col("p.token"), F.col("p.fields"))).collect()
    assert [r[0] for r in back] == ["A|x=1|y=a=b", "A"]
    rows = spark.createDataFrame([(1, "r", "a", "1"), (1, "r", "a", "2"), (1, "s", "a", "1"), (1, "s", "a", "1"), (1, "o", "a", "1"), (1, "t", "a", "1")], "q int, rid string, slot string, value string")
    known = spark.createDataFrame([(1, x) for x in "rstu"], "q int, rid string")
    assert {r.rid: r.problem for r in Rec.assemble(rows, known, "q", "rid").collect()} == {"r": "conflict", "s": "duplicate", "o": "orphan", "t": None, "u": "empty_requirement"}
    ok = {"id": "1", "kind": "filter", "spans": ["높은"]}
    assert Rec.parse_submission([ok], question="가장 높은 것") == ([ok], [])
    for bad in ([{**ok, "x": 1}], [ok, ok], [{**ok, "spans": "높은"}], [{**ok, "ref": "fd_1"}], [{"id": "1"}], "x", [{**ok, "spans": ["없는"]}]):
        assert Rec.parse_submission(bad, question="가장 높은 것")[0] == []


def test_references():
    r = Ref.make_reference("fd", "k", "salt")
    assert r.startswith("fd_") and len(r) == 35 and r != Ref.make_reference("fd", "k", "other") != Ref.make_reference("ds", "k", "salt")
    with pytest.raises(ValueError):
        Ref.make_reference("zz", "k", "salt")


def test_evaluation(spark):
    runs = spark.createDataFrame([("r", "a", 1, True, 1.0), ("r", "a", 2, True, 3.0), ("r", "b", 1, True, 2.0), ("r", "b", 2, False, 2.0), ("r", "c", 1, False, 2.0)], "run_id string, case_id string, repeat int, passed boolean, latency_ms double")
    s = E.run_summary(runs).first()
    assert (s.pass_rate, s.n_every, s.n_unstable, s.n_none, s.mean_latency, s.max_latency) == (0.6, 1, 1, 1, 2.0, 3.0)
    pairs = spark.createDataFrame([(1, "e1", "r1", 0.9), (1, "e1", "r2", 0.95), (1, "e2", "r2", 0.9), (1, "e2", "r1", 0.1)], "case_id int, expected string, returned string, score double")
    assert {(r.expected, r.returned) for r in E.greedy_match(pairs).collect()} == {("e1", "r2"), ("e2", "r1")}
    spans = spark.createDataFrame([(1, "long", 0, 5), (1, "short", 2, 2), (1, "next", 5, 2)], "question_id int, form_id string, start int, length int")
    assert {r.form_id: r.stands for r in E.span_ledger(spans).collect()} == {"long": True, "short": False, "next": True}
    slots = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "z"), (2, "a", "x"), (2, "a", "y"), (2, "b", "x"), (2, "b", "y")], "question_id int, slot string, reading string")
    got = {r.question_id: (r.n_options, r.options, r.blocked) for r in E.plan_options(slots, 3).collect()}
    assert got == {1: (2, ["x|z", "y|z"], False), 2: (4, [], True)}
    gold = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "d")], "case_id string, id string")
    fixed = E.adjusted_gold(gold, spark.createDataFrame([("c", "a")], "case_id string, id string"), spark.createDataFrame([("c", "b", "e")], "case_id string, id string, new_id string"))
    assert {r.id for r in fixed.collect()} == {"e", "d"}
    t = spark.createDataFrame([("key=abc Bearer x.y-z end",)], "t string")
    assert E.redact(t, "t", ["abc"]).first().t == "key=[redacted] Bearer [redacted] end"


def test_shapes(spark):
    tr = [("h1", "rdf:type", "Holding", "iri"), ("h1", "of", "p1", "iri"), ("h1", "sec", "s1", "iri"), ("p1", "rdf:type", "Portfolio", "iri"), ("s1", "rdf:type", "Security", "iri"), ("h2", "rdf:type", "Holding", "iri"), ("h2", "sec", "s1", "iri"), ("h2", "sec", "s2", "iri"), ("h2", "w", "x", "xsd:string")]
    t = spark.createDataFrame(tr, "s string, p string, o string, o_type string")
    rules = [{"name": "of", "target": "Holding", "path": "of", "min": 1, "max": 1, "class": "Portfolio"}, {"name": "sec", "target": "Holding", "path": "sec", "max": 1, "class": "Security"}, {"name": "w", "target": "Holding", "path": "w", "datatype": "xsd:double"}]
    assert {(r.node, r.shape, r.problem) for r in Q.shapes(t, rules).collect()} == {("h2", "of", "too_few"), ("h2", "sec", "too_many"), ("h2", "sec", "bad_value"), ("h2", "w", "bad_value")}
    assert Q.physical_names(["rank by met:fee", "from metric_observation"], ["metric_observation"], ["numeric_value"]) == ["metric_observation"]
    assert Q.custody(t, 9, ["s", "p", "o", "o_type"]) == [] and len(Q.custody(t, 8, ["s"])) == 2


def test_gates_and_encodings(spark):
    cases = spark.createDataFrame([("c1", "h", "h", ["a"], ["b"]), ("c1", "h", "h", ["a"], ["b"]), ("c2", "h", "x", ["a", "z"], ["a"]), ("c3", "h", "h", [], ["b"])], "case_id string, question_hash string, recorded_hash string, required array<string>, confusable array<string>")
    got = {(r.case_id, r.problem) for r in E.case_problems(cases, spark.createDataFrame([("a",), ("b",)], "id string")).collect()}
    assert got == {("c1", "repeated_case"), ("c2", "other_question"), ("c2", "unknown_id"), ("c2", "required_and_confusable"), ("c3", "nothing_required")}
    out = spark.createDataFrame([(1, '{"requirements": [{"id": "r1", "slots": {"op": "gte", "v": "3"}}]}'), (2, "{broken"), (3, None)], "k int, t string")
    assert {tuple(r) for r in E.decode_nested(out, "k", "t").collect()} == {(1, "r1", "op", "gte", None), (1, "r1", "v", "3", None), (2, None, None, None, "unreadable"), (3, None, None, None, "unreadable")}
    terms = spark.createDataFrame([("a", None), ("b", "a"), ("c", "gone"), ("a", None)], "id string, owner string")
    assert {tuple(r) for r in E.registry_problems(terms, spark.createDataFrame([("a",), ("b",), ("zz",)], "id string")).collect()} == {("a", "repeated_term"), ("c", "unknown_owner"), ("c", "term_without_form"), ("zz", "form_of_no_term")}
    assert G.selection_policy(1) == "unique_per_subject" and G.selection_policy(3) == "latest_effective_as_of"
    with pytest.raises(G.Refused):
        G.selection_policy(None)


@pytest.mark.parametrize("seed", range(3))
def test_candidates_hold_every_match(spark, seed):
    """Whatever matches among all pairs of questions and forms is among the candidates of the equi-join."""
    import random

    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("ab c가_") for _ in range(rng.randrange(a, b)))
    forms = [(f"f{i}", f"t{i % 9}", rng.choice(["label", "alias", "id", "definition"]), word(1, 9)) for i in range(60)] + [("e1", "t", "label", "_"), ("e2", "t", "alias", " ")]
    f = spark.createDataFrame(forms, "form_id string, semantic_id string, role string, text string").withColumn("normal", T.retrieval_normal(F.col("text")))
    q = spark.createDataFrame([(i, word(0, 14)) for i in range(40)] + [(98, "_"), (99, "")], "question_id int, question string").withColumn("question_normal", T.retrieval_normal(F.col("question")))
    key = lambda df: sorted((r.question_id, r.form_id, r.tier) for r in df.select("question_id", "form_id", "tier").collect())
    every = key(R.match_pairs(q.crossJoin(f)))
    assert key(R.match_pairs(R.candidate_pairs(q, f))) == every and len({t for *_, t in every}) == 4


def test_payload_and_ledgers_of_nothing(spark):
    q = spark.createDataFrame([], "question_id bigint, question string")
    f = spark.createDataFrame([], "form_id string, text string")
    s = E.scan_forms(q, f)
    assert s.count() == 0 and E.question_ledger(s).count() == 0
    one = E.scan_forms(spark.createDataFrame([(1, "top 3, nothing else"), (2, ""), (3, None)], "question_id bigint, question string"), f)
    assert [(r.text, r.state) for r in E.question_ledger(one).orderBy("place").collect()] == [("top", "direction"), ("3,", "number"), ("nothing", "unknown"), ("else", "unknown")]
    assert E.plan_options(spark.createDataFrame([], "question_id bigint, slot string, reading string")).count() == 0

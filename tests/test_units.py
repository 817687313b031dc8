"""Problem 1: reading units, and decoding them."""
import datetime as dt
import math

import numpy as np
import pytest

from graindeck.functions import units as U
from graindeck.operators import units as O

UNITS = [("percent_observed", "share", 1.0), ("ratio", "share", 100.0), ("basis_point", "share", 0.01), ("permille", "share", 0.1), ("currency_amount", "amount", 1.0), ("thousand", "amount", 1e3), ("million", "amount", 1e6)]
RATES = [("KRW", 1.0), ("USD", 1400.0), ("GBP", 1800.0), ("GBX", 18.0)]
METRIC = "subject_key string, metric_id string, numeric_value double, raw_text_value string, unit_code string, currency_code string, effective_as_of date, source_id string, source_row_id string"
HOLDING = ("holding_key string, portfolio_key string, security_key string, held_isin_raw string, security_name_raw string, effective_as_of date, requested_as_of date, weight_value double, weight_unit string, "
           "value_amount double, value_amount_unit string, currency string, source_id string")


@pytest.mark.parametrize("text, unit", [("pct", "percent_observed"), ("%", "percent_observed"), ("퍼센트", "percent_observed"), ("b.p.", "basis_point"), ("‱", "basis_point"), ("천분율", "permille"), ("fraction of 1", "ratio"), ("KRW", None), ("", None), (None, None)])
def test_share_units(text, unit):
    assert U.share_unit(text) == unit


@pytest.mark.parametrize("text, unit, currency", [("US$'000", "thousand", "USD"), ("백만홍콩달러", "million", "HKD"), ("KRW 100mn", "hundred_million", "KRW"), ("억 원", "hundred_million", "KRW"), ("p (GBP/100)", "currency_amount", "GBX"), ("GBp", "currency_amount", "GBX"),
                                                  ("GBP k", "thousand", "GBP"), ("₩bn", "billion", "KRW"), ("currency_amount", "currency_amount", None), ("", None, None), ("dozen", None, None)])
def test_amount_units(text, unit, currency):
    assert U.amount_unit(text) == unit and U.currency_named(text) == currency


@pytest.mark.parametrize("text, around", [("약 2,224.50억 원", "억 원"), ("HK$9.9 million", "HK$ million"), ("529.82p (GBX)", "p GBX"), ("-1,686.39bp (annualised)", "bp"), ("0.05 as a fraction", "fraction"), ("8909.07", None), ("n.a.", None), (None, None)])
def test_unit_in_text(text, around):
    assert U.unit_in_text(text) == around


@pytest.mark.parametrize("note, said", [("Blank unit: rates in bps, amounts in USD thousand.", ("basis_point", "thousand", "USD")), ("금액 단위가 없으면 천원, 비중 단위가 없으면 만분율", ("basis_point", "thousand", "KRW")), ("resend after outage", (None, None, None)), (None, (None, None, None)),
                                        ("From this file on a blank unit means percent for rates and millions of won for amounts.", ("percent_observed", "million", "KRW")), ("Weights left without a unit are fractions of net assets; values left without one are US dollars.", ("ratio", "currency_amount", "USD"))])
def test_notes(note, said):
    assert U.note_units(note) == said


def test_order_of_evidence():
    assert U.stated(True, "bp", None, "3%", "blank unit: percent") == ("basis_point", "none", "column")
    assert U.stated(True, "number", None, "3%", "x") == ("percent_observed", "none", "text")
    assert U.stated(True, "number", None, "3", "Blank unit: rates in bps") is None  # the note speaks of null units only
    assert U.stated(True, None, None, "3", "Blank unit: rates in bps") == ("basis_point", "none", "note")
    assert U.stated(False, "million", "usd", None, None) == ("million", "USD", "column")
    assert U.stated(False, "USDm", "KRW", None, None) == ("million", "USD", "column")
    assert U.stated(False, "million", None, None, None) is None  # no currency, no known unit


def test_viterbi_finds_a_switch():
    """Percent, then the same level written as a ratio; only the first row states its unit."""
    logs = np.log(np.array([12.0, 12.1, 0.119, 0.121, 11.9]))
    path = O.viterbi(logs, np.arange(5) * 7.0, np.array([0, -1, -1, -1, -1]), np.array([0]), np.array([5]), np.log(np.array([1.0, 100.0, 0.01, 0.1])))
    assert path.tolist() == [0, 0, 1, 1, 0]


def test_viterbi_against_all_paths():
    """Viterbi's path costs what the cheapest of all paths costs."""
    import itertools

    rng = np.random.default_rng(5)
    factors = np.log(np.array([1.0, 100.0, 0.01]))

    def cost(path, logs, days, pinned):
        c = 0.0 if path[0] == 0 or pinned[0] >= 0 else O.RARE
        for t in range(1, len(path)):
            jump = logs[t] + factors[path[t]] - logs[t - 1] - factors[path[t - 1]]
            c += jump**2 / (2 * O.SPREAD**2 * (1 + (days[t] - days[t - 1]) / O.LEVEL_DAYS)) + (path[t] != path[t - 1]) * (O.SWITCH + (path[t] != 0) * O.RARE)
        return c if all(p < 0 or p == x for p, x in zip(pinned, path)) else math.inf

    sizes = rng.integers(1, 6, 30)
    ends = np.cumsum(sizes)
    starts, n = ends - sizes, int(ends[-1])
    logs, days = rng.normal(0, 3, n), np.concatenate([np.cumsum(rng.integers(1, 40, k)) for k in sizes]).astype(float)
    pinned = np.where(rng.random(n) < 0.4, rng.integers(0, 3, n), -1)
    path = O.viterbi(logs, days, pinned, starts, ends, factors)
    for a, b in zip(starts, ends):
        best = min(cost(p, logs[a:b], days[a:b], pinned[a:b]) for p in itertools.product(range(3), repeat=int(b - a)))
        assert math.isclose(cost(path[a:b].tolist(), logs[a:b], days[a:b], pinned[a:b]), best, rel_tol=1e-9)
        through = O.first_costs(pinned[a:b], 3)[0][:, None] + O.transfer(logs[a:b], days[a:b], pinned[a:b], factors)
        assert math.isclose(np.nanmin(np.where(np.isnan(through), np.inf, through)), best, rel_tol=1e-9)


def _tables(spark, metrics, holdings, notes=()):
    cat = spark.createDataFrame([("met:fee", "share"), ("met:aum", "amount"), ("met:n", "count")], "metric_id string, dimension string")
    src = spark.createDataFrame(list(notes) or [("s", None)], "source_id string, note string")
    units = spark.createDataFrame(UNITS, "unit_id string, dimension string, factor_to_common double")
    rates = spark.createDataFrame(RATES, "currency_code string, krw_per_unit double")
    m = spark.createDataFrame(metrics, METRIC).selectExpr("*", "'x' AS note", "1 AS kind", "'clash' AS device")
    h = spark.createDataFrame(holdings, HOLDING).selectExpr("*", "'x' AS note", "1 AS value")
    return O.normalise(m, h, cat, src, units, rates)


def test_normalise(spark):
    d = [dt.date(2026, 7, i) for i in range(1, 29)]
    metrics = [("A", "met:fee", 1.5, "1.5%", None, None, d[0], "s", "s#1"), ("A", "met:fee", 0.015, None, None, None, d[7], "s", "s#2"), ("A", "met:fee", 150.0, None, "bp", None, d[14], "s", "s#3"), ("A", "met:fee", 150.0, None, "bp", None, d[14], "s", "s#3"),
               ("A", "met:aum", 2.0, None, "million", "USD", d[0], "s", "s#4"), ("B", "met:aum", float("nan"), None, "KRW", None, None, "s", "s#5"), (None, "met:aum", None, None, "US$", None, d[0], None, "s#6"), ("C", "met:fee", 3.0, "3", None, None, d[0], "s", "s#7"),
               ("C", "met:n", 3.0, "3", "count", None, d[0], "s", "s#8"), ("D", None, 3.0, "3", "%", None, d[0], "s", "s#9"), ("E", "met:fee", float("inf"), None, "bp", None, d[0], "s", "s#10"), ("E", "met:aum", 7.0, "x" * 100_000, "number", "KRW", d[0], "s", "s#11")]
    holdings = [("h1", "p", None, None, None, None, None, 0.5, "ratio", 100.0, "GBp", "KRW", "s"), ("h2", None, None, None, "", d[0], None, None, None, None, None, None, None)]
    got = {(r.row_key, r.quantity): r for r in _tables(spark, metrics, holdings).collect()}
    assert len(got) == 13  # nine metric rows of a listed share or amount, four quantities of holdings
    one = lambda k, q="numeric_value": got[(k, q)]
    assert one("met:fee@s#3").value_common == pytest.approx(1.5) and one("met:fee@s#3").basis == "column"
    assert one("met:fee@s#2").unit_id == "ratio" and one("met:fee@s#2").basis == "level"  # from the level of its neighbours
    assert one("met:aum@s#4").value_common == pytest.approx(2.8e9)
    assert one("met:aum@s#5").value_common is None and one("met:aum@s#5").unit_id == "currency_amount"
    assert one("met:fee@s#7").unit_id is None and one("met:fee@s#7").basis is None
    assert one("h1", "weight_value").value_common == pytest.approx(50.0)
    assert one("h1", "value_amount").currency_code == "GBX" and one("h1", "value_amount").value_common == pytest.approx(1800.0)
    cases = {(r.row_key, r.quantity) for r in O.found(_tables(spark, metrics, holdings)).collect()}
    assert cases == {("met:fee@s#3", "numeric_value"), ("met:aum@s#4", "numeric_value"), ("h1", "weight_value"), ("h1", "value_amount")}


def test_notes_decide_null_units(spark):
    rows = [("A", "met:fee", 25.0, None, None, None, dt.date(2026, 7, 1), "s", "s#1"), ("A", "met:fee", 25.0, None, None, None, dt.date(2026, 7, 2), "t", "t#1")]
    got = {r.row_key: (r.recorded_unit, r.recorded_currency) for r in O.found(_tables(spark, rows, [], [("s", "Blank unit: rates in bps, amounts in USD thousand."), ("t", "late")])).collect()}
    assert got == {"met:fee@s#1": ("basis_point", "none")}


def test_empty(spark):
    assert _tables(spark, [], []).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    rows = [(f"S{i % 3}", "met:fee", 1.0 + i % 7, None, "%" if i % 2 else "bp", None, dt.date(2026, 1, 1 + i % 28), "s", f"s#{i}") for i in range(200)]
    cat = spark.createDataFrame([("met:fee", "share")], "metric_id string, dimension string")
    rec = O.metric_recordings(spark.createDataFrame(rows, METRIC), cat, spark.createDataFrame([("s", None)], "source_id string, note string"))
    hidden = [("share", "percent_observed", "none", 1.0), ("share", "basis_point", "none", 0.01)]
    a, b = (sorted(map(tuple, O.decode(rec, hidden, n).collect())) for n in (1, 7))
    assert a == b and len(a) == 200


def _recordings(spark, rows):
    cat = spark.createDataFrame([("met:fee", "share")], "metric_id string, dimension string")
    return O.metric_recordings(spark.createDataFrame(rows, METRIC), cat, spark.createDataFrame([("s", None)], "source_id string, note string"))


HIDDEN = [("share", "percent_observed", "none", 1.0), ("share", "basis_point", "none", 0.01), ("share", "permille", "none", 0.1), ("share", "ratio", "none", 100.0)]


@pytest.mark.parametrize("n, heavy, block, size", [(7, 1 << 17, 4096, 10_000), (1, 10, 4, 3), (5, 10, 7, 3), (4, 10, 1, 50), (3, 10, 4096, 10_000)])
def test_a_device_that_is_cut_decodes_as_if_whole(spark, n, heavy, block, size):
    """Long stretches without a unit between few rows that state one, some rows delivered twice, cut between tasks and blocks."""
    rng = np.random.default_rng(3)
    rows = [("B", "met:fee", 1.0, None, "%", None, dt.date(2026, 1, 1), "s", "b"), ("C", "met:fee", 1.0, None, None, None, dt.date(2026, 1, 1), "s", "c")]
    rows += [("D", "met:fee", float(i), None, None, None, dt.date(2026, 1, 1), "s", f"d{i:03d}") for i in range(40)]  # long, and nothing stated
    for i in range(300):
        unit = {5: "%", 35: "bp", 290: "bp"}.get(i)
        switched = i % 60 > 20
        value = None if i % 37 == 0 else float(round((2.0 + rng.normal(0, 0.02)) * (100 if switched else 1), 4))
        row = ("A", "met:fee", value, None, unit, None, dt.date(2026, 1, 1) + dt.timedelta(days=i), "s", f"s#{i:03d}")
        rows += [row] * (1 + (i % 4 == 0))
    rec = _recordings(spark, rows)
    whole = sorted(map(str, O.decode(rec, HIDDEN, 1).collect()))
    assert len(whole) == 342
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        assert sorted(map(str, O.decode(rec, HIDDEN, n, heavy, block).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("n, heavy", [(1, 1 << 17), (4, 1 << 17), (16, 100)])
def test_a_long_run_keeps_its_unit(spark, n, heavy):
    """One stated ratio, 199 unstated rows of that level as ratio, 200 as percent."""
    rows = [("A", "met:fee", 0.05 if i < 200 else 5.0, None, None if i else "ratio", None, dt.date(2025, 1, 1) + dt.timedelta(days=i), "s", f"s#{i:03d}") for i in range(400)]
    got = {r.row_key: (r.unit_id, r.basis) for r in O.decode(_recordings(spark, rows), HIDDEN, n, heavy, 64).collect()}
    assert [got[f"met:fee@s#{i:03d}"] for i in range(400)] == [("ratio", "column")] + [("ratio", "level")] * 199 + [("percent_observed", "level")] * 200


def test_planted_switches_are_decoded(spark):
    """60 devices of a drifting level whose unit switches at random and is stated on one row in four: of the others, and of every switch, nearly all come out right."""
    rng, rows, truth, switches = np.random.default_rng(17), [], {}, []
    names = {"percent_observed": "%", "basis_point": "bp", "permille": "permille", "ratio": "ratio"}
    factor = {u: f for _, u, _, f in HIDDEN}
    for d in range(60):
        level, unit = rng.normal(1, 0.8), "percent_observed"
        for i in range(50):
            level += rng.normal(0, 0.08)
            if rng.random() < 0.08:
                unit = str(rng.choice(list(names)))
                switches.append(f"met:fee@{d:02d}#{i:02d}")
            key, told = f"{d:02d}#{i:02d}", rng.random() < 0.25
            rows.append((f"D{d}", "met:fee", float(np.exp(level) / factor[unit]), None, names[unit] if told else None, None, dt.date(2024, 1, 1) + dt.timedelta(days=7 * i), "s", key))
            truth["met:fee@" + key] = unit
    got = {r.row_key: (r.unit_id, r.basis) for r in O.decode(_recordings(spark, rows), HIDDEN).collect()}
    untold = [k for k, (_, basis) in got.items() if basis == "level"]
    assert len(got) == 3000 and len(untold) > 2000
    assert np.mean([got[k][0] == truth[k] for k in untold]) > 0.97 and np.mean([got[k][0] == truth[k] for k in switches]) > 0.95

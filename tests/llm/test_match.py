"""Problem 5: keys, rules, and a planted set of noisy records."""
import random

import pytest

from graindeck.llm import match

WORDS = ["capital", "foods", "logistics", "networks", "semicon", "shipworks", "software"]


@pytest.mark.parametrize("a, b", [("Alfa Networks Inc", "ALFA NTWKS INCORPORATED ORD"), ("Alfa Logistics Group Class B", "alfa Logist. grp cl B"), ("Alfa Foods SA 4% 10/2036", "alfa foods sa 4.0 % 10/2036"), ("Alfa Shipworks Ltd", "Shipworks, Alfa Limited"), ("Alfa Shipworks Ltd", "Alfa Ship Works Ltd /THE"), ("가나다물류2우B", "(주)가나다 물류2우B"),
                                  ("가나다물류25-1", "가나다물류25 - 1 (상장)"), ("가나다물류", "주식회사 가나다물류 보통주"), ("가나다물류우", "가나다물류㈜ 우선주"), ("가나다물류 1.5% 02/2040", "가나다물류 1.5프로 02.2040")])
def test_names_that_mean_one(a, b):
    assert match.name_key(a, WORDS) == match.name_key(b, WORDS) is not None


@pytest.mark.parametrize("a, b", [("Alfa Foods SA 4% 10/2036", "Alfa Foods SA 4.25% 10/2036"), ("Alfa Foods SA 4% 10/2036", "Alfa Foods SA 4% 10/2037"), ("Alfa Foods SA", "Alfa Foods SA Class B"), ("Alfa Foods SA", "Alfa Capital SA"), ("가나다물류2우B", "가나다물류3우B"), ("가나다물류25-1", "가나다물류25-2")])
def test_names_that_mean_two(a, b):
    assert match.name_key(a, WORDS) != match.name_key(b, WORDS)


@pytest.mark.parametrize("name", ["", "  ", None, "Alfa Foods convertible 2030", "Alfa Foods TRS 2030", "CDS 2030 Alfa"])
def test_no_security(name):
    assert match.name_key(name, WORDS) is None


@pytest.mark.parametrize("raw, clean", [("XCLS UN Equity", "XCLS"), ("Q:ZNFF", "ZNFF"), ("XPB/N", "XPBN"), ("ZHEK.O", "ZHEK"), ("903299 QK", "903299"), ("A910516", "910516"), ("xdtnh", "XDTNH"), ("", None), (None, None)])
def test_tickers(raw, clean):
    assert match.clean_ticker(raw) == clean


def test_near_codes(spark):
    from pyspark.sql import functions as F

    rows = [("ABCDE", "ABCDE", True), ("ABCDE", "ABXDE", True), ("ABCDE", "ABDCE", True), ("ABCDE", "ABCD", True), ("ABCDE", "ABDXE", False), ("ABCDE", "BACED", False), ("AB", "BA", True)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select("want", match.near_code(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


HOLD = "holding_key string, security_key string, held_isin_raw string, held_ticker_raw string, security_name_raw string"
MASTER = "security_key string, isin string, ticker string, security_name string, issuer_name string"


def _master(n=60):
    rng, rows = random.Random(4), []
    for i in range(n):
        first = "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(4)).title()
        issuer = f"{first} {rng.choice(WORDS).title()} {rng.choice(['Inc', 'Ltd', 'Group'])}"
        code = "QU" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(9)) + str(rng.randrange(10))
        rows.append((f"sec:{i:03}", code, f"X{i:03}Q", issuer, issuer))
        rows.append((f"bond:{i:03}", code[:4] + code[4:11][::-1] + code[11], None, f"{issuer} {1 + i % 5}.5% 0{1 + i % 9}/2040", issuer))
    return rows


def test_planted_matches(spark):
    master, rng = _master(), random.Random(8)
    rows, want = [], {}

    def add(isin, ticker, name, key):
        k = f"h{len(rows)}"
        rows.append((k, None, isin, ticker, name))
        if key:
            want[k] = key

    for key, isin, ticker, name, _ in master[:80]:
        add(isin[2:11], None, name[:9], key)
        add(isin[:11], None, "whatever", key)
        p = rng.randrange(2, 11)
        add(isin[:p] + ("0" if isin[p] != "0" else "1") + isin[p + 1:], None, None, key)
        add(isin[:5] + isin[6] + isin[5] + isin[7:], None, name, key)
        add(isin[:6] + isin[7:], "ZZZZ9", name.upper(), key)
        add(None, None, name.lower() + " ", key)
        add(None, None, name[:3] + name[4] + name[3] + name[5:] if name[3] != name[4] else name, key)
        if ticker:
            add(None, ticker.lower(), name[:8], key)
        add(None, None, name + " CDS 2030", None)
        add("QZ9999999990", None, name, None)  # another security of that name
    add(None, None, "USD cash", None)
    add(None, "X001Q", "Someone Else Entirely Plc", None)
    add(None, None, None, None)
    add("", "", "", None)
    add(None, None, "n" * 100_000, None)
    labelled = [(f"l{i}", key, isin, ticker, name) for i, (key, isin, ticker, name, _) in enumerate(master)]
    df = spark.createDataFrame(rows + rows[:20] + labelled, HOLD).selectExpr("*", "'c' AS isin", "'c' AS ticker", "1 AS rid", "'x' AS label")
    ref = spark.createDataFrame(master + [(None, None, None, None, None), ("sec:null", None, None, None, None)], MASTER).selectExpr("*", "'x' AS entity", "1 AS i")
    out = match.match_holdings(df, ref).collect()
    got = {r.holding_key: r.security_key for r in out}
    assert len(out) == len(got)
    wrong = {k: (v, want.get(k), rows[int(k[1:])]) for k, v in got.items() if want.get(k) != v}
    assert not wrong
    assert len(got) / len(want) > 0.97
    assert all(0 < r.confidence < 1 for r in out)


def test_empty(spark):
    none = spark.createDataFrame([], HOLD)
    ref = spark.createDataFrame(_master(3), MASTER)
    assert match.match_holdings(none, ref).count() == 0
    assert match.match_holdings(spark.createDataFrame([("h", None, "X", "Y", "Z")], HOLD), spark.createDataFrame([], MASTER)).count() == 0


@pytest.mark.parametrize("most", [4, 12, 64])
def test_words_one_slip_apart_share_a_key(spark, most):
    from pyspark.sql import functions as F

    rng, rows = random.Random(most), []
    for _ in range(150):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 14)))
        p = rng.randrange(len(w) - 1)
        rows.append((w, rng.choice([w, w[:p] + "z" + w[p + 1:], w[:p] + w[p + 1:], w[:p] + "z" + w[p:], w[:p] + w[p + 1] + w[p] + w[p + 2:]])))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", F.arrays_overlap(match.slip_keys("t", F.col("a"), most=most), match.slip_keys("t", F.col("b"), most=most)).alias("meet"))
    near = got.where(match.near_code(F.col("a"), F.col("b")) & (F.length("b") > 0))
    assert near.count() > 100 and near.where("NOT meet").count() == 0


def test_codes_of_one_prefix_meet_few_others(spark):
    """20,000 codes that share their first five and last signs: the pairs that keys bring grow with the codes, not with their square."""
    from pyspark.sql import functions as F

    codes = spark.range(20_000).select(F.concat(F.lit("US912"), F.lpad((F.col("id") * 49).cast("string"), 6, "0"), F.lit("7")).alias("code"))
    keyed = codes.withColumn("key", F.explode(match.slip_keys("c", F.col("code"))))
    assert keyed.alias("a").join(keyed.alias("b"), "key").count() < 60 * 20_000


def test_too_many_frequent_words_are_refused(spark):
    names = spark.createDataFrame([("alpha beta",), ("gamma delta",)], "n string")
    assert match.frequent_words(names, "n") == ["alpha", "beta", "delta", "gamma"]
    with pytest.raises(ValueError):
        match.frequent_words(names, "n", bound=3)


def test_a_word_written_apart():
    assert match.name_key("Alfa Ship Works Inc", WORDS) == match.name_key("Alfa Shipworks", WORDS)
    assert match.name_key("Alfa Net Works Ltd", WORDS) == match.name_key("Alfa Networks", WORDS)

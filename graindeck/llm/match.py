"""Problem 5: matching records to reference entities without a shared key.

A cascade of rules, strongest first. Each rule is an exact join of the records still open with the reference on keys made of
some attributes, checked on the pairs it brings; a record that exactly one entity answers is resolved and leaves the
cascade, the others go on to the next rule. Each rule also runs over a bounded sample of records whose entity is known; how
often it was right there, smoothed by one right and one wrong match, is the confidence of its matches.

Records enter as distinct attribute combinations, so a name that a third of all rows carry is matched once.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graindeck.session import cut

# Legal forms, fillers and derivatives in names of securities.
LEGAL_FORMS = {"corp", "corporation", "inc", "incorporated", "ltd", "limited", "plc", "ag", "sa", "group", "grp", "holdings", "hldgs", "co", "company"}
FILLERS = {"the", "com", "ord", "reg", "shs", "/the"}
DERIVATIVES = re.compile(r"\b(cds|trs|convertible|warrant|futures?|options?|swap)\b|전환사채|신주인수권")
KOREAN_FORMS = re.compile(r"㈜|\(주\)|주식회사|\(상장\)|\(상?장?$")
COUPON = re.compile(r"(\d+(?:\.\d+)?)\s*(?:%|프로|퍼센트)\s*(\d{1,2})\s*[/.]\s*(\d{4})")

KEYS = "isin string, ticker string, tail string, core string, kind string, squashed string, first string, rest string"


def frequent_words(names: DataFrame, column: str, share: float = 0.002, bound: int = 100_000) -> list[str]:
    """Words that stand in at least ``share`` of the names, legal forms aside: at most (words per name) / share of them; more
    than ``bound`` are refused."""
    words = names.select(F.explode(F.array_distinct(F.split(F.lower(column), r"\s+"))).alias("w"))
    total = names.select(F.count(F.lit(1)).alias("n"))
    rows = words.groupBy("w").count().where((F.col("count") >= F.lit(share) * total.scalar()) & F.col("w").rlike("^[a-z]{3,}$")).select("w").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} words in a share of {share} of the names")
    return sorted(r[0] for r in rows if r[0] not in LEGAL_FORMS | FILLERS | {"class", "adr", "pref"})


class Words(list):
    """Frequent words, with what tokens were read as so far: a worker reads each token once."""

    def __init__(self, words: list[str]):
        super().__init__(words)
        self.every, self.read = set(words), {}

    def whole(self, token: str) -> str:
        if len(self.read) > 1 << 18:
            self.read.clear()
        if token not in self.read:
            self.read[token] = whole_word(token, self)
        return self.read[token]


def whole_word(token: str, words: list[str]) -> str:
    """The one frequent word that a token abbreviates: its beginning, a longer spelling, or its letters in order; else the token."""
    if token in words:
        return token
    hits = [w for w in words if (len(token) >= 3 and w.startswith(token)) or (len(w) >= 5 and token.startswith(w))]
    if not hits and len(token) >= 4:
        hits = [w for w in words if w[0] == token[0] and all(c in it for it in [iter(w)] for c in token)]
    return hits[0] if len(hits) == 1 else token


def name_key(name: str | None, words: list[str]) -> tuple[str, str] | None:
    """(issuer, kind): legal forms, fillers, case, spaces and abbreviations aside. kind is coupon and maturity, series, or share
    class. None for empty names and for derivatives, which are no listed securities."""
    s = KOREAN_FORMS.sub(" ", (name or "").lower()).strip()
    kind = ""
    if m := COUPON.search(s):
        kind = f"{float(m[1]):g}@{int(m[2]):02d}/{m[3]}"
        s = f"{s[:m.start()]} {s[m.end():]}"
    if not s.strip() or DERIVATIVES.search(s):
        return None
    if re.search("[가-힣]", s):
        s = re.sub(r"\s+", "", s)
        s = re.sub("우선주", "우", re.sub("보통주$", "", s))
        if m := re.search(r"(\d+-\d+)$", s) or re.search(r"(\d?우b?)$", s):
            kind, s = kind or m[1], s[:m.start()]
        return (s, kind) if s else None
    if m := re.search(r"\b(?:class|cl)\.? ([a-z])\b", s):
        kind, s = kind or f"class {m[1]}", f"{s[:m.start()]} {s[m.end():]}"
    if m := re.search(r"\b(adr|pref|preferred)\b", s):
        kind, s = kind or m[1][:4], f"{s[:m.start()]} {s[m.end():]}"
    words = words if isinstance(words, Words) else Words(words)
    if (m := re.match(r"^\s*([^,\s]+),\s*(\S+)(.*)$", s)) and words.whole(m[1].strip(".")) in words.every:
        s = f"{m[2]} {m[1]} {m[3]}"
    tokens = [t.strip(".,") for t in s.split()]
    tokens = [t for t in tokens if t and t not in LEGAL_FORMS and t not in FILLERS]
    for i in range(len(tokens) - 1, 0, -1):
        if i < len(tokens) and tokens[i - 1] + tokens[i] in words.every:  # a frequent word written in two
            tokens[i - 1:i + 1] = [tokens[i - 1] + tokens[i]]
    tokens = tokens[:1] + [words.whole(t) for t in tokens[1:]]
    return (" ".join(tokens), kind) if tokens else None


def clean_isin(text: str | None) -> str | None:
    return re.sub("[^0-9A-Z]", "", text.upper()) or None if text else None


def clean_ticker(text: str | None) -> str | None:
    """Without exchange before or behind it, signs and case; six-digit codes without a letter before them."""
    if not text:
        return None
    s = re.sub(r"^[A-Z]{1,2}:|\s+EQUITY$", "", text.upper().strip())
    s = re.sub(r"\s+[A-Z]{1,2}$|\.[A-Z]{1,2}$", "", s)
    s = re.sub("[^A-Z0-9]", "", s)
    return re.sub(r"^A(\d{6})$", r"\1", s) or None


def with_keys(df: DataFrame, isin: str, ticker: str, name: str, words: list[str]) -> DataFrame:
    """Add the match keys (``KEYS``) to each row, read in Arrow batches. Null and empty attributes give null keys."""
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known_words = Words(words)
        for b in batches:
            names = {n: name_key(n, known_words) for n in b[name].dropna().unique()}
            known = [names.get(n) for n in b[name]]
            out = b[columns].copy()
            out["isin"] = [clean_isin(x if isinstance(x, str) else None) for x in b[isin]]
            out["ticker"] = [clean_ticker(x if isinstance(x, str) else None) for x in b[ticker]]
            out["tail"] = [t.lstrip("09") or None if t and t.isdigit() else None for t in out["ticker"]]
            out["core"] = [k[0] if k else None for k in known]
            out["kind"] = [k[1] if k else None for k in known]
            out["squashed"] = [k[0].replace(" ", "") if k else None for k in known]
            out["first"] = [k[0].split(" ")[0] if k else None for k in known]
            out["rest"] = [" ".join([*k[0].split(" ")[1:], k[1]]) if k else None for k in known]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, {KEYS}")


def near_code(a: Column, b: Column) -> Column:
    """Codes that differ by one sign replaced, missing or too many, or by two neighbours changed over."""
    swapped = F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda p: F.concat(
        F.substring(a, F.lit(1), p - 1), F.substring(a, p + 1, F.lit(1)), F.substring(a, p, F.lit(1)), F.substring(a, p + 2, F.length(a))) == b)
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (F.length(a) > 1) & swapped)


def isin_agrees(a: Column, b: Column) -> Column:
    """A recorded ISIN against one of the reference: equal, a known part of it, or near."""
    return F.when(F.length(a) == 9, a == F.substring(b, 3, 9)).otherwise(near_code(a, b))


def slip_keys(tag: str, word: Column, *rest: Column, most: int = 64) -> Column:
    """Keys that two words share whenever they differ by one letter replaced, missing or too many, or by two neighbours changed
    over: the word itself and the word without each one of its letters, as far as it has ``most``. Of longer words (and those one
    shorter, so that both sides meet) the first and the last (n - 1) div 2 letters, as one end is whole; n counts one more or less too.
    """
    n, key = F.length(word), lambda *x: F.concat_ws("|", F.lit(tag), *x, *rest)
    without = F.transform(F.sequence(F.lit(1), n), lambda i: key(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n))))
    short = F.array_distinct(F.concat(F.array(key(word)), F.when(n > 0, without).otherwise(F.array().cast("array<string>"))))
    ends = F.array_distinct(F.array(*[F.floor((n - 1 + d) / 2).cast("int") for d in (-1, 0, 1)]))
    halves = F.flatten(F.transform(ends, lambda h: F.array(key(F.lit("a"), h.cast("string"), F.substring(word, F.lit(1), h)), key(F.lit("z"), h.cast("string"), F.right(word, h)))))
    none = F.array().cast("array<string>")
    return F.concat(F.when(n <= most, short).otherwise(none), F.when(n >= most, halves).otherwise(none))


def rules() -> list[tuple[str, Column, Column, Column | None]]:
    """(name, keys of a record, keys of an entity, check of a pair): strongest first. Keys are arrays of strings, empty where
    the attributes are missing; records have the columns of KEYS, entities the same with the prefix m_."""
    c = F.col
    none = F.array().cast("array<string>")
    some = lambda cond, *keys: F.when(cond, F.array(*keys)).otherwise(none)
    tagged = lambda tag, *parts: F.concat_ws("|", F.lit(tag), *parts)
    length = F.length("isin")
    name_fits = (F.levenshtein("squashed", F.substring(c("m_squashed"), F.lit(1), F.length("squashed"))) <= F.when(c("squashed").rlike("^[a-z]"), 2).otherwise(1))
    # written "Group, Name" and cut off, a name ends within its first word
    first_cut = (F.length("first") >= 3) & F.startswith(c("m_first"), c("first")) & (c("rest") == c("m_rest"))
    code_open = c("isin").isNull() | c("m_isin").isNull() | isin_agrees(c("isin"), c("m_isin"))
    ticker_open = c("ticker").isNull() | c("m_ticker").isNull() | (c("ticker") == c("m_ticker")) | (c("tail") == c("m_tail")) | c("ticker_elsewhere")
    open_ids = F.coalesce(code_open, F.lit(True)) & F.coalesce(ticker_open, F.lit(True))
    # labelled records rarely have parts of codes; to try the rule on them, their whole codes count as parts too
    part = F.when(length == 9, F.array(tagged("9", c("isin")))).when(length == 11, F.array(tagged("11", c("isin"))))
    part = part.when((length == 12) & c("label").isNotNull(), F.array(tagged("9", F.substring("isin", 3, 9)))).otherwise(none)
    # Latin names only: one other syllable makes another Korean name; a letter lost or two changed over, not one replaced
    first_ok = c("first").rlike("^[a-z]{4,}$")
    slip = near_code(c("first"), c("m_first")) & ((F.length("first") != F.length("m_first")) | (c("first") == c("m_first")) | (F.levenshtein("first", "m_first") == 2))
    return [
        ("isin", some(length == 12, c("isin")), some(F.length("m_isin") == 12, c("m_isin")), None),
        ("isin_part", part,
         some(F.length("m_isin") == 12, tagged("9", F.substring("m_isin", 3, 9)), tagged("11", F.substring("m_isin", 1, 11))), None),
        ("isin_near", F.when(length.isin(11, 12), slip_keys("c", c("isin"))).otherwise(none),
         F.when(F.length("m_isin") == 12, slip_keys("c", c("m_isin"))).otherwise(none), near_code(c("isin"), c("m_isin"))),
        ("ticker_name", some(c("ticker").isNotNull() & c("squashed").isNotNull(), tagged("t", c("ticker")), tagged("9", F.coalesce(c("tail"), c("ticker")))),
         some(c("m_ticker").isNotNull(), tagged("t", c("m_ticker")), tagged("9", F.coalesce(c("m_tail"), c("m_ticker")))), name_fits | F.coalesce(first_cut, F.lit(False))),
        ("name", some(c("core").isNotNull(), tagged("n", c("squashed"), c("kind"))), some(c("m_core").isNotNull(), tagged("n", c("m_squashed"), c("m_kind"))), open_ids),
        ("name_near", F.when(first_ok, slip_keys("d", c("first"), c("rest"))).otherwise(none),
         F.when(c("m_first").rlike("^[a-z]{4,}$"), slip_keys("d", c("m_first"), c("m_rest"))).otherwise(none),
         slip & open_ids),
    ]


def cascade(records: DataFrame, reference: DataFrame) -> DataFrame:
    """Resolve distinct records. ``records``: rid, label (the known entity or null) and KEYS; ``reference``: entity and KEYS,
    one row per entity. Gives (rid, label, entity, rule) of those that some rule resolved; labelled records stay in the
    cascade and come out once for every rule that answers them.

    Two entities that answer one record leave it open for the next rule. Each pass is written to the shared folder.
    """
    m = reference.select("entity", *[F.col(k.split()[0]).alias("m_" + k.split()[0]) for k in KEYS.split(", ")])
    listed = m.where(F.col("m_ticker").isNotNull()).select(F.col("m_ticker").alias("ticker"), F.lit(True).alias("ticker_elsewhere")).distinct()
    todo = cut(records.join(listed, "ticker", "left").withColumn("ticker_elsewhere", F.coalesce("ticker_elsewhere", F.lit(False))), "match-open")
    m = cut(m, "match-reference")
    resolved = None
    for name, own, theirs, check in rules():
        keyed = todo.withColumn("key", F.explode(own))
        pairs = keyed.join(m.withColumn("key", F.explode(theirs)), "key")
        if check is not None:
            pairs = pairs.where(check)
        hits = pairs.groupBy("rid").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).where(F.col("entity") == F.col("other"))
        done = cut(todo.select("rid", "label").join(hits.select("rid", "entity"), "rid").withColumn("rule", F.lit(name)), "match-" + name)
        if name != rules()[-1][0]:
            todo = cut(todo.join(done.where(F.col("label").isNull()).select("rid"), "rid", "left_anti"), "match-open")
        resolved = done if resolved is None else resolved.unionByName(done)
    return resolved


def match_holdings(holdings: DataFrame, securities: DataFrame, labelled: int = 50_000) -> DataFrame:
    """(holding_key, security_key, rule, confidence) for rows without security_key that mean a listed security.

    Confidence comes from about ``labelled`` rows that have a security_key (all of them where there are fewer), taken by hash.

    Attributes: held_isin_raw, held_ticker_raw, security_name_raw, any of them null or empty. Cash, derivatives and unlisted
    securities match nothing and don't come out. Re-delivered rows come out once. Either table may be empty.
    """
    words = frequent_words(securities, "issuer_name")
    ref = with_keys(securities.where(F.col("security_key").isNotNull()).select(F.col("security_key").alias("entity"), F.col("isin").alias("i"), F.col("ticker").alias("t"), F.col("security_name").alias("n")),
                    "i", "t", "n", words).drop("i", "t", "n")
    attributes = ["held_isin_raw", "held_ticker_raw", "security_name_raw"]
    rid = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in attributes]))
    rows = holdings.select("holding_key", "security_key", *attributes, rid.alias("combination"))
    known = holdings.where(F.col("security_key").isNotNull()).count()
    sampled = F.col("security_key").isNull() | (F.pmod(F.xxhash64("combination"), F.lit(max(1, -(-known // labelled)))) == 0)
    # what a labelled record means may differ from row to row, so its label is part of it
    distinct = rows.where(sampled).groupBy("combination", "security_key", *attributes).agg(F.count(F.lit(1)).alias("n_rows"))
    records = with_keys(distinct.select(F.concat_ws("|", "combination", "security_key").alias("rid"), F.col("security_key").alias("label"), *attributes, "n_rows"), *attributes, words).drop(*attributes)
    resolved = cascade(records, ref)
    right = F.when(F.col("label") == F.col("entity"), 1).otherwise(0)
    precision = resolved.where(F.col("label").isNotNull()).groupBy("rule").agg(F.sum(right).alias("right"), F.count(F.lit(1)).alias("tried"))
    prior = resolved.select("rule").distinct()
    confidence = prior.join(precision, "rule", "left").select("rule", ((F.coalesce("right", F.lit(0)) + 1) / (F.coalesce("tried", F.lit(0)) + 2)).alias("confidence"))
    answers = resolved.where(F.col("label").isNull()).select(F.col("rid").alias("combination"), F.col("entity").alias("matched"), "rule")
    answers = answers.join(F.broadcast(confidence), "rule")  # one row per rule
    open_rows = rows.where(F.col("security_key").isNull()).select("holding_key", "combination")
    return open_rows.join(answers, "combination").groupBy("holding_key").agg(
        F.min("matched").alias("security_key"), F.min("rule").alias("rule"), F.min("confidence").alias("confidence"))

"""Offline evaluation: recall, sweeps, confusion, budgets, run summaries."""
from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graindeck.functions import spans as K
from graindeck.functions.text import covers, token_estimate
from graindeck.session import parallelism


def cross_form_sweep(scores: DataFrame, thresholds: Sequence[float], cuts: Sequence[int]) -> DataFrame:
    """Leave-one-form-out: from (query_id, query_label, semantic_id, score) of queries against all other forms, per threshold and cut:
    recall, mean reciprocal rank, mean candidates and mean competing ids. Best form per id first; the grid is small and broadcast."""
    spark = scores.sparkSession
    best = scores.groupBy("query_id", "query_label", "semantic_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "semantic_id")))
    grid = spark.createDataFrame([(float(t), int(k)) for t in thresholds for k in cuts], "threshold double, top_k int")
    # ranks don't change under a threshold, as they follow the score
    g = ranked.join(F.broadcast(grid), (F.col("score") >= F.col("threshold")) & (F.col("rank") <= F.col("top_k")))
    own = F.col("semantic_id") == F.col("query_label")
    per = g.groupBy("threshold", "top_k", "query_id").agg(F.max(own.cast("int")).alias("hit"), F.max(F.when(own, 1.0 / F.col("rank"))).alias("rr"), F.count(F.lit(1)).alias("n"), F.count_if(~own).alias("other"))
    queries = scores.agg(F.countDistinct("query_id").alias("q"))
    out = grid.join(per.groupBy("threshold", "top_k").agg(F.sum("hit").alias("h"), F.sum("rr").alias("r"), F.sum("n").alias("n"), F.sum("other").alias("o")), ["threshold", "top_k"], "left").na.fill(0)
    q = queries.scalar()
    return out.select("threshold", "top_k", F.round(F.col("h") / q, 6).alias("recall"), F.round(F.col("r") / q, 6).alias("mrr"), F.round(F.col("n") / q, 6).alias("mean_candidates"), F.round(F.col("o") / q, 6).alias("mean_competing"))


def recall_at(returned: DataFrame, required: DataFrame, k: int, case: str = "case_id") -> DataFrame:
    """One row: cases, cases all of whose required ids are among the first k returned, micro and macro recall. ``returned``: case, id, rank."""
    hit = required.select(case, "id").distinct().join(returned.where(F.col("rank") <= k).select(case, "id").distinct().withColumn("h", F.lit(1)), [case, "id"], "left")
    per = hit.groupBy(case).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h"))
    return per.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("n") == F.col("h")).alias("n_complete"), F.round(F.sum("h") / F.sum("n"), 6).alias("micro_recall"), F.round(F.avg(F.col("h") / F.col("n")), 6).alias("macro_recall"))


def quantile_thresholds(scores: DataFrame, score: str, points: Sequence[float] = (0, 0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """One row per point: the score's linear quantile there."""
    one = scores.agg(F.percentile(score, F.array(*[F.lit(float(p)) for p in points])).alias("v"))
    return one.select(F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in points]).alias("point"), F.col("v").alias("threshold"))).alias("z")).select(F.col("z.point").alias("point"), F.round("z.threshold", 6).alias("threshold"))


def miss_reason(ranked: DataFrame, required: DataFrame, threshold: float, top_k: int, merged_k: int, case: str = "case_id") -> DataFrame:
    """(case, id, reason) of required ids: found, or the step that lost them: not_scored, threshold, top_k, merge. ``ranked``: case, id, score, rank,
    merged_rank."""
    j = required.join(ranked, [case, "id"], "left")
    reason = (F.when(F.col("score").isNull(), "not_scored").when(F.col("score") < threshold, "threshold").when(F.col("rank") > top_k, "top_k").when(F.coalesce("merged_rank", F.lit(2**31 - 1)) > merged_k, "merge").otherwise("found"))
    return j.select(case, "id", reason.alias("reason"))


def recall_by(returned: DataFrame, required: DataFrame, kind: str, case: str = "case_id") -> DataFrame:
    """Recall per kind of the required ids, an id counting as found if it or an equivalent (array column ``equivalents``) was returned."""
    r = required.withColumn("any", F.explode(F.array_union(F.array("id"), F.coalesce("equivalents", F.array().cast("array<string>")))))
    hit = r.join(returned.select(case, F.col("id").alias("any")).distinct().withColumn("h", F.lit(1)), [case, "any"], "left").groupBy(case, kind, "id").agg(F.coalesce(F.max("h"), F.lit(0)).alias("h"))
    return hit.groupBy(kind).agg(F.count(F.lit(1)).alias("n_required"), F.sum("h").alias("n_found"), F.round(F.avg("h"), 6).alias("recall"))


def confusion(returned: DataFrame, expected: DataFrame, confusable: DataFrame, case: str = "case_id") -> DataFrame:
    """Counts per category of returned and expected ids: correct, confusable, irrelevant, missing."""
    e = expected.select(case, "id").distinct().withColumn("e", F.lit(True))
    c = confusable.select(case, "id").distinct().withColumn("c", F.lit(True))
    r = returned.select(case, "id").distinct().withColumn("r", F.lit(True))
    j = e.join(r, [case, "id"], "full").join(c, [case, "id"], "left")
    cat = F.when(F.col("e") & F.col("r"), "correct").when(F.col("e").isNotNull(), "missing").when(F.col("c").isNotNull(), "confusable").otherwise("irrelevant")
    return j.groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def case_precision(cases: DataFrame) -> DataFrame:
    """precision, irrelevant and missing of each case from its expected and returned id arrays, and whether all were returned."""
    both = F.array_intersect("expected", "returned")
    return cases.select("case_id", F.round(F.when(F.size("returned") > 0, F.size(both) / F.size("returned")).otherwise(0.0), 6).alias("precision"), F.size(F.array_except("returned", "expected")).alias("n_irrelevant"),
                        F.size(F.array_except("expected", "returned")).alias("n_missing"), covers(F.col("expected"), F.col("returned")).alias("complete"))


def budget_simulation(ranked: DataFrame, required: DataFrame, budgets: dict[str, int], case: str = "case_id") -> DataFrame:
    """One row: recall with seats per kind against the same number of seats in one list. ``ranked``: case, id, kind, rank."""
    seat = F.row_number().over(Window.partitionBy(case, "kind").orderBy("rank"))
    allowed = F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv])[F.col("kind")]
    total = sum(budgets.values())
    r = ranked.withColumn("by_kind", F.coalesce(seat <= allowed, F.lit(False))).withColumn("by_list", F.row_number().over(Window.partitionBy(case).orderBy("rank")) <= total)
    j = required.join(r, [case, "id"], "left")
    return j.agg(F.round(F.avg(F.coalesce("by_kind", F.lit(False)).cast("int")), 6).alias("recall_by_kind"), F.round(F.avg(F.coalesce("by_list", F.lit(False)).cast("int")), 6).alias("recall_by_list"))


def run_summary(runs: DataFrame) -> DataFrame:
    """From (run_id, case_id, repeat, passed, latency_ms): per run the pass rate, cases that passed in every, some or no repeat, unstable ones, and latency."""
    case = runs.groupBy("run_id", "case_id").agg(F.bool_and("passed").alias("a"), F.bool_or("passed").alias("s"), F.count_if("passed").alias("p"), F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("l"), F.max("latency_ms").alias("m"))
    return case.groupBy("run_id").agg(F.round(F.sum("p") / F.sum("n"), 6).alias("pass_rate"), F.count_if("a").alias("n_every"), F.count_if(F.col("s") & ~F.col("a")).alias("n_unstable"), F.count_if(~F.col("s")).alias("n_none"),
                                      F.round(F.sum("l") / F.sum("n"), 4).alias("mean_latency"), F.max("m").alias("max_latency"))


def homonyms(forms: DataFrame, word: str, key: str, facts: Sequence[str]) -> DataFrame:
    """Words that name several keys: with equal facts they collapse to the least key, with different ones they are ambiguous."""
    g = forms.groupBy(word).agg(F.countDistinct(key).alias("n_keys"), F.countDistinct(F.struct(*facts)).alias("n_readings"), F.min(key).alias("least"))
    return g.where(F.col("n_keys") > 1).select(word, "n_keys", F.when(F.col("n_readings") > 1, "ambiguous").otherwise("collapsed").alias("outcome"), F.when(F.col("n_readings") == 1, F.col("least")).alias("chosen"))


def comparable(reports: DataFrame, facts: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """One row (per group): may these reports be compared, which they may if they agree in all facts?"""
    return reports.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_reports"), (F.countDistinct(F.struct(*facts)) <= 1).alias("comparable"))


def adjusted_gold(gold: DataFrame, drops: DataFrame, overrides: DataFrame) -> DataFrame:
    """Gold (case_id, id) after an audit: dropped pairs out, overridden ids replaced."""
    left = gold.join(drops, ["case_id", "id"], "left_anti")
    return left.join(overrides.select("case_id", "id", "new_id"), ["case_id", "id"], "left").select("case_id", F.coalesce("new_id", "id").alias("id")).distinct()


def accepted_gold(gold: DataFrame, drops: DataFrame, overrides: DataFrame, inverses: DataFrame) -> DataFrame:
    """(case_id, id, accepted) after an audit: ``adjusted_gold`` with, for each id, all ids that count for it: itself and what is declared its inverse, in
    either direction (``inverses``: id, inverse)."""
    both = inverses.select("id", "inverse").unionByName(inverses.select(F.col("inverse").alias("id"), F.col("id").alias("inverse"))).groupBy("id").agg(F.collect_set("inverse").alias("more"))
    j = adjusted_gold(gold, drops, overrides).join(both, "id", "left")
    return j.select("case_id", "id", F.sort_array(F.array_union(F.array("id"), F.coalesce("more", F.array().cast("array<string>")))).alias("accepted"))


def rescore_rankings(ranked: DataFrame, accepted: DataFrame, cuts: Sequence[int]) -> DataFrame:
    """Per cut: cases, required ids, ids of which an accepted one is among the first so many of the stored ranking (case_id, id, rank), recall, and cases
    complete. Nothing is retrieved again."""
    best = accepted.select("case_id", "id", F.explode("accepted").alias("any")).join(ranked.select("case_id", F.col("id").alias("any"), "rank"), ["case_id", "any"], "left").groupBy("case_id", "id").agg(F.min("rank").alias("rank"))
    grid = ranked.sparkSession.createDataFrame([(int(k),) for k in cuts], "k int")
    per = best.join(F.broadcast(grid), F.lit(True)).groupBy("k", "case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") <= F.col("k")).alias("h"))
    return per.groupBy("k").agg(F.count(F.lit(1)).alias("n_cases"), F.sum("n").alias("n_required"), F.sum("h").alias("n_found"), F.round(F.sum("h") / F.sum("n"), 6).alias("recall"), F.count_if(F.col("h") == F.col("n")).alias("n_complete"))


def view_payload(candidates: DataFrame, question: str = "question_id", columns: Sequence[str] = ("semantic_id", "kind", "label")) -> DataFrame:
    """(question, payload, n_candidates, n_chars, n_bytes, token_estimate): what a model is shown of each question's candidates, as JSON in order of the first
    column, and how large that is. Candidates of one question are bounded by its retrieval budget."""
    body = F.to_json(F.sort_array(F.collect_list(F.struct(*columns))))
    p = candidates.groupBy(question).agg(body.alias("payload"), F.count(F.lit(1)).alias("n_candidates"))
    return p.select(question, "payload", "n_candidates", F.length("payload").alias("n_chars"), F.octet_length("payload").alias("n_bytes"), token_estimate(F.col("payload")).alias("token_estimate"))


def greedy_match(pairs: DataFrame, case: str = "case_id") -> DataFrame:
    """Expected against returned records per case, best score first (ties by ids), each used once: (case, expected, returned, score). ``pairs``: case,
    expected, returned, score. Order matters, so a case is matched by itself; a case is one request of tens of records."""

    kind = pairs.schema[case].dataType.simpleString()
    per = pairs.groupBy(case).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "expected", "returned", "score"))).alias("pairs"))

    def one(r: dict) -> Iterator[tuple]:
        used_e, used_r = set(), set()
        for x in r["pairs"]:
            if x["expected"] not in used_e and x["returned"] not in used_r:
                used_e.add(x["expected"])
                used_r.add(x["returned"])
                yield r[case], x["expected"], x["returned"], x["score"]

    return _per_row(per, f"{case} {kind}, expected string, returned string, score double", one)


def _per_row(df: DataFrame, fields: str, one: Callable[[dict], Iterable[tuple]]) -> DataFrame:
    """Rows that ``one`` makes of each row. A row is one question with what belongs to it, tens of entries."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for r in b.to_dict("records") for x in one(r)], columns=names)

    return df.mapInPandas(run, fields)


def span_ledger(matches: DataFrame, question: str = "question_id") -> DataFrame:
    """Which matched spans of a question stand: longest first, then leftmost, none overlapping one that stands. Adds ``stands``. ``matches``: question,
    form_id, start, length. Sequential within a question, whose matches are few."""
    kind = matches.schema[question].dataType.simpleString()
    per = matches.groupBy(question).agg(F.collect_list(F.struct("form_id", "start", "length")).alias("spans"))

    def one(r: dict) -> Iterator[tuple]:
        for s, ok in _standing(r["spans"]):
            yield r[question], s["form_id"], s["start"], s["length"], ok

    return _per_row(per, f"{question} {kind}, form_id string, start int, length int, stands boolean", one)


def _standing(spans: Sequence) -> Iterator[tuple]:
    taken: list[tuple[int, int]] = []
    for s in sorted(spans, key=lambda s: (-s["length"], s["start"], s["form_id"])):
        ok = all(s["start"] >= e or s["start"] + s["length"] <= b for b, e in taken)
        if ok:
            taken.append((s["start"], s["start"] + s["length"]))
        yield s, ok


def scan_forms(questions: DataFrame, forms: DataFrame, bound: int = 100_000) -> DataFrame:
    """(question_id, question, spans) of every question: all occurrences of every form in it, case aside; spans is empty where none occurs. Forms meet
    questions by an equi-join on the form's own text, of whose lengths there are few. Forms are counted and broadcast, more than ``bound`` are joined.
    Spark takes the places for as small as the questions that they are made of, so no join may choose its side by itself, and questions are dealt out first."""
    low = forms.select("form_id", F.lower(F.trim("text")).alias("needle")).where(F.col("needle") != "").distinct()
    sizes = {r[0]: r[1] for r in low.groupBy(F.length("needle")).agg(F.count(F.lit(1))).collect()}  # at most as many as the longest form has letters
    q = questions.where(F.col("question").isNotNull()).select("question_id", "question", F.lower("question").alias("__low"))
    none = F.array().cast("array<struct<start:int,needle:string>>")

    def pieces(k: int) -> Column:
        at = F.sequence(F.lit(1), F.length("__low") - k + 1)
        return F.when(F.length("__low") >= k, F.transform(at, lambda i: F.struct((i - 1).alias("start"), F.substring(F.col("__low"), i, F.lit(k)).alias("needle")))).otherwise(none)

    dealt = q.repartition(parallelism(q.sparkSession), "question_id")
    places = dealt.select("question_id", F.inline(F.flatten(F.array(none, *[pieces(k) for k in sorted(sizes)]))))
    met = places.join(low.hint("broadcast" if sum(sizes.values()) <= bound else "merge"), "needle")
    hits = met.groupBy("question_id").agg(F.collect_list(F.struct("form_id", "start", F.length("needle").alias("length"))).alias("spans"))
    return q.drop("__low").join(hits.hint("merge"), "question_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<form_id:string,start:int,length:int>>")))


def _word_state(word: str) -> str:
    w = word.strip(".,?!").lower()
    if re.fullmatch(K.NUMBER + r"\D{0,2}", w):
        return "number"
    for state, table in (("direction", K.DIRECTIONS), ("comparison", K.COMPARISONS), ("aggregate", K.AGGREGATES)):
        if any(w == f for forms in table.values() for f in forms):
            return state
    if w in K.CONNECTIVES or not w:
        return "connective"
    return "limit" if w in K.LIMIT_PREFIXES + K.LIMIT_COUNTERS else "negation" if w in K.NEGATIONS_ASCII + K.NEGATIONS + K.NEGATIONS_OUTSIDE_COMPARISON else "unknown"


def question_ledger(scanned: DataFrame) -> DataFrame:
    """(question_id, place, start, length, text, state, form_id, frame): every part of a question accounted for, in order. Overlapping forms are resolved as
    in ``span_ledger``; a standing form has state form, each word between them the state that the span grammar gives it, else unknown. A
    frame is a standing form with the words behind it; words before the first form are frame 0. ``scanned``: see ``scan_forms``."""
    kind = scanned.schema["question_id"].dataType.simpleString()

    def one(r: dict) -> Iterator[tuple]:
        spans = sorted((s["start"], s["length"], s["form_id"]) for s, ok in _standing(r["spans"]) if ok)
        parts, at = [], 0
        for start, length, form in [*spans, (len(r["question"]), 0, None)]:
            parts += [(at + m.start(), len(m[0]), _word_state(m[0]), None) for m in re.finditer(r"\S+", r["question"][at:start])]
            if form is not None:
                parts.append((start, length, "form", form))
            at = max(at, start + length)
        frame = 0
        for place, (start, length, state, form) in enumerate(parts):
            frame += state == "form"
            yield r["question_id"], place, start, length, r["question"][start:start + length], state, form, frame

    return _per_row(scanned, f"question_id {kind}, place int, start int, length int, text string, state string, form_id string, frame int", one)


def case_ledger(ledger: DataFrame, scanned: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per case of a corpus (question_id, anchors: expected form ids, states: expected states of its frames' words): anchors found, anchors swallowed by a
    longer form that stands, parts unknown, states that collapsed (expected, but absent), and whether it passed, that is, none of these is amiss."""
    per = ledger.groupBy("question_id").agg(F.collect_set(F.when(F.col("state") == "form", F.col("form_id"))).alias("stand"), F.collect_set("state").alias("seen"), F.count_if(F.col("state") == "unknown").alias("n_unknown"))
    every = scanned.select("question_id", F.array_distinct(F.transform("spans", lambda s: s["form_id"])).alias("occur"))
    none = F.array().cast("array<string>")
    j = expected.join(per, "question_id", "left").join(every, "question_id", "left")
    j = j.withColumns({c: F.coalesce(c, none) for c in ("stand", "seen", "occur")})
    missing = F.array_except("anchors", "stand")
    out = j.select("question_id", F.size("anchors").alias("n_anchors"), (F.size("anchors") - F.size(missing)).alias("n_found"), F.size(F.array_intersect(missing, F.col("occur"))).alias("n_swallowed"),
                   F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), F.sort_array(F.array_except("states", "seen")).alias("collapsed"))
    return out.withColumn("passed", (F.col("n_found") == F.col("n_anchors")) & (F.col("n_swallowed") == 0) & (F.col("n_unknown") == 0) & (F.size("collapsed") == 0))


@dataclass(frozen=True)
class Caps:
    """What one question may have at most; more blocks it whole, as a lossy list is no list."""

    readings: int = 8  # of one slot
    slots: int = 8
    options: int = 32  # combinations, before impossible ones go
    kept: int = 16  # combinations that may be


def plan_options(slots: DataFrame, caps: Caps | int = Caps(), conflicts: DataFrame | None = None, question: str = "question_id") -> DataFrame:
    """All combinations of one reading per slot, per question: (question, n_options, n_kept, options, blocked, reason). Combinations with two readings that can't
    stand together (``conflicts``: reading, other, a few pairs) go, which loses nothing; a cap that is exceeded is named in ``reason`` and no
    option comes out. A number as ``caps`` caps the combinations alone. ``slots``: question, slot, reading; null readings are none."""
    kind = slots.schema[question].dataType.simpleString()
    caps = Caps(2**31, 2**31, caps, caps) if isinstance(caps, int) else caps
    pairs = {frozenset(r) for r in conflicts.select("reading", "other").distinct().collect()} if conflicts is not None else set()
    per = slots.where(F.col("reading").isNotNull()).groupBy(question, "slot").agg(F.sort_array(F.collect_set("reading")).alias("readings")).groupBy(question).agg(F.sort_array(F.collect_list(F.struct("slot", "readings"))).alias("lists"))

    def one(r: dict) -> Iterator[tuple]:
        lists = [list(x["readings"]) for x in r["lists"]]
        n = math.prod(len(x) for x in lists)
        blocked = "readings" if any(len(x) > caps.readings for x in lists) else "slots" if len(lists) > caps.slots else "options" if n > caps.options else None
        kept = [] if blocked else [c for c in itertools.product(*lists) if not any(frozenset(p) in pairs for p in itertools.combinations(c, 2))]
        blocked = blocked or ("kept" if len(kept) > caps.kept else "impossible" if not kept else None)
        yield r[question], n, len(kept), [] if blocked else ["|".join(c) for c in kept], blocked is not None, blocked

    return _per_row(per, f"{question} {kind}, n_options bigint, n_kept bigint, options array<string>, blocked boolean, reason string", one)


def redact(df: DataFrame, text: str, secrets: Sequence[str]) -> DataFrame:
    """A transcript without the given secrets and without anything that looks like a bearer token."""
    c = F.regexp_replace(text, r"(?i)bearer\s+[A-Za-z0-9._\-]+", "Bearer [redacted]")
    for s in secrets:
        c = F.replace(c, F.lit(s), F.lit("[redacted]"))
    return df.withColumn(text, c)


def threshold_sweep(scores: DataFrame, required: DataFrame, unrelated: DataFrame, thresholds: Sequence[float], case: str = "case_id") -> DataFrame:
    """Per threshold: micro recall of the required ids, candidates and competing candidates per case, and candidates of cases that should have
    none. ``scores``: case, id, score; the thresholds are few and broadcast."""
    grid = scores.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    marked = scores.join(required.select(case, "id", F.lit(1).alias("__req")), [case, "id"], "left").join(unrelated.select(case, F.lit(1).alias("__un")).distinct(), case, "left")
    g = marked.join(F.broadcast(grid), F.col("score") >= F.col("threshold")).groupBy("threshold").agg(
        F.count("__req").alias("hits"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("__req").isNull()).alias("competing"), F.count("__un").alias("false_positives"))
    cases, needed = scores.agg(F.countDistinct(case)).scalar(), required.agg(F.count(F.lit(1))).scalar()
    return grid.join(g, "threshold", "left").na.fill(0).select("threshold", F.round(F.col("hits") / needed, 6).alias("recall"), F.round(F.col("n") / cases, 6).alias("mean_candidates"),
                                                              F.round(F.col("competing") / cases, 6).alias("mean_competing"), "false_positives")


def entity_gaps(entities: DataFrame, returned: DataFrame, kind: str) -> DataFrame:
    """Per kind: entities of the vocabulary and how many of them no case ever returned."""
    seen = returned.select("id").distinct().withColumn("__s", F.lit(1))
    return entities.join(seen, "id", "left").groupBy(kind).agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("__s").isNull()).alias("n_never_returned"))


def case_problems(cases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(case_id, problem) of evaluation cases (case_id, question_hash, recorded_hash, required, confusable arrays): a repeated case, a question that
    isn't the recorded one, ids outside the vocabulary, an id both required and confusable, nothing required."""
    many = cases.groupBy("case_id").count().where(F.col("count") > 1).select("case_id", F.lit("repeated_case").alias("problem"))
    ids = cases.select("case_id", F.explode(F.array_union("required", "confusable")).alias("id"))
    unknown = ids.join(vocabulary.select("id").distinct(), "id", "left_anti").select("case_id", F.lit("unknown_id").alias("problem")).distinct()
    own = F.filter(F.array(F.when(~F.col("question_hash").eqNullSafe(F.col("recorded_hash")), F.lit("other_question")), F.when(F.arrays_overlap("required", "confusable"), F.lit("required_and_confusable")),
                           F.when(F.size("required") == 0, F.lit("nothing_required"))), lambda x: x.isNotNull())
    return many.unionByName(unknown).unionByName(cases.select("case_id", F.explode(own).alias("problem")).distinct())


def family_recall(required: DataFrame, returned: DataFrame, case: str = "case_id") -> DataFrame:
    """Per family: required ids (exploded from their ``families``), found ones, recall."""
    r = required.select(case, "id", F.explode("families").alias("family")).join(returned.select(case, "id").distinct().withColumn("__h", F.lit(1)), [case, "id"], "left")
    return r.groupBy("family").agg(F.count(F.lit(1)).alias("n_required"), F.count("__h").alias("n_found"), F.round(F.count("__h") / F.count(F.lit(1)), 6).alias("recall"))


def cap_boundaries(slots: DataFrame, caps: Sequence[int], question: str = "question_id") -> DataFrame:
    """Per cap: questions whose number of plan options lies below, at and above it (those above are blocked). The number is the product of distinct
    readings per slot, so no option is made."""
    per = slots.groupBy(question, "slot").agg(F.countDistinct("reading").alias("r")).groupBy(question).agg(F.round(F.exp(F.sum(F.log("r")))).cast("bigint").alias("n"))
    grid = slots.sparkSession.createDataFrame([(int(c),) for c in caps], "cap bigint")
    return per.join(F.broadcast(grid), F.lit(True)).groupBy("cap").agg(F.count_if(F.col("n") < F.col("cap")).alias("below"), F.count_if(F.col("n") == F.col("cap")).alias("at_cap"), F.count_if(F.col("n") > F.col("cap")).alias("blocked"))


def rescore(runs: DataFrame, criteria: DataFrame) -> DataFrame:
    """(run_id, n, passed_before, passed_now, changed) of archived runs (run_id, case_id, answer, passed) under new criteria (case_id, accepted array)."""
    now = runs.join(criteria, "case_id", "left").withColumn("now", F.coalesce(F.array_contains("accepted", F.col("answer")), F.lit(False)))
    return now.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed_before"), F.count_if("now").alias("passed_now"), F.count_if(F.col("passed") != F.col("now")).alias("changed"))


def decode_nested(outputs: DataFrame, key: str, text: str) -> DataFrame:
    """Requirements nested in JSON ({"requirements": [{"id", "slots": {...}}]}) as flat rows (key, requirement_id, slot, value); broken JSON gives one row
    with the problem and no values."""
    kind = "requirements array<struct<id:string,slots:map<string,string>>>"
    parsed = outputs.select(key, F.from_json(text, kind, {"mode": "PERMISSIVE"}).alias("j"))
    flat = parsed.select(key, F.explode_outer("j.requirements").alias("r")).select(key, F.col("r.id").alias("requirement_id"), F.explode_outer("r.slots").alias("slot", "value"))
    return flat.withColumn("problem", F.when(F.col("requirement_id").isNull(), "unreadable"))


def registry_problems(terms: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, problem) of a registry: a term twice, an owner that isn't a term, a form of no term, a term without a form."""
    twice = terms.groupBy("id").count().where(F.col("count") > 1).select("id", F.lit("repeated_term").alias("problem"))
    ids = terms.select("id").distinct()
    orphan = terms.where(F.col("owner").isNotNull()).select("id", F.col("owner").alias("o")).join(ids.withColumnRenamed("id", "o"), "o", "left_anti").select("id", F.lit("unknown_owner").alias("problem"))
    stray = forms.select("id").distinct().join(ids, "id", "left_anti").select("id", F.lit("form_of_no_term").alias("problem"))
    bare = ids.join(forms.select("id").distinct(), "id", "left_anti").select("id", F.lit("term_without_form").alias("problem"))
    return twice.unionByName(orphan).unionByName(stray).unionByName(bare)

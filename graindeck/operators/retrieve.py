"""Candidate retrieval: surface forms, lexical tiers, vectors, and merging both by semantic id."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graindeck.functions import text as T
from graindeck.operators.select import best_of
from graindeck.session import parallelism

# Tiers in order of strength; which role may match by which, and whether it is embedded.
TIERS = ["exact", "normalized", "phrase", "substring"]
ROLES = {"label": (TIERS, True), "alias": (TIERS, True), "id": (TIERS[:3], False), "definition": (TIERS[:3], True)}
GROUNDING = ["exact", "normalized", "phrase"]


@dataclass(frozen=True)
class Settings:
    """Retrieval settings. What each value was chosen on is recorded beside it (``bases``: name to text); a value that differs from the default without a
    recorded basis shows as set by hand."""

    min_substring_chars: int = 2
    substring_ratio: float = 0.6
    max_candidates: int = 50
    threshold: float = 0.5
    top_k: int = 20
    basis: str = "default; tune with the sweep of evaluate.py"
    bases: tuple[tuple[str, str], ...] = ()

    def recorded(self) -> list[tuple[str, str, str]]:
        """(name, value, basis) of every setting."""
        known, default = dict(self.bases), {f.name: f.default for f in fields(self)}
        if unknown := set(known) - set(default):
            raise ValueError(f"no settings: {sorted(unknown)}")
        names = [n for n in default if n not in ("basis", "bases")]
        return [(n, str(getattr(self, n)), known.get(n) or (self.basis if getattr(self, n) == default[n] else "set by hand")) for n in names]


def surface_forms(terms: DataFrame) -> DataFrame:
    """(form_id, semantic_id, role, text, normal) of terms (semantic_id, labels array, aliases array, definition), white space
    collapsed, empty ones left out, each (semantic_id, role, text) once."""
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    one = lambda role, c: F.struct(F.lit(role).alias("role"), tidy(c).alias("text"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    forms = F.concat(F.array(one("id", F.col("semantic_id"))), F.coalesce(F.transform("labels", lambda x: one("label", x)), none), F.coalesce(F.transform("aliases", lambda x: one("alias", x)), none), F.array(one("definition", F.col("definition"))))
    long = terms.select("semantic_id", F.inline(forms)).where(F.col("text") != "").distinct()
    return long.select(F.sha2(F.concat_ws("\u0001", "semantic_id", "role", "text"), 256).alias("form_id"), "semantic_id", "role", "text", T.retrieval_normal(F.col("text")).alias("normal"))


def allows(role: Column, tier: str) -> Column:
    return role.isin([r for r, (tiers, _) in ROLES.items() if tier in tiers])


def match_pairs(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Tier, score, overlap and occurrences of (question, question_normal) against (text, normal, role) pairs; rows without a tier
    drop out. exact: the stripped texts are equal; normalized: their normal forms are; phrase: the form stands in the question;
    substring: a long enough fragment of it does."""
    fragment = T.longest_fragment(F.col("normal"), F.col("question_normal"), settings.min_substring_chars, settings.substring_ratio)
    role, n = F.col("role"), F.length("normal")
    tier = (F.when(allows(role, "exact") & (F.trim("question") == F.col("text")), "exact").when(allows(role, "normalized") & (F.col("question_normal") == F.col("normal")), "normalized")
            .when(allows(role, "phrase") & (n > 0) & F.contains(F.col("question_normal"), F.col("normal")), "phrase").when(allows(role, "substring") & F.col("fragment").isNotNull(), "substring"))
    p = pairs.withColumn("fragment", F.when(allows(role, "substring") & ~F.contains(F.col("question_normal"), F.col("normal")), fragment)).withColumn("tier", tier).where(F.col("tier").isNotNull())
    span = F.when(F.col("tier") == "substring", F.col("fragment")).otherwise(F.col("normal"))
    whole = F.col("tier").isin("exact", "normalized")
    return p.withColumn("overlap", F.length(span)).withColumn("score", T.coverage_score(F.col("overlap"), n)).withColumn(
        "starts", F.when(whole, F.array(F.lit(0))).otherwise(T.occurrences(F.col("question_normal"), span))).withColumn("reach", F.when(whole, F.length("question_normal")).otherwise(F.col("overlap"))).drop("fragment")


def candidate_pairs(questions: DataFrame, forms: DataFrame, settings: Settings = Settings(), bound: int = 10_000, fragments: bool = True, few: int = 100_000) -> DataFrame:
    """Questions with every form that some tier could match, each pair once, for a vocabulary of any size. Without ``fragments`` only those with every form
    that stands in the question whole.

    Whatever the tier, the question's normal form then holds a stretch of the form's as long as the least fragment that counts (the
    whole form where that is shorter, or where its role admits no fragments). So forms meet questions in an equi-join on their stretches of
    that length. The lengths that occur in the vocabulary, at most as many as its longest form has characters, are collected; more
    than ``bound`` are refused. Forms and questions of which nothing is left meet on the empty stretch. Forms of up to ``few`` stretches are
    broadcast, more are joined; Spark takes what is made of a question for as small as the question, so no join may choose its side by itself.
    """
    n = F.length("normal")
    least = F.greatest(F.lit(settings.min_substring_chars), F.ceil(F.lit(settings.substring_ratio) * n)).cast("int")
    size = F.when(allows(F.col("role"), "substring"), F.least(least, n)).otherwise(n) if fragments else n
    stretches = lambda c, k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, k))
    sized = forms.select("form_id", "role", "text", "normal", size.alias("__k"))
    kinds = [r for r in sized.groupBy("__k").agg(F.sum(F.length("normal") - F.col("__k") + 1).alias("n")).limit(bound + 1).collect() if r["__k"] is not None]
    lengths = sorted(r["__k"] for r in kinds)
    if len(lengths) > bound:
        raise ValueError(f"forms of more than {bound} lengths")
    how = "broadcast" if sum(r["n"] for r in kinds) <= few else "merge"
    keys = sized.select("form_id", "role", "text", F.col("__k"), F.explode(F.array_distinct(stretches("normal", F.col("__k")))).alias("__s"))
    none = F.array().cast("array<struct<k:int,s:string>>")

    def marked(k: int) -> Column:
        here = F.length("question_normal") >= k if k else F.length("question_normal") == 0
        return F.when(here, F.transform(stretches("question_normal", F.lit(k)), lambda s: F.struct(F.lit(k).alias("k"), s.alias("s")))).otherwise(none)

    marks = F.array_distinct(F.flatten(F.array(none, *[marked(k) for k in lengths])))
    asked = questions.repartition(parallelism(questions.sparkSession), "question_id").select("question_id", F.inline(marks).alias("__k", "__s"))
    pairs = asked.join(keys.hint(how), ["__k", "__s"]).select("question_id", "form_id", "role", "text").distinct()
    return pairs.join(questions.hint("merge"), "question_id").join(forms.hint(how), ["form_id", "role", "text"])


def downgrade_shadowed(matches: DataFrame, question: str = "question_id") -> DataFrame:
    """Phrases that only ever stand inside an occurrence of a longer grounded form of the same question become substrings."""
    grounded = matches.where(F.col("tier").isin(GROUNDING)).select(question, F.length("normal").alias("o_len"), F.explode("starts").alias("o_start"), F.col("reach").alias("o_reach"))
    phrases = matches.where(F.col("tier") == "phrase").select(question, "form_id", F.length("normal").alias("len"), "reach", F.explode("starts").alias("start"))
    inside = (F.col("o_len") > F.col("len")) & (F.col("o_start") <= F.col("start")) & (F.col("start") + F.col("reach") <= F.col("o_start") + F.col("o_reach"))
    shaded = phrases.join(grounded, question).groupBy(question, "form_id", "start").agg(F.max(inside).alias("s")).groupBy(question, "form_id").agg(F.bool_and("s").alias("shadowed"))
    out = matches.join(shaded, [question, "form_id"], "left")
    return out.withColumn("tier", F.when((F.col("tier") == "phrase") & F.coalesce("shadowed", F.lit(False)), "substring").otherwise(F.col("tier"))).drop("shadowed")


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)


def best_per_term(matches: DataFrame, question: str = "question_id", settings: Settings = Settings()) -> DataFrame:
    """One match per question and term, the strongest (tier, score, length, form id), with its rank; cut at max_candidates, with how many
    of a question's terms the cut left out."""
    order = F.struct(tier_rank(F.col("tier")).alias("t"), (-F.col("score")).alias("s"), (-F.length("normal")).alias("n"), F.col("form_id").alias("f"))
    best = best_of(matches.withColumn("order", order), [question, "semantic_id"], F.col("order"), ["form_id", "tier", "score", "role", "text", "normal", "order"])
    w = Window.partitionBy(question)
    ranked = best.withColumn("rank", F.row_number().over(w.orderBy("order"))).withColumn("truncated", F.greatest(F.count(F.lit(1)).over(w) - settings.max_candidates, F.lit(0)))
    return ranked.where(F.col("rank") <= settings.max_candidates).drop("order")


def search_blocks(entries: DataFrame, queries: DataFrame, key: str, vector: str, threshold: float | None = None, top_k: int | None = None, block: int = 512, chunk: int = 4096, digits: int | None = 5) -> DataFrame:
    """(key, query_id, score[, rank]): a stated query set against all entries by inner product in double, exhaustively.

    Entries are packed into chunks and queries into blocks of about a fixed number of vectors, by hash; every chunk meets every block
    once and a pair is one matrix product in a worker. Neither side is broadcast or collected, and a task holds one chunk and
    one block. With ``top_k`` a pair passes on its k best per query (all ties) and the final cut, ties by key, ranks those few. Scores are rounded to ``digits`` last, if at all.
    """
    kind = entries.schema[key].dataType.simpleString()

    def packed(df: DataFrame, size: int, name: str) -> DataFrame:
        parts = max(1, -(-df.count() // size))
        return df.select(F.pmod(F.xxhash64(key), F.lit(parts)).alias("__p"), F.struct(F.col(key).alias("k"), F.col(vector).alias("v")).alias("__s")).groupBy("__p").agg(F.collect_list("__s").alias(name)).drop("__p")

    pairs = packed(entries, chunk, "e").join(packed(queries, block, "q"), F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for e, q in zip(b.column(0), b.column(1)):
                (ek, ev), (qk, qv) = ((x.values.field("k"), np.array(x.values.field("v").to_pylist(), float)) for x in (e, q))
                s = ev.reshape(len(ek), -1) @ qv.reshape(len(qk), -1).T
                if threshold is not None:
                    i, j = np.nonzero(s >= threshold)
                elif top_k is not None and len(s) > top_k:
                    i, j = np.nonzero(s >= np.partition(s, len(s) - top_k, axis=0)[len(s) - top_k][None, :])
                else:
                    i, j = np.nonzero(np.ones_like(s, bool))
                yield pa.RecordBatch.from_arrays([ek.take(pa.array(i)), qk.take(pa.array(j)), pa.array(s[i, j])], names=[key, "query_id", "score"])

    out = pairs.mapInArrow(run, f"{key} {kind}, query_id {kind}, score double")
    if top_k is not None:
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return out if digits is None else out.withColumn("score", F.round("score", digits))


def embedding_candidates(scores: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """From (query_id, semantic_id, entry, score): those at or above the threshold, best entry per id, then the top_k ids. Never groundable."""
    kept = scores.where(F.col("score") >= settings.threshold)
    best = best_of(kept, ["query_id", "semantic_id"], F.struct(-F.col("score"), F.col("entry")), ["entry", "score"])
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "semantic_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= settings.top_k)


def merge_paths(rule: DataFrame, vectors: DataFrame | None, keys: Sequence[str] = ("question_id", "semantic_id")) -> DataFrame:
    """Both paths by id: what each says, in merged order groundable first, then rule rank, similarity, id. ``vectors`` None: that path was not
    available, the rule results stay and say so."""
    r = rule.select(*keys, F.col("tier"), F.col("rank").alias("rule_rank"), F.col("score").alias("rule_score"))
    if vectors is None:
        out = r.withColumns({"similarity": F.lit(None).cast("double"), "vector_rank": F.lit(None).cast("int"), "vector_path": F.lit("unavailable")})
    else:
        v = vectors.select(*keys, F.col("score").alias("similarity"), F.col("rank").alias("vector_rank"))
        out = r.join(v, list(keys), "full").withColumn("vector_path", F.lit("available"))
    out = out.withColumn("groundable", F.coalesce(F.col("tier").isin(GROUNDING), F.lit(False)))
    out = out.withColumn("paths", F.filter(F.array(F.when(F.col("rule_rank").isNotNull(), F.lit("rule")), F.when(F.col("vector_rank").isNotNull(), F.lit("embedding"))), lambda x: x.isNotNull()))
    order = [F.col("groundable").desc(), F.col("rule_rank").asc_nulls_last(), F.col("similarity").desc_nulls_last(), F.col(keys[1])]
    return out.withColumn("position", F.row_number().over(Window.partitionBy(keys[0]).orderBy(*order)))


def ambiguities(matches: DataFrame, question: str = "question_id") -> DataFrame:
    """Grounded normal expressions that name more than one id: (question, normal, display: shortest then first text, ids)."""
    g = matches.where(F.col("tier").isin(GROUNDING)).groupBy(question, "normal").agg(
        F.min_by("text", F.struct(F.length("text"), F.col("text"))).alias("display"), F.sort_array(F.collect_set("semantic_id")).alias("ids"))
    return g.where(F.size("ids") > 1)


def question_status(questions: DataFrame, merged: DataFrame, ambiguous: DataFrame, question: str = "question_id") -> DataFrame:
    """unresolved (nothing groundable), ambiguous, or candidates."""
    g = merged.groupBy(question).agg(F.bool_or("groundable").alias("g"), F.count(F.lit(1)).alias("n_candidates"))
    a = ambiguous.select(question).distinct().withColumn("a", F.lit(True))
    out = questions.select(question).join(g, question, "left").join(a, question, "left")
    status = F.when(~F.coalesce("g", F.lit(False)), "unresolved").when(F.coalesce("a", F.lit(False)), "ambiguous").otherwise("candidates")
    return out.select(question, status.alias("status"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def index_usable(forms: DataFrame, index: DataFrame, registry_hash: str, index_hash: str, provider: str = "", index_provider: str = "") -> DataFrame:
    """(problem, n): why an index can't serve a vocabulary; empty if it can. Embeddable forms must be covered exactly, by vectors of one width, made
    from this registry by the provider (model and version) that will embed the questions."""
    wanted = forms.where(F.col("role").isin([r for r, (_, e) in ROLES.items() if e])).select("form_id")
    missing = wanted.join(index.select("form_id"), "form_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("missing_forms"))
    unknown = index.select("form_id").join(wanted, "form_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("unknown_forms"))
    widths = index.select(F.size("vector").alias("w")).groupBy("w").count().agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("n")).withColumn("problem", F.lit("unequal_widths"))
    out = missing.unionByName(unknown).unionByName(widths)
    for problem, same in (("other_registry", registry_hash == index_hash), ("other_provider", provider == index_provider)):
        if not same:
            out = out.unionByName(forms.sparkSession.createDataFrame([(1, problem)], "n bigint, problem string"))
    return out.where(F.col("n") > 0).select("problem", "n")

"""Validation of submitted requirements against the registry: many requests at once, refusing whatever would need a guess.

Every check is a projection or a join that yields (request_id, requirement_id, code); the codes of a requirement decide it. A
requirement that its sender left open is kept as it is and checked no further.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graindeck.functions import spans as K
from graindeck.functions import text as T
from graindeck.session import cut

# Kinds that must name what they want, kinds that nothing reads yet, and codes that leave a requirement ambiguous.
NEEDS_OUTPUT = ["attribute_lookup"]
NO_CANONICALIZER = ["grouping", "comparison", "explanation"]
AMBIGUOUS_CODES = ["relation_direction_undecidable"]
REF = ["request_id", "ref"]
KEY = ["request_id", "requirement_id"]

REQUIREMENTS = ("request_id string, requirement_id string, kind string, status string, source_span string, targets array<string>, fields array<struct<ref:string,role:string>>, "
                "conditions array<struct<ref:string,comparison:string,value:string>>, ordering struct<ref:string,direction:string>, limit_span string, aggregation struct<ref:string,function:string>, relation struct<predicate:string,anchor:string>")
VIEW = "request_id string, ref string, ref_kind string, semantic_id string, families array<string>, grains array<string>, scope string, unit string, operations array<string>"


def _issues(rows: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    codes = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for bad, code in checks]))
    return rows.select(*KEY, F.explode(codes).alias("code"))


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _spans() -> Column:
    """Every quoted part of a requirement."""
    one = lambda c: F.array(c)
    return F.concat(one(F.col("source_span")), F.flatten(F.transform("conditions", lambda c: F.array(c["comparison"], c["value"]))), one(F.col("ordering.direction")), one(F.col("limit_span")), one(F.col("aggregation.function")))


def _all_fields() -> Column:
    """(ref, role) of every field a requirement refers to."""
    pair = lambda ref, role: F.struct(ref.alias("ref"), F.lit(role).alias("role"))
    more = F.concat(F.transform("conditions", lambda c: pair(c["ref"], "condition")), F.array(pair(F.col("ordering.ref"), "order")), F.array(pair(F.col("aggregation.ref"), "aggregate")))
    return F.array_distinct(F.concat("fields", F.filter(more, lambda x: x["ref"].isNotNull())))


def _referenced(refs: DataFrame, view: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """References of one kind joined with what the request was shown, and the issues of those that it wasn't or that are of another kind."""
    j = refs.join(view, REF, "left")
    wrong = _issues(j, (F.col("ref_kind").isNull(), "unknown_ref"), (F.col("ref_kind") != kind, "ref_kind_mismatch"))
    return j.where(F.col("ref_kind") == kind), wrong


def _bound(fields: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields bound to the targets whose families and grains they share, and the issues of those that no target has."""
    open_ = fields.where(F.col("scope") == "scope_unproven")
    t = targets.select(*KEY, F.col("semantic_id").alias("dataset"), F.col("families").alias("t_families"), F.col("grains").alias("t_grains"))
    j = fields.where(~F.col("scope").eqNullSafe("scope_unproven")).join(t, KEY, "left")
    family, grain = (F.coalesce(F.arrays_overlap(a, b), F.lit(False)) for a, b in (("families", "t_families"), ("grains", "t_grains")))
    j = j.withColumns({"fits": family & grain, "near": family & ~grain})
    per = j.groupBy(*KEY, "ref", "role").agg(F.bool_or("fits").alias("fits"), F.bool_or("near").alias("near"))
    issues = _issues(open_, (F.lit(True), "field_scope_unproven")).unionByName(_issues(per, (~F.col("fits") & F.col("near"), "field_grain_mismatch"), (~F.col("fits") & ~F.col("near"), "cross_family_field")))
    return j.where("fits").select(*KEY, F.struct("dataset", F.col("semantic_id").alias("field"), "role").alias("binding")), issues


def _related(asked: DataFrame, view: DataFrame, entities: DataFrame, relations: DataFrame, kinds: DataFrame, targets: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The predicate and direction that each relation resolves to, and the first thing that stops it.

    A predicate may be read forward or as its declared inverse; the one whose domain the anchor is of is meant, and must be one. ``kinds``:
    (node, ancestor) with every node its own ancestor; ``families``: (node, families).
    """
    p = view.select("request_id", F.col("ref").alias("predicate"), F.col("ref_kind").alias("p_kind"), F.col("semantic_id").alias("p_id"))
    e = entities.select("request_id", F.col("ref").alias("anchor"), "class_id", "resolved")
    j = asked.join(p, ["request_id", "predicate"], "left").join(e, ["request_id", "anchor"], "left")
    first = (F.when(F.col("p_kind").isNull(), "unknown_ref").when(F.col("p_kind") != "predicate", "ref_kind_mismatch").when(F.col("class_id").isNull(), "unknown_ref").when(~F.col("resolved"), "entity_unresolved"))
    j = j.withColumn("stop", first)
    inverse = relations.select(F.col("relation").alias("given"), "inverse_of").where(F.col("inverse_of").isNotNull())
    either = inverse.unionByName(inverse.select(F.col("inverse_of").alias("given"), F.col("given").alias("inverse_of"))).distinct()
    options = relations.select(F.col("relation").alias("p_id"), "relation", "domain", "range").unionByName(
        either.join(relations.select(F.col("relation").alias("inverse_of"), "domain", "range"), "inverse_of").select(F.col("given").alias("p_id"), F.col("inverse_of").alias("relation"), "domain", "range")).distinct()
    fits = j.where(F.col("stop").isNull()).join(options, "p_id").join(kinds.select(F.col("node").alias("class_id"), F.col("ancestor").alias("domain")), ["class_id", "domain"])
    one = fits.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("relation", "domain", "range", "p_id")).alias("o"))
    chosen = one.where(F.col("n") == 1).select(*KEY, "o.*")
    # what the relation yields must be what a target is
    aims = targets.select(*KEY, F.col("semantic_id").alias("node"), F.col("families").alias("t_families"))
    hit = chosen.join(aims, KEY, "left").join(kinds.select("node", F.col("ancestor").alias("range"), F.lit(True).alias("is_kind")), ["node", "range"], "left").join(
        families.select(F.col("node").alias("range"), F.col("families").alias("r_families")), "range", "left")
    hit = hit.groupBy(*KEY).agg(F.count("node").alias("n_targets"), F.coalesce(F.bool_or("is_kind"), F.lit(False)).alias("is_kind"),
                                F.coalesce(F.bool_or(F.arrays_overlap("r_families", "t_families")), F.lit(False)).alias("shares"), F.coalesce(F.max(F.size("r_families")), F.lit(0)).alias("n_families"))
    late = F.when((F.col("n_targets") > 0) & ~F.col("is_kind"), "relation_target_mismatch").when((F.col("n_families") > 0) & ~F.col("shares"), "cross_family_predicate")
    done = j.join(one.select(*KEY, "n"), KEY, "left").join(hit.select(*KEY, late.alias("late")), KEY, "left")
    code = F.coalesce("stop", F.when(F.coalesce("n", F.lit(0)) != 1, F.lit("relation_direction_undecidable")), "late")
    good = chosen.join(done.where(code.isNull()).select(*KEY), KEY, "left_semi")
    way = F.when(F.col("relation") == F.col("p_id"), "forward").otherwise("inverse")
    return good.select(*KEY, F.struct("relation", way.alias("direction"), F.col("domain").alias("subject"), F.col("range").alias("object")).alias("relation")), done.select(*KEY, code.alias("code")).where(F.col("code").isNotNull())


def _read(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """Issues of quoted slots that don't read as an execution value, or whose field doesn't permit the operation."""
    one = lambda slot, ref, text, value: F.struct(F.lit(slot).alias("slot"), ref.alias("ref"), text.alias("text"), value.alias("value"))
    none = F.lit(None).cast("string")
    single = F.array(one("order", F.col("ordering.ref"), F.col("ordering.direction"), none), one("aggregate", F.col("aggregation.ref"), F.col("aggregation.function"), none), one("limit", F.lit(""), F.col("limit_span"), none))
    every = F.concat(F.transform("conditions", lambda c: one("filter", c["ref"], c["comparison"], c["value"])), F.filter(single, lambda x: x["ref"].isNotNull() & ~((x["slot"] == "limit") & _blank(x["text"]))))
    low = lambda c: F.lower(F.trim(T.span_normal(F.col(c))))
    slots = rows.select(*KEY, F.inline(every)).withColumns({"text": low("text"), "value": low("value")})
    known = fields.groupBy(*REF).agg(F.first("unit").alias("unit"), F.first("operations").alias("operations"))  # one row of the view per reference
    slots = cut(slots.join(known, REF, "left"), "slots")  # the readings below name each text often
    text, operations = F.col("text"), F.col("operations")
    refusals = {"order": [K.permitted(K.read_direction(text), operations, "order")], "aggregate": [K.permitted(K.read_aggregate(text), operations, "aggregate")], "limit": [K.read_limit(text)],
                "filter": [K.permitted(K.read_comparison(text), operations, "filter"), K.read_value(F.col("value"), F.col("unit"))]}
    refused = reduce(lambda rest, k: F.when(F.col("slot") == k, F.coalesce(*[r["refusal"] for r in refusals[k]])).otherwise(rest), refusals, none)
    return slots.where(refused.isNotNull()).select(*KEY, F.lit("canonicalization_refused").alias("code"))


def validate(requirements: DataFrame, questions: DataFrame, view: DataFrame, entities: DataFrame, relations: DataFrame, ancestors: DataFrame, families: DataFrame) -> DataFrame:
    """(request_id, requirement_id, decision, codes, targets, bindings, relation): mapped where no check fails, ambiguous where the sender left it
    so or a relation has no single direction, else unresolved; codes sorted, each once.

    ``requirements``: REQUIREMENTS; ``questions``: request_id, question; ``view``: VIEW, what each request was shown; ``entities``: request_id, ref, class_id,
    resolved; ``relations``: relation, domain, range, inverse_of; ``ancestors``: node, ancestor (closed); ``families``: node, families. A reference that belongs to
    another request is unknown like one that never was. Null arrays count as empty.
    """
    empty = {"targets": "array<string>", "fields": "array<struct<ref:string,role:string>>", "conditions": "array<struct<ref:string,comparison:string,value:string>>"}
    r = requirements.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in empty.items()})
    left_open = r.where(~F.col("status").eqNullSafe("mapped"))
    m = r.where(F.col("status") == "mapped")
    issues = [_issues(left_open, (F.col("status") == "ambiguous", "requirement_ambiguous"), (~F.col("status").eqNullSafe("ambiguous"), "requirement_unresolved"))]
    # spans are quotations
    q = m.join(questions, "request_id", "left")
    quoted = q.select(*KEY, "question", F.explode(_spans()).alias("span")).where(~_blank(F.col("span")))
    placed = T.alignment(F.col("question"), F.col("span"), T.span_normal(F.col("question")), T.span_normal(F.col("span")))
    issues += [_issues(m, (_blank(F.col("source_span")), "missing_source_span")), _issues(quoted, (F.coalesce(placed, F.lit("not_in_question")) == "not_in_question", "span_alignment_failed"))]
    # what it is about
    targets, wrong = _referenced(m.select(*KEY, F.explode("targets").alias("ref")), view, "dataset")
    targets, wrong = cut(targets, "targets"), cut(wrong, "targets-unknown")  # each is read by several checks
    issues.append(wrong)
    complete = m.join(wrong.select(*KEY).distinct(), KEY, "left_anti")
    output = F.exists("fields", lambda x: x["role"] == "output") | F.col("relation").isNotNull()
    none, kind = F.size("targets") == 0, F.col("kind")
    issues.append(_issues(complete, (none, "missing_target_dataset"), (none & ~output & (F.size("conditions") == 0), "empty_requirement"), (
        (kind.isin(NEEDS_OUTPUT) & ~output) | ((kind == "aggregation") & (F.col("aggregation.ref").isNull() | _blank(F.col("aggregation.function")))) | ((kind == "ranking") & (F.col("ordering").isNull() | _blank(F.col("limit_span")))),
        "requirement_incomplete")))
    # its fields, its relation, and what the server can read
    fields, wrong = _referenced(m.select(*KEY, F.inline(_all_fields())), view, "field")
    fields = cut(fields, "fields")
    bindings, unbound = _bound(fields, targets)
    issues += [wrong, unbound, _issues(m, (kind.isin(NO_CANONICALIZER), "canonicalizer_unavailable"))]
    kinds = ancestors.select("node", "ancestor").unionByName(ancestors.select("node", F.col("node").alias("ancestor"))).unionByName(ancestors.select(F.col("ancestor").alias("node"), "ancestor"))
    for known in (entities.select(F.col("class_id").alias("node")), targets.select(F.col("semantic_id").alias("node"))):
        kinds = kinds.unionByName(known.withColumn("ancestor", F.col("node")))
    kinds = kinds.distinct()
    related, stopped = _related(m.where(F.col("relation").isNotNull()).select(*KEY, "relation.*"), view, entities, relations, kinds, targets, families)
    issues += [stopped, _read(m, fields)]
    codes = reduce(DataFrame.unionByName, issues).groupBy(*KEY).agg(F.sort_array(F.collect_set("code")).alias("codes"))
    aims = targets.groupBy(*KEY).agg(F.sort_array(F.collect_set("semantic_id")).alias("aims"))
    bound = bindings.groupBy(*KEY).agg(F.sort_array(F.collect_set("binding")).alias("bindings"))
    out = r.select(*KEY, "status").join(codes, KEY, "left").join(aims, KEY, "left").join(bound, KEY, "left").join(related, KEY, "left")
    decision = F.when(F.col("codes").isNull(), "mapped").when((F.col("status") == "ambiguous") | F.arrays_overlap("codes", F.array(*[F.lit(c) for c in AMBIGUOUS_CODES])), "ambiguous").otherwise("unresolved")
    return out.select(*KEY, decision.alias("decision"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), F.col("aims").alias("targets"), "bindings", "relation")


def request_status(decisions: DataFrame, unaccounted: DataFrame) -> DataFrame:
    """(request_id, status, open_requirements): executable only if every requirement is mapped and no explicit span of the question was left
    unaccounted (``unaccounted``: request_id, span)."""
    left = unaccounted.groupBy("request_id").agg(F.count(F.lit(1)).alias("left"))
    per = decisions.groupBy("request_id").agg(F.sort_array(F.collect_list(F.when(F.col("decision") != "mapped", F.col("requirement_id")))).alias("open_requirements"), F.bool_or(F.col("decision") == "ambiguous").alias("a"))
    j = per.join(left, "request_id", "left")
    status = F.when(F.col("left") > 0, "unaccounted_explicit_span").when(F.size("open_requirements") == 0, "executable").when(F.col("a"), "ambiguous").otherwise("unresolved")
    return j.select("request_id", status.alias("status"), "open_requirements")

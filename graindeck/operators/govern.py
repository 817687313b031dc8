"""Governed execution: a registry of bound fields, fail-closed resolution, selected observations, and rankings with their evidence."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graindeck.operators import observe as O
from graindeck.operators import select as S
from graindeck.session import cut
from graindeck.sources.tables import folded_key, own_subjects


@dataclass(frozen=True)
class Binding:
    """Where a meaning is stored, and what may be done with it."""

    semantic_id: str
    family_id: str
    subject_grain: str
    table: str
    selector_column: str
    selector_value: str
    value_column: str
    operations: tuple[str, ...] = ("order",)
    zero_semantics: str = "included"  # or excluded
    selection: str = "latest_effective_as_of"  # or unique_per_subject
    snapshot: str = "single_effective_date"
    coverage: str = "observed"  # or full, unknown
    max_rows_per_subject: int | None = None
    row_columns: dict[str, str] = field(default_factory=lambda: {"subject": "subject_key", "source": "source_id", "row": "source_row_id", "as_of": "effective_as_of", "status": "value_status"})


class Refused(Exception):
    """A request that the registry doesn't permit: ``code`` names the first check that failed, ``detail`` is safe to show."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail


def resolve(bindings: Sequence[Binding], semantic_id: str, family_id: str, grain: str, operation: str) -> Binding:
    """The one binding of a field; every stage has its own code and the first that fails ends it."""
    stages = [("unknown_field", lambda b: b.semantic_id == semantic_id), ("family_not_bound", lambda b: b.family_id == family_id), ("grain_not_bound", lambda b: b.subject_grain == grain)]
    left = list(bindings)
    for code, test in stages:
        left = [b for b in left if test(b)]
        if not left:
            raise Refused(code, semantic_id)
    if len(left) > 1:
        raise Refused("binding_not_unique", semantic_id)
    b = left[0]
    if operation and operation not in b.operations:
        raise Refused("operation_not_permitted", operation)
    for name in (b.table, b.selector_column, b.value_column, *b.row_columns.values()):
        if not O.IDENTIFIER.match(name):
            raise Refused("unsafe_identifier", name)
    if set(b.row_columns) < {"subject", "source", "row", "as_of", "status"}:
        raise Refused("row_binding_missing", semantic_id)
    if b.selector_column == b.value_column:
        raise Refused("selector_not_isolated", semantic_id)
    if b.selection not in ("latest_effective_as_of", "unique_per_subject") or b.snapshot != "single_effective_date":
        raise Refused("selection_policy_missing", semantic_id)
    return b


def selection_policy(max_rows_per_subject: int | None) -> str:
    if max_rows_per_subject is None or max_rows_per_subject < 1:
        raise Refused("selection_policy_missing")
    return "unique_per_subject" if max_rows_per_subject == 1 else "latest_effective_as_of"


def policy_of(most_rows: Column) -> Column:
    """``selection_policy`` of a column: null where a field has no rows to select from."""
    return F.when(most_rows == 1, "unique_per_subject").when(most_rows > 1, "latest_effective_as_of")


def resolution_funnel(bindings: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, outcome): for many requests (semantic_id, family_id, subject_grain, operation) at once, resolved or the first stage that
    fails. ``bindings``: semantic_id, family_id, subject_grain, operations. One aggregate over one join; bindings are a registry."""
    b = bindings.select(*[F.col(c).alias("b_" + c) for c in ("semantic_id", "family_id", "subject_grain", "operations")])
    j = requests.join(b, F.col("semantic_id") == F.col("b_semantic_id"), "left")
    fam, grain = F.col("b_family_id") == F.col("family_id"), F.col("b_subject_grain") == F.col("subject_grain")
    op = F.array_contains("b_operations", F.col("operation"))
    g = j.groupBy("request_id").agg(F.count("b_semantic_id").alias("n1"), F.count_if(fam).alias("n2"), F.count_if(fam & grain).alias("n3"), F.count_if(fam & grain & op).alias("n4"))
    outcome = (F.when(F.col("n1") == 0, "unknown_field").when(F.col("n2") == 0, "family_not_bound").when(F.col("n3") == 0, "grain_not_bound").when(F.col("n3") > 1, "binding_not_unique")
               .when(F.col("n4") == 0, "operation_not_permitted").otherwise("resolved"))
    return g.select("request_id", outcome.alias("outcome"))


def selected(observations: DataFrame, b: Binding, as_of: str | None = None) -> DataFrame:
    """One observation per subject (subject_key, value, as_of, source_id, source_row_id) as the binding selects it, under
    its folded key. Under unique_per_subject a subject with several rows keeps them all, so that the evidence can show it."""
    c = b.row_columns
    rows = observations.where(O.bound_predicate(b.selector_column, b.selector_value, b.value_column, c["status"], "valid", (c["as_of"], as_of) if as_of else None, b.zero_semantics == "excluded"))
    rows = rows.select(folded_key(c["subject"]).alias("subject_key"), F.col(b.value_column).alias("value"), F.col(c["as_of"]).alias("as_of"), F.col(c["source"]).alias("source_id"), F.col(c["row"]).alias("source_row_id"))
    rows = rows.where(F.col("subject_key").isNotNull())
    if b.selection == "unique_per_subject":
        return rows.distinct()
    return S.latest_per_subject(rows, ["value", "as_of", "source_id", "source_row_id"], as_of="as_of")


def coverage_claim(universe: Column, population: Column, order: Binding, display: Binding, zeros: Column) -> Column:
    """full only if both bindings declare full coverage and every subject of the population was seen (zeros that are excluded were seen too);
    unknown if one is unknown or there is no population; else observed."""
    if "unknown" in (order.coverage, display.coverage):
        return F.lit("unknown")
    both_full = order.coverage == display.coverage == "full"
    seen = universe + (zeros if order.zero_semantics == "excluded" else F.lit(0))
    return F.when(population.isNull(), "unknown").when(F.lit(both_full) & (seen == population), "full").otherwise("observed")


def governed_top_k(observations: DataFrame, displays: DataFrame, order: Binding, display: Binding, sources: DataFrame, subjects: DataFrame, n: int, as_of: str | None = None, descending: bool = True) -> DataFrame:
    """The first n subjects by a field, each row with the evidence of the whole: universe, dates, duplicates, sources, integrity, coverage
    claim, freshness and whether a global ranking may be claimed. The evidence is one aggregate over all selected rows, before the cut.
    """
    n = S.positive_limit(n)
    o = selected(observations, order, as_of).select("subject_key", F.col("value").alias("order_value"), F.col("as_of").alias("order_as_of"), "source_id", F.col("source_row_id").alias("order_row"))
    d = selected(displays, display, as_of).select("subject_key", F.col("value").alias("display_value"), F.col("as_of").alias("display_as_of"), F.col("source_row_id").alias("display_row"), F.col("source_id").alias("display_source"))
    # written once: evidence, sources and ranking all read it
    both = cut(own_subjects(o.join(d, "subject_key"), subjects), "governed")
    e = S.evidence(both, provenance=("source_id", "order_row", "display_source", "display_row"))
    population = subjects.where((F.col("family_id") == order.family_id) & (F.col("subject_grain") == order.subject_grain)).agg(F.countDistinct(folded_key("subject_key")).alias("population"))
    used = both.select("source_id").union(both.select("display_source")).distinct()
    checked = used.join(sources.select("source_id", F.col("hash_matches").alias("ok"), F.col("sha256").alias("sha")), "source_id", "left")
    integrity = checked.agg(F.coalesce(F.bool_and(F.coalesce("ok", F.lit(False)) & (F.coalesce(F.length("sha"), F.lit(0)) > 0)), F.lit(False)).alias("sources_verified"))
    one = e.join(F.broadcast(population), F.lit(True)).join(F.broadcast(integrity), F.lit(True))  # one row each
    single = (F.col("unknown_as_of") == 0) & (F.col("as_of_mismatches") == 0) & (F.col("order_as_of_min") == F.col("order_as_of_max"))
    single &= (F.col("order_as_of_min") == F.lit(as_of).cast("date")) if as_of else F.lit(True)
    claim = coverage_claim(F.col("universe"), F.col("population"), order, display, F.lit(0))
    one = one.withColumn("snapshot_compatible", F.coalesce(single, F.lit(False))).withColumn("coverage", claim)
    one = one.withColumn("freshness", F.lit("exact_requested" if as_of else "latest_available")).withColumn("global_ranking_claim_allowed", (F.col("coverage") == "full") & F.col("snapshot_compatible") & F.col("sources_verified"))
    top = S.top_k(both, "order_value", "subject_key", n, descending)
    return top.select("subject_key", "order_value", "display_value", "order_as_of", "order_row", "display_row").join(
        F.broadcast(one.select("universe", "population", "duplicates", "provenance_missing", "unknown_as_of", "as_of_mismatches", "snapshot_compatible", "sources_verified", "coverage", "freshness", "global_ranking_claim_allowed")), F.lit(True))


def execute(top: DataFrame) -> tuple[str, list]:
    """Run a governed ranking for one request and refuse what its evidence doesn't allow: (status, rows). Up to n rows come back."""
    rows = top.collect()
    if not rows:
        return "as_of_unavailable_or_empty", []
    first = rows[0]
    for code, bad in (("provenance_binding_unavailable", first["provenance_missing"] > 0), ("duplicate_subjects", first["duplicates"] > 0), ("snapshot_incompatible", not first["snapshot_compatible"]), ("source_not_verified", not first["sources_verified"])):
        if bad:
            return code, []
    return "ok", rows


def bind_populations(requests: DataFrame, datasets: DataFrame) -> DataFrame:
    """(request_id, outcome, population) of requests (request_id, family_id, subject_grain): bound only where exactly one dataset
    binding (family_id, subject_grain, population) is declared for both and it names a population."""
    d = datasets.select("family_id", "subject_grain", F.col("population").alias("p"), F.lit(1).alias("declared"))
    g = requests.join(d, ["family_id", "subject_grain"], "left").groupBy("request_id").agg(F.count("declared").alias("n"), F.max("p").alias("population"))
    bound = (F.col("n") == 1) & F.col("population").isNotNull()
    return g.select("request_id", F.when(bound, "bound").otherwise("dataset_binding_unavailable").alias("outcome"), F.when(bound, F.col("population")).alias("population"))


def ranking_evidence(selected: DataFrame, sources: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field (columns ``fields``): the evidence of a ranking of its selected observations (subject_key, as_of, source_id, source_row_id):
    rows, subjects above one row, rows without source or row id, unknown dates, span of dates, and whether every source is verified."""
    ok = sources.select("source_id", F.coalesce(F.col("hash_matches") & (F.length("sha256") > 0), F.lit(False)).alias("ok"))
    per = selected.groupBy(*fields, "subject_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("source_id").isNull() | F.col("source_row_id").isNull()).alias("gaps"), F.count_if(F.col("as_of").isNull()).alias("unknown"), F.min("as_of").alias("lo"), F.max("as_of").alias("hi"))
    rows = per.groupBy(*fields).agg(F.sum("n").alias("universe"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("gaps").alias("provenance_missing"), F.sum("unknown").alias("unknown_as_of"), F.min("lo").alias("as_of_min"), F.max("hi").alias("as_of_max"))
    used = selected.select(*fields, "source_id").distinct().join(F.broadcast(ok), "source_id", "left")  # source loads, tens at any scale
    checked = used.groupBy(*[F.col(f).alias("__" + f) for f in fields]).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("sources_verified"))
    return rows.join(checked, [F.col(f).eqNullSafe(F.col("__" + f)) for f in fields]).drop(*["__" + f for f in fields])


def freshness(requested: Column, lo: Column, hi: Column, unknown: Column) -> Column:
    """exact_requested or latest_available where all rows are of one known date (the requested one, if any), else mixed_effective_dates."""
    single = (unknown == 0) & (lo == hi)
    return F.when(single & requested.isNotNull() & (lo == requested), "exact_requested").when(single & requested.isNull(), "latest_available").otherwise("mixed_effective_dates")


def outcome(requested: Column) -> Column:
    """The first thing that stops a ranking, from the columns of ``ranking_evidence``; null if nothing does. ``requested``: the date asked for, or null."""
    mixed = freshness(requested, F.col("as_of_min"), F.col("as_of_max"), F.col("unknown_as_of")) == "mixed_effective_dates"
    return (F.when(F.coalesce("universe", F.lit(0)) == 0, "as_of_unavailable").when(F.col("provenance_missing") > 0, "provenance_binding_unavailable").when(F.col("duplicates") > 0, "selection_policy_unavailable")
            .when(mixed, "snapshot_incompatible").when(~F.coalesce("sources_verified", F.lit(False)), "source_integrity_mismatch"))


def applied_operations(stopped: Column, operation: Column, field_id: Column, direction: Column, limit: Column) -> Column:
    """The record of what was done to a result: one operation with its field, direction and row limit; none where the request was stopped."""
    one = F.struct(operation.alias("operation"), field_id.alias("field_id"), direction.alias("direction"), limit.cast("int").alias("row_limit"))
    return F.when(stopped.isNull(), F.array(one)).otherwise(F.array().cast("array<struct<operation:string,field_id:string,direction:string,row_limit:int>>"))


def coverage_state(observed: Column, population: Column, declared: Column) -> Column:
    """unknown without a population, unavailable without rows, full or partial by count where declared so, else observed."""
    return (F.when(population.isNull(), "unknown").when(F.coalesce(observed, F.lit(0)) == 0, "unavailable").when((declared == "full") & (observed >= population), "full")
            .when(declared == "full", "partial").otherwise("observed"))


def snapshot_state(unknown: Column, lo: Column, hi: Column) -> Column:
    """unknown before partial: some row without a date; single date; else mixed."""
    return F.when(lo.isNull(), "unknown").when(unknown > 0, "partial_unknown").when(lo == hi, "single").otherwise("mixed")


def capability(terms: DataFrame, bindings: DataFrame) -> DataFrame:
    """(semantic_id, family_id, state): resolved (one binding with an operation the term permits), ambiguous (several), unsupported (bound, no
    common operation), unavailable (no binding of the family)."""
    j = terms.join(bindings.select("semantic_id", "family_id", F.col("operations").alias("physical"), F.lit(1).alias("bound")), ["semantic_id", "family_id"], "left")
    g = j.groupBy("semantic_id", "family_id").agg(F.count("bound").alias("n"), F.count_if(F.arrays_overlap("operations", "physical")).alias("ok"))
    return g.select("semantic_id", "family_id", F.when(F.col("n") == 0, "unavailable").when(F.col("ok") == 0, "unsupported").when(F.col("ok") > 1, "ambiguous").otherwise("resolved").alias("state"))


def target_summary(bindings: DataFrame) -> DataFrame:
    """Per family and grain: the operations and fields that can be served."""
    return bindings.select("family_id", "subject_grain", "semantic_id", F.explode("operations").alias("op")).groupBy("family_id", "subject_grain").agg(
        F.sort_array(F.collect_set("op")).alias("operations"), F.countDistinct("semantic_id").alias("n_fields"))


def candidate_kind(has_domain: Column, has_range: Column, n_operations: Column, n_families: Column, grain: Column) -> Column:
    """relation (domain and range), field (operations and a grain), dataset (no operations, a family and a grain), else entity."""
    return (F.when(has_domain & has_range, "relation").when((n_operations > 0) & grain.isNotNull(), "field").when((n_operations == 0) & (n_families > 0) & grain.isNotNull(), "dataset").otherwise("entity"))


def minimal_cover(members: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Members (family_id, node) none of whose ancestors (node, ancestor) is a member of the same family."""
    held = members.join(ancestors, "node").select("family_id", "node", "ancestor")
    shadowed = held.join(members.select("family_id", F.col("node").alias("ancestor")), ["family_id", "ancestor"], "left_semi").where(F.col("node") != F.col("ancestor")).select("family_id", "node")
    return members.join(shadowed, ["family_id", "node"], "left_anti")


def effective_families(terms: DataFrame, served: DataFrame) -> DataFrame:
    """(semantic_id, families, basis): declared families, else those that serve the term, else none (unproven)."""
    s = served.groupBy("semantic_id").agg(F.sort_array(F.collect_set("family_id")).alias("served"))
    j = terms.join(s, "semantic_id", "left")
    declared = F.size(F.coalesce("declared", F.array().cast("array<string>"))) > 0
    return j.select("semantic_id", F.when(declared, F.sort_array("declared")).otherwise(F.coalesce("served", F.array().cast("array<string>"))).alias("families"),
                    F.when(declared, "declared").when(F.col("served").isNotNull(), "served").otherwise("unproven").alias("basis"))


def siblings(relations: DataFrame) -> DataFrame:
    """(relation, sibling): relations between the same two ends, in either direction, that are not each other's inverse."""
    ends = F.array_join(F.array_sort(F.array("domain", "range")), "|")
    a = relations.select("relation", "inverse_of", ends.alias("ends"))
    b = a.select(F.col("relation").alias("sibling"), F.col("inverse_of").alias("o_inverse"), "ends")
    j = a.join(b, "ends").where(F.col("relation") != F.col("sibling"))
    inverse = F.coalesce(F.col("inverse_of") == F.col("sibling"), F.lit(False)) | F.coalesce(F.col("o_inverse") == F.col("relation"), F.lit(False))
    return j.where(~inverse).select("relation", "sibling")


def executable_operations(semantic: DataFrame, physical: DataFrame, support: dict[str, list[str]]) -> DataFrame:
    """(semantic_id, operation): permitted operations of which some physical operation exists that supports them."""
    sup = F.create_map(*[x for k, v in support.items() for x in (F.lit(k), F.array(*[F.lit(o) for o in v]))])
    j = semantic.join(physical.select("semantic_id", F.col("operations").alias("phys")), "semantic_id").select("semantic_id", "phys", F.explode("operations").alias("operation"))
    return j.where(F.arrays_overlap(sup[F.col("operation")], F.col("phys"))).select("semantic_id", "operation").distinct()

"""Record notations of submitted requirements: one line, several lines, grouped rows; parsed fail-closed, and rendered back."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_line(line: Column) -> Column:
    """A struct (token, fields, problem) of ``TOKEN|key=value|...``. A repeated key, a part without '=' or an empty token is a problem, and
    then there are no fields."""
    parts = F.split(line, r"\|")
    token = F.trim(F.element_at(parts, 1))
    pairs = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, "=", 2))
    keys = F.transform(pairs, lambda p: F.trim(F.element_at(p, 1)))
    problem = (F.when(F.coalesce(token, F.lit("")) == "", "empty_token").when(F.exists(pairs, lambda p: F.size(p) < 2), "missing_value").when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate_key"))
    entries = F.when(problem.isNull(), F.transform(pairs, lambda p: F.struct(F.trim(F.element_at(p, 1)).alias("key"), F.try_element_at(p, F.lit(2)).alias("value"))))
    return F.struct(token.alias("token"), F.map_from_entries(entries).alias("fields"), problem.alias("problem"))


def parse_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line of a record text: key, line_no, token, fields, problem. The last line must be END; lines after it, or no END at all, are
    problems of their lines."""
    lines = df.select(key, F.posexplode(F.split(F.trim(text), r"\r?\n")).alias("pos", "line"), F.size(F.split(F.trim(text), r"\r?\n")).alias("n"))
    p = lines.withColumn("p", parse_line(F.col("line")))
    is_end, last = F.col("p.token") == "END", F.col("pos") == F.col("n") - 1
    problem = F.coalesce(F.col("p.problem"), F.when(is_end & ~last, "end_before_last_line"), F.when(last & ~is_end, "no_end"))
    return p.select(key, (F.col("pos") + 1).alias("line_no"), F.col("p.token").alias("token"), F.when(problem.isNull(), F.col("p.fields")).alias("fields"), problem.alias("problem"))


def assemble(rows: DataFrame, requirements: DataFrame, request: str, requirement: str) -> DataFrame:
    """Grouped flat records (request, requirement id, slot, value) put together under their requirements: (request, requirement id, slots,
    problem). A slot given twice with one value is a duplicate, with two values a conflict; rows of an unknown requirement are orphans."""
    per = rows.groupBy(request, requirement, "slot").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    flags = per.groupBy(request, requirement).agg(
        F.max(F.when(F.col("lo") != F.col("hi"), 2).when(F.col("n") > 1, 1).otherwise(0)).alias("worst"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("slot", "lo")))).alias("slots"))
    known = requirements.select(request, requirement).distinct().withColumn("known", F.lit(True))
    j = flags.join(known, [request, requirement], "full")
    problem = F.when(F.col("known").isNull(), "orphan").when(F.col("worst") == 2, "conflict").when(F.col("worst") == 1, "duplicate").when(F.col("worst").isNull(), "empty_requirement")
    return j.select(request, requirement, F.when(problem.isNull(), F.col("slots")).alias("slots"), problem.alias("problem"))


def render_line(token: Column, fields: Column) -> Column:
    """``TOKEN|key=value|...`` with keys in order: what ``parse_line`` reads back."""
    parts = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(k, F.lit("="), fields[k]))
    return F.array_join(F.concat(F.array(token), parts), "|")


def parse_submission(data: object, required: Sequence[str] = ("id", "kind", "spans"), allowed: Sequence[str] = ("id", "kind", "spans", "ref"), question: str = "") -> tuple[list[dict], list[str]]:
    """Requirements of one request, fail-closed: (requirements, problems); any problem leaves no requirements. Unknown properties, wrong types,
    repeated ids, references of the wrong form and spans that the question doesn't contain are problems."""
    import re

    problems, seen = [], set()
    if not isinstance(data, list):
        return [], ["not a list of requirements"]
    for i, r in enumerate(data):
        if not isinstance(r, dict):
            problems.append(f"{i}: not an object")
            continue
        problems += [f"{i}: unknown property {k}" for k in r if k not in allowed] + [f"{i}: missing {k}" for k in required if k not in r]
        if r.get("id") in seen:
            problems.append(f"{i}: repeated id")
        seen.add(r.get("id"))
        if "ref" in r and not (isinstance(r["ref"], str) and re.match(r"^(ds|fd|pr|en|cl)_[0-9a-f]{32}$", r["ref"])):
            problems.append(f"{i}: malformed reference")
        spans = r.get("spans", [])
        if not isinstance(spans, list) or not all(isinstance(s, str) for s in spans):
            problems.append(f"{i}: spans must be texts")
        elif question:
            problems += [f"{i}: span not in question" for s in spans if " ".join(s.split()) not in " ".join(question.split())]
    return ([] if problems else data), problems


def relation_direction(relations: DataFrame, ancestors: DataFrame, request: DataFrame) -> DataFrame:
    """(request_id, direction, problem): which way a relation is meant, from the type of its anchor. The relation's domain must be the anchor's
    class or an ancestor for forward, its range for inverse; exactly one of both must hold. ``request``: request_id, relation, anchor_class."""
    up = ancestors.unionByName(ancestors.select("node").distinct().withColumn("ancestor", F.col("node"))).distinct()
    up = up.unionByName(request.select(F.col("anchor_class").alias("node"), F.col("anchor_class").alias("ancestor")).distinct()).distinct()
    j = request.join(relations, "relation", "left").join(up, F.col("anchor_class") == F.col("node"), "left")
    g = j.groupBy("request_id").agg(F.coalesce(F.bool_or(F.col("ancestor") == F.col("domain")), F.lit(False)).alias("f"), F.coalesce(F.bool_or(F.col("ancestor") == F.col("range")), F.lit(False)).alias("i"))
    return g.select("request_id", F.when(F.col("f") & ~F.col("i"), "forward").when(F.col("i") & ~F.col("f"), "inverse").alias("direction"),
                    F.when(F.col("f") & F.col("i"), "ambiguous_direction").when(~F.col("f") & ~F.col("i"), "anchor_not_an_end").alias("problem"))


# What a caller may read about a refusal.
SAFE_REASONS = {"unknown_field": "The question names something that isn't recorded.", "snapshot_incompatible": "The values are not of one date.", "source_not_verified": "A source could not be verified."}


def safe_reason(code: Column, default: str = "The question can't be answered from the data.") -> Column:
    """A sentence for a refusal code that names no table, column, id or code."""
    known = F.create_map(*[F.lit(x) for kv in SAFE_REASONS.items() for x in kv])
    return F.when(code.isNotNull(), F.coalesce(known[code], F.lit(default)))


def envelope(status: Column, answer: Column, evidence: Column, as_of: Column, note: Column) -> Column:
    """The response as JSON of five strings; nothing to say is refused / no_data."""
    text = lambda c, d: F.coalesce(c.cast("string"), F.lit(d))
    return F.to_json(F.struct(text(status, "refused").alias("status"), text(answer, "no_data").alias("answer"), text(evidence, "").alias("evidence"), text(as_of, "").alias("as_of"), text(note, "").alias("note")))

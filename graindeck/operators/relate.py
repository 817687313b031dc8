"""Joins between grains: products, portfolios, holdings and securities, without letting duplicates inflate a count."""
from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graindeck.session import cut


def null_aware_anti(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """NOT IN: rows of ``left`` whose key is none of ``right``'s; rows with a null key drop out. ``right`` must hold no null key
    (else NOT IN is empty), so nulls are taken off it first."""
    return left.where(F.col(key).isNotNull()).join(right.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Children whose non-null key no parent has."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def with_match_flag(left: DataFrame, right: DataFrame, key: str, flag: str = "matched") -> DataFrame:
    """``left`` with a boolean: does ``right`` have the key? Rows of ``left`` aren't multiplied."""
    known = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__m", F.lit(True))
    return left.join(known, key, "left").withColumn(flag, F.coalesce("__m", F.lit(False))).drop("__m")


def update_from(rows: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns replaced by those of ``changes`` where the key matches and the change isn't null; one change per key."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def relation(mapping: DataFrame, holdings: DataFrame) -> DataFrame:
    """Distinct (subject_key, family_id, relation_kind, security_key) along subject, map, portfolio, holding, security.

    Holdings are reduced to distinct (portfolio, kind, security) before the join, which combines on the map side: a hot portfolio
    enters the join with its securities, not its rows.
    """
    held = holdings.where(F.col("security_key").isNotNull() & F.col("portfolio_key").isNotNull()).select("portfolio_key", "relation_kind", "security_key").distinct()
    edges = mapping.where(F.col("portfolio_key").isNotNull()).select("subject_key", "family_id", "portfolio_key").distinct()
    return edges.join(held, "portfolio_key").select("subject_key", "family_id", "relation_kind", "security_key").distinct()


def forward(mapping: DataFrame, holdings: DataFrame) -> DataFrame:
    """Securities per subject and kind."""
    return relation(mapping, holdings).groupBy("subject_key", "relation_kind").agg(F.count(F.lit(1)).alias("n_securities"))


def inverse(mapping: DataFrame, holdings: DataFrame) -> DataFrame:
    """Subjects per security, kind and family."""
    return relation(mapping, holdings).groupBy("security_key", "relation_kind", "family_id").agg(F.count(F.lit(1)).alias("n_subjects"))


def holding_any(subjects: DataFrame, mapping: DataFrame, holdings: DataFrame, security: Column) -> DataFrame:
    """Subjects with some holding whose security fulfils a condition; a filter that never multiplies a subject."""
    held = holdings.where(security).select("portfolio_key").where(F.col("portfolio_key").isNotNull()).distinct()
    return subjects.join(mapping.join(held, "portfolio_key", "left_semi"), "subject_key", "left_semi")


def join_cardinality(parent: DataFrame, parent_key: str, child: DataFrame, child_key: str) -> DataFrame:
    """One row: matched parents and the most children of one. Children are counted per key before they meet the parents."""
    counts = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("__k")).agg(F.count(F.lit(1)).alias("n"))
    return parent.select(F.col(parent_key).alias("__k")).distinct().join(counts, "__k").agg(F.count(F.lit(1)).alias("matched_parents"), F.coalesce(F.max("n"), F.lit(0)).alias("max_children"))


def containment(texts: DataFrame, text: str, forms: DataFrame, form: str, bound: int = 1_000_000) -> DataFrame:
    """(all columns of both): texts that contain a form as a substring. A theta join; forms, a vocabulary of checked size, are broadcast
    and more than ``bound`` are refused (use ``containment_any`` for those)."""
    if forms.count() > bound:
        raise ValueError(f"more than {bound} forms: use containment_any")
    return texts.join(F.broadcast(forms), F.contains(F.col(text), F.col(form)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def _stretch_hashes(points: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every stretch of ``length`` code points."""
    n, out = len(points) - length + 1, np.uint64(0)
    for i in range(length):
        out = _mixed((out + points[i : i + n] + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _proposed(texts: DataFrame, k: int, reach: int, known: np.ndarray | None) -> DataFrame:
    """(key, start, tail) of ``texts`` (key, text): stretches of ``k`` characters with up to ``reach`` in all, of those whose hash is among ``known``, or of
    all where that is None; each once for a text. One pass over the characters, as a substring in the JVM counts from the text's beginning."""
    bits = min(26, max(16, 5 + len(known).bit_length())) if known is not None else 0
    schema = f"key {texts.schema['key'].dataType.simpleString()}, start string, tail string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if known is not None:
            first = np.zeros(1 << bits, bool)
            first[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
        for b in batches:
            rows, tails, held = [], [], 0
            for row, text in enumerate(b.column(1).to_pylist()):
                at: Iterable[int] = range(len(text) - k + 1)
                if known is not None:
                    h = _stretch_hashes(_points(text), k)
                    at = np.flatnonzero(first[(h >> np.uint64(64 - bits)).astype(np.int64)])
                    at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]].tolist() if len(known) else []
                found = {text[i : i + reach] for i in at}
                rows += [row] * len(found)
                tails += found
                held += len(found) * reach
                if held > 1 << 23:
                    yield packed(b, rows, tails)
                    rows, tails, held = [], [], 0
            yield packed(b, rows, tails)

    def packed(b: pa.RecordBatch, rows: list[int], tails: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([x[:k] for x in tails], pa.string()), pa.array(tails, pa.string())], names=["key", "start", "tail"])

    return texts.mapInArrow(run, schema)


def containment_any(texts: DataFrame, key: str, text: str, forms: DataFrame, form: str, most: int = 12, reach: int = 64, bound: int = 2_000_000) -> DataFrame:
    """(key, form): the same for any number of forms, each pair once. Texts and forms meet in an equi-join on stretches as long as the shortest
    form (``most`` at most), a form's being its beginning; the ``reach`` characters there tell whether the form follows, and only longer forms are checked
    on the whole text. Forms are counted: up to ``bound`` beginnings are known to the workers by their hash, and other stretches of a text aren't joined.
    Empty forms stand nowhere; ``key`` is unique."""
    f = forms.select(F.col(form).alias("form")).where(F.length("form") > 0).distinct()
    shortest, longest, n = f.agg(F.min(F.length("form")), F.max(F.length("form")), F.count(F.lit(1))).first()
    k = min(shortest or 1, most)
    reach = max(k, min(reach, longest or 1))
    f = f.withColumn("start", F.substring("form", 1, k))
    known = None
    if n <= bound:
        starts = f.select("start").distinct().toLocalIterator()
        known = np.unique(np.array([_stretch_hashes(_points(r[0]), k)[0] for r in starts], np.uint64))
    t = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") >= k)
    pairs = _proposed(t, k, reach, known).hint("merge").join(f, "start")
    near = pairs.where(F.startswith("tail", F.col("form"))).select("key", "form").distinct()
    if (longest or 0) > reach:
        far = pairs.where((F.length("form") > reach) & F.startswith("form", F.col("tail"))).select("key", "form").distinct()
        near = near.unionByName(far.join(t.hint("merge"), "key").where(F.contains(F.col("text"), F.col("form"))).select("key", "form"))
    return near.select(F.col("key").alias(key), F.col("form").alias(form))


def containment_of_words(texts: DataFrame, text: str, forms: DataFrame, form: str, words: int = 3, bound: int = 100_000) -> DataFrame:
    """Texts that contain a form of up to ``words`` words as whole words: an equi-join on the text's word runs, for any number of forms. Forms are counted and
    broadcast, more than ``bound`` are joined. A text is split once: bound to a variable, as an expression inside a lambda is worked out for every element."""

    def runs_of(tokens: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))

    split = F.array(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"))
    runs = F.flatten(F.transform(split, lambda tokens: F.flatten(F.array(tokens, *[runs_of(tokens, n) for n in range(2, words + 1)]))))
    keyed = texts.withColumn("__w", F.explode(F.array_distinct(runs)))
    wanted = forms.withColumn("__w", F.lower(form))
    few = forms.limit(bound + 1).count() <= bound
    return keyed.join(wanted.hint("broadcast" if few else "merge"), "__w").drop("__w")


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """All (node, ancestor) of a graph of ``child`` to ``parent`` edges, cycles allowed and of any depth: paths double in length each round and a
    round that adds nothing ends it, so the rounds are few. A node of a cycle is its own ancestor."""
    known = cut(edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).distinct(), "closure")
    size = known.count()
    while True:
        longer = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"))
        known = cut(known.unionByName(longer).distinct(), "closure")
        grown = known.count()
        if grown == size:
            return known
        size = grown


def neighbours(terms: DataFrame, rules: dict[str, tuple[list[str], Column | None]]) -> DataFrame:
    """(term, neighbour, reasons): one hop by each rule, a rule being columns that must be equal and a condition on the pair
    (columns of the other side with the prefix o_). Groups a rule joins on should be small vocabularies."""
    other = terms.select(*[F.col(c).alias("o_" + c) for c in terms.columns])
    found = None
    for reason, (columns, condition) in rules.items():
        pairs = terms.join(other, [F.col(c) == F.col("o_" + c) for c in columns]).where(F.col("term") != F.col("o_term"))
        pairs = (pairs.where(condition) if condition is not None else pairs).select("term", F.col("o_term").alias("neighbour"), F.lit(reason).alias("reason"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.groupBy("term", "neighbour").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Full outer comparison of two catalogs: (key, rule) for keys on one side only and for every column that differs."""
    a = left.select(key, *[F.col(c).alias("l_" + c) for c in columns], F.lit(True).alias("__l"))
    b = right.select(key, *[F.col(c).alias("r_" + c) for c in columns], F.lit(True).alias("__r"))
    rules = [F.when(F.col("__l").isNull(), "missing_left"), F.when(F.col("__r").isNull(), "missing_right")]
    both = F.col("__l").isNotNull() & F.col("__r").isNotNull()
    rules += [F.when(both & ~F.col("l_" + c).eqNullSafe(F.col("r_" + c)), c) for c in columns]
    return a.join(b, key, "full").select(key, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("rule"))

"""Problem 10: long spans that stand verbatim in more than one text.

Level-wise doubling. At each length below the wanted one, every text gives a sample of its windows of that length, chosen by
their content alone: of any run of as many neighbouring windows as still lie within one wanted window, the one with the least
hash (winnowing). So every wanted window holds a chosen one, the same in every text. Windows that stand in one text only
are dropped; around those repeated, and only there, windows twice as long are tried, until at the wanted length all
windows around are tried and what is repeated is the answer. Hashes double along: a window's is made of its halves'.

Texts equal throughout are one class, represented by the least id; their spans are tried once.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graindeck.session import cut

CHUNK = 1 << 19  # code points hashed at a time: keeps a worker's arrays to some tens of MB


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(points: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every window of ``length`` code points, by doubling: a hash of two halves, remainders joined on."""
    with np.errstate(over="ignore"):
        power = _mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 + salt))
        size, done, got = 1, None, 0
        while True:
            if length & size:
                if done is None:
                    done, got = power, size
                else:
                    n = len(points) - got - size + 1
                    done = _mix(done[:n] * np.uint64(0xD6E8FEB86659FD93) + power[got:got + n])
                    got += size
            if 2 * size > length:
                return done
            n = len(points) - 2 * size + 1
            power = _mix(power[:n] * np.uint64(0xA0761D6478BD642F) + power[size:size + n])
            size *= 2


def winnow(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions of the least hash (the first of equals) of every ``span`` neighbours."""
    n = len(hashes) - span + 1
    if span == 1:
        return np.arange(len(hashes))
    value, at = hashes, np.arange(len(hashes), dtype=np.int32)
    size = 1
    while 2 * size <= span:
        later = value[size:] < value[:-size]
        at = np.where(later, at[size:], at[:-size])
        value = np.minimum(value[size:], value[:-size])
        size *= 2
    if size < span:
        gap = span - size
        at = np.where(value[gap:gap + n] < value[:n], at[gap:gap + n], at[:n])
    keep = np.zeros(len(hashes), bool)
    keep[at[:n]] = True
    return np.flatnonzero(keep)


def _batches(ids: list, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in chunks of about CHUNK code points: ids, start of each text in the chunk (with the end), code points."""
    at = 0
    while at < len(texts):
        size, to = len(texts[at]), at + 1
        while to < len(texts) and size + len(texts[to]) <= CHUNK:
            size += len(texts[to])
            to += 1
        points = np.frombuffer("".join(texts[at:to]).encode("utf-32-le", "surrogatepass"), "<u4")
        yield np.array(ids[at:to]), np.cumsum([0, *map(len, texts[at:to])]), points
        at = to


def _sample(points: np.ndarray, bounds: np.ndarray, length: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position in the text, hash) of the chosen windows of each text that is long enough."""
    if len(points) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = window_hashes(points, length)
    span = wanted - length + 1
    if span == 1:
        picked = np.arange(len(hashes))
    elif len(points) < wanted:
        picked = np.empty(0, np.int64)
    else:
        # chosen over the chunk as one run: windows across a border between texts only add choices, never take one away
        picked = winnow(hashes, span)
    text = np.searchsorted(bounds, picked, "right") - 1
    ok = picked + length <= bounds[text + 1]
    return text[ok], (picked - bounds[text])[ok], hashes[picked][ok]


def classes(docs: DataFrame, doc: str, text: str, wanted: int) -> tuple[DataFrame, DataFrame]:
    """(class_id, text) once per different text of at least ``wanted`` code points, and (doc, class_id) of its copies."""
    d = docs.where((F.length(text) >= wanted) & F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.sha2(text, 256).alias("print"), F.col(text).alias("text"))
    members = cut(d.groupBy("print", "doc").agg(F.lit(1).alias("one")).drop("one"), "span-members")
    heads = members.groupBy("print").agg(F.min("doc").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return heads, members


def _hash_rows(texts: DataFrame, length: int, wanted: int) -> DataFrame:
    """(h, class_id, pos) of the chosen windows of ``texts`` (class_id, text[, near: array of positions to stay around])."""
    around = "near" in texts.columns
    columns = ["class_id", "text", *(["near"] if around else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_pylist()
            words = b.column(1).to_pylist()
            near = b.column(2).to_pylist() if around else None
            at = 0
            for ids, bounds, points in _batches(every, words):
                text, pos, h = _sample(points, bounds, length, wanted)
                if around and len(text):
                    # a wanted window that holds a repeated window of half the length, starting at p, lies in [p - reach, p + wanted)
                    reach = wanted - length // 2
                    hit = np.zeros(len(points) + 1, np.int32)
                    spots = np.concatenate([np.asarray(x, np.int64) + s for x, s in zip(near[at:at + len(ids)], bounds)])
                    base = bounds[np.searchsorted(bounds, spots, "right") - 1]
                    np.add.at(hit, np.maximum(spots - reach, base), 1)
                    np.add.at(hit, np.minimum(spots + wanted - length + 1, len(points)), -1)
                    ok = np.cumsum(hit)[bounds[text] + pos] > 0
                    text, pos, h = text[ok], pos[ok], h[ok]
                at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[text] if len(text) else ids[:0], pa.int64()), pa.array(pos, pa.int32())], names=["h", "class_id", "pos"])

    return texts.select(*columns).mapInArrow(run, "h bigint, class_id bigint, pos int")


def _repeated(rows: DataFrame) -> DataFrame:
    """Hashes that stand in two or more classes."""
    return rows.groupBy("h").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where(F.col("lo") != F.col("hi")).select("h")


def _around(rows: DataFrame, texts: DataFrame, small_rows: int) -> DataFrame:
    """The texts with the positions of their repeated windows."""
    hits = rows.join(_repeated(rows), "h", "left_semi").groupBy("class_id").agg(F.sort_array(F.collect_set("pos")).alias("near"))
    return _with_texts(cut(hits, "span-hits"), texts, small_rows)


def _with_texts(hits: DataFrame, texts: DataFrame, small_rows: int) -> DataFrame:
    """``hits`` (class_id, near) with their texts: broadcast to the scan up to ``small_rows`` entries, else joined."""
    n = hits.agg(F.coalesce(F.sum(F.size("near")), F.lit(0))).first()[0]
    return texts.join(F.broadcast(hits) if n <= small_rows else hits, "class_id")


def _digests(hits: DataFrame, wanted: int) -> DataFrame:
    """(d, class_id, pos): the digest of the characters of each window of ``hits`` (class_id, text, near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, text, near in zip(*(b.column(i).to_pylist() for i in range(3))):
                if near:
                    digests = [hashlib.blake2b(text[p:p + wanted].encode("utf-8", "surrogatepass"), digest_size=16).digest() for p in near]
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([one] * len(near), pa.int64()), pa.array(near, pa.int32())], names=["d", "class_id", "pos"])

    return hits.select("class_id", "text", "near").mapInArrow(run, "d binary, class_id bigint, pos int")


def windows_of(docs: DataFrame, doc: str, text: str, wanted: int, first_length: int | None, small_rows: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of ``wanted`` code points around everything that may be repeated: (h, class_id, pos); the texts (class_id, text); and the members
    (doc, class_id, copies) of every class. See ``shared_windows`` for the parameters."""
    heads, members = classes(docs, doc, text, wanted)
    members = cut(members.join(heads, "print").select("doc", "class_id", "copies", "print"), "span-classes")
    texts = docs.where((F.length(text) >= wanted) & F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    copies = members.where(F.col("doc") != F.col("class_id")).select("doc")
    n_copies = copies.count()
    texts = texts.join(F.broadcast(copies) if n_copies <= small_rows else copies, "doc", "left_anti").withColumnRenamed("doc", "class_id")
    short = (lambda df: df) if bits == 64 else (lambda df: df.withColumn("h", F.pmod("h", F.lit(1 << bits))))
    length = first_length or max(1, wanted // 2)
    rows = short(_hash_rows(texts, length, wanted))
    while length < wanted:
        near = _around(cut(rows, "span-windows"), texts, small_rows)
        length = min(2 * length, wanted)
        rows = short(_hash_rows(near, length, wanted))
    return rows, texts, members


def shared_windows(docs: DataFrame, doc: str = "doc_id", text: str = "text", wanted: int = 200, first_length: int | None = None, small_rows: int = 2_000_000, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The windows of ``wanted`` code points that stand in two or more different texts: (h, class_id, pos), repeats of a
    window inside a text included, h equal where the characters are; and the members (doc, class_id, copies) of every class.

    ``first_length`` is the length of the first level, half of ``wanted`` by default; each level doubles it. Ids must be
    integers; rows without one take no part. Null texts and texts shorter than ``wanted`` share nothing. ``small_rows``: positions (12 bytes each) up to which the
    repeated windows of a level are broadcast to the scan of the texts; beyond it they are joined. ``bits`` of the hashes are used; fewer
    give the same result and more to confirm: where a window of each set of texts is the same in all of them, h is the hash, by which the set's
    other windows go; where some set fails, every window is confirmed and h is the digest.
    """
    rows, texts, members = windows_of(docs, doc, text, wanted, first_length, small_rows, bits)
    rows = cut(rows, "span-windows")
    if _proven(rows, texts, wanted, small_rows)[-1].first() is not None:
        rows = cut(_digests(_around(rows, texts, small_rows), wanted).withColumnRenamed("d", "h"), "span-confirmed")
    return cut(rows.join(_repeated(rows), "h", "left_semi"), "span-shared"), members


SET = ["size", "p", "q"]


def _sets(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, class_id, pos) once per text, and (h, size, p, q): which set of texts each window that stands in several names."""
    one = windows.repartition("h").groupBy("h", "class_id").agg(F.min("pos").alias("pos"))
    # the last condition always holds: with it both results read all columns of one exchange, which then runs once
    named = one.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("class_id")).alias("p"), F.bit_xor(F.xxhash64("class_id", F.lit(1))).alias("q"), F.min("pos").alias("__pos")).where((F.col("size") > 1) & (F.col("__pos") >= 0))
    return one, named.drop("__pos")


def _proven(windows: DataFrame, texts: DataFrame, wanted: int, small_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(h, size, p, q) of the windows that stand in several texts; per set and text the digest d of the set's window of the least hash; and the
    sets whose texts differ in it."""
    one, named = _sets(windows)
    sets = cut(one.join(named, "h").groupBy(*SET, "class_id").agg(F.min_by("pos", "h").alias("pos")), "span-sets")
    near = cut(sets.groupBy("class_id").agg(F.sort_array(F.collect_set("pos")).alias("near")), "span-witnesses")
    proof = cut(sets.join(_digests(_with_texts(near, texts, small_rows), wanted), ["class_id", "pos"]), "span-proofs")
    return named, proof, cut(proof.groupBy(*SET).agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where(F.col("lo") != F.col("hi")).select(*SET), "span-doubts")


def passage_sets(windows: DataFrame, texts: DataFrame, wanted: int, small_rows: int = 2_000_000) -> DataFrame:
    """(size, p, q, class_id): every set of two or more texts that share some window, one row per text of the set. A set is named by its
    size and two combined hashes of its members; neighbouring windows of a passage stand in the same texts and give one set.

    The window of the least hash of each set is confirmed in all its texts. Where that shows texts that differ, the set is
    parted: all its windows are named anew by their digests.
    """
    named, proof, doubt = _proven(windows, texts, wanted, small_rows)
    if doubt.first() is None:
        return proof.select(*SET, "class_id")
    again = windows.join(named.join(doubt, SET, "left_semi").select("h"), "h", "left_semi")
    near = cut(again.groupBy("class_id").agg(F.sort_array(F.collect_set("pos")).alias("near")), "span-doubtful")
    one, named = _sets(cut(_digests(_with_texts(near, texts, small_rows), wanted).withColumnRenamed("d", "h"), "span-parted"))
    parted = one.join(named, "h").select(*SET, "class_id")
    return cut(proof.join(doubt, SET, "left_anti").select(*SET, "class_id").unionByName(parted).distinct(), "span-sets")


def _expanded(sets: DataFrame, names: list[str], member: str, size: str, part: int = 1_000) -> DataFrame:
    """(x, y), x below y: all pairs of each set. One side of a set of more than ``part`` members is spread over as many tasks as
    it has parts, and meets the whole other side in each."""
    parts = F.floor((F.col(size) + part - 1) / part).cast("int")
    a = sets.select(*names, F.col(member).alias("x"), F.pmod(F.xxhash64(member), parts).cast("int").alias("part"))
    b = sets.select(*names, F.col(member).alias("y"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return a.join(b, [*names, "part"]).where(F.col("x") < F.col("y")).select("x", "y")


def document_classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", wanted: int = 200, first_length: int | None = None, small_rows: int = 2_000_000, bits: int = 64) -> DataFrame:
    """(doc_id, class_id, n_copies, n_sets, largest_set) of every document that stands in a class: the least id with its text, how
    many documents have that text, in how many passage sets it is, and how many texts the largest of them holds."""
    windows, texts, members = windows_of(docs, doc, text, wanted, first_length, small_rows, bits)
    per = passage_sets(windows, texts, wanted, small_rows).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_sets"), F.max("size").alias("largest_set"))
    out = members.join(per, "class_id", "left")
    return out.select(F.col("doc").alias(doc), "class_id", F.col("copies").alias("n_copies"), F.coalesce("n_sets", F.lit(0)).alias("n_sets"), F.coalesce("largest_set", F.lit(0)).alias("largest_set"))


def document_pairs(docs: DataFrame, doc: str = "doc_id", text: str = "text", wanted: int = 200, first_length: int | None = None, small_rows: int = 2_000_000, bits: int = 64) -> DataFrame:
    """(doc_id_a, doc_id_b), a below b: documents whose texts share a run of at least ``wanted`` code points.

    The pairs of texts come from the passage sets, each once; the copies of a text join at the end.
    """
    windows, texts, members = windows_of(docs, doc, text, wanted, first_length, small_rows, bits)
    pairs = _expanded(passage_sets(windows, texts, wanted, small_rows), SET, "class_id", "size").distinct()
    own = members.select("class_id", "doc", "copies")
    x, y = (own.select(F.col("class_id").alias(k), F.col("doc").alias("doc_" + k)) for k in "xy")
    across = pairs.join(x, "x").join(y, "y").select("doc_x", "doc_y")
    within = _expanded(own.where(F.col("copies") > 1), ["class_id"], "doc", "copies")
    out = across.unionByName(within.select(F.col("x").alias("doc_x"), F.col("y").alias("doc_y")))
    return out.select(F.least("doc_x", "doc_y").alias("doc_id_a"), F.greatest("doc_x", "doc_y").alias("doc_id_b"))


def longer_windows(windows: DataFrame, wanted: int) -> DataFrame:
    """(class_id, level): the longest doubling of ``wanted`` at which a window of the text still stands in another text.

    A window of twice the length is two repeated ones end to end; its name is the digest of theirs. Each level keeps what is
    repeated, and the last is the one that keeps nothing.
    """
    level, found = windows, None
    while True:
        has = level.select("class_id").distinct().withColumn("level", F.lit(wanted).cast("bigint"))
        found = has if found is None else found.unionByName(has)
        later = level.select("class_id", (F.col("pos") - wanted).alias("pos"), F.col("h").alias("__later"))
        both = level.join(later, ["class_id", "pos"]).select(F.unhex(F.md5(F.concat_ws("|", F.hex("h"), F.hex("__later")))).alias("h"), "class_id", "pos")
        both = cut(both, "span-doubled")
        level, wanted = cut(both.join(_repeated(both), "h", "left_semi"), "span-longer"), 2 * wanted
        if level.first() is None:
            return found.groupBy("class_id").agg(F.max("level").alias("level"))


def shared_parts(docs: DataFrame, doc: str = "doc_id", text: str = "text", wanted: int = 200, first_length: int | None = None) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_part, n_spans, longest_level) of every document: the code points that lie in some run of at
    least ``wanted`` that also stands in another document, the number of maximal such stretches, and the longest doubling of ``wanted``
    that some run shared with another document reaches (0 if none does). Documents with a copy are shared throughout (if long enough);
    a null or empty text has 0 of 0, part 0.
    """
    hits, members = shared_windows(docs, doc, text, wanted, first_length)
    w = Window.partitionBy("class_id").orderBy("pos")  # windows of one text
    gap = F.col("pos") - F.lag("pos").over(w)
    spans = hits.select("class_id", "pos").distinct().withColumn("adds", F.least(F.coalesce(gap, F.lit(wanted)), F.lit(wanted))).withColumn("opens", F.coalesce((gap > wanted).cast("int"), F.lit(1)))
    per = spans.groupBy("class_id").agg(F.sum("adds").alias("shared"), F.sum("opens").alias("spans"))
    known = members.join(per, "class_id", "left").join(longer_windows(hits, wanted), "class_id", "left").select(F.col("doc").alias("__doc"), "copies", "shared", "spans", "level")
    out = docs.select(F.col(doc), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars")).join(known, F.col(doc) == F.col("__doc"), "left")
    copied = F.col("copies") > 1
    shared = F.when(copied, F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))).cast("bigint")
    whole = F.lit(wanted) * F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_chars") / F.lit(wanted))))  # of a text that has copies
    return out.select(doc, "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared_part"),
                      F.when(copied, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
                      F.when(copied, whole).otherwise(F.coalesce("level", F.lit(0))).cast("bigint").alias("longest_level"))

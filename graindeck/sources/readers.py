"""Scans: sheets, CSV, JSON lines, Parquet, archives, vocabularies in Turtle, and files registered by hash. Never inferred schemas."""
from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_schema(path: str) -> tuple[list[str], dict[str, dict]]:
    """A schema sheet as CSV (name, type, nullable, comment): field order and declarations. An authored file, read on the driver."""
    import csv

    with open(path, encoding="utf-8-sig", newline="") as f:
        rows = list(csv.DictReader(f))
    order = [r["name"].strip() for r in rows if r["name"].strip()]
    if len(set(order)) != len(order):
        raise ValueError("a field is declared twice")
    return order, {r["name"].strip(): {"type": r["type"].strip(), "nullable": r["nullable"].strip().lower() in ("y", "yes", "true", "1"), "comment": r.get("comment", "")} for r in rows if r["name"].strip()}


def stage_sheet(rows: Iterable[Sequence[object]], order: Sequence[str], target: str, ordinal: str = "source_ordinal") -> int:
    """Rows of a sheet (header first) to a CSV of texts with a stored ordinal; the header must be the declared order. Returns the row count."""
    import csv

    it = iter(rows)
    header = [str(x) for x in next(it)]
    if header != list(order):
        raise ValueError(f"header {header} isn't the declared {list(order)}")
    n = 0
    with open(target, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow([*order, ordinal])
        for n, r in enumerate(it, 1):
            w.writerow(["" if x is None else str(x) for x in r] + [n])
    return n


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV with header, every column text, in the order given; another header fails the read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, multiLine=True, escape='"', mode="FAILFAST")


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with header under a declared schema; a value that doesn't fit fails the read."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, multiLine=True, escape='"', mode="FAILFAST")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under a declared schema; a broken line fails the read."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def read_parquet_with_id(spark: SparkSession, path: str, table_id: str, ordinal: str) -> DataFrame:
    """Parquet with source_row_id = table_id#ordinal, the ordinal being a column of the data (never made up at read time)."""
    df = spark.read.parquet(path)
    return df.select(F.concat(F.lit(f"{table_id}#"), F.col(ordinal).cast("string")).alias("source_row_id"), "*")


def extract_bundle(path: str, target: str, members: Sequence[str], manifest: str = "manifest.json") -> dict:
    """The named members of a ZIP bundle, each checked against the manifest's SHA-256; names that leave the target are refused."""
    out, root = {}, Path(target).resolve()
    with zipfile.ZipFile(path) as z:
        recorded = json.loads(z.read(manifest))
        for m in members:
            to = (root / m).resolve()
            if root not in to.parents:
                raise ValueError(f"unsafe member {m!r}")
            data = z.read(m)
            digest = hashlib.sha256(data).hexdigest()
            if recorded.get(m) not in (None, digest):
                raise ValueError(f"{m} isn't what the manifest records")
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(data)
            out[m] = str(to)
    return out


def register_files(spark: SparkSession, path: str, recorded: DataFrame) -> DataFrame:
    """(source_file, sha256, recorded_sha256, hash_matches) of files under a path, hashed in parallel where they lie."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.sha2("content", 256).alias("sha256"))
    return files.join(recorded.select("source_file", "recorded_sha256"), "source_file", "left").withColumn("hash_matches", F.coalesce(F.col("sha256") == F.col("recorded_sha256"), F.lit(False)))


_TTL = re.compile(r'"""(.*?)"""(?:@([\w-]+)|\^\^([^\s;,.]+))?|"((?:[^"\\]|\\.)*)"(?:@([\w-]+)|\^\^([^\s;,.]+))?|<([^>]*)>|([A-Za-z_][\w-]*:[\w.-]*|:[\w-]+|\ba\b|true|false|[-+]?\d+(?:\.\d+)?)|([;,.\[\]])', re.S)


def read_turtle(spark: SparkSession, text: str) -> DataFrame:
    """(s, p, o, o_type, lang) of a vocabulary in plain Turtle: prefixed names, literals, lists by ';' and ','. Blank nodes and collections
    are refused. An authored file of some thousand terms, parsed on the driver."""
    rows, body = [], []
    for line in text.splitlines():
        if not re.match(r"\s*(@prefix|PREFIX|@base)", line):
            body.append(re.sub(r"(^|\s)#(?![^<]*>).*$", "", line))
    s = p = None
    state = 0
    for m in _TTL.finditer("\n".join(body)):
        long, l1, t1, short, l2, t2, iri, name, sign = m.groups()
        if sign in ("[", "]"):
            raise ValueError("blank nodes aren't read")
        if sign == ".":
            s, p, state = None, None, 0
        elif sign == ";":
            p, state = None, 1
        elif sign == ",":
            state = 2
        else:
            literal = long if long is not None else short
            value = literal.replace('\\"', '"') if literal is not None else iri if iri is not None else ("rdf:type" if name == "a" else name)
            if state == 0:
                s, state = value, 1
            elif state == 1:
                p, state = value, 2
            else:
                kind = (t1 or t2 or "xsd:string") if literal is not None else "xsd:boolean" if name in ("true", "false") else "xsd:decimal" if name and re.match(r"^[-+]?\d", name) else "iri"
                rows.append((s, p, value, kind, l1 or l2))
    return spark.createDataFrame(rows, "s string, p string, o string, o_type string, lang string")


def terms_of(triples: DataFrame) -> DataFrame:
    """One row per term of a vocabulary: semantic_id, labels, aliases, definition, class, from its triples."""
    one = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    many = lambda p: F.sort_array(F.collect_set(F.when(F.col("p") == p, F.col("o"))))
    return triples.groupBy(F.col("s").alias("semantic_id")).agg(many("rdfs:label").alias("labels"), many("skos:altLabel").alias("aliases"), one("skos:definition").alias("definition"), one("rdf:type").alias("class"), many("rdfs:subClassOf").alias("subclass_of"))


def load_catalog(path: str, required: Sequence[str], closed: dict[str, Sequence[str]], unique: Sequence[str]) -> list[dict]:
    """An authored catalog CSV with its checks: columns there, values of closed sets, unique keys; every problem is named at once."""
    import csv

    with open(path, encoding="utf-8-sig", newline="") as f:
        rows = list(csv.DictReader(f))
    problems = [f"missing column {c}" for c in required if rows and c not in rows[0]]
    seen = set()
    for i, r in enumerate(rows, 2):
        problems += [f"line {i}: {c}={r.get(c)!r}" for c, values in closed.items() if r.get(c) not in values]
        key = tuple(r.get(c) for c in unique)
        problems += [f"line {i}: key {key} again"] if key in seen else []
        seen.add(key)
    if problems:
        raise ValueError("; ".join(problems))
    return rows


def bytes_of_zip(members: dict[str, bytes]) -> bytes:
    """A bundle with its manifest, as ``extract_bundle`` reads it."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
        z.writestr("manifest.json", json.dumps({n: hashlib.sha256(d).hexdigest() for n, d in members.items()}))
    return out.getvalue()

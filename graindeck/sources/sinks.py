"""Sinks: tables, JSON and CSV for people, triples, vectors; and generations of a store published as one."""
from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A table as Parquet; partition only by low-cardinality columns such as family_id."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_json(rows: DataFrame, path: str, bound: int = 100_000) -> int:
    """A small table (a catalog, a registry) as pretty UTF-8 JSON, replaced as a whole; more than ``bound`` rows are refused."""
    data = [json.loads(r) for r in rows.limit(bound + 1).toJSON().collect()]
    if len(data) > bound:
        raise ValueError(f"more than {bound} rows")
    replace_text(path, json.dumps(data, ensure_ascii=False, indent=2) + "\n")
    return len(data)


def replace_text(path: str, text: str) -> None:
    """Write beside, then rename over: readers see the old text or the new one."""
    tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    Path(tmp).write_text(text, encoding="utf-8")
    os.replace(tmp, path)


def write_csv_with_bom(df: DataFrame, path: str, bound: int = 1_000_000) -> int:
    """One CSV with a byte-order mark for spreadsheets, streamed through the driver; more than ``bound`` rows are refused."""
    import csv

    tmp, n = f"{path}.tmp", 0
    with open(tmp, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        for n, r in enumerate(df.toLocalIterator(), 1):
            if n > bound:
                raise ValueError(f"more than {bound} rows")
            w.writerow(["" if x is None else x for x in r])
    os.replace(tmp, path)
    return n


def triples_of(df: DataFrame, subject: str, cls: str, properties: dict[str, tuple[str, str]]) -> DataFrame:
    """(s, p, o, o_type) of rows: a type each, and one triple per non-null property (column to predicate and datatype)."""
    cells = [F.struct(F.lit("rdf:type").alias("p"), F.lit(cls).alias("o"), F.lit("iri").alias("o_type"))]
    cells += [F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o"), F.lit(t).alias("o_type")) for c, (p, t) in properties.items()]
    return df.select(F.url_encode(F.col(subject)).alias("s"), F.inline(F.array(*cells))).where(F.col("o").isNotNull())


def write_turtle(triples: DataFrame, path: str, prefix: str = "http://example.org/") -> None:
    """Triples as lines of Turtle, one statement a line, written in parallel."""
    literal = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'), F.when(F.col("o_type") == "xsd:string", "").otherwise(F.concat(F.lit("^^"), F.col("o_type"))))
    line = F.concat(F.lit(f"<{prefix}"), F.col("s"), F.lit("> "), F.when(F.col("p") == "rdf:type", "a").otherwise(F.col("p")), F.lit(" "), F.when(F.col("o_type") == "iri", F.col("o")).otherwise(literal), F.lit(" ."))
    triples.select(line.alias("value")).write.mode("errorifexists").text(path)


def write_vectors(df: DataFrame, path: str, key: str, vector: str, registry_hash: str) -> dict:
    """Vectors as array<float> with a manifest (rows, width, registry hash, digest over keys and values); unequal widths are refused."""
    v = df.select(key, F.col(vector).cast("array<float>").alias(vector))
    facts = v.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"), F.countDistinct(key).alias("keys"), F.sum(F.xxhash64(key, vector).cast("decimal(20,0)")).alias("digest")).first()
    if facts["n"] and (facts["lo"] != facts["hi"] or facts["n"] != facts["keys"]):
        raise ValueError("vectors must be of one width and have keys of their own")
    v.write.mode("errorifexists").parquet(f"{path}/vectors")
    manifest = {"kind": "vectors", "version": 1, "dtype": "float32", "rows": facts["n"], "width": facts["lo"] or 0, "registry_hash": registry_hash, "digest": str(facts["digest"])}
    replace_text(f"{path}/manifest.json", json.dumps(manifest))
    return manifest


def load_vectors(spark: SparkSession, path: str, key: str, vector: str, registry_hash: str) -> DataFrame:
    """Vectors whose manifest fits them and the registry; anything else is refused by name."""
    manifest = json.loads(Path(f"{path}/manifest.json").read_text())
    for name, want in (("kind", "vectors"), ("version", 1), ("dtype", "float32"), ("registry_hash", registry_hash)):
        if manifest.get(name) != want:
            raise ValueError(f"{name} is {manifest.get(name)!r}, not {want!r}")
    df = spark.read.parquet(f"{path}/vectors")
    n, digest = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(key, vector).cast("decimal(20,0)"))).first()
    if n != manifest["rows"] or str(digest) != manifest["digest"]:
        raise ValueError("the vectors aren't those of the manifest")
    return df


def write_vector_sidecar(df: DataFrame, path: str, key: str, vector: str, registry_hash: str, bound: int = 5_000_000) -> dict:
    """The vectors of an index as one little-endian float32 file in order of key, with the keys and a manifest in JSON beside it. For
    indexes that a single reader maps into memory: streamed through the driver, more than ``bound`` vectors are refused (``write_vectors`` takes any number)."""
    h, keys, width, tmp = hashlib.sha256(), [], None, f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    try:
        with open(tmp, "wb") as f:
            for k, v in df.select(key, vector).orderBy(key).toLocalIterator():
                width = len(v) if width is None else width
                if len(v) != width or len(keys) >= bound or (keys and keys[-1] == k):
                    raise ValueError("vectors must be of one width, have keys of their own, and be few enough")
                raw = np.asarray(v, "<f4").tobytes()
                f.write(raw)
                h.update(raw)
                keys.append(k)
        os.replace(tmp, path)
    finally:
        Path(tmp).unlink(missing_ok=True)
    manifest = {"kind": "vector_sidecar", "version": 1, "dtype": "<f4", "rows": len(keys), "width": width or 0, "registry_hash": registry_hash, "sha256": h.hexdigest(), "keys": keys}
    replace_text(f"{path}.json", json.dumps(manifest, ensure_ascii=False))
    return manifest


def read_vector_sidecar(path: str, registry_hash: str) -> tuple[list, np.ndarray]:
    """Keys and mapped vectors of a sidecar; a file that isn't what its manifest says is refused."""
    m = json.loads(Path(f"{path}.json").read_text(encoding="utf-8"))
    for name, want in (("kind", "vector_sidecar"), ("version", 1), ("dtype", "<f4"), ("registry_hash", registry_hash)):
        if m.get(name) != want:
            raise ValueError(f"{name} is {m.get(name)!r}, not {want!r}")
    if os.path.getsize(path) != 4 * m["rows"] * m["width"] or hashlib.sha256(Path(path).read_bytes()).hexdigest() != m["sha256"] or len(m["keys"]) != m["rows"]:
        raise ValueError("the vectors aren't those of the manifest")
    shape = (m["rows"], m["width"])
    return m["keys"], np.memmap(path, "<f4", "r", shape=shape) if m["rows"] else np.zeros(shape, "<f4")


@contextmanager
def build_lock(root: str) -> Iterator[None]:
    """One build at a time: a lock file that must not exist yet; a second build fails at once."""
    at = Path(root) / ".build.lock"
    fd = os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        os.write(fd, f"{os.getpid()} {time.time()}".encode())
        os.close(fd)
        yield
    finally:
        at.unlink(missing_ok=True)


def publish(root: str, tables: dict[str, DataFrame], validate: Callable[[dict[str, DataFrame]], list[str]] = lambda t: []) -> str:
    """Write all tables as one generation, validate what was written, then point CURRENT at it: a failure before that leaves the old
    generation published and the new one removed. Returns the build id, which the manifest carries too."""
    import shutil

    build = uuid.uuid4().hex
    Path(root).mkdir(parents=True, exist_ok=True)
    with build_lock(root):
        at = Path(root) / f"gen-{build}"
        try:
            for name, df in tables.items():
                write_table(df, str(at / name))
            spark = next(iter(tables.values())).sparkSession if tables else None
            written = {name: spark.read.parquet(str(at / name)) for name in tables}
            if problems := validate(written):
                raise ValueError("; ".join(problems))
            facts = {name: {"rows": d.count(), "columns": d.columns, "files": _digest(spark, at / name)} for name, d in written.items()}
            replace_text(str(at / "manifest.json"), json.dumps({"build_id": build, "tables": facts}))
            replace_text(str(Path(root) / "CURRENT"), build)
        except BaseException:
            shutil.rmtree(at, ignore_errors=True)
            raise
    return build


def _digest(spark: SparkSession, folder: Path) -> str:
    """A digest of the content of a table's files, each hashed by a task that reads it in pieces."""
    files = [str(p.relative_to(folder)) for p in sorted(folder.rglob("*.parquet"))]
    root = str(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name in b["name"]:
                h = hashlib.sha256()
                with open(f"{root}/{name}", "rb") as f:
                    while piece := f.read(1 << 20):
                        h.update(piece)
                out.append(h.hexdigest())
            yield b.assign(digest=out)

    df = spark.createDataFrame([(f,) for f in files], "name string").repartition(max(1, len(files)))
    seen = sorted((r["name"], r["digest"]) for r in df.mapInPandas(run, "name string, digest string").collect())  # a line per file
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()


def open_generation(spark: SparkSession, root: str, build_id: str | None = None) -> dict[str, DataFrame]:
    """The published generation; with ``build_id`` (of a registry made with it) only that one, a mixed pair is refused, and so are tables
    whose content isn't what was published."""
    current = (Path(root) / "CURRENT").read_text().strip()
    if build_id is not None and build_id != current:
        raise ValueError(f"the store is of build {current}, the registry of {build_id}")
    at = Path(root) / f"gen-{current}"
    manifest = json.loads((at / "manifest.json").read_text())
    if manifest["build_id"] != current:
        raise ValueError("manifest of another build")
    for name, facts in manifest["tables"].items():
        if _digest(spark, at / name) != facts["files"]:
            raise ValueError(f"{name} was changed after it was published")
    return {name: spark.read.parquet(str(at / name)) for name in manifest["tables"]}

"""Readers, sinks, publication, streaming."""
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graindeck.sources import readers, sinks
from graindeck.streaming import latest


def test_sheet_round_trip(spark, tmp_path):
    (tmp_path / "schema.csv").write_text("name,type,nullable,comment\na,text,Y,\nb,bigint,N,x\n", encoding="utf-8")
    order, fields = readers.read_schema(str(tmp_path / "schema.csv"))
    assert order == ["a", "b"] and fields["b"] == {"type": "bigint", "nullable": False, "comment": "x"}
    assert readers.stage_sheet([["a", "b"], ["x,\"y", 1], [None, "2\n3"]], order, str(tmp_path / "s.csv")) == 2
    df = readers.read_text_csv(spark, str(tmp_path / "s.csv"), [*order, "source_ordinal"])
    assert [tuple(r) for r in df.collect()] == [("x,\"y", "1", "1"), (None, "2\n3", "2")]
    with pytest.raises(ValueError):
        readers.stage_sheet([["b", "a"]], order, str(tmp_path / "t.csv"))
    with pytest.raises(Exception):
        readers.read_text_csv(spark, str(tmp_path / "s.csv"), ["z", "b", "source_ordinal"]).collect()


def test_typed_readers(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2.5\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    assert tuple(readers.read_typed_csv(spark, str(tmp_path / "x.csv"), schema).first()) == (1, 2.5)
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": 2.5}\n{"a": 2}\n')
    assert [tuple(r) for r in readers.read_json_lines(spark, str(tmp_path / "x.jsonl"), schema).orderBy("a").collect()] == [(1, 2.5), (2, None)]
    spark.createDataFrame([(7, "x")], "n long, v string").write.parquet(str(tmp_path / "p"))
    assert readers.read_parquet_with_id(spark, str(tmp_path / "p"), "t", "n").first().source_row_id == "t#7"


def test_bundle_and_hashes(spark, tmp_path):
    (tmp_path / "b.zip").write_bytes(readers.bytes_of_zip({"a.csv": b"1", "d/b.csv": b"2"}))
    out = readers.extract_bundle(str(tmp_path / "b.zip"), str(tmp_path / "out"), ["a.csv", "d/b.csv"])
    assert Path(out["d/b.csv"]).read_bytes() == b"2"
    with pytest.raises(ValueError):
        readers.extract_bundle(str(tmp_path / "b.zip"), str(tmp_path / "out"), ["../x"])
    rec = spark.createDataFrame([("a.csv", hashlib.sha256(b"1").hexdigest())], "source_file string, recorded_sha256 string")
    assert readers.register_files(spark, str(tmp_path / "out" / "a.csv"), rec).first().hash_matches is True


def test_turtle(spark):
    t = readers.read_turtle(spark, '@prefix x: <http://e/> .\nx:fee a x:Metric ; rdfs:label "총보수"@ko , "Fee \\"all in\\""@en ; # note\n  skos:altLabel "보수" ; rdfs:subClassOf x:Cost ; x:scale 2 .\nx:Cost a x:Class .')
    term = {r.semantic_id: r for r in readers.terms_of(t).collect()}["x:fee"]
    assert term.labels == ['Fee "all in"', "총보수"] and term.aliases == ["보수"] and term["class"] == "x:Metric" and term.subclass_of == ["x:Cost"]
    with pytest.raises(ValueError):
        readers.read_turtle(spark, "x:a x:b [ x:c 1 ] .")


def test_catalog(tmp_path):
    (tmp_path / "c.csv").write_text("id,role\n1,a\n2,b\n")
    assert len(readers.load_catalog(str(tmp_path / "c.csv"), ["id"], {"role": ["a", "b"]}, ["id"])) == 2
    (tmp_path / "c.csv").write_text("id,role\n1,a\n1,z\n")
    with pytest.raises(ValueError, match="role='z'.*again"):
        readers.load_catalog(str(tmp_path / "c.csv"), ["id"], {"role": ["a"]}, ["id"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "가\"나"), (2, None)], "k int, v string")
    assert sinks.write_json(df, str(tmp_path / "j.json")) == 2 and json.loads((tmp_path / "j.json").read_text())[0]["v"] == "가\"나"
    with pytest.raises(ValueError):
        sinks.write_json(df, str(tmp_path / "k.json"), bound=1)
    assert sinks.write_csv_with_bom(df, str(tmp_path / "c.csv")) == 2 and (tmp_path / "c.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    tr = sinks.triples_of(df, "k", "x:Thing", {"v": ("x:v", "xsd:string")})
    assert tr.count() == 3
    sinks.write_turtle(tr, str(tmp_path / "t"))
    assert '<http://example.org/1> x:v "가\\"나" .' in "".join(p.read_text() for p in (tmp_path / "t").glob("part*"))


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "k bigint, v array<float>")
    sinks.write_vectors(df, str(tmp_path / "v"), "k", "v", "h1")
    assert sinks.load_vectors(spark, str(tmp_path / "v"), "k", "v", "h1").count() == 2
    with pytest.raises(ValueError, match="registry_hash"):
        sinks.load_vectors(spark, str(tmp_path / "v"), "k", "v", "h2")
    with pytest.raises(ValueError):
        sinks.write_vectors(df.union(spark.createDataFrame([(3, [1.0])], df.schema)), str(tmp_path / "w"), "k", "v", "h1")


def test_publication(spark, tmp_path):
    root, df = str(tmp_path / "store"), spark.createDataFrame([(1,)], "k int")
    first = sinks.publish(root, {"t": df})
    with pytest.raises(ValueError, match="bad"):
        sinks.publish(root, {"t": df.union(df)}, lambda t: ["bad"] if t["t"].count() > 1 else [])
    assert sinks.open_generation(spark, root, first)["t"].count() == 1 and len(list(Path(root).glob("gen-*"))) == 1
    second = sinks.publish(root, {"t": df.union(df)})
    assert sinks.open_generation(spark, root)["t"].count() == 2
    with pytest.raises(ValueError, match="registry"):
        sinks.open_generation(spark, root, first)
    with sinks.build_lock(root), pytest.raises(FileExistsError):
        sinks.publish(root, {"t": df})
    assert (Path(root) / "CURRENT").read_text() == second and not (Path(root) / ".build.lock").exists()
    next(Path(root, f"gen-{second}", "t").glob("*.parquet")).write_bytes(b"x")
    with pytest.raises(ValueError, match="changed"):
        sinks.open_generation(spark, root)


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", "a", 1.0, "r1"), (1, "2024-01-01 11:00:00", "b", 2.0, "r2"), (2, "2024-01-01 10:30:00", "a", 3.0, "r3"), (1, "2024-01-01 11:00:00", "a", 4.0, "r1b")]
    df = spark.createDataFrame(rows, "user_id int, t string, kind string, value double, row string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("latest_q", latest.latest_stream(s, "user_id", "ts", "row", ["value"]), "complete"), ("window_q", latest.windowed_counts(s, "ts", "kind"), "append")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {r.user_id: r.value for r in spark.table("latest_q").collect()} == {1: 4.0, 2: 3.0}
    assert spark.table("window_q").count() >= 0


def test_a_change_of_equal_size_is_seen(spark, tmp_path):
    root = str(tmp_path / "store")
    build = sinks.publish(root, {"t": spark.range(50).toDF("id")})
    assert sinks.open_generation(spark, root, build)["t"].count() == 50
    part = max((tmp_path / "store" / f"gen-{build}" / "t").glob("*.parquet"), key=lambda p: p.stat().st_size)
    raw = bytearray(part.read_bytes())
    raw[len(raw) // 2] ^= 1
    part.write_bytes(bytes(raw))
    with pytest.raises(ValueError, match="changed"):
        sinks.open_generation(spark, root, build)


def test_vector_sidecar(spark, tmp_path):
    path = str(tmp_path / "index.f32")
    df = spark.createDataFrame([("b", [1.0, 2.0]), ("a", [0.5, -3.0])], "k string, v array<double>")
    m = sinks.write_vector_sidecar(df, path, "k", "v", "reg")
    keys, vectors = sinks.read_vector_sidecar(path, "reg")
    assert keys == ["a", "b"] and vectors.tolist() == [[0.5, -3.0], [1.0, 2.0]] and (m["rows"], m["width"]) == (2, 2)
    for bad in ([("a", [1.0]), ("b", [1.0, 2.0])], [("a", [1.0]), ("a", [2.0])]):
        with pytest.raises(ValueError):
            sinks.write_vector_sidecar(spark.createDataFrame(bad, "k string, v array<double>"), str(tmp_path / "bad.f32"), "k", "v", "reg")
    with pytest.raises(ValueError):
        sinks.read_vector_sidecar(path, "another")
    raw = bytearray(open(path, "rb").read())
    raw[0] ^= 1
    open(path, "wb").write(bytes(raw))
    with pytest.raises(ValueError):
        sinks.read_vector_sidecar(path, "reg")


def test_an_application_deletes_its_own_tables_only(spark):
    import os

    from graindeck import session

    session.cut(spark.range(3), "mine")
    own = session._own_folder(spark).removeprefix("file://")
    other = os.path.join(os.path.dirname(own), "app-of-another")
    os.makedirs(other, exist_ok=True)
    assert os.listdir(own)
    session.purge(spark)
    assert not os.path.exists(own) and os.path.exists(other)

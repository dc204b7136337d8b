"""Package sources and streaming rate windows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veritrail.sources import packages
from veritrail.streaming import rates

SF = "/root/testdata/sf0.001"
DOC = {
    "@context": "c", "id": "urn:p", "type": ["Package", "Case"], "level": 2, "ratio": 0.5, "done": True, "none": None,
    "hasResult": [{"id": "urn:r1", "label": 'a "b"\n\\c\t'}, {"id": "urn:bare"}, {"label": "no id"}],
    "when": {"@value": "2020-01-01", "@type": "date"},
}


def test_documents_become_triples(spark, tmp_path):
    (tmp_path / "a.jsonld").write_text(json.dumps(DOC))
    (tmp_path / "b.jsonld").write_text("{not json")
    (tmp_path / "c.jsonld").write_text(json.dumps({"@graph": [DOC, DOC]}))
    (tmp_path / "d.txt").write_text("{}")
    rows = packages.read_packages(spark, str(tmp_path)).collect()
    own = {(r.s, r.p, r.o, r.o_kind) for r in rows if r.package_id.endswith("a.jsonld")}
    assert own == {
        ("urn:p", "type", "Package", "iri"), ("urn:p", "type", "Case", "iri"), ("urn:p", "level", "2", "lit"), ("urn:p", "ratio", "0.5", "lit"), ("urn:p", "done", "true", "lit"),
        ("urn:p", "hasResult", "urn:r1", "iri"), ("urn:p", "hasResult", "urn:bare", "iri"), ("urn:p", "hasResult", "_:b0", "blank"), ("urn:p", "when", "2020-01-01", "lit"),
        ("urn:r1", "label", 'a "b"\n\\c\t', "lit"), ("_:b0", "label", "no id", "lit"),
    }
    assert [r.p for r in rows if r.package_id.endswith("b.jsonld")] == ["parseError"]
    assert {(r.s, r.p) for r in rows if r.package_id.endswith("c.jsonld")} >= {("urn:p", "level"), ("urn:r1", "label")}
    assert not any(r.package_id.endswith("d.txt") for r in rows)


def test_ntriples_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("x", json.dumps(DOC)), ("y", None)], "package_id string, doc string")
    given = packages.triples(docs)
    packages.write_ntriples(given, str(tmp_path / "out"))
    back = packages.read_ntriples(spark, str(tmp_path / "out"))
    names = ["s", "p", "o", "o_kind", "o_datatype"]
    assert sorted(map(tuple, back.select(names).collect()), key=str) == sorted(map(tuple, given.select(names).collect()), key=str)


def test_stream_gives_the_windows_of_the_batch(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = rates.call_rates(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "value", "60 minutes", "30 minutes")
    assert stream.isStreaming
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = rates.call_rates(batch, "user_id", "ts", "value", "60 minutes", "30 minutes")
    key = lambda r: (r.user_id, r.window_start, r.window_end, r.calls, round(r.amount, 4))
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, want.collect()))
    assert rates.over_limit(want, 10**9, 1e18).isEmpty() and rates.over_limit(want, 0, 1e18).count() == want.count()

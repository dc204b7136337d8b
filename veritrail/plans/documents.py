"""Registered queries that go from JSON documents to triples: contexts by path and inline, terms resolved."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.session import table
from veritrail.sources import contexts, packages

from .registry import query

V, P, X = "https://example.org/vocab#", "http://www.w3.org/ns/prov#", "http://www.w3.org/2001/XMLSchema#"
SHARED = {"@vocab": V, "id": "@id", "type": "@type", "v": V, "prov": P, "xsd": X, "bindsModel": {"@id": "v:bindsModel", "@type": "@id"}, "riskLevel": {"@id": "v:modelRiskLevel", "@type": "xsd:integer"}, "wasDerivedFrom": {"@id": "prov:wasDerivedFrom", "@type": "@id"}}
OWN = {"own": {"@id": "prov:used", "@type": "@id"}, "prov": P}


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package_id, path, doc): a document for each order; every third has terms of its own beside the context that it names by a relative path, some name none."""
    own = F.when(F.col("o_orderkey") % 3 == 0, F.lit(json.dumps(["../ctx/v1.jsonld", OWN]))).when(F.col("o_orderkey") % 3 == 1, F.lit('"../ctx/v1.jsonld"'))
    head = F.coalesce(F.concat(F.lit('"@context": '), own, F.lit(", ")), F.lit(""))
    doc = F.concat(
        F.lit("{"), head, F.lit('"id": "u", "type": "UnitOfAssurance", "bindsModel": "m'), F.col("o_custkey").cast("string"), F.lit('", "riskLevel": '), F.substring("o_orderpriority", 1, 1),
        F.lit(', "wasDerivedFrom": {"id": "d", "type": "prov:Entity"}, "own": "o", "free": ["'), F.col("o_orderstatus"), F.lit('", true]}'),
    )
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").cast("string").alias("package_id"), F.concat(F.lit("/base/packages/"), F.col("o_orderkey").cast("string"), F.lit(".jsonld")).alias("path"), doc.alias("doc"))


def triple_sql() -> str:
    """Each triple of a document, by whether it names the shared context (o_orderkey % 3 < 2) and has terms of its own (o_orderkey % 3 = 0)."""
    named, own = "o_orderkey % 3 < 2", "o_orderkey % 3 = 0"
    full = lambda iri, key: f"CASE WHEN {named} THEN '{iri}' ELSE '{key}' END"
    kind = f"CASE WHEN {named} THEN 'iri' ELSE 'lit' END"
    text = f"CASE WHEN {named} THEN NULL ELSE '{X}string' END"
    rows = [
        ("'u'", "'type'", full(V + "UnitOfAssurance", "UnitOfAssurance"), "'iri'", "NULL"),
        ("'u'", full(V + "bindsModel", "bindsModel"), "'m' || o_custkey", kind, text),
        ("'u'", full(V + "modelRiskLevel", "riskLevel"), "substr(o_orderpriority, 1, 1)", "'lit'", f"'{X}integer'"),
        ("'u'", full(P + "wasDerivedFrom", "wasDerivedFrom"), "'d'", "'iri'", "NULL"),
        ("'d'", "'type'", full(P + "Entity", "prov:Entity"), "'iri'", "NULL"),
        ("'u'", f"CASE WHEN {own} THEN '{P}used' WHEN {named} THEN '{V}own' ELSE 'own' END", "'o'", f"CASE WHEN {own} THEN 'iri' ELSE 'lit' END", f"CASE WHEN {own} THEN NULL ELSE '{X}string' END"),
        ("'u'", full(V + "free", "free"), "o_orderstatus", "'lit'", f"'{X}string'"), ("'u'", full(V + "free", "free"), "'true'", "'lit'", f"'{X}boolean'"),
    ]
    return " UNION ALL ".join(f"SELECT CAST(o_orderkey AS VARCHAR) AS package_id, {s} AS s, {p} AS p, {o} AS o, {k} AS o_kind, {d} AS o_datatype FROM orders" for s, p, o, k, d in rows)


@query(triple_sql())
def src_1(spark, sf_dir):
    """The triples of all documents, terms resolved by the context that each names and by its own."""
    docs = contexts.of_packages(order_documents(spark, sf_dir), "path", "doc")
    shared = contexts.terms(spark.createDataFrame([("/base/ctx/v1.jsonld", json.dumps(SHARED))], "context string, json string"), "context", "json")
    inline = contexts.terms(docs.where("inline IS NOT NULL"), "package_id", "inline")
    return contexts.resolved(packages.triples(docs, keep="context"), shared, inline)


USES = "SELECT p, count(*) AS triples, count(DISTINCT package_id) AS packages FROM ({}) GROUP BY p"


@query(USES.format(triple_sql()))
def gw_3(spark, sf_dir):
    """How often each resolved predicate is used, and in how many packages."""
    return src_1(spark, sf_dir).groupBy("p").agg(F.count("*").alias("triples"), F.countDistinct("package_id").alias("packages"))

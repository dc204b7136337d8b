"""Evidence packages as (package_id, s, p, o, o_kind, o_datatype) triples: JSON documents and N-Triples.

A file is one package, and its path the package_id. Files are read and flattened on the executors, each on its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contexts

TRIPLES = "package_id string, s string, p string, o string, o_kind string, o_datatype string"
#: Datatypes of plain JSON values.
XSD = "http://www.w3.org/2001/XMLSchema#"


def flatten(doc: object) -> Iterator[tuple[str, str, str, str, str | None]]:
    """(s, p, o, o_kind, o_datatype) of a document: nested objects are nodes of their own, arrays give several values.

    An object with an id and nothing else is a reference. Objects without an id get blank names in document order.
    """
    blank = 0

    def literal(value):
        if isinstance(value, bool):
            return str(value).lower(), "lit", XSD + "boolean"
        if isinstance(value, int | float):
            return repr(value), "lit", XSD + ("integer" if isinstance(value, int) else "double")
        return str(value), "lit", XSD + "string"

    stack = list(reversed(doc)) if isinstance(doc, list) else [doc]
    named: dict[int, str] = {}

    def name(node: dict) -> str:
        nonlocal blank
        if id(node) not in named:
            named[id(node)] = node.get("id") or node.get("@id") or f"_:b{blank}"
            blank += named[id(node)] == f"_:b{blank}"
        return named[id(node)]

    while stack:
        node = stack.pop()
        if not isinstance(node, dict):
            continue
        graph = node.get("@graph")
        if graph is not None:
            stack.extend(reversed(graph if isinstance(graph, list) else [graph]))
        s = name(node)
        for key, value in node.items():
            if key in ("id", "@id", "@context", "@graph") or value is None:
                continue
            p = "type" if key == "@type" else key
            for x in value if isinstance(value, list) else [value]:
                if isinstance(x, dict) and "@value" in x:
                    yield s, p, str(x["@value"]), "lit", x.get("@type", XSD + "string")
                elif isinstance(x, dict):
                    o = name(x)
                    yield s, p, o, "blank" if o.startswith("_:") else "iri", None
                    if set(x) - {"id", "@id"}:
                        stack.append(x)
                elif p == "type":
                    yield s, p, str(x), "iri", None
                elif x is not None:
                    o, kind, datatype = literal(x)
                    reference = datatype.endswith("string") and o.startswith(("http://", "https://", "urn:"))
                    yield (s, p, o, "iri", None) if reference else (s, p, o, kind, datatype)


def triples(docs: DataFrame, id_col: str = "package_id", json_col: str = "doc", keep: str | None = None) -> DataFrame:
    """Triples of JSON documents in a column, each once. A document that isn't JSON gives one triple with p = parseError.

    ``keep``: a text column of the document that its triples carry along.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for package, kept, text in zip(batch["id"], batch["kept"], batch["doc"], strict=True):
                try:
                    own = dict.fromkeys(flatten(json.loads(text or "null")))
                except ValueError as e:
                    own = {("", "parseError", str(e), "lit", XSD + "string"): None}
                out += [(package, *t, kept) for t in own]
            yield pd.DataFrame(out, columns=["package_id", "s", "p", "o", "o_kind", "o_datatype", "kept"])

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(json_col).alias("doc"), (F.col(keep) if keep else F.lit(None)).cast("string").alias("kept"))
    out = rows.mapInPandas(run, TRIPLES + ", kept string")
    return out.withColumnRenamed("kept", keep) if keep else out.drop("kept")


def read_packages(spark: SparkSession, path: str, pattern: str = "*.jsonld") -> DataFrame:
    """Triples of all documents below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return triples(files.select(F.col("_metadata.file_path").alias("package_id"), F.col("value").alias("doc")))


def load(spark: SparkSession, path: str, context_path: str, pattern: str = "*.jsonld") -> DataFrame:
    """Triples of all documents below a folder, with terms resolved by the contexts below another and local names, as rules ask for them."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    docs = contexts.of_packages(files.select(contexts.plain_path(F.col("_metadata.file_path")).alias("package_id"), F.col("value").alias("doc")), "package_id", "doc")
    return expand(docs, contexts.read_contexts(spark, context_path))


def expand(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Rule-ready triples of documents (package_id, doc, context, inline), with the terms of shared contexts."""
    inline = contexts.terms(docs.where("inline IS NOT NULL"), "package_id", "inline")
    return contexts.localised(contexts.resolved(triples(docs, keep="context"), shared, inline))


def assured(rows: DataFrame) -> DataFrame:
    """(package_id, s): the nodes of a package that are units of assurance, wherever in its graph they stand."""
    return rows.where("p = 'type' AND o = 'UnitOfAssurance'").select("package_id", "s").distinct()


LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@(\S+))?)\s*\.\s*$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files; lines that aren't triples (comments, blank lines) give none."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("package_id"), "value").where(F.col("value").rlike(LINE))
    part = lambda i: F.nullif(F.regexp_extract("value", LINE, i), F.lit(""))
    text = F.regexp_extract("value", LINE, 5)
    for escaped, plain in ((r"\\n", "\n"), (r"\\t", "\t"), (r'\\"', '"'), (r"\\\\", r"\\")):
        text = F.regexp_replace(text, escaped, plain)
    iri, blank = part(3), part(4)
    kind = F.when(iri.isNotNull(), "iri").when(blank.isNotNull(), "blank").otherwise("lit")
    return rows.select(
        "package_id", F.regexp_replace(part(1), "^<|>$", "").alias("s"), part(2).alias("p"), F.coalesce(iri, blank, text).alias("o"), kind.alias("o_kind"),
        F.when(kind == "lit", F.coalesce(part(6), F.lit(XSD + "string"))).alias("o_datatype"),
    )


def write_ntriples(triples: DataFrame, path: str) -> None:
    """One line per triple; names without a scheme are kept as they are, between angle brackets."""
    node = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = F.col("o")
    for plain, escaped in ((r"\\", r"\\\\"), ('"', r'\\"'), ("\n", r"\\n"), ("\t", r"\\t")):
        text = F.regexp_replace(text, plain, escaped)
    typed = F.when(F.col("o_datatype").isNull() | (F.col("o_datatype") == XSD + "string"), "").otherwise(F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">")))
    o = F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), text, F.lit('"'), typed)).otherwise(node(F.col("o")))
    triples.select(F.concat_ws(" ", node(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), o, F.lit(".")).alias("value")).write.text(path)

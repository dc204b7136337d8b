"""Canonical JSON and its digests; names that must not occur; JSON entries as rows.

Canonical is: keys sorted at every level, no white space, no escapes beyond JSON's own, numbers as they are read and
written by Python's json module, UTF-8. Digests of other tools depend on exactly that (1.0 stays 1.0, which Spark's
variants write as 1), so this one step is a small Python function over Arrow batches; all else is native.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields that say how a document was sealed, and the blocks in which decisions may stand.
INTEGRITY = ("hash", "signature", "signatureAlg", "canonicalizationAlg")
ACTIONS = ("engineerDecision", "guardrailAction")


def plain(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def canonical(doc: Column, without: tuple[str, ...] = (), context: Column | None = None) -> Column:
    """The canonical text of JSON documents, less some top-level fields; null for what isn't JSON.

    ``context``: JSON text that takes the place of a document's @context, where it isn't null.
    """

    @F.pandas_udf("string")
    def run(docs: pd.Series, contexts: pd.Series) -> pd.Series:
        def one(text, own):
            try:
                value = json.loads(text)
                if isinstance(value, dict):
                    if own is not None and "@context" in value:
                        value["@context"] = json.loads(own)
                    value = {k: v for k, v in value.items() if k not in without}
                return plain(value)
            except (TypeError, ValueError):
                return None

        return pd.Series([one(t, c) for t, c in zip(docs, contexts, strict=True)], dtype="object")

    return run(doc, F.lit(None).cast("string") if context is None else context)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def document_hash(doc: Column, context: Column | None = None) -> Column:
    """SHA-256 of a document without its integrity fields."""
    return digest(canonical(doc, INTEGRITY, context))


def measurement_hash(doc: Column) -> Column:
    """SHA-256 of what was measured: integrity fields and decision blocks left out."""
    return digest(canonical(doc, INTEGRITY + ACTIONS))


def block_hash(block: Column, field: str = "hash") -> Column:
    """SHA-256 of a block without the field that holds it."""
    return digest(canonical(block, (field,)))


def intact(block: Column, field: str = "hash") -> Column:
    """Whether the digest that a block holds (with or without a scheme before it) is its own; false without one."""
    stored = F.regexp_replace(F.get_json_object(block, f"$.{field}"), "^[^:]*:", "")
    return F.coalesce(stored == block_hash(block, field), F.lit(False))


def bound(signature_scope: Column, doc: Column) -> Column:
    """Whether a signed block names the measurement hash of the document that it stands in."""
    return F.coalesce(F.regexp_replace(signature_scope, "^sha256:", "") == measurement_hash(doc), F.lit(False))


def forbidden(docs: DataFrame, id_col: str, json_col: str, names: tuple[str, ...], exempt: tuple[str, ...] = ACTIONS) -> DataFrame:
    """(id, path, name) of every property with a forbidden name, compared whole. Top-level blocks that are exempt aren't looked into; deeper ones of that name are."""
    kind = dict(docs.dtypes)[id_col]
    barred = frozenset(names)

    def walk(value: object, path: str) -> Iterator[tuple[str, str]]:
        stack = [(value, path)]
        while stack:
            value, path = stack.pop()
            if isinstance(value, dict):
                yield from ((f"{path}.{k}", k) for k in value if k in barred)
                stack += [(v, f"{path}.{k}") for k, v in value.items()]
            elif isinstance(value, list):
                stack += [(v, f"{path}[{i}]") for i, v in enumerate(value)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["doc"], strict=True):
                try:
                    value = json.loads(text)
                except (TypeError, ValueError):
                    continue
                if isinstance(value, dict):
                    value = {k: v for k, v in value.items() if k not in exempt}
                out += [(i, *x) for x in walk(value, "$")]
            yield pd.DataFrame(out, columns=["id", "path", "name"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(json_col).alias("doc"))
    return rows.mapInPandas(run, f"id {kind}, path string, name string").withColumnRenamed("id", id_col)


def entries(docs: DataFrame, id_col: str, json_col: str, path: str = "$") -> DataFrame:
    """(id, pos, key, value) of the object or array at a path, one row an entry; ``key`` is null in arrays, ``value`` JSON text. Anything else has no rows."""
    rows = docs.select(F.col(id_col).alias("_id"), F.try_variant_get(F.try_parse_json(json_col), path, "variant").alias("_v"))
    found = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    return found.select(F.col("_id").alias(id_col), "pos", "key", F.to_json("value").alias("value"))

"""Terms of JSON-LD contexts: read, resolved and joined to the triples of packages.

A context is rows (context, term, iri, coercion), with prefixes already expanded; the row of the term @vocab holds what
undeclared terms are put behind. Contexts that many packages name are a small table, joined once to all triples; a
package's own, inline terms are joined by package. Everything is native: no document goes to Python for its context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "package_id"
ABSOLUTE = "^(https?://|urn:|file:/)"


def terms(rows: DataFrame, key: str, json_col: str) -> DataFrame:
    """(key, term, iri, coercion) of contexts given as JSON text, each under its key.

    An entry is an IRI, prefix:name, or an object with @id and @type; an object without @id coerces a term that @vocab
    expands. Prefixes are looked up in the same context; an entry of a prefix that isn't there is kept as it is.
    """
    raw = F.from_json(json_col, "map<string, string>")
    entries = rows.select(F.col(key).alias("_key"), F.explode(raw).alias("term", "raw"))
    inside = lambda name: F.when(F.startswith("raw", F.lit("{")), F.get_json_object("raw", f"$['{name}']"))
    own = entries.select("_key", "term", F.when(F.startswith("raw", F.lit("{")), inside("@id")).otherwise(F.col("raw")).alias("iri"), inside("@type").alias("coercion"))
    prefixes = own.where(F.col("iri").rlike(ABSOLUTE)).select("_key", F.col("term").alias("prefix"), F.col("iri").alias("base"))

    def expanded(df: DataFrame, column: str) -> DataFrame:
        head, rest = F.regexp_extract(column, "^([^:/]+):(?!//)", 1), F.regexp_extract(column, "^[^:/]+:(?!//)(.*)$", 1)
        joined = df.withColumn("prefix", F.nullif(head, F.lit(""))).join(prefixes, ["_key", "prefix"], "left")
        return joined.withColumn(column, F.when(F.col("base").isNotNull(), F.concat("base", rest)).otherwise(F.col(column))).drop("prefix", "base")

    return expanded(expanded(own, "iri"), "coercion").select(F.col("_key").alias(key), "term", "iri", "coercion")


def read_contexts(spark: SparkSession, path: str, pattern: str = "*.jsonld") -> DataFrame:
    """All contexts below a folder: (context, term, iri, coercion); a context's name is its file's path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    inner = files.select(plain_path(F.col("_metadata.file_path")).alias("context"), F.get_json_object("value", "$['@context']").alias("json"))
    return terms(inner.where("json LIKE '{%'"), "context", "json")


def plain_path(path: Column) -> Column:
    """A path without the scheme of local files, with . and .. worked out."""
    parts = F.split(F.regexp_replace(path, "^file:/+", "/"), "/")
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.array_append(done, x))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def of_packages(docs: DataFrame, path_col: str, json_col: str) -> DataFrame:
    """Adds ``context`` (the path of the context that a document names, relative to its own folder) and ``inline`` (its own terms as JSON).

    An array may hold both; of several references, or several objects, the last counts.
    """
    own = F.get_json_object(json_col, "$['@context']")
    listed = F.when(F.startswith(own, F.lit("[")), F.from_json(own, "array<string>")).when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>"))
    last = lambda keep: F.try_element_at(F.filter(listed, keep), F.lit(-1))
    reference = last(lambda x: ~F.startswith(x, F.lit("{")))
    folder = F.regexp_extract(path_col, "^(.*/)?[^/]*$", 1)
    full = F.when(reference.rlike(ABSOLUTE) | F.startswith(reference, F.lit("/")), reference).otherwise(F.concat(folder, reference))
    return docs.withColumns({"context": plain_path(full), "inline": last(lambda x: F.startswith(x, F.lit("{")))})


def resolved(triples: DataFrame, contexts: DataFrame, inline: DataFrame) -> DataFrame:
    """Triples (with their package's ``context``) with full IRIs for predicates and types, and coerced objects.

    A key is, in this order: absolute; a term of the package's own; a term of the context it names; prefix:name with a
    prefix of either; else @vocab and the key; else the key as it is. ``inline`` has (package_id, term, iri, coercion).
    A context is one row with a map of its terms, so the triples meet each kind of context in one join.
    """

    def mapped(df: DataFrame, key: str, name: str) -> DataFrame:
        entries = df.groupBy(key, "term").agg(F.max(F.struct("iri", "coercion")).alias("x"))
        return entries.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "x"))).alias(name))

    rows = triples.join(mapped(contexts, "context", "_shared"), "context", "left").join(mapped(inline, KEY, "_own"), KEY, "left")
    entry = lambda term, part: F.coalesce(F.try_element_at("_own", term)[part], F.try_element_at("_shared", term)[part])

    def iri(term: Column) -> Column:
        prefix, rest = F.regexp_extract(term, "^([^:/]+):(?!//)", 1), F.regexp_extract(term, "^[^:/]+:(.*)$", 1)
        behind = F.concat(F.coalesce(entry(F.lit("@vocab"), "iri"), F.lit("")), term)
        return F.when(term.rlike(ABSOLUTE) | F.startswith(term, F.lit("_:")), term).otherwise(F.coalesce(entry(term, "iri"), F.concat(entry(prefix, "iri"), rest), behind))

    coercion, typed = entry(F.col("p"), "coercion"), F.col("p") == "type"
    kind = F.when(coercion == "@id", "iri").otherwise(F.col("o_kind"))
    return rows.select(
        KEY, "s", F.when(F.col("p").isin("type", "parseError"), F.col("p")).otherwise(iri(F.col("p"))).alias("p"),
        F.when(typed, iri(F.col("o"))).otherwise(F.col("o")).alias("o"), kind.alias("o_kind"),
        F.when(kind == "lit", F.when(coercion.rlike(ABSOLUTE), coercion).otherwise(F.col("o_datatype"))).alias("o_datatype"),
    )


def localised(triples: DataFrame) -> DataFrame:
    """Predicates by their local names, and objects too that are terms of a vocabulary (IRIs with a fragment): the names that rules use."""
    local = lambda c: F.regexp_extract(c, "([^#/]*)$", 1)
    return triples.withColumns({"p": local("p"), "o": F.when((F.col("o_kind") == "iri") & F.contains("o", F.lit("#")), local("o")).otherwise(F.when(F.col("p") == "type", local("o")).otherwise(F.col("o")))}).distinct()

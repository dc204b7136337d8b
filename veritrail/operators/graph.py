"""Triple patterns, absence, chains and reachability over (package_id, s, p, o) frames.

The package is part of every key: evidence never leaks from one package to another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.storage import cut

KEY = "package_id"


def pattern(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Bindings of one pattern; names that start with ? are variables, anything else is a constant.

    A variable that stands twice asks for equal values.
    """
    rows = triples.where(F.col("p") == p)
    for column, term in (("s", s), ("o", o)):
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == term)
    if s == o and s.startswith("?"):
        rows = rows.where("s = o")
    names = {term[1:]: column for column, term in (("s", s), ("o", o)) if term.startswith("?")}
    return rows.select(KEY, *[F.col(c).alias(n) for n, c in names.items()])


def match(*frames: DataFrame) -> DataFrame:
    """Natural join of bindings on the package and all variables they share."""
    return reduce(lambda a, b: a.join(b, [c for c in a.columns if c in b.columns]), frames).distinct()


def absent(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    """The rows for which no binding agrees on the shared variables."""
    return rows.join(bindings, [c for c in rows.columns if c in bindings.columns], "left_anti")


def exists(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    return rows.join(bindings, [c for c in rows.columns if c in bindings.columns], "left_semi")


def optional(rows: DataFrame, bindings: DataFrame) -> DataFrame:
    return rows.join(bindings, [c for c in rows.columns if c in bindings.columns], "left")


def reach(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(package_id, start, node) over (package_id, s, o) edges, starts included; cycles end by the visited set.

    Rounds go on until nothing new is reached, however long the chains are. Each round joins only the new frontier. The lineage is cut by checkpoint(), in the folder that all executors share.
    """
    seen = frontier = starts.select(KEY, F.col("node").alias("start"), "node").distinct()
    rounds = 0
    hops = edges.select(KEY, F.col("s").alias("node"), F.col("o").alias("next"))
    while True:
        step = frontier.join(hops, [KEY, "node"]).select(KEY, "start", F.col("next").alias("node")).distinct()
        frontier = step.join(seen, [KEY, "start", "node"], "left_anti")
        frontier = cut(frontier)
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
        if (rounds := rounds + 1) % 16 == 0:
            seen = cut(seen.coalesce(edges.sparkSession.sparkContext.defaultParallelism))


def dangling(triples: DataFrame) -> DataFrame:
    """Objects that are references but described by no triple of their package, with how often they are used."""
    used = triples.where("o_kind = 'iri'").groupBy(KEY, F.col("o").alias("node")).agg(F.count("*").alias("uses"))
    return used.join(triples.select(KEY, F.col("s").alias("node")).distinct(), [KEY, "node"], "left_anti")

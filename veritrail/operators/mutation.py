"""Mutants of packages as overlays: which triples go and come, and what the rules say then against the package's own baseline.

A mutation is data: where it applies (patterns), what it removes there and what it puts in. The manifest holds one row a
mutant with both lists. All mutants are packages of one table, with the mutant's id for a package id, so the rules run
once over all of them; nothing is copied but the triples of the mutated packages.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.storage import laid

from . import packed
from .graph import KEY

UOA = ("?uoa", "type", "UnitOfAssurance")


@dataclass(frozen=True)
class Mutation:
    """At each ``node`` that the patterns bind, all triples of ``removes`` go and those of ``adds`` (predicate, object) come."""

    id: str
    target: str
    node: str
    sites: tuple[tuple[str, str, str], ...]
    removes: tuple[str, ...] = ()
    adds: tuple[tuple[str, str], ...] = ()


MUTATIONS = [
    Mutation("drop-signature", "W-SI-01", "uoa", (UOA, ("?uoa", "signature", "?x")), ("signature",)),
    Mutation("drop-requirement", "W-SI-02", "uoa", (UOA, ("?uoa", "bindsRequirement", "?x")), ("bindsRequirement",)),
    Mutation("drop-generation", "W-EP-02", "v", (UOA, ("?uoa", "hasValidationResult", "?v"), ("?v", "wasGeneratedBy", "?x")), ("wasGeneratedBy",)),
    Mutation("drop-comparator", "W-AR-05", "v", (UOA, ("?uoa", "hasValidationResult", "?v"), ("?v", "comparedAgainst", "?x")), ("comparedAgainst",)),
    Mutation("drop-criteria", "W-AR-01", "f", (UOA, ("?uoa", "hasCredibilityFactor", "?f"), ("?f", "acceptanceCriteria", "?x")), ("acceptanceCriteria",)),
    Mutation("not-assessed", "W-EP-04", "f", (UOA, ("?uoa", "hasCredibilityFactor", "?f")), ("factorStatus",), (("factorStatus", "not-assessed"),)),
]
TRIPLE = "array<struct<s: string, p: string, o: string>>"


def predicates(mutations: list[Mutation] = MUTATIONS) -> set[str]:
    """The predicates that mutations look at or change."""
    return {p for m in mutations for p in (*m.removes, *[p for p, _ in m.adds], *[x for _, x, _ in m.sites])}


def manifest(triples: DataFrame, mutations: list[Mutation] = MUTATIONS, site: int | None = 0) -> DataFrame:
    """(mutant, package_id, operator, target, site, place, removed, added) of all live mutants.

    ``site``: which of a mutation's sites in a package, ordered by name, is taken; None: each of them. A mutant that
    would change nothing isn't live and isn't listed. Sites of one package are ordered within it: a package is small.
    """
    return manifest_packed(packed.packed(triples, predicates(mutations)), mutations, site)


def manifest_packed(rows: DataFrame, mutations: list[Mutation] = MUTATIONS, site: int | None = 0, kept: tuple[str, ...] = ()) -> DataFrame:
    """The same of packed rows, with the columns that are kept."""
    rows = rows.select(KEY, *kept, F.inline(F.expr(f"concat({', '.join(mutants(m, site) for m in mutations)})")))
    rows = rows.where("size(removed) + size(added) > 0")
    return rows.select(F.concat_ws("#", F.col(KEY).cast("string"), "operator", F.col("place").cast("string")).alias("mutant"), KEY, "operator", "target", "site", "place", "removed", "added", *kept)


def mutants(m: Mutation, site: int | None) -> str:
    """SQL of an array, over a packed row, of a mutation's mutants; ``removed`` and ``added`` are what differs."""
    sites = f"array_sort(array_distinct({packed.matches(m.sites, (), [], (m.node,), lambda env: env[m.node])}))"
    every = f"transform({sites}, (_s, _i) -> struct(_s AS site, _i AS place))"
    gone = ", ".join(f"transform(filter({packed.column(p)}, _t -> _t.s = _m.site), _t -> struct(_t.s AS s, {packed.literal(p)} AS p, _t.o AS o))" for p in m.removes)
    new = ", ".join(f"struct(_m.site AS s, {packed.literal(p)} AS p, {packed.literal(o)} AS o)" for p, o in m.adds)
    gone, new = f"CAST(concat({gone}) AS {TRIPLE})", f"CAST(array({new}) AS {TRIPLE})"
    fields = f"{packed.literal(m.id)} AS operator, {packed.literal(m.target)} AS target, _m.site AS site, _m.place AS place, array_sort(array_except({gone}, {new})) AS removed, array_except({new}, {gone}) AS added"
    return f"transform({every if site is None else f'slice({every}, {site + 1}, 1)'}, _m -> struct({fields}))"


def judged(rows: DataFrame, counts: Mapping[str, tuple[str, set[str]]], mutations: list[Mutation] = MUTATIONS, site: int | None = 0) -> DataFrame:
    """What ``verified`` says, of packed rows: each mutant is its package's row with the facts that it changes.

    ``counts``: SQL of how many findings a pattern has in a packed row, and the predicates that decide it. A pattern none
    of whose predicates a mutant changes has as many findings as in the package itself, and isn't worked out again.
    """
    facts = [c for c in rows.columns if c.startswith("p_")]
    rows = packed.fenced(rows, [KEY, *facts], {"_before": f"array({', '.join(n for n, _ in counts.values())})"})
    rows = manifest_packed(rows, mutations, site, (*facts, "_before"))
    told = ["mutant", KEY, "operator", "target", "site"]
    now = {}
    for m in mutations:
        for p in (*m.removes, *[p for p, _ in m.adds]):
            gone = f"exists(removed, _r -> _r.p = {packed.literal(p)} AND _r.s = _t.s AND _r.o = _t.o)"
            now[f"p_{p}"] = f"concat(filter({packed.column(p)}, _t -> NOT coalesce({gone}, false)), transform(filter(added, _a -> _a.p = {packed.literal(p)}), _a -> struct(_a.s AS s, _a.o AS o)))"
    rows = packed.fenced(rows, [*told, "_before", *[f for f in facts if f not in now]], now | {"_changed": "array_distinct(transform(concat(removed, added), _x -> _x.p))"})
    each = [f"struct({packed.literal(i)} AS pattern_id, IF(arrays_overlap(_changed, array({', '.join(map(packed.literal, sorted(asked)))})), {n} - _before[{k}], 0) AS delta)" for k, (i, (n, asked)) in enumerate(counts.items())]
    rows = packed.fenced(rows, told, {"_all": f"filter(array({', '.join(each)}), _d -> _d.delta <> 0)"})
    entry = lambda sign: f"array_sort(transform(filter(_all, _d -> {sign} * _d.delta > 0), _d -> struct(_d.pattern_id AS pattern_id, CAST({sign} * _d.delta AS BIGINT) AS by)))"
    delta = "CAST(coalesce(try_element_at(filter(_all, _d -> _d.pattern_id = target), 1).delta, 0) AS BIGINT)"
    return rows.selectExpr(*told, f"{delta} AS delta", f"{entry(-1)} AS suppressed", f"{entry(1)} AS gained", f"{delta} > 0 AS injected")


def overlay(triples: DataFrame, mutants: DataFrame) -> DataFrame:
    """(package_id, s, p, o) of all mutants, their own id in place of the package's. What is removed is tested row by row, without another join."""
    kept = triples.join(mutants.select("mutant", KEY, "removed"), KEY).where(~F.array_contains("removed", F.struct("s", "p", "o"))).select(F.col("mutant").alias(KEY), "s", "p", "o")
    return kept.unionByName(mutants.select(F.col("mutant").alias(KEY), F.explode("added").alias("t")).select(KEY, "t.*"))


def verified(triples: DataFrame, mutants: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(mutant, package_id, operator, target, site, delta, injected, suppressed, gained): each mutant against its own baseline.

    ``evaluate`` gives the findings (package_id, pattern_id, ...) of triples. ``suppressed`` and ``gained`` list every
    pattern with fewer or more findings than before, and by how many; a mutation can be detected and yet hide something.
    """
    base = laid(counted(evaluate(triples.join(mutants.select(KEY).distinct(), KEY, "left_semi")), [KEY], "before"), "counts")
    now = laid(counted(evaluate(overlay(triples, mutants)).withColumnRenamed(KEY, "mutant"), ["mutant"], "now"), "counts")
    return compared(mutants, base, mutants.select("mutant", KEY).join(now, "mutant"))


def counted(findings: DataFrame, key: list[str], name: str) -> DataFrame:
    return findings.groupBy(*key, "pattern_id").agg(F.count("*").alias(name))


def compared(mutants: DataFrame, base: DataFrame, now: DataFrame) -> DataFrame:
    """Mutants with what ``verified`` says of them, from the counts (package_id, pattern_id, before) and (package_id, mutant, pattern_id, now)."""
    before = mutants.select(KEY, "mutant").join(base, KEY)
    both = before.join(now, [KEY, "mutant", "pattern_id"], "full_outer").withColumn("delta", F.coalesce("now", F.lit(0)) - F.coalesce("before", F.lit(0))).where("delta <> 0")
    entry = lambda sign: F.sort_array(F.collect_list(F.when(sign * F.col("delta") > 0, F.struct("pattern_id", (sign * F.col("delta")).alias("by")))))
    changes = both.groupBy(KEY, "mutant").agg(entry(-1).alias("suppressed"), entry(1).alias("gained"))
    rows = mutants.drop("removed", "added", "place").join(changes, [KEY, "mutant"], "left")
    empty = F.array().cast("array<struct<pattern_id: string, by: bigint>>")
    rows = rows.withColumns({"suppressed": F.coalesce("suppressed", empty), "gained": F.coalesce("gained", empty)})
    find = lambda column: F.coalesce(F.try_element_at(F.filter(column, lambda x: x["pattern_id"] == F.col("target")), F.lit(1))["by"], F.lit(0))
    delta = (find("gained") - find("suppressed")).alias("delta")
    return rows.select("mutant", KEY, "operator", "target", "site", delta, "suppressed", "gained").withColumn("injected", F.col("delta") > 0)

"""All rules over the triples of packages, in three strata: single findings, pack compounds, core compounds.

Triples become one row per node with its facts (one aggregation). A frame walks from the unit of assurance along named
predicates, one join a hop, and all rules of a frame are conditions over its rows, evaluated in one pass. Rules that need
joins of another kind (identifiers, arguments, derived flags) stay in ``graph_rules``; reachability is ``graph.reach``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph_rules, packed
from .graph import KEY

#: Hops (from, predicate, to) from the unit of assurance, which is ``uoa``.
RESULT = (("uoa", "hasValidationResult", "v"),)
FACTOR = (("uoa", "hasCredibilityFactor", "f"),)
FRAMES = {
    "package": (),
    "claim": (("uoa", "bindsClaim", "c"),),
    "context": (("uoa", "hasContextOfUse", "c"),),
    "result": RESULT,
    "activity": (*RESULT, ("v", "wasGeneratedBy", "a")),
    "required activity": (*RESULT, ("v", "wasGeneratedBy", "a"), ("uoa", "bindsRequirement", "r")),
    "data": (*RESULT, ("v", "wasGeneratedBy", "a"), ("a", "used", "d")),
    "two results": (*RESULT, ("uoa", "hasValidationResult", "w")),
    "factor": FACTOR,
    "decided factor": (*FACTOR, ("uoa", "hasDecisionRecord", "d")),
    "evidence": (("uoa", "hasEvidence", "e"),),
}
#: What chains of provenance follow.
PROVENANCE = ("wasDerivedFrom", "wasGeneratedBy", "used")


def has(node: str, p: str) -> str:
    return f"exists({node}, t -> t.p = '{p}')"


def none(node: str, p: str) -> str:
    return f"NOT {has(node, p)}"


def value(node: str, p: str, condition: str) -> str:
    """Some object ``x`` of the predicate meets the condition."""
    return f"exists({node}, t -> t.p = '{p}' AND {condition.replace('{x}', 't.o')})"


def one_of(node: str, p: str, *objects: str) -> str:
    return value(node, p, "{x} IN (" + ", ".join(f"'{o}'" for o in objects) + ")")


def both(node: str, p: str, other: str, q: str, condition: str) -> str:
    """Some object ``x`` of one predicate and ``y`` of another meet the condition."""
    inner = condition.replace("{x}", "t.o").replace("{y}", "u.o")
    return f"exists({node}, t -> t.p = '{p}' AND exists({other}, u -> u.p = '{q}' AND {inner}))"


LESS = "try_cast({x} AS DOUBLE) < try_cast({y} AS DOUBLE)"
BEFORE = "try_cast({x} AS TIMESTAMP) < try_cast({y} AS TIMESTAMP)"
AFTER = "try_cast({x} AS TIMESTAMP) > try_cast({y} AS TIMESTAMP)"
NOT_FALSE = "{x} <> 'false'"
above = lambda n: f"try_cast({{x}} AS DOUBLE) > {n}"


@dataclass(frozen=True)
class FrameRule:
    """``condition`` is over the facts of the frame's nodes; ``node`` is the one that is reported."""

    id: str
    pack: str
    severity: str
    frame: str
    node: str
    condition: str
    level: int = 1


def _rules(pack: str, *rows: tuple[str, str, str, str, str]) -> list[FrameRule]:
    return [FrameRule(i, pack, severity, frame, node, condition) for i, severity, frame, node, condition in rows]


ASSESSED, NOT_ASSESSED = one_of("f", "factorStatus", "assessed"), one_of("f", "factorStatus", "not-assessed")
OUT = one_of("f", "factorStatus", "scoped-out", "not-applicable")
ACCEPTED = one_of("d", "outcome", "Accepted")
kind = lambda name: one_of("f", "factorType", name)
unevidenced = lambda name: f"{kind(name)} AND {ASSESSED} AND {none('f', 'hasEvidence')}"

RULES = [
    *_rules(
        "core",
        ("W-EP-01", "Critical", "claim", "c", f"{one_of('c', 'type', 'Claim')} AND {none('c', 'wasDerivedFrom')}"),
        ("W-EP-02", "High", "result", "v", none("v", "wasGeneratedBy")),
        ("W-EP-03", "High", "data", "v", both("d", "dataVintage", "uoa", "modelRevisionDate", BEFORE)),
        ("W-EP-04", "High", "factor", "f", f"{NOT_ASSESSED} AND {value('uoa', 'modelRiskLevel', above(2))}"),
        ("W-AL-01", "High", "result", "v", none("v", "hasUncertaintyQuantification")),
        ("W-AL-02", "Medium", "package", "uoa", f"{value('uoa', 'hasUncertaintyQuantification', NOT_FALSE)} AND {none('uoa', 'hasSensitivityAnalysis')}"),
        ("W-ON-01", "High", "package", "uoa", none("uoa", "hasContextOfUse")),
        ("W-ON-02", "High", "context", "c", f"{none('c', 'hasApplicabilityConstraint')} AND {none('c', 'hasOperatingEnvelope')}"),
        ("W-AR-01", "Critical", "factor", "f", f"{has('f', 'requiredLevel')} AND {none('f', 'acceptanceCriteria')} AND NOT {OUT}"),
        ("W-AR-02", "Critical", "decided factor", "f", f"{ACCEPTED} AND {none('d', 'hasOffsetRationale')} AND {both('f', 'achievedLevel', 'f', 'requiredLevel', LESS)}"),
        ("W-AR-03", "High", "required activity", "v", both("r", "requiredVerificationMethod", "a", "activityType", "{x} <> {y}")),
        ("W-AR-04", "High", "data", "v", both("d", "modelVersion", "uoa", "currentModelVersion", "{x} <> {y}")),
        ("W-AR-05", "High", "result", "v", none("v", "comparedAgainst")),
        ("W-SI-01", "High", "package", "uoa", none("uoa", "signature")),
        ("W-SI-02", "High", "package", "uoa", f"({none('uoa', 'bindsRequirement')} OR {none('uoa', 'hasValidationResult')})"),
        ("W-CON-01", "High", "decided factor", "f", f"{ACCEPTED} AND {none('f', 'requiredLevel')} AND {none('f', 'achievedLevel')} AND NOT {OUT} AND NOT {NOT_ASSESSED}"),
        ("W-CON-03", "High", "evidence", "e", both("e", "evidenceTimestamp", "uoa", "signatureTimestamp", AFTER)),
        ("W-CON-04", "Medium", "package", "uoa", f"{one_of('uoa', 'conformsToProfile', 'ProfileComplete')} AND {none('uoa', 'hasSensitivityAnalysis')}"),
    ),
    *_rules(
        "nasa",
        ("W-NASA-01", "High", "factor", "f", f"{kind('Data pedigree')} AND {NOT_ASSESSED} AND {value('uoa', 'modelRiskLevel', above(1))}"),
        ("W-NASA-02", "High", "factor", "f", unevidenced("Development technical review")),
        ("W-NASA-03", "High", "factor", "f", unevidenced("Development process and product management")),
        ("W-NASA-04", "Medium", "factor", "f", f"{kind('Use history')} AND {NOT_ASSESSED} AND {value('uoa', 'modelRiskLevel', above(2))}"),
        ("W-NASA-05", "High", "factor", "f", f"{kind('Results uncertainty')} AND {ASSESSED} AND {none('uoa', 'hasUncertaintyQuantification')}"),
        ("W-NASA-06", "High", "factor", "f", unevidenced("Results robustness")),
    ),
    *_rules(
        "cards",
        ("W-EV-GEN-02", "High", "result", "v", none("v", "samplingAccount")),
        ("W-EV-DET-03", "High", "result", "v", none("v", "harnessDeterminismStatement")),
        ("W-EV-NULL-04", "High", "result", "v", none("v", "nullBaselineStatement")),
        ("W-EV-COU-05", "Critical", "result", "v", f"{none('v', 'claimedCOU')} AND {has('uoa', 'decisionContextOfUse')}"),
        ("W-EV-COU-05", "High", "result", "v", f"{none('v', 'claimedCOU')} AND {none('uoa', 'decisionContextOfUse')}"),
        ("W-EV-CAP-06", "Medium", "result", "v", none("v", "confoundControlStatement")),
        ("W-EV-DIV-07", "High", "result", "v", has("v", "divergesFromFurnished")),
        ("W-EV-SUB-08", "High", "result", "v", none("v", "subjectVersionGuarantee")),
        ("W-EV-COR-09", "High", "two results", "v", f"{one_of('v', 'evidenceSource', 'reported')} AND {none('v', 'corroboratedBy')} AND {one_of('w', 'evidenceSource', 'furnished')}"),
    ),
    FrameRule("COMPOUND-EV-01", "cards", "Critical", "result", "v", f"{none('v', 'hasUncertaintyQuantification')} AND {none('v', 'nullBaselineStatement')} AND {value('uoa', 'decisionRiskLevel', above(2))}", 2),
    FrameRule("COMPOUND-EV-02", "cards", "Critical", "result", "v", f"{has('v', 'generalizedClaim')} AND {none('v', 'samplingAccount')}", 2),
]
PACKS = ("core", "nasa", "cards", "surrogate", "argument", "management")


def nodes(triples: DataFrame) -> DataFrame:
    """(package_id, id, facts): one row per described node; facts is a set of (p, o). A node's facts are bounded by its document."""
    return triples.groupBy(KEY, F.col("s").alias("id")).agg(F.collect_set(F.struct("p", "o")).alias("facts"))


def objects(node: str, p: str) -> Column:
    return F.transform(F.filter(node, lambda t: t["p"] == p), lambda t: t["o"])


#: What a mutant says, beside its package: its name, the node that it changes, and the triples that go and come there.
EDIT = ("mutant", "site", "removed", "added")


def edited(name: str) -> Column:
    """A node's facts as the mutant in hand has them."""
    plain = lambda c: F.transform(c, lambda t: F.struct(t["p"].alias("p"), t["o"].alias("o")))
    return F.when(F.col(f"{name}_id") == F.col("site"), F.array_union(F.array_except(F.col(name), plain(F.col("removed"))), plain(F.col("added")))).otherwise(F.col(name))


def frame(described: DataFrame, hops: tuple, wanted: dict[str, set[str]], edits: DataFrame | None = None) -> DataFrame:
    """(package_id, and for each node its id and facts): units of assurance joined with what their hops lead to.

    Undescribed nodes have no facts. ``wanted``: the predicates that are looked at, by node; others don't travel.
    ``edits`` (package_id and ``EDIT``): the walk starts once for each mutant, and whatever node it comes to is taken as
    the mutant has it, so nothing of a package is copied but the rows of its frames.
    """
    empty = F.array().cast(described.schema["facts"].dataType)
    own = () if edits is None else EDIT

    def only(name: str, column: Column) -> Column:
        asked = sorted(wanted.get(name, set()) | {p for source, p, _ in hops if source == name} | {"type" for _ in own if name == "uoa"})
        return F.filter(column, lambda t: t["p"].isin(asked)) if asked else empty

    unit = "exists({}, t -> t.p = 'type' AND t.o = 'UnitOfAssurance')"
    starts = described.select(KEY, F.col("id").alias("uoa_id"), "facts")
    if edits is None:
        rows = starts.where(unit.format("facts")).select(KEY, "uoa_id", only("uoa", F.col("facts")).alias("uoa"))
    else:
        rows = starts.select(KEY, "uoa_id", only("uoa", F.col("facts")).alias("uoa")).join(edits.select(KEY, *EDIT), KEY)
        rows = rows.where(f"uoa_id = site OR {unit.format('uoa')}").withColumn("uoa", edited("uoa")).where(unit.format("uoa"))
    for source, p, name in hops:
        rows = rows.withColumn(f"{name}_id", F.explode(objects(source, p)))
        if name in wanted or any(s == name for s, _, _ in hops):
            other = described.select(KEY, F.col("id").alias(f"{name}_id"), only(name, F.col("facts")).alias(name))
            rows = rows.join(other, [KEY, f"{name}_id"], "left").withColumn(name, F.coalesce(name, empty))
            rows = rows.withColumn(name, edited(name)) if own else rows
    return rows


def looked_at(conditions: list[str]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for c in conditions:
        for node, p in re.findall(r"exists\((\w+), \w -> \w\.p = '([^']+)'", c):
            out.setdefault(node, set()).add(p)
    return out


def looked_for(rules: list[FrameRule] = RULES) -> set[str]:
    """The predicates that these rules look at or walk along."""
    return set().union(*looked_at([r.condition for r in rules]).values(), {p for r in rules for _, p, _ in FRAMES[r.frame]}, {"type"})


def relevant(triples: DataFrame, rules: list[FrameRule]) -> DataFrame:
    """The triples that these rules look at or walk along; the others make no difference to them."""
    return triples.where(F.col("p").isin(*sorted(looked_for(rules))))


def framed(described: DataFrame, rules: list[FrameRule], edits: DataFrame | None = None) -> DataFrame:
    """Findings of frame rules, each once; with ``edits`` those of each mutant, by package and mutant."""
    out, key = [], [KEY] if edits is None else [KEY, "mutant"]
    for name in dict.fromkeys(r.frame for r in rules):
        own = [r for r in rules if r.frame == name]
        rows = frame(described, FRAMES[name], looked_at([r.condition for r in own]), edits)
        found = F.array(*[F.when(F.expr(r.condition), F.struct(F.lit(r.id).alias("pattern_id"), F.lit(r.severity).alias("severity"), F.col(f"{r.node}_id").alias("node"))) for r in own])
        out.append(rows.select(*key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select(*key, "f.*"))
    return reduce(DataFrame.unionByName, out).distinct()


def walks(rules: list[FrameRule]) -> dict[tuple[str, str], list[str]]:
    """Arrays of the nodes that frame rules report, by pattern and severity: the hops of a frame are patterns, and its conditions look at the facts of what they bind."""
    out: dict[tuple[str, str], list[str]] = {}
    for r in rules:
        hops = (graph_rules.UOA, *[(f"?{source}", p, f"?{name}") for source, p, name in FRAMES[r.frame]])
        out.setdefault((r.id, r.severity), []).append(packed.matches(hops, (), [packed.framed(r.condition)], (r.node,), lambda env, r=r: env[r.node]))
    return out


def counts(rules: list[FrameRule]) -> dict[str, tuple[str, set[str]]]:
    """SQL of how many findings each pattern has in a packed row, and the predicates that decide it."""
    out: dict[str, list[str]] = {}
    for (i, _), nodes in walks(rules).items():
        out.setdefault(i, []).append(f"size(array_distinct({nodes[0] if len(nodes) == 1 else 'concat(' + ', '.join(nodes) + ')'}))")
    return {i: (" + ".join(n), looked_for([r for r in rules if r.id == i])) for i, n in out.items()}


def chosen(packs: tuple[str, ...]) -> tuple[list[FrameRule], list[graph_rules.GraphRule]]:
    """The frame rules of packs, and those of their other rules that no frame rule states already."""
    own = {(r.pack, r.id) for r in RULES}
    return [r for r in RULES if r.pack in packs], [r for r in graph_rules.RULES if r.pack in packs and (r.pack, r.id) not in own]


def asked(packs: tuple[str, ...] = PACKS, derivations: list[graph_rules.Derivation] = graph_rules.DERIVATIONS) -> set[str]:
    """The predicates that triples must give for ``check``."""
    frames, joined = chosen(packs)
    _, given = graph_rules.running(derivations, graph_rules.names(joined))
    return looked_for(frames) | given | {"assuranceLevel"} | ({*PROVENANCE, "bindsClaim", "isFoundationalEvidence"} if "core" in packs else set())


def check(triples: DataFrame, packs: tuple[str, ...] = PACKS, derivations: list[graph_rules.Derivation] = graph_rules.DERIVATIONS) -> DataFrame:
    """All findings (package_id, pattern_id, severity, node, level) of packages as triples."""
    return check_packed(packed.packed(triples, asked(packs, derivations)), packs, derivations)


def check_packed(rows: DataFrame, packs: tuple[str, ...] = PACKS, derivations: list[graph_rules.Derivation] = graph_rules.DERIVATIONS) -> DataFrame:
    """The same of packed rows: a package's findings are one array, over which its compounds are worked out, so nothing is shuffled or written."""
    frames, joined = chosen(packs)
    rows = graph_rules.with_flags(rows, derivations, graph_rules.names(joined) | asked(packs, derivations))
    first = graph_rules.reported(joined)
    for key, nodes in walks([r for r in frames if r.level == 1]).items():
        first.setdefault(key, []).extend(nodes)
    if "core" in packs:
        first.setdefault(("W-PROV-01", "Critical"), []).append(unsupported_ends())
    own = {(*k, 1): x for k, x in first.items()} | {(*k, 2): x for k, x in walks([r for r in frames if r.level == 2]).items()}
    # a package's nodes by rule are columns, over which its compounds are worked out
    rows = packed.fenced(rows, [KEY, "p_assuranceLevel"], {f"_{i}": f"array_distinct({x[0] if len(x) == 1 else 'concat(' + ', '.join(x) + ')'})" for i, x in enumerate(own.values())})
    return graph_rules.told(rows, {k: [f"_{i}"] for i, k in enumerate(own)} | core_compounds({k: f"_{i}" for i, k in enumerate(own)}), ("pattern_id", "severity", "level"))


def core_compounds(own: dict[tuple, str]) -> dict[tuple, list[str]]:
    """The last stratum, from arrays of the nodes found by (pattern, severity, level): one for each pair of a Critical and a High pattern of a package, and one where risk isn't low."""
    ids = lambda severity: f"array_distinct(array_compact(array({', '.join(f'IF(size({x}) > 0, {packed.literal(i)}, NULL)' for (i, s, _), x in own.items() if s == severity)})))"
    pairs = f"transform(array({ids('High')}), _high -> flatten(transform({ids('Critical')}, _c -> transform(_high, _h -> concat(_c, '+', _h)))))[0]"
    risky = f"transform(filter({packed.column('assuranceLevel')}, _t -> _t.o <> 'Low' AND size({ids('Critical')}) > 0), _t -> _t.s)"
    return {("COMPOUND-01", "Critical", 3): [pairs], ("COMPOUND-03", "High", 3): [risky]}


def unsupported_ends() -> str:
    """W-PROV-01: SQL of what a claim rests on in the end, though nothing says that it is foundational."""
    claims = packed.matches((graph_rules.UOA, ("?uoa", "bindsClaim", "?c")), (), [], ("c",), lambda env: env["c"])
    return packed.ends(claims, list(PROVENANCE), f"exists({packed.column('isFoundationalEvidence')}, _t -> _t.s = _n AND _t.o = 'true')")

"""Rules over the triples of packages: patterns that must match, patterns that must not, and a comparison of what is bound.

Derivations run first, in their order, and add flags to the triples of their package; each sees the flags of those
before it, and rules see all. A rule only tests the absence of what the packages or the derivations say, never of what
another rule found, so one pass is enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .graph import KEY

Pattern = tuple[str, str, str]


@dataclass(frozen=True)
class GraphRule:
    """``node`` is the variable that is reported; each entry of ``without`` is a pattern that nothing may match."""

    id: str
    pack: str
    severity: str
    node: str
    patterns: tuple[Pattern, ...]
    without: tuple[Pattern, ...] = ()
    condition: str | None = None


@dataclass(frozen=True)
class Derivation:
    """A flag that is set on ``node`` wherever the patterns match: 'true', or what the variable ``value`` is bound to."""

    flag: str
    node: str
    patterns: tuple[Pattern, ...]
    without: tuple[Pattern, ...] = ()
    condition: str | None = None
    value: str | None = None


UOA = ("?uoa", "type", "UnitOfAssurance")
ARGUED = (UOA, ("?uoa", "conformsToProfile", "ProfileArgument"), ("?uoa", "hasInferenceStep", "?i"), ("?i", "supportsClaim", "?c"))

#: Days after which an audit of a cadence is overdue; any other cadence has the last.
CADENCES = {"annual": 365, "quarterly": 90, "monthly": 30}
OTHER_CADENCE = 9999


def dated(as_of: str) -> list[Derivation]:
    """Derivations of management systems; ``as_of`` is the day that audits are judged on, as an SQL expression."""
    days = " ".join(f"WHEN '{k}' THEN {v}" for k, v in CADENCES.items())
    part = lambda c, i: f"try_cast(regexp_extract({c}, r'^v?([0-9]+)\\.([0-9]+)\\.([0-9]+)$', {i}) AS INT)"
    older = f"struct({', '.join(part('evaluated', i) for i in (1, 2, 3))}) < struct({', '.join(part('latest', i) for i in (1, 2, 3))})"
    both = f"{part('evaluated', 1)} IS NOT NULL AND {part('latest', 1)} IS NOT NULL"
    evidence = (UOA, ("?uoa", "hasEvidence", "?e"))
    return [
        Derivation("_auditOverdue", "e", (("?e", "type", "AuditResultsRecord"), ("?e", "auditDate", "?day"), ("?e", "auditCadence", "?cadence")), condition=f"date_diff({as_of}, CAST(try_cast(day AS TIMESTAMP) AS DATE)) > CASE cadence {days} ELSE {OTHER_CADENCE} END"),
        Derivation("_modelEvalStaleByVersion", "e", (*evidence, ("?e", "type", "ModelEvaluationReport"), ("?e", "evaluatedModelVersion", "?evaluated"), ("?uoa", "currentModelVersion", "?latest")), condition=f"{both} AND {older}"),
        Derivation("_evalCoverageGap", "uoa", (*evidence, ("?e", "type", "ModelEvaluationReport"), ("?uoa", "deploymentPopulationCategory", "?category")), (("?e", "testSetCoverageCategory", "?category"),)),
        Derivation("_controlledFramework", "uoa", (*evidence, ("?e", "type", "AIMSControl"), ("?e", "mappedToFramework", "?framework")), value="framework"),
        Derivation("_crosswalkUnsupported", "uoa", (*evidence, ("?e", "type", "StatementOfApplicability"), ("?e", "mappedToFramework", "?framework")), (("?uoa", "_controlledFramework", "?framework"),), value="framework"),
        Derivation("_pointOutsideEnvelope", "uoa", (UOA, ("?uoa", "hasEvaluationPoint", "?point"), ("?point", "dimension", "?name"), ("?point", "coordinate", "?x"), ("?uoa", "hasEnvelope", "?envelope"), ("?envelope", "dimension", "?name"), ("?envelope", "min", "?least"), ("?envelope", "max", "?most")), condition="CAST(x AS DOUBLE) < CAST(least AS DOUBLE) OR CAST(x AS DOUBLE) > CAST(most AS DOUBLE)"),
    ]


DERIVATIONS = [
    Derivation("_noMonitoringEvidence", "uoa", (UOA, ("?uoa", "hasDataResourceProvenance", "?d")), (("?uoa", "hasOngoingDataQualityMonitoring", "?m"),)),
    Derivation("_justificationNonEmpty", "r", (("?r", "justification", "?j"),), condition="j <> ''"),
    Derivation("_targetMeasureNonEmpty", "t", (("?t", "targetMeasure", "?m"),), condition="m <> ''"),
    Derivation("_lineageGap", "stage", (("?stage", "stageName", "?name"),), (("?stage", "hasNextStage", "?next"),), "name <> 'consumption'"),
    Derivation(
        "_evalOutsideEnvelope", "uoa",
        (UOA, ("?uoa", "hasEvaluationRegion", "?region"), ("?region", "dimension", "?name"), ("?region", "min", "?lo"), ("?region", "max", "?hi"), ("?uoa", "hasEnvelope", "?envelope"), ("?envelope", "dimension", "?name"), ("?envelope", "min", "?least"), ("?envelope", "max", "?most")),
        condition="CAST(lo AS DOUBLE) < CAST(least AS DOUBLE) OR CAST(hi AS DOUBLE) > CAST(most AS DOUBLE)",
    ),
    *dated("current_date()"),
]

RULES = [
    GraphRule("W-EP-03", "core", "High", "v", (UOA, ("?uoa", "modelRevisionDate", "?r"), ("?uoa", "hasValidationResult", "?v"), ("?v", "wasGeneratedBy", "?a"), ("?a", "used", "?d"), ("?d", "dataVintage", "?t")), condition="t < r"),
    GraphRule("W-SI-02", "core", "High", "uoa", (UOA,), (("?uoa", "bindsRequirement", "?r"),)),
    GraphRule("W-SI-02", "core", "High", "uoa", (UOA,), (("?uoa", "hasValidationResult", "?v"),)),
    GraphRule("W-CON-02", "core", "Medium", "o", (("?x", "referencesIdentifier", "?o"),), (("?o", "type", "?t"), ("?o", "url", "?u"))),
    GraphRule("W-CON-05", "core", "High", "a", (UOA, ("?uoa", "hasVerificationActivity", "?a")), (("?v", "wasGeneratedBy", "?a"),)),
    GraphRule("W-SURR-01", "surrogate", "High", "pc", (UOA, ("?uoa", "declaredPhysicsConstraint", "?pc"), ("?pc", "type", "PhysicsConstraint")), (("?pc", "hasConstraintCheckEvidence", "?e"),)),
    GraphRule("W-SURR-02", "surrogate", "Critical", "snap", (UOA, ("?uoa", "parentModelSnapshot", "?snap"), ("?snap", "parentDecision", "Not Accepted"))),
    GraphRule("W-SURR-02", "surrogate", "High", "snap", (UOA, ("?uoa", "parentModelSnapshot", "?snap"), ("?snap", "type", "ParentModelSnapshot")), (("?snap", "parentDecision", "?d"),)),
    GraphRule("W-SURR-03", "surrogate", "High", "uoa", (UOA, ("?uoa", "_evalOutsideEnvelope", "true"))),
    GraphRule("W-SURR-03", "surrogate", "High", "uoa", (UOA, ("?uoa", "_pointOutsideEnvelope", "true"))),
    GraphRule("W-ARG-01", "argument", "Critical", "i", (*ARGUED, ("?c", "aboutQuantity", "?n"), ("?n", "quantityId", "?q")), (("?i", "groundQuantity", "?q"),)),
    GraphRule("W-ARG-02", "argument", "High", "i", (*ARGUED, ("?c", "overScope", "?s"), ("?s", "populationId", "?p")), (("?i", "groundPopulation", "?p"),)),
    GraphRule("W-ARG-03", "argument", "Critical", "i", (*ARGUED, ("?c", "claimModality", "sufficient"), ("?i", "hasGround", "?g"), ("?g", "claimModality", "necessary"), ("?i", "warrantKind", "direct-measurement"))),
    GraphRule("W-ARG-04", "argument", "High", "i", (*ARGUED, ("?c", "claimKind", "model-behaviour"), ("?i", "hasGround", "?g"), ("?g", "claimKind", "assessment-rigour"))),
    GraphRule("W-AIMS-DATA-DRIFT-UNDETECTED", "management", "High", "uoa", (UOA, ("?uoa", "_noMonitoringEvidence", "true"))),
    GraphRule("W-AR-02", "management", "High", "k", (UOA, ("?uoa", "hasRisk", "?k"), ("?k", "decision", "accept"), ("?k", "hasRationale", "?r")), (("?r", "_justificationNonEmpty", "true"),)),
    GraphRule("W-AIMS-OBJECTIVE-UNMEASURED", "management", "High", "t", (UOA, ("?uoa", "hasObjective", "?t")), (("?t", "_targetMeasureNonEmpty", "true"),)),
    GraphRule("W-AIMS-DATA-LINEAGE-BROKEN", "management", "High", "stage", (UOA, ("?uoa", "hasLineageStage", "?stage"), ("?stage", "_lineageGap", "true"))),
    GraphRule("W-AIMS-AUDIT-STALE", "management", "High", "e", (UOA, ("?uoa", "hasEvidence", "?e"), ("?e", "_auditOverdue", "true"))),
    GraphRule("W-AIMS-MODEL-EVAL-STALE", "management", "High", "e", (UOA, ("?uoa", "hasEvidence", "?e"), ("?e", "_modelEvalStaleByVersion", "true"))),
    GraphRule("W-AIMS-MODEL-EVAL-SCOPE", "management", "High", "uoa", (UOA, ("?uoa", "_evalCoverageGap", "true"))),
    GraphRule("W-AIMS-CROSSWALK-INVALID", "management", "High", "framework", (UOA, ("?uoa", "_crosswalkUnsupported", "?framework"))),
]


def names(rules: Iterable[GraphRule | Derivation]) -> set[str]:
    """The predicates that rules ask for."""
    return {p for r in rules for _, p, _ in (*r.patterns, *r.without)}


def bindings(rule: GraphRule | Derivation, out: tuple[str, ...], make: Callable[[dict[str, str]], str]) -> str:
    """SQL of an array, over a packed row, of what the patterns of a rule bind, less what one of the absent patterns agrees with."""
    tests = [packed.named(rule.condition, packed.variables(*rule.patterns))] if rule.condition else []
    return packed.matches(rule.patterns, rule.without, tests, out, make)


def derived(d: Derivation) -> str:
    if d.value:
        return f"array_distinct({bindings(d, (d.node, d.value), lambda env: f'struct({env[d.node]} AS s, {env[d.value]} AS o)')})"
    return f"transform(array_distinct({bindings(d, (d.node,), lambda env: env[d.node])}), _n -> struct(_n AS s, 'true' AS o))"


def running(derivations: list[Derivation], asked: set[str]) -> tuple[list[Derivation], set[str]]:
    """The derivations that run if these predicates are asked for, and the predicates that triples must give."""
    needed, own = set(asked), []
    for d in reversed(derivations):
        if d.flag in needed:
            own.insert(0, d)
            needed |= names([d])
    return own, needed - {d.flag for d in own}


def with_flags(rows: DataFrame, derivations: list[Derivation], asked: set[str]) -> DataFrame:
    """Packed rows with the flags asked for among their facts. Derivations run in order; those that nothing asks for don't run."""
    own, given = running(derivations, asked)
    known = sorted(given)
    for flags in layers(own, given):
        made = {}
        for f, new in flags.items():
            every = [packed.column(f)] * (f in known) + new
            made[f"p_{f}"] = every[0] if len(every) == 1 else f"array_distinct(concat({', '.join(every)}))"
        rows = packed.fenced(rows, [KEY, *[f"p_{p}" for p in known if p not in flags]], made)
        known = sorted({*known, *flags})
    return rows


def layers(own: list[Derivation], given: set[str]) -> Iterator[dict[str, list[str]]]:
    """SQL of derivations by flag, those together that read none of each other's flags, in their order."""
    known, flags = set(given), {}
    for i, d in enumerate(own):
        if late := names([d]) & {x.flag for x in own[i:]} - known - flags.keys():
            raise ValueError(f"{d.flag} reads {sorted(late)}, which later derivations set")
        if names([d]) & flags.keys():
            yield flags
            known, flags = known | flags.keys(), {}
        flags.setdefault(d.flag, []).append(derived(d))
    if flags:
        yield flags


def derive(triples: DataFrame, derivations: list[Derivation] = DERIVATIONS) -> DataFrame:
    """The derived triples alone: (package_id, s, flag, value)."""
    return derive_packed(packed.packed(triples, running(derivations, {d.flag for d in derivations})[1]), derivations)


def derive_packed(rows: DataFrame, derivations: list[Derivation] = DERIVATIONS) -> DataFrame:
    """The same of packed rows."""
    flags = dict.fromkeys(d.flag for d in derivations)
    rows = with_flags(rows, derivations, set(flags))
    each = [f"transform({packed.column(f)}, _n -> struct(_n.s AS s, {packed.literal(f)} AS p, _n.o AS o))" for f in flags]
    return rows.select(KEY, F.explode(F.expr(f"concat({', '.join(each)})")).alias("t")).select(KEY, "t.*")


def told(rows: DataFrame, nodes: Mapping[tuple, list[str]], fields: tuple[str, ...] = ("pattern_id", "severity")) -> DataFrame:
    """Findings, each once, from arrays of the nodes that are found, by what ``fields`` say of them. No finding is a row before the end."""
    each = [x[0] if len(x) == 1 else f"concat({', '.join(x)})" for x in nodes.values()]
    found = rows.select(KEY, F.posexplode(F.expr(f"array({', '.join(f'array_distinct({x})' for x in each)})")).alias("_rule", "_nodes"))
    kinds = F.array(*[F.struct(*[F.lit(x).alias(f) for f, x in zip(fields, k, strict=True)]) for k in nodes])
    return found.select(KEY, "_rule", F.explode("_nodes").alias("node")).withColumn("_kind", kinds[F.col("_rule")]).select(KEY, *[f"_kind.{f}" for f in fields[:2]], "node", *[f"_kind.{f}" for f in fields[2:]])


def reported(rules: Iterable[GraphRule]) -> dict[tuple[str, str], list[str]]:
    """Arrays of the nodes that rules report, by pattern and severity."""
    out: dict[tuple[str, str], list[str]] = {}
    for r in rules:
        out.setdefault((r.id, r.severity), []).append(bindings(r, (r.node,), lambda env, r=r: env[r.node]))
    return out


def evaluate(triples: DataFrame, rules: list[GraphRule], derivations: list[Derivation] = DERIVATIONS) -> DataFrame:
    """Findings (package_id, pattern_id, severity, node) of packages as triples, each once.

    Empty tables give no findings; a null subject or object binds nothing that is joined.
    """
    return evaluate_packed(packed.packed(triples, running(derivations, names(rules))[1]), rules, derivations)


def evaluate_packed(rows: DataFrame, rules: list[GraphRule], derivations: list[Derivation] = DERIVATIONS) -> DataFrame:
    """The same of packed rows."""
    return told(with_flags(rows, derivations, names(rules)), reported(rules))

"""Shapes over triples: constraints as data, checked in one pass for each target class.

A node is one row with its facts. A shape targets a class and, if it belongs to a profile, only nodes that declare it or
a profile that extends it; so what fails is reported field by field for the profile that a node itself declares. Counts
give one violation a property, constraints on values one for each value that fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import KEY

XSD = "http://www.w3.org/2001/XMLSchema#"
MISSING = "MISSING"


@dataclass(frozen=True)
class Property:
    """What the objects of one predicate must be; what is None isn't asked."""

    path: str
    least: int = 0
    most: int | None = None
    kind: str | None = None
    datatype: str | None = None
    one_of: tuple[str, ...] = ()
    pattern: str | None = None
    low: float | None = None
    high: float | None = None
    severity: str = "Violation"


@dataclass(frozen=True)
class Shape:
    target: str
    properties: tuple[Property, ...]
    profile: str | None = None
    pack: str = "core"


def iri(path: str, least: int = 1) -> Property:
    return Property(path, least, kind="iri")


def text(path: str, **more) -> Property:
    return Property(path, datatype="string", **more)


def number(path: str) -> Property:
    return Property(path, 1, 1, datatype="double")


def share(path: str) -> Property:
    return Property(path, most=1, low=0, high=1)


#: What each profile adds to those it extends, and the values that fields may have.
EXTENDS = {"ProfileMinimal": (), "ProfileComplete": ("ProfileMinimal",), "ProfileDisposition": ("ProfileMinimal",)}
UNIT = "UnitOfAssurance"
SHAPES = [
    Shape(UNIT, (iri("bindsRequirement"), iri("hasValidationResult"), iri("hasDecisionRecord"), Property("generatedAtTime", 1, 1, datatype="dateTime"), text("hash", least=1, most=1, pattern="^sha256:[0-9a-f]{64}$"), text("signature", least=1, most=1, pattern="^ed25519:[0-9a-f]+$")), "ProfileMinimal"),
    Shape(
        UNIT,
        (
            iri("bindsModel"), iri("bindsDataset"), iri("wasDerivedFrom"), iri("wasAttributedTo"), iri("criteriaSet"), Property("hasCredibilityFactor", 1), share("credibilityIndex"), share("traceCompleteness"), share("verificationCoverage"), share("validationCoverage"),
            Property("uncertaintyCIWidth", most=1, low=0), Property("assuranceLevel", most=1, one_of=("Low", "Medium", "High")),
        ),
        "ProfileComplete",
    ),
    Shape(UNIT, (iri("hasDisposition"),), "ProfileDisposition"),
    Shape(UNIT, (Property("deviceClass", most=1, one_of=("Class I", "Class II", "Class III", "N/A")),), "ProfileComplete", "vv40"),
    Shape(UNIT, (iri("hasContextOfUse"),), None, "vv40"),
    Shape("CredibilityFactor", (Property("factorType", 1, 1), Property("factorStatus", most=1, one_of=("assessed", "not-assessed", "scoped-out", "not-applicable")), Property("requiredLevel", most=1, datatype="integer", low=0, high=5), Property("achievedLevel", most=1, datatype="integer", low=0, high=5))),
    Shape("WeakenerAnnotation", (Property("patternId", 1, 1, pattern=r"^(W-[A-Z]+(-[A-Z]+)*-[0-9]{2}|COMPOUND(-[A-Z]+)?-[0-9]{2})$"), Property("severity", 1, 1, one_of=("Critical", "High", "Medium", "Low")), iri("affectedNode"))),
    Shape("Disposition", (text("actionClass", least=1, most=1, one_of=("restrict-cou", "acquire-validation", "characterize-region", "accept-residual-risk", "change-cou")), text("actionParameters", most=1), Property("confidenceLevel", most=1)), None, "disposition"),
    Shape("Discrepancy", (number("surrogatePrediction"), number("solverTruth"), number("discrepancyMagnitude"), text("discrepancyRegion", most=1), text("measureType", most=1, one_of=("point", "aggregate"))), None, "disposition"),
]


def nodes(triples: DataFrame) -> DataFrame:
    """(package_id, focus_node, facts): facts is a set of (p, o, o_kind, o_datatype)."""
    return triples.groupBy(KEY, F.col("s").alias("focus_node")).agg(F.collect_set(F.struct("p", "o", "o_kind", "o_datatype")).alias("facts"))


def quoted(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: What a violation says.
FIELDS = ("path", "constraint_kind", "requirement", "actual", "fix", "severity", "profile")


def violation(path: str, kind: str, requirement: str, actual: str, fix: str, severity: str, profile: str, asked: tuple[str, ...] = FIELDS) -> str:
    """SQL of one violation; ``actual`` and ``profile`` are expressions. What isn't asked for isn't worked out."""
    fields = {"path": quoted(path), "constraint_kind": quoted(kind), "requirement": quoted(requirement), "actual": f"CAST({actual} AS STRING)", "fix": quoted(fix), "severity": quoted(severity), "profile": profile}
    return "named_struct(" + ", ".join(f"'{n}', {fields[n]}" for n in asked) + ")"


def failing(p: Property, profile: str, asked: tuple[str, ...] = FIELDS) -> str:
    """SQL of an array of the violations of one property by the node in hand; its objects are worked out once, as ``own``."""
    make = lambda kind, requirement, actual, fix: violation(p.path, kind, requirement, actual, fix, p.severity, profile, asked)
    out = []

    def count(bad: str, kind: str, requirement: str, actual: str, fix: str) -> None:
        out.append(f"filter(array({make(kind, requirement, actual, fix)}), v -> {bad})")

    def values(bad: str, kind: str, requirement: str, fix: str, actual: str = "t.o") -> None:
        out.append(f"transform(filter(own, t -> {bad}), t -> {make(kind, requirement, actual, fix)})")

    if p.least:
        count(f"size(own) < {p.least}", "minCount", f"minCount {p.least}", f"IF(size(own) = 0, '{MISSING}', CAST(size(own) AS STRING))", f"add {p.path}")
    if p.most is not None:
        count(f"size(own) > {p.most}", "maxCount", f"maxCount {p.most}", "size(own)", f"keep {p.most} of {p.path}")
    if p.kind:
        values(f"t.o_kind <> '{p.kind}'", "nodeKind", f"nodeKind {p.kind}", f"give {p.path} as {p.kind}")
    if p.datatype:
        values(f"NOT (t.o_datatype <=> '{XSD}{p.datatype}')", "datatype", f"datatype {p.datatype}", f"give {p.path} as {p.datatype}", "coalesce(regexp_extract(t.o_datatype, '([^#]*)$', 1), t.o_kind)")
    if p.one_of:
        values(f"t.o NOT IN ({', '.join(map(quoted, p.one_of))})", "in", "one of " + ", ".join(p.one_of), f"choose a listed value for {p.path}")
    if p.pattern:
        values(f"NOT rlike(t.o, {quoted(p.pattern)})", "pattern", f"pattern {p.pattern}", f"write {p.path} in that form")
    for bound, kind, test in ((p.low, "minInclusive", ">="), (p.high, "maxInclusive", "<=")):
        if bound is not None:  # what isn't a number can't be compared, and fails
            values(f"NOT coalesce(try_cast(t.o AS DOUBLE) {test} {bound}, false)", kind, f"{kind} {bound:g}", f"bring {p.path} into its range")
    return f"transform(array(filter(facts, t -> t.p = {quoted(p.path)})), own -> concat({', '.join(out)}))[0]"


def checked(s: Shape, asked: tuple[str, ...] = FIELDS) -> str:
    """SQL of all violations of a shape, by the profile that the node declares; without one a shape of a profile asks for nothing."""
    found = lambda profile: "concat(" + ", ".join(failing(p, profile, asked) for p in s.properties) + ")"
    if not s.profile:
        return found("CAST(NULL AS STRING)")
    allowed = ", ".join(quoted(q) for q in EXTENDS if s.profile in (q, *EXTENDS[q]))
    return f"flatten(transform(slice(filter(declared, q -> q IN ({allowed})), 1, 1), profile -> {found('profile')}))"


def violations(triples: DataFrame, shapes: list[Shape] = SHAPES, packs: tuple[str, ...] = ("core", "vv40", "disposition")) -> DataFrame:
    """(package_id, focus_node, path, constraint_kind, requirement, actual, fix, severity, profile) of all targets.

    A unit that declares none of the profiles has the one violation that none of them is met.
    """
    return violations_of(nodes(triples), shapes, packs)


def violations_of(described: DataFrame, shapes: list[Shape] = SHAPES, packs: tuple[str, ...] = ("core", "vv40", "disposition"), fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The same of ``nodes``, in one pass over them: a node's violations are those of each target that it is of; ``fields``: what is asked of a violation."""
    every = []
    active = [s for s in shapes if s.pack in packs]
    for target in dict.fromkeys(s.target for s in active):
        own = [s for s in active if s.target == target]
        checks = [checked(s, fields) for s in own]
        if any(s.profile for s in own):
            none = violation("conformsToProfile", "or", "one of " + ", ".join(EXTENDS), f"IF(size(declared) = 0, '{MISSING}', array_join(array_sort(declared), ', '))", "declare a profile", "Violation", "CAST(NULL AS STRING)", fields)
            checks.append(f"filter(array({none}), v -> NOT exists(declared, q -> q IN ({', '.join(map(quoted, EXTENDS))})))")
        every.append(f"IF(exists(facts, t -> t.p = 'type' AND t.o = '{target}'), concat({', '.join(checks)}), array())")
    rows = described.withColumn("declared", F.expr("transform(filter(facts, t -> t.p = 'conformsToProfile'), t -> t.o)"))
    return rows.select(KEY, "focus_node", F.explode(F.expr(f"concat({', '.join(every)})")).alias("v")).select(KEY, "focus_node", "v.*")


def conformance(triples: DataFrame, found: DataFrame) -> DataFrame:
    """(package_id, conforms, has_target, failed_paths) of every package. One without a unit conforms too, having nothing to check: ``has_target`` tells."""
    return verdicts(triples.groupBy(KEY).agg(F.max((F.col("p") == "type") & (F.col("o") == UNIT)).alias("has_target")), found)


def conformance_of(described: DataFrame, found: DataFrame) -> DataFrame:
    """The same of ``nodes``."""
    return verdicts(described.groupBy(KEY).agg(F.max(F.expr(f"exists(facts, t -> t.p = 'type' AND t.o = '{UNIT}')")).alias("has_target")), found)


def verdicts(each: DataFrame, found: DataFrame) -> DataFrame:
    failed = found.groupBy(KEY).agg(F.sort_array(F.collect_set("path")).alias("failed_paths"))
    rows = each.join(failed, KEY, "left")
    return rows.select(KEY, F.col("failed_paths").isNull().alias("conforms"), "has_target", F.coalesce("failed_paths", F.array().cast("array<string>")).alias("failed_paths"))


def compared(before: DataFrame, after: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(package_id, change, failed_before, failed_after) of two runs: regress, improved, new, gone or same; ``more``: columns of the later run beside them."""
    a = before.select(KEY, F.col("conforms").alias("was"), F.col("failed_paths").alias("failed_before"))
    b = after.select(KEY, F.col("conforms").alias("is"), F.col("failed_paths").alias("failed_after"), *more)
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was") & ~F.col("is"), "regress").when(~F.col("was") & F.col("is"), "improved").otherwise("same")
    return a.join(b, KEY, "full_outer").select(KEY, change.alias("change"), "failed_before", "failed_after", *more)


def explained(found: DataFrame, definitions: DataFrame) -> DataFrame:
    """Violations with ``means``: the definition of the failing term, where the vocabulary (term, comment) has one."""
    return found.join(definitions.groupBy(F.col("term").alias("path")).agg(F.min("comment").alias("means")), "path", "left")

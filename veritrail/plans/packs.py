"""Rule packs over the triples of packages, each with SQL written by hand over the star schema itself."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import graph_rules, package_rules, packed
from veritrail.session import table

from .evidence import LINE_KEY
from .registry import ORACLES, query

#: (when, subject, predicate, object): a package is an order, its steps, results and regions are its lines.
ORDER_FACTS = [
    ("true", "'uoa'", "type", "'UnitOfAssurance'"),
    ("o_orderkey % 3 > 0", "'uoa'", "conformsToProfile", "'ProfileArgument'"),
    ("o_orderkey % 4 > 0", "'uoa'", "bindsRequirement", "'req'"),
    ("true", "'uoa'", "modelRevisionDate", "CAST(CAST(o_orderdate AS DATE) AS STRING)"),
    ("o_orderkey % 5 > 0", "'uoa'", "parentModelSnapshot", "'snap'"),
    ("o_orderkey % 5 > 0", "'snap'", "type", "'ParentModelSnapshot'"),
    ("o_orderkey % 5 IN (1, 2)", "'snap'", "parentDecision", "IF(o_orderkey % 5 = 1, 'Not Accepted', 'Accepted')"),
    ("true", "'uoa'", "hasEnvelope", "'n0'"), ("true", "'n0'", "dimension", "'x0'"), ("true", "'n0'", "min", "'10'"), ("true", "'n0'", "max", "'45'"),
    ("o_orderkey % 2 = 0", "'uoa'", "hasDataResourceProvenance", "'dp'"),
    ("o_orderkey % 6 = 0", "'uoa'", "hasOngoingDataQualityMonitoring", "'m'"),
    ("true", "'uoa'", "hasRisk", "'risk'"),
    ("o_orderkey % 3 = 0", "'risk'", "decision", "'accept'"),
    ("true", "'risk'", "hasRationale", "'why'"),
    ("o_orderkey % 7 > 1", "'why'", "justification", "IF(o_orderkey % 7 = 2, '', 'because')"),
    ("true", "'uoa'", "hasObjective", "'goal'"),
    ("o_orderkey % 11 > 1", "'goal'", "targetMeasure", "IF(o_orderkey % 11 = 2, '', 'rate')"),
    ("o_orderkey % 3 = 0", "'uoa'", "conformsToProfile", "'ProfileComplete'"),
    ("true", "'uoa'", "bindsClaim", "'claim'"), ("true", "'claim'", "type", "IF(o_orderkey % 4 > 1, 'Claim', 'AssuranceClaim')"),
    ("o_orderkey % 11 > 0", "'uoa'", "hasContextOfUse", "'cou'"), ("o_orderkey % 7 > 2", "'cou'", "hasApplicabilityConstraint", "'c'"), ("o_orderkey % 2 = 0", "'cou'", "hasOperatingEnvelope", "'n'"),
    ("o_orderkey % 4 > 0", "'uoa'", "hasUncertaintyQuantification", "IF(o_orderkey % 4 = 1, 'true', 'false')"), ("o_orderkey % 5 = 0", "'uoa'", "hasSensitivityAnalysis", "'true'"),
    ("o_orderkey % 13 > 0", "'uoa'", "signature", "'s'"), ("true", "'uoa'", "signatureTimestamp", "CAST(o_orderdate AS STRING)"),
    ("o_orderkey % 8 > 2", "'req'", "requiredVerificationMethod", "'method-' || o_orderkey % 3"),
    ("o_orderkey % 8 > 0", "'uoa'", "currentModelVersion", "'v1.' || o_custkey % 3 || '.0'"),
    ("true", "'uoa'", "hasDecisionRecord", "'dr'"), ("true", "'dr'", "outcome", "IF(o_orderstatus = 'F', 'Accepted', 'Not accepted')"), ("o_orderkey % 6 = 0", "'dr'", "hasOffsetRationale", "'o'"),
    ("true", "'uoa'", "modelRiskLevel", "substr(o_orderpriority, 1, 1)"), ("true", "'uoa'", "assuranceLevel", "CASE WHEN o_totalprice < 60000 THEN 'Low' WHEN o_totalprice < 180000 THEN 'Medium' ELSE 'High' END"),
    ("o_orderkey % 9 > 0", "'uoa'", "decisionRiskLevel", "CAST(o_orderkey % 5 AS STRING)"), ("o_orderkey % 3 = 1", "'uoa'", "decisionContextOfUse", "'d'"),
    ("o_orderkey % 2 = 0", "'uoa'", "deploymentPopulationCategory", "'cat' || o_custkey % 3"),
    ("true", "'uoa'", "hasEvaluationPoint", "'pt'"), ("true", "'pt'", "dimension", "'x0'"), ("true", "'pt'", "coordinate", "CAST(o_custkey % 50 AS STRING)"),
]
#: The factors that rules name, and one that none does.
FACTORS = ["Data pedigree", "Development technical review", "Development process and product management", "Use history", "Results uncertainty", "Results robustness", "Model form"]
FACTOR_TYPE = "CASE l_partkey % 7 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FACTORS)) + " END"
FACTOR_STATUS = "CASE l_linenumber % 4 WHEN 0 THEN 'not-assessed' WHEN 2 THEN 'scoped-out' ELSE 'assessed' END"
LINE_FACTS = [
    ("true", "'uoa'", "hasInferenceStep", "'i' || k"), ("true", "'i' || k", "supportsClaim", "'c' || k"),
    ("true", "'c' || k", "claimModality", "IF(l_returnflag = 'R', 'sufficient', 'necessary')"),
    ("true", "'c' || k", "claimKind", "IF(l_linestatus = 'F', 'model-behaviour', 'assessment-rigour')"),
    ("true", "'i' || k", "hasGround", "'g' || l_suppkey % 4"),
    ("l_tax > 0.04", "'g' || l_suppkey % 4", "claimModality", "'necessary'"),
    ("l_discount > 0.05", "'g' || l_suppkey % 4", "claimKind", "'assessment-rigour'"),
    ("true", "'i' || k", "warrantKind", "IF(l_linenumber % 2 = 0, 'direct-measurement', 'model')"),
    ("true", "'c' || k", "aboutQuantity", "'q' || k"), ("true", "'q' || k", "quantityId", "CAST(l_partkey % 5 AS STRING)"), ("true", "'i' || k", "groundQuantity", "CAST(l_suppkey % 5 AS STRING)"),
    ("true", "'c' || k", "overScope", "'s' || k"), ("true", "'s' || k", "populationId", "CAST(l_partkey % 3 AS STRING)"), ("true", "'i' || k", "groundPopulation", "CAST(l_suppkey % 3 AS STRING)"),
    ("l_linenumber < 3", "'uoa'", "hasValidationResult", "'v' || k"),
    ("l_linestatus = 'F'", "'v' || k", "wasGeneratedBy", "'a' || l_suppkey % 6"),
    ("true", "'a' || l_suppkey % 6", "used", "'d' || l_partkey % 6"),
    ("true", "'d' || l_partkey % 6", "dataVintage", "CAST(CAST(l_shipdate AS DATE) AS STRING)"),
    ("true", "'uoa'", "hasVerificationActivity", "'a' || l_partkey % 6"),
    ("true", "'v' || k", "referencesIdentifier", "'o' || l_partkey % 8"),
    ("l_tax > 0.05", "'o' || l_suppkey % 8", "type", "'Thing'"), ("l_discount > 0.07", "'o' || l_suppkey % 8", "url", "'http'"),
    ("true", "'uoa'", "declaredPhysicsConstraint", "'pc' || l_partkey % 5"), ("l_quantity > 5", "'pc' || l_partkey % 5", "type", "'PhysicsConstraint'"),
    ("l_tax > 0.03", "'pc' || l_suppkey % 5", "hasConstraintCheckEvidence", "'e'"),
    ("true", "'uoa'", "hasEvaluationRegion", "'r' || k"), ("true", "'r' || k", "dimension", "'x' || l_partkey % 3"),
    ("true", "'r' || k", "min", "CAST(l_quantity AS STRING)"), ("true", "'r' || k", "max", "CAST(l_quantity + 5 AS STRING)"),
    ("true", "'uoa'", "hasLineageStage", "'t' || k"), ("true", "'t' || k", "stageName", "IF(l_linenumber % 3 = 0, 'consumption', 'collection')"), ("l_tax > 0.02", "'t' || k", "hasNextStage", "'u'"),
    ("l_linenumber = 1", "'claim'", "wasDerivedFrom", "'v' || k"),
    ("l_discount > 0.05", "'d' || l_partkey % 6", "isFoundationalEvidence", "'true'"), ("l_partkey % 6 < 4", "'d' || l_partkey % 6", "modelVersion", "'v1.' || l_partkey % 6 || '.0'"),
    ("true", "'a' || l_suppkey % 6", "activityType", "'method-' || l_suppkey % 3"),
    ("l_tax > 0.02", "'v' || k", "hasUncertaintyQuantification", "'q'"), ("l_returnflag <> 'N'", "'v' || k", "comparedAgainst", "'x'"),
    ("l_linenumber % 2 = 0", "'v' || k", "samplingAccount", "'s'"), ("l_quantity > 10", "'v' || k", "harnessDeterminismStatement", "'d'"), ("l_suppkey % 3 = 0", "'v' || k", "nullBaselineStatement", "'b'"),
    ("l_suppkey % 4 > 0", "'v' || k", "claimedCOU", "'c'"), ("l_discount > 0.02", "'v' || k", "confoundControlStatement", "'c'"), ("l_suppkey % 2 = 0", "'v' || k", "subjectVersionGuarantee", "'v'"),
    ("l_quantity > 40", "'v' || k", "generalizedClaim", "'g'"), ("true", "'v' || k", "evidenceSource", "IF(l_suppkey % 5 < 3, 'reported', 'furnished')"),
    ("l_partkey % 3 = 0", "'v' || k", "corroboratedBy", "'y'"), ("l_partkey % 4 = 0", "'v' || k", "divergesFromFurnished", "'z'"),
    ("true", "'uoa'", "hasCredibilityFactor", "'f' || k"), ("true", "'f' || k", "factorType", FACTOR_TYPE), ("true", "'f' || k", "factorStatus", FACTOR_STATUS),
    ("l_partkey % 7 > 0", "'f' || k", "requiredLevel", "CAST(1 + l_partkey % 5 AS STRING)"), ("l_quantity > 3", "'f' || k", "achievedLevel", "CAST(CAST(1 + floor(l_quantity) % 5 AS INT) AS STRING)"),
    ("l_discount > 0.01", "'f' || k", "acceptanceCriteria", "'a'"), ("l_tax > 0.03", "'f' || k", "hasEvidence", "'e'"),
    ("l_linenumber > 3", "'uoa'", "hasEvidence", "'e' || k"), ("l_linenumber = 4", "'e' || k", "evidenceTimestamp", "CAST(l_shipdate AS STRING)"),
    ("l_linenumber = 5", "'e' || k", "type", "'AuditResultsRecord'"), ("l_linenumber = 5", "'e' || k", "auditDate", "CAST(l_shipdate AS STRING)"), ("l_linenumber = 5", "'e' || k", "auditCadence", "CASE l_partkey % 4 WHEN 0 THEN 'annual' WHEN 1 THEN 'quarterly' WHEN 2 THEN 'monthly' ELSE 'never' END"),
    ("l_linenumber = 6", "'e' || k", "type", "'ModelEvaluationReport'"), ("l_linenumber = 6", "'e' || k", "evaluatedModelVersion", "'v1.' || l_partkey % 12 || '.0'"), ("l_linenumber = 6", "'e' || k", "testSetCoverageCategory", "'cat' || l_suppkey % 3"),
    ("l_linenumber = 7", "'e' || k", "type", "IF(l_suppkey % 2 = 0, 'StatementOfApplicability', 'AIMSControl')"), ("l_linenumber = 7", "'e' || k", "mappedToFramework", "'fw' || l_partkey % 3"),
]
AS_OF = "DATE'1996-01-01'"
DERIVATIONS = [d for d in graph_rules.DERIVATIONS if d.flag not in {x.flag for x in graph_rules.dated(AS_OF)}] + graph_rules.dated(AS_OF)


#: Lines of a bucket of packages: what one task holds doesn't grow with the tables.
BUCKET_LINES = 150_000


def buckets(spark: SparkSession, sf_dir: str) -> int:
    return max(8, -(-table(spark, sf_dir, "lineitem").count() // BUCKET_LINES))


def packed_rows(spark: SparkSession, sf_dir: str, wanted: set[str]) -> DataFrame:
    """One row a package with the facts of the wanted predicates: orders and lines are shuffled once, as they are, and a package's facts are made where its rows lie."""
    facts = [(side, *f) for side, own in (("o", ORDER_FACTS), ("l", LINE_FACTS)) for f in own if f[2] in wanted]
    used = {c for _, when, s, _, o in facts for c in re.findall(r"\b[ol]_\w+", " ".join((when, s, o)))} | {"o_orderkey", *re.findall(r"l_\w+", LINE_KEY)}
    sides = [table(spark, sf_dir, n).select(F.col(key).alias("package_id"), *sorted(c for c in used if c[0] == key[0])) for n, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True).repartition(buckets(spark, sf_dir), "package_id").groupBy("package_id")
    own = both.agg(*[F.collect_list(F.when(F.col(key).isNotNull(), F.struct(*rows.columns[1:]))).alias(key[0]) for rows, key in zip(sides, ("o_orderkey", "l_orderkey"), strict=True)])
    row = lambda x: re.sub(r"\b([ol]_\w+|k)\b", r"r.\1", x)
    keyed = {"lines": f"transform(l, r -> struct({', '.join(f'r.{c} AS {c}' for c in sides[1].columns[1:])}, {row(LINE_KEY)} AS k))"}
    made: dict[str, list[str]] = {}
    for side, when, s, p, o in facts:
        own_rows = {"o": "o", "l": "lines"}[side]
        made.setdefault(f"p_{p}", []).append(f"transform({own_rows if when == 'true' else f'filter({own_rows}, r -> {row(when)})'}, r -> struct({row(s)} AS s, {row(o)} AS o))")
    return packed.fenced(packed.fenced(own, ["package_id", "o"], keyed), ["package_id"], {p: x[0] if len(x) == 1 else f"concat({', '.join(x)})" for p, x in sorted(made.items())})


def pack(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    own = [r for r in graph_rules.RULES if r.pack == name]
    _, given = graph_rules.running(DERIVATIONS, graph_rules.names(own))
    return graph_rules.evaluate_packed(packed_rows(spark, sf_dir, given), own, DERIVATIONS)


K = f"WITH RECURSIVE orders_ AS (SELECT o_orderkey AS package_id, * FROM orders), x AS (SELECT l_orderkey AS package_id, {LINE_KEY} AS k, * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) "
FINDING = "SELECT DISTINCT package_id, '{}' AS pattern_id, '{}' AS severity, {} AS node FROM {}"


def finding(*rows: tuple[str, str, str, str]) -> str:
    return K + " UNION ".join(FINDING.format(*r) for r in rows)


@query(finding(
    ("W-EP-03", "High", "'v' || k", "x JOIN orders_ USING (package_id) WHERE l_linenumber < 3 AND l_linestatus = 'F' AND EXISTS (SELECT 1 FROM x u JOIN x d ON d.package_id = u.package_id AND d.l_partkey % 6 = u.l_partkey % 6 WHERE u.package_id = x.package_id AND u.l_suppkey % 6 = x.l_suppkey % 6 AND d.l_shipdate::DATE < o_orderdate::DATE)"),
    ("W-SI-02", "High", "'uoa'", "orders_ WHERE o_orderkey % 4 = 0 OR NOT EXISTS (SELECT 1 FROM x WHERE x.package_id = orders_.package_id AND l_linenumber < 3)"),
    ("W-CON-02", "Medium", "'o' || l_partkey % 8", "(SELECT l_orderkey AS package_id, * FROM lineitem) y WHERE NOT EXISTS (SELECT 1 FROM lineitem z WHERE z.l_orderkey = y.package_id AND z.l_suppkey % 8 = y.l_partkey % 8 AND (z.l_tax > 0.05 OR z.l_discount > 0.07))"),
    ("W-CON-05", "High", "'a' || l_partkey % 6", "x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.package_id = x.package_id AND y.l_linestatus = 'F' AND y.l_suppkey % 6 = x.l_partkey % 6)"),
))
def graph_core(spark, sf_dir):
    """Core rules over triples: data older than the model, unbound requirements, undescribed identifiers, activities without a result."""
    return pack(spark, sf_dir, "core")


@query(finding(
    ("W-SURR-01", "High", "'pc' || l_partkey % 5", "x WHERE l_quantity > 5 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.package_id = x.package_id AND y.l_tax > 0.03 AND y.l_suppkey % 5 = x.l_partkey % 5)"),
    ("W-SURR-02", "Critical", "'snap'", "orders_ WHERE o_orderkey % 5 = 1"),
    ("W-SURR-02", "High", "'snap'", "orders_ WHERE o_orderkey % 5 > 2"),
    ("W-SURR-03", "High", "'uoa'", "x WHERE l_partkey % 3 = 0 AND (l_quantity < 10 OR l_quantity + 5 > 45)"),
    ("W-SURR-03", "High", "'uoa'", "orders_ WHERE o_custkey % 50 NOT BETWEEN 10 AND 45"),
))
def graph_surrogate(spark, sf_dir):
    """Surrogate rules; that an evaluation leaves its envelope is derived first."""
    return pack(spark, sf_dir, "surrogate")


@query(finding(
    ("W-ARG-01", "Critical", "'i' || k", "x WHERE package_id % 3 > 0 AND l_partkey % 5 <> l_suppkey % 5"),
    ("W-ARG-02", "High", "'i' || k", "x WHERE package_id % 3 > 0 AND l_partkey % 3 <> l_suppkey % 3"),
    ("W-ARG-03", "Critical", "'i' || k", "x WHERE package_id % 3 > 0 AND l_returnflag = 'R' AND l_linenumber % 2 = 0 AND EXISTS (SELECT 1 FROM x y WHERE y.package_id = x.package_id AND y.l_suppkey % 4 = x.l_suppkey % 4 AND y.l_tax > 0.04)"),
    ("W-ARG-04", "High", "'i' || k", "x WHERE package_id % 3 > 0 AND l_linestatus = 'F' AND EXISTS (SELECT 1 FROM x y WHERE y.package_id = x.package_id AND y.l_suppkey % 4 = x.l_suppkey % 4 AND y.l_discount > 0.05)"),
))
def graph_argument(spark, sf_dir):
    """Argument rules: conclusions that reach beyond their grounds."""
    return pack(spark, sf_dir, "argument")


@query(finding(
    ("W-AIMS-DATA-DRIFT-UNDETECTED", "High", "'uoa'", "orders_ WHERE o_orderkey % 2 = 0 AND o_orderkey % 6 > 0"),
    ("W-AR-02", "High", "'risk'", "orders_ WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 < 3"),
    ("W-AIMS-OBJECTIVE-UNMEASURED", "High", "'goal'", "orders_ WHERE o_orderkey % 11 < 3"),
    ("W-AIMS-DATA-LINEAGE-BROKEN", "High", "'t' || k", "x WHERE l_linenumber % 3 > 0 AND l_tax <= 0.02"),
    ("W-AIMS-AUDIT-STALE", "High", "'e' || k", "x WHERE l_linenumber = 5 AND date_diff('day', l_shipdate::DATE, DATE '1996-01-01') > CASE l_partkey % 4 WHEN 0 THEN 365 WHEN 1 THEN 90 WHEN 2 THEN 30 ELSE 9999 END"),
    ("W-AIMS-MODEL-EVAL-STALE", "High", "'e' || k", "x JOIN orders_ USING (package_id) WHERE l_linenumber = 6 AND o_orderkey % 8 > 0 AND l_partkey % 12 < o_custkey % 3"),
    ("W-AIMS-MODEL-EVAL-SCOPE", "High", "'uoa'", "x JOIN orders_ USING (package_id) WHERE l_linenumber = 6 AND o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.package_id = x.package_id AND y.k = x.k AND y.l_suppkey % 3 = o_custkey % 3)"),
    ("W-AIMS-CROSSWALK-INVALID", "High", "'fw' || l_partkey % 3", "x WHERE l_linenumber = 7 AND l_suppkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.package_id = x.package_id AND y.l_linenumber = 7 AND y.l_suppkey % 2 = 1 AND y.l_partkey % 3 = x.l_partkey % 3)"),
))
def graph_management(spark, sf_dir):
    """Management-system rules over derived flags."""
    return pack(spark, sf_dir, "management")


DERIVED = {
    ("'uoa'", "_noMonitoringEvidence", "'true'"): "orders_ WHERE o_orderkey % 2 = 0 AND o_orderkey % 6 > 0", ("'why'", "_justificationNonEmpty", "'true'"): "orders_ WHERE o_orderkey % 7 > 2",
    ("'goal'", "_targetMeasureNonEmpty", "'true'"): "orders_ WHERE o_orderkey % 11 > 2", ("'t' || k", "_lineageGap", "'true'"): "y WHERE l_linenumber % 3 > 0 AND l_tax <= 0.02",
    ("'uoa'", "_evalOutsideEnvelope", "'true'"): "x WHERE l_partkey % 3 = 0 AND (l_quantity < 10 OR l_quantity + 5 > 45)", ("'uoa'", "_pointOutsideEnvelope", "'true'"): "orders_ WHERE o_custkey % 50 NOT BETWEEN 10 AND 45",
    ("'e' || k", "_auditOverdue", "'true'"): "y WHERE l_linenumber = 5 AND date_diff('day', l_shipdate::DATE, DATE '1996-01-01') > CASE l_partkey % 4 WHEN 0 THEN 365 WHEN 1 THEN 90 WHEN 2 THEN 30 ELSE 9999 END",
    ("'e' || k", "_modelEvalStaleByVersion", "'true'"): "x JOIN orders_ USING (package_id) WHERE l_linenumber = 6 AND o_orderkey % 8 > 0 AND l_partkey % 12 < o_custkey % 3",
    ("'uoa'", "_evalCoverageGap", "'true'"): "x JOIN orders_ USING (package_id) WHERE l_linenumber = 6 AND o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.package_id = x.package_id AND y.k = x.k AND y.l_suppkey % 3 = o_custkey % 3)",
    ("'uoa'", "_controlledFramework", "'fw' || l_partkey % 3"): "x WHERE l_linenumber = 7 AND l_suppkey % 2 = 1",
    ("'uoa'", "_crosswalkUnsupported", "'fw' || l_partkey % 3"): "x WHERE l_linenumber = 7 AND l_suppkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM x z WHERE z.package_id = x.package_id AND z.l_linenumber = 7 AND z.l_suppkey % 2 = 1 AND z.l_partkey % 3 = x.l_partkey % 3)",
}


@query(K + ", y AS (SELECT l_orderkey AS package_id, " + LINE_KEY + " AS k, * FROM lineitem) " + " UNION ".join(f"SELECT package_id, {s} AS s, '{p}' AS p, {o} AS o FROM {source}" for (s, p, o), source in DERIVED.items()))
def graph_derived(spark, sf_dir):
    """The derived triples alone; each derivation sees those before it."""
    _, given = graph_rules.running(DERIVATIONS, {d.flag for d in DERIVATIONS})
    return graph_rules.derive_packed(packed_rows(spark, sf_dir, given), DERIVATIONS)


F_STATUS = "(CASE l_linenumber % 4 WHEN 0 THEN 'not-assessed' WHEN 2 THEN 'scoped-out' ELSE 'assessed' END)"
V = "x JOIN orders_ USING (package_id) WHERE l_linenumber < 3 AND "
N = "x JOIN orders_ USING (package_id) WHERE "
FRAMED = [
    ("W-EP-01", "Critical", "'claim'", "orders_ WHERE o_orderkey % 4 > 1 AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = o_orderkey AND y.l_linenumber = 1)"),
    ("W-EP-02", "High", "'v' || k", V + "l_linestatus <> 'F'"),
    ("W-EP-04", "High", "'f' || k", N + "l_linenumber % 4 = 0 AND substr(o_orderpriority, 1, 1)::INT > 2"),
    ("W-AL-01", "High", "'v' || k", V + "l_tax <= 0.02"),
    ("W-AL-02", "Medium", "'uoa'", "orders_ WHERE o_orderkey % 4 = 1 AND o_orderkey % 5 > 0"),
    ("W-ON-01", "High", "'uoa'", "orders_ WHERE o_orderkey % 11 = 0"),
    ("W-ON-02", "High", "'cou'", "orders_ WHERE o_orderkey % 11 > 0 AND o_orderkey % 7 < 3 AND o_orderkey % 2 = 1"),
    ("W-AR-01", "Critical", "'f' || k", N + "l_partkey % 7 > 0 AND l_discount <= 0.01 AND l_linenumber % 4 <> 2"),
    ("W-AR-02", "Critical", "'f' || k", N + "o_orderstatus = 'F' AND o_orderkey % 6 > 0 AND l_partkey % 7 > 0 AND l_quantity > 3 AND floor(l_quantity) % 5 < l_partkey % 5"),
    ("W-AR-03", "High", "'v' || k", V + "o_orderkey % 4 > 0 AND o_orderkey % 8 > 2 AND l_linestatus = 'F' AND l_suppkey % 3 <> o_orderkey % 3"),
    ("W-AR-04", "High", "'v' || k", V + "o_orderkey % 8 > 0 AND l_linestatus = 'F' AND EXISTS (SELECT 1 FROM x d WHERE d.package_id = x.package_id AND d.l_suppkey % 6 = x.l_suppkey % 6 AND d.l_partkey % 6 < 4 AND d.l_partkey % 6 <> o_custkey % 3)"),
    ("W-AR-05", "High", "'v' || k", V + "l_returnflag = 'N'"),
    ("W-SI-01", "High", "'uoa'", "orders_ WHERE o_orderkey % 13 = 0"),
    ("W-CON-01", "High", "'f' || k", N + "o_orderstatus = 'F' AND l_partkey % 7 = 0 AND l_quantity <= 3 AND l_linenumber % 2 = 1"),
    ("W-CON-03", "High", "'e' || k", N + "l_linenumber = 4 AND l_shipdate > o_orderdate"),
    ("W-CON-04", "Medium", "'uoa'", "orders_ WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 > 0"),
    ("W-PROV-01", "Critical", "'v' || k", "x WHERE l_linenumber = 1 AND l_linestatus <> 'F'"),
    ("W-PROV-01", "Critical", "'d' || d.l_partkey % 6", "x d WHERE EXISTS (SELECT 1 FROM x v WHERE v.package_id = d.package_id AND v.l_linenumber = 1 AND v.l_linestatus = 'F' AND v.l_suppkey % 6 = d.l_suppkey % 6) AND NOT EXISTS (SELECT 1 FROM x g WHERE g.package_id = d.package_id AND g.l_partkey % 6 = d.l_partkey % 6 AND g.l_discount > 0.05)"),
    ("W-NASA-01", "High", "'f' || k", N + "l_partkey % 7 = 0 AND l_linenumber % 4 = 0 AND substr(o_orderpriority, 1, 1)::INT > 1"),
    ("W-NASA-02", "High", "'f' || k", N + "l_partkey % 7 = 1 AND l_linenumber % 2 = 1 AND l_tax <= 0.03"),
    ("W-NASA-03", "High", "'f' || k", N + "l_partkey % 7 = 2 AND l_linenumber % 2 = 1 AND l_tax <= 0.03"),
    ("W-NASA-04", "Medium", "'f' || k", N + "l_partkey % 7 = 3 AND l_linenumber % 4 = 0 AND substr(o_orderpriority, 1, 1)::INT > 2"),
    ("W-NASA-05", "High", "'f' || k", N + "l_partkey % 7 = 4 AND l_linenumber % 2 = 1 AND o_orderkey % 4 = 0"),
    ("W-NASA-06", "High", "'f' || k", N + "l_partkey % 7 = 5 AND l_linenumber % 2 = 1 AND l_tax <= 0.03"),
    ("W-EV-GEN-02", "High", "'v' || k", V + "l_linenumber = 1"),
    ("W-EV-DET-03", "High", "'v' || k", V + "l_quantity <= 10"),
    ("W-EV-NULL-04", "High", "'v' || k", V + "l_suppkey % 3 > 0"),
    ("W-EV-COU-05", "Critical", "'v' || k", V + "l_suppkey % 4 = 0 AND o_orderkey % 3 = 1"),
    ("W-EV-COU-05", "High", "'v' || k", V + "l_suppkey % 4 = 0 AND o_orderkey % 3 <> 1"),
    ("W-EV-CAP-06", "Medium", "'v' || k", V + "l_discount <= 0.02"),
    ("W-EV-DIV-07", "High", "'v' || k", V + "l_partkey % 4 = 0"),
    ("W-EV-SUB-08", "High", "'v' || k", V + "l_suppkey % 2 = 1"),
    ("W-EV-COR-09", "High", "'v' || k", V + "l_suppkey % 5 < 3 AND l_partkey % 3 > 0 AND EXISTS (SELECT 1 FROM x w WHERE w.package_id = x.package_id AND w.l_linenumber < 3 AND w.l_suppkey % 5 > 2)"),
    ("COMPOUND-EV-01", "Critical", "'v' || k", V + "l_tax <= 0.02 AND l_suppkey % 3 > 0 AND o_orderkey % 9 > 0 AND o_orderkey % 5 > 2"),
    ("COMPOUND-EV-02", "Critical", "'v' || k", V + "l_quantity > 40 AND l_linenumber = 1"),
]
BELOW = "below AS MATERIALIZED (SELECT DISTINCT * FROM (" + " UNION ".join([FINDING.format(*r) for r in FRAMED] + [ORACLES[f"graph_{p}"].removeprefix(K) for p in ("core", "surrogate", "argument", "management")]) + "))"
COMPOUNDS = """SELECT package_id, 'COMPOUND-01' AS pattern_id, 'Critical' AS severity, c.pattern_id || '+' || h.pattern_id AS node, 3 AS level FROM (SELECT DISTINCT package_id, pattern_id FROM below WHERE severity = 'Critical') c JOIN (SELECT DISTINCT package_id, pattern_id FROM below WHERE severity = 'High') h USING (package_id)
UNION ALL SELECT package_id, 'COMPOUND-03', 'High', 'uoa', 3 FROM orders_ WHERE o_totalprice >= 60000 AND package_id IN (SELECT package_id FROM below WHERE severity = 'Critical')"""


@query(K + ", " + BELOW + " SELECT *, CASE WHEN pattern_id LIKE 'COMPOUND%' THEN 2 ELSE 1 END AS level FROM below UNION ALL " + COMPOUNDS)
def graph_check(spark, sf_dir):
    """All packs over the triples of all packages: single findings, pack compounds, core compounds."""
    return package_rules.check_packed(packed_rows(spark, sf_dir, package_rules.asked(derivations=DERIVATIONS)), derivations=DERIVATIONS)

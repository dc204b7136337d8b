"""Goal decomposition and shapes over the packages of the star schema, with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import goals
from veritrail.session import table
from veritrail.storage import dealt

from .evidence import LINE_KEY
from .packs import buckets
from .registry import query

#: Taxonomies and claim types, by the remainder of the order's key; kinds of evidence, by that of the part's.
TAXONOMIES = ["subjective-model-form-adequacy", "tacit-knowledge-transfer", "behavioral-compliance", "regulatory-jurisdiction-conflict", "clinical-judgment-arbitration", "none-of-these"]
CLAIMS = ["CalibrationClaim", "ComparativePerformanceClaim", "ModelFormAdequacyClaim", "Claim"]
KINDS = ["StructuredComparisonStudy", "DocumentedSOP", "BehavioralAuditRecord", "JurisdictionalAlignmentDocument", "ArbitrationRecord", "CalibrationEvidence", "CalibrationDataProvenance", "ModelComparisonRecord"]


def case(expression: str, names: list[str], prefix: str = "") -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{prefix}{n}'" for i, n in enumerate(names)) + " END"


#: Packages bind claims c0 and c1 (the second in two of three); a line of number 1 to 4 is evidence of one of them.
ORDER_FACTS = [
    ("true", "'uoa'", "type", "'UnitOfAssurance'"), ("true", "'uoa'", "adversarialProvenance", "'prov'"), ("true", "'prov'", "sourceTaxonomy", case("o_orderkey % 6", TAXONOMIES, "oos/")),
    ("true", "'uoa'", "bindsClaim", "'c0'"), ("o_orderkey % 3 > 0", "'uoa'", "bindsClaim", "'c1'"),
    ("true", "'c0'", "type", case("o_custkey % 4", CLAIMS)), ("true", "'c1'", "type", case("(o_custkey + 1) % 4", CLAIMS)),
]
LINE_FACTS = [("l_linenumber < 5", "'c' || l_suppkey % 2", "hasSupportingEvidence", "'e' || k"), ("l_tax > 0.01", "'e' || k", "type", case("l_partkey % 8", KINDS))]


def goal_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package_id, s, p, o) in buckets of packages: orders and lines are shuffled as they are, and what is joined by package afterwards isn't."""
    triple = lambda when, s, p, o: F.expr(f"CASE WHEN {when} THEN named_struct('s', {s}, 'p', '{p}', 'o', {o}) END")
    parts = buckets(spark, sf_dir)
    by_package = lambda name, key: table(spark, sf_dir, name).repartition(parts, key).withColumn("package_id", F.col(key))
    orders, lines = by_package("orders", "o_orderkey"), by_package("lineitem", "l_orderkey").withColumn("k", F.expr(LINE_KEY))
    rows = [rows.select("package_id", F.explode(F.array_compact(F.array(*[triple(*f) for f in facts]))).alias("t")).select("package_id", "t.*") for rows, facts in ((orders, ORDER_FACTS), (lines, LINE_FACTS))]
    return dealt(rows[0].unionByName(rows[1]), "goal_triples", "package_id", parts, ["package_id", "s"], lying=True)


OOS = f"""WITH claims AS (SELECT o_orderkey AS package_id, 'c0' AS claim, {case("o_custkey % 4", CLAIMS)} AS kind, {case("o_orderkey % 6", TAXONOMIES, "oos/")} AS taxonomy, true AS bound FROM orders
  UNION ALL SELECT o_orderkey, 'c1', {case("(o_custkey + 1) % 4", CLAIMS)}, {case("o_orderkey % 6", TAXONOMIES, "oos/")}, o_orderkey % 3 > 0 FROM orders),
support AS (SELECT l_orderkey AS package_id, 'c' || l_suppkey % 2 AS claim, count(*) AS n, list(CASE WHEN l_tax > 0.01 THEN {case("l_partkey % 8", KINDS)} END) AS kinds FROM lineitem WHERE l_linenumber < 5 GROUP BY ALL),
both_ AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(kinds, []) AS kinds FROM claims c LEFT JOIN support USING (package_id, claim)),
asked AS (SELECT *, unnest(['oos_modelform_adequacy_warranted', 'oos_tacit_knowledge_warranted', 'oos_behavioral_compliance_warranted', 'oos_jurisdictional_alignment_warranted', 'oos_clinical_arbitration_warranted']) AS rule_name, unnest({TAXONOMIES[:5]}) AS t, unnest({KINDS[:5]}) AS wanted FROM both_)
SELECT package_id, rule_name, claim AS subject, CASE WHEN n = 0 THEN 5 ELSE 6 END AS failed_clause FROM asked WHERE bound AND taxonomy = 'oos/' || t AND NOT list_contains(kinds, wanted)
UNION ALL SELECT package_id, 'oos_surr_calibration_provenance_warranted', claim, CASE WHEN n = 0 THEN 4 WHEN NOT list_contains(kinds, 'CalibrationEvidence') THEN 5 ELSE 7 END FROM both_ WHERE bound AND kind = 'CalibrationClaim' AND NOT (list_contains(kinds, 'CalibrationEvidence') AND list_contains(kinds, 'CalibrationDataProvenance'))
UNION ALL SELECT package_id, 'oos_surr_model_comparison_warranted', claim, CASE WHEN n = 0 THEN 4 ELSE 5 END FROM both_ WHERE bound AND kind = 'ComparativePerformanceClaim' AND NOT list_contains(kinds, 'ModelComparisonRecord')
UNION ALL SELECT package_id, 'oos_modelform_adequacy_warranted_backward', claim, CASE WHEN n = 0 THEN 2 ELSE 3 END FROM both_ WHERE kind = 'ModelFormAdequacyClaim' AND NOT list_contains(kinds, 'StructuredComparisonStudy')"""


@query(OOS)
def oos_goals(spark, sf_dir):
    """All goals over all packages: the first clause that even the best candidate fails."""
    return goals.decompose(goal_triples(spark, sf_dir)).select("package_id", "rule_name", "subject", "failed_clause")


@query("SELECT package_id, list_sort(list(rule_name || ' ' || subject || ' ' || failed_clause)) AS oos_results FROM (" + OOS + ") GROUP BY package_id UNION ALL SELECT o_orderkey, [] FROM orders WHERE o_orderkey NOT IN (SELECT package_id FROM (" + OOS + "))")
def oos_7(spark, sf_dir):
    """Packages with their verdicts, as goals are enabled."""
    t = goal_triples(spark, sf_dir)
    rows = goals.with_verdicts(t.where("p = 'type' AND o = 'UnitOfAssurance'").select("package_id"), t, enable=True)
    return rows.withColumn("oos_results", F.sort_array(F.transform("oos_results", lambda x: F.concat_ws(" ", x["rule_name"], x["subject"], x["failed_clause"].cast("string")))))

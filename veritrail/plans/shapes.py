"""Shapes over the packages of the star schema, two runs compared, and violations with definitions; SQL written by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.operators import shapes
from veritrail.session import table
from veritrail.storage import dealt

from .evidence import LINE_KEY
from .packs import buckets
from .registry import query

#: (when, subject, predicate, object, kind or datatype)
UNIT_FACTS = [
    ("o_orderkey % 17 > 0", "type", "'UnitOfAssurance'", "iri"), ("o_orderkey % 17 = 0", "type", "'Draft'", "iri"),
    ("o_orderkey % 5 > 0", "conformsToProfile", "CASE o_orderkey % 5 WHEN 3 THEN 'ProfileComplete' WHEN 4 THEN 'ProfileOther' ELSE 'ProfileMinimal' END", "iri"),
    ("o_orderkey % 3 > 0 AND o_orderkey % 7 > 0", "bindsRequirement", "'r'", "iri"), ("o_orderkey % 3 > 0 AND o_orderkey % 7 = 0", "bindsRequirement", "'r'", "string"),
    ("true", "hasDecisionRecord", "'dr'", "iri"), ("true", "generatedAtTime", "CAST(o_orderdate AS STRING)", "dateTime"), ("o_orderkey % 6 = 0", "generatedAtTime", "'later'", "string"),
    ("true", "hash", "IF(o_orderkey % 4 = 0, 'md5:1', 'sha256:' || sha2(CAST(o_orderkey AS STRING), 256))", "string"), ("o_orderkey % 13 > 0", "signature", "'ed25519:ab'", "string"),
    ("o_custkey % 3 > 0", "bindsModel", "'m'", "iri"), ("true", "bindsDataset", "'d'", "iri"), ("true", "wasDerivedFrom", "'p'", "iri"), ("o_custkey % 4 > 0", "wasAttributedTo", "'w'", "iri"), ("true", "criteriaSet", "'s'", "iri"),
    ("true", "credibilityIndex", "IF(o_custkey % 10 = 0, 'n/a', CAST(o_orderkey % 3 AS STRING))", "decimal"), ("true", "uncertaintyCIWidth", "CAST(o_custkey % 5 - 1 AS STRING)", "decimal"),
    ("true", "assuranceLevel", "CASE o_custkey % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Extreme' END", "string"),
    ("true", "deviceClass", "IF(o_custkey % 5 = 0, 'Turbine', 'Class II')", "string"), ("o_custkey % 6 = 0", "deviceClass", "'N/A'", "string"),
    ("o_orderkey % 11 > 0", "hasContextOfUse", "'c'", "iri"), ("o_orderkey % 4 > 0", "hasUncertaintyQuantification", "'true'", "boolean"),
]
NODE_FACTS = [
    ("l_linenumber = 2", "'uoa'", "hasValidationResult", "'n' || k", "iri"), ("l_linenumber = 1", "'uoa'", "hasCredibilityFactor", "'n' || k", "iri"),
    ("l_linenumber = 1", "'n' || k", "type", "'CredibilityFactor'", "iri"), ("l_linenumber = 1", "'n' || k", "factorType", "'f'", "string"),
    ("l_linenumber = 1", "'n' || k", "factorStatus", "IF(l_suppkey % 5 = 4, 'unknown', 'assessed')", "string"), ("l_linenumber = 1", "'n' || k", "requiredLevel", "CAST(l_partkey % 8 AS STRING)", "integer"),
    ("l_linenumber = 1 AND l_tax > 0.05", "'n' || k", "achievedLevel", "CAST(l_suppkey % 4 AS STRING)", "double"), ("l_linenumber = 1 AND l_tax <= 0.05", "'n' || k", "achievedLevel", "CAST(l_suppkey % 4 AS STRING)", "integer"),
    ("l_linenumber = 3", "'n' || k", "type", "'WeakenerAnnotation'", "iri"), ("l_linenumber = 3", "'n' || k", "patternId", "CASE l_partkey % 4 WHEN 0 THEN 'W-EP-01' WHEN 1 THEN 'COMPOUND-EV-01' WHEN 2 THEN 'w-ep-1' ELSE 'W-AIMS-AUDIT-STALE' END", "string"),
    ("l_linenumber = 3", "'n' || k", "severity", "IF(l_suppkey % 3 = 0, 'Bad', 'High')", "string"), ("l_linenumber = 3 AND l_suppkey % 2 = 0", "'n' || k", "affectedNode", "'x'", "iri"), ("l_linenumber = 3 AND l_suppkey % 2 = 1", "'n' || k", "affectedNode", "'x'", "string"),
    ("l_linenumber = 4", "'n' || k", "type", "'Disposition'", "iri"), ("l_linenumber = 4 AND l_tax > 0.02", "'n' || k", "actionClass", "IF(l_partkey % 3 = 0, 'wait', 'change-cou')", "string"),
    ("l_linenumber = 5", "'n' || k", "type", "'Discrepancy'", "iri"), ("l_linenumber = 5", "'n' || k", "surrogatePrediction", "'1.5'", "double"), ("l_linenumber = 5 AND l_suppkey % 4 > 0", "'n' || k", "solverTruth", "'1.25'", "double"),
    ("l_linenumber = 5 AND l_suppkey % 4 = 0", "'n' || k", "solverTruth", "'1'", "integer"), ("l_linenumber = 5 AND l_discount > 0.02", "'n' || k", "discrepancyMagnitude", "'0.25'", "double"), ("l_linenumber = 5", "'n' || k", "measureType", "IF(l_partkey % 2 = 0, 'point', 'line')", "string"),
]


def shape_triples(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """(package_id, s, p, o, o_kind, o_datatype) from one pass over orders and one over lines, which are dealt out by package, into ``parts``, as they are: triples are made where they are grouped."""

    def triple(when: str, s: str, p: str, o: str, kind: str) -> F.Column:
        other = "'iri' AS o_kind, CAST(NULL AS STRING) AS o_datatype" if kind == "iri" else f"'lit' AS o_kind, '{shapes.XSD}{kind}' AS o_datatype"
        return F.expr(f"CASE WHEN {when} THEN struct({s} AS s, '{p}' AS p, {o} AS o, {other}) END")

    by_package = lambda name, key: table(spark, sf_dir, name).repartition(*[parts] * bool(parts), key).withColumn("package_id", F.col(key))
    orders = by_package("orders", "o_orderkey")
    lines = by_package("lineitem", "l_orderkey").withColumn("k", F.expr(LINE_KEY))
    own = [(orders, [(w, "'uoa'", p, o, kind) for w, p, o, kind in UNIT_FACTS]), (lines, NODE_FACTS)]
    parts = [rows.select("package_id", F.explode(F.array_compact(F.array(*[triple(*f) for f in facts]))).alias("t")).select("package_id", "t.*") for rows, facts in own]
    return parts[0].unionByName(parts[1])


U, M, C = "orders WHERE o_orderkey % 17 > 0", "orders WHERE o_orderkey % 17 > 0 AND o_orderkey % 5 IN (1, 2, 3)", "orders WHERE o_orderkey % 17 > 0 AND o_orderkey % 5 = 3"
NO_LINE = "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = {})"
#: (path, constraint, actual, source)
UNIT_SQL = [
    ("bindsRequirement", "minCount", "'MISSING'", M + " AND o_orderkey % 3 = 0"), ("bindsRequirement", "nodeKind", "'r'", M + " AND o_orderkey % 3 > 0 AND o_orderkey % 7 = 0"),
    ("hasValidationResult", "minCount", "'MISSING'", M + " AND " + NO_LINE.format(2)), ("generatedAtTime", "maxCount", "'2'", M + " AND o_orderkey % 6 = 0"), ("generatedAtTime", "datatype", "'string'", M + " AND o_orderkey % 6 = 0"),
    ("hash", "pattern", "'md5:1'", M + " AND o_orderkey % 4 = 0"), ("signature", "minCount", "'MISSING'", M + " AND o_orderkey % 13 = 0"),
    ("bindsModel", "minCount", "'MISSING'", C + " AND o_custkey % 3 = 0"), ("wasAttributedTo", "minCount", "'MISSING'", C + " AND o_custkey % 4 = 0"), ("hasCredibilityFactor", "minCount", "'MISSING'", C + " AND " + NO_LINE.format(1)),
    ("credibilityIndex", "minInclusive", "'n/a'", C + " AND o_custkey % 10 = 0"), ("credibilityIndex", "maxInclusive", "CASE WHEN o_custkey % 10 = 0 THEN 'n/a' ELSE '2' END", C + " AND (o_custkey % 10 = 0 OR o_orderkey % 3 = 2)"),
    ("uncertaintyCIWidth", "minInclusive", "'-1'", C + " AND o_custkey % 5 = 0"), ("assuranceLevel", "in", "'Extreme'", C + " AND o_custkey % 4 = 3"),
    ("deviceClass", "maxCount", "'2'", C + " AND o_custkey % 6 = 0"), ("deviceClass", "in", "'Turbine'", C + " AND o_custkey % 5 = 0"),
    ("hasContextOfUse", "minCount", "'MISSING'", U + " AND o_orderkey % 11 = 0"), ("conformsToProfile", "or", "CASE o_orderkey % 5 WHEN 0 THEN 'MISSING' ELSE 'ProfileOther' END", U + " AND o_orderkey % 5 IN (0, 4)"),
]
NODE_SQL = [
    ("factorStatus", "in", "'unknown'", "l_linenumber = 1 AND l_suppkey % 5 = 4"), ("requiredLevel", "maxInclusive", "CAST(l_partkey % 8 AS VARCHAR)", "l_linenumber = 1 AND l_partkey % 8 > 5"), ("achievedLevel", "datatype", "'double'", "l_linenumber = 1 AND l_tax > 0.05"),
    ("patternId", "pattern", "CASE l_partkey % 4 WHEN 2 THEN 'w-ep-1' ELSE 'W-AIMS-AUDIT-STALE' END", "l_linenumber = 3 AND l_partkey % 4 > 1"), ("severity", "in", "'Bad'", "l_linenumber = 3 AND l_suppkey % 3 = 0"), ("affectedNode", "nodeKind", "'x'", "l_linenumber = 3 AND l_suppkey % 2 = 1"),
    ("actionClass", "minCount", "'MISSING'", "l_linenumber = 4 AND l_tax <= 0.02"), ("actionClass", "in", "'wait'", "l_linenumber = 4 AND l_tax > 0.02 AND l_partkey % 3 = 0"),
    ("solverTruth", "datatype", "'integer'", "l_linenumber = 5 AND l_suppkey % 4 = 0"), ("discrepancyMagnitude", "minCount", "'MISSING'", "l_linenumber = 5 AND l_discount <= 0.02"), ("measureType", "in", "'line'", "l_linenumber = 5 AND l_partkey % 2 = 1"),
]
FOUND = " UNION ".join(
    [f"SELECT o_orderkey AS package_id, 'uoa' AS focus_node, '{p}' AS path, '{c}' AS constraint_kind, {a} AS actual, {'NULL' if p in ('hasContextOfUse', 'conformsToProfile') else chr(39) + 'x' + chr(39)} AS tag FROM {source}" for p, c, a, source in UNIT_SQL]
    + [f"SELECT l_orderkey, 'n' || {LINE_KEY}, '{p}', '{c}', {a}, NULL FROM lineitem WHERE {when}" for p, c, a, when in NODE_SQL]
)
SH_1 = f"SELECT package_id, focus_node, path, constraint_kind, actual, CASE WHEN tag IS NOT NULL THEN CASE package_id % 5 WHEN 3 THEN 'ProfileComplete' ELSE 'ProfileMinimal' END END AS profile FROM ({FOUND})"


@query(SH_1)
def sh_1(spark, sf_dir):
    """All violations, with the profile that the unit itself declares: counts, datatypes, kinds, ranges, patterns, enumerations."""
    return shapes.violations(shape_triples(spark, sf_dir)).select("package_id", "focus_node", "path", "constraint_kind", "actual", "profile")


LATER_SHAPES = [*shapes.SHAPES, shapes.Shape(shapes.UNIT, (shapes.Property("hasUncertaintyQuantification", 1),))]


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conformance of the packages before 1998 under all packs, and of those since mid-1992 under the core, which asks for one thing more by then."""
    date = F.col("o_orderdate")
    parts = buckets(spark, sf_dir)
    dated = table(spark, sf_dir, "orders").repartition(parts, "o_orderkey").groupBy(F.col("o_orderkey").alias("package_id")).agg(F.bool_or(date < F.expr("TIMESTAMP'1998-01-01 00:00:00'")).alias("early"), F.bool_or(date >= F.expr("TIMESTAMP'1992-06-01 00:00:00'")).alias("late"))
    # nodes are made once for both runs, and stay where they lie, in as many tasks as the lines ask for
    described = dealt(shapes.nodes(shape_triples(spark, sf_dir, parts)).join(dated, "package_id"), "shape_nodes", "package_id", parts, ["package_id"], lying=True)
    early, late = described.where("early"), described.where("late")
    return shapes.conformance_of(early, shapes.violations_of(early, fields=("path",))), shapes.conformance_of(late, shapes.violations_of(late, LATER_SHAPES, ("core",), ("path",)))


RUNS = f"""found AS MATERIALIZED (SELECT DISTINCT package_id, path FROM ({FOUND})),
early AS (SELECT o_orderkey AS package_id, o_orderkey % 17 > 0 AS has_target, o_orderkey NOT IN (SELECT package_id FROM found) AS conforms FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
late AS (SELECT o_orderkey AS package_id, o_orderkey % 17 > 0 AS has_target, o_orderkey NOT IN (SELECT package_id FROM found WHERE path NOT IN ('deviceClass', 'hasContextOfUse', 'actionClass', 'solverTruth', 'discrepancyMagnitude', 'measureType')) AND NOT (o_orderkey % 17 > 0 AND o_orderkey % 4 = 0) AS conforms FROM orders WHERE o_orderdate >= TIMESTAMP '1992-06-01'),
changes AS (SELECT coalesce(a.package_id, b.package_id) AS package_id, CASE WHEN a.package_id IS NULL THEN 'new' WHEN b.package_id IS NULL THEN 'gone' WHEN a.conforms AND NOT b.conforms THEN 'regress' WHEN NOT a.conforms AND b.conforms THEN 'improved' ELSE 'same' END AS change FROM early a FULL JOIN late b ON a.package_id = b.package_id)"""


@query("WITH " + RUNS + " SELECT * FROM changes")
def sh_12(spark, sf_dir):
    """What became of each package between two runs."""
    return shapes.compared(*runs(spark, sf_dir)).select("package_id", "change")


@query("WITH " + RUNS + " SELECT 'change' AS part, change AS name, count(*) AS n FROM changes GROUP BY change UNION ALL SELECT 'later run', CASE WHEN NOT conforms THEN 'failing' WHEN has_target THEN 'conforming' ELSE 'vacuous' END, count(*) FROM late GROUP BY ALL")
def sh_12_counts(spark, sf_dir):
    """How many packages changed each way, and of the later run how many conform, fail, or had nothing to check."""
    before, after = runs(spark, sf_dir)
    both = shapes.compared(before, after.withColumn("state", F.when(~F.col("conforms"), "failing").when(F.col("has_target"), "conforming").otherwise("vacuous")), ("state",))
    each = F.array(F.struct(F.lit("change").alias("part"), F.col("change").alias("name")), F.struct(F.lit("later run").alias("part"), F.col("state").alias("name")))
    return both.select(F.inline(each)).where("name IS NOT NULL").groupBy("part", "name").agg(F.count("*").alias("n"))


VOCABULARY = [("bindsModel", "the model that is assessed"), ("bindsRequirement", "the requirement that is substantiated"), ("signature", "who signed"), ("hash", "digest of the content"), ("severity", "how much a finding weighs"), ("measureType", "point or aggregate")]


@query(f"SELECT path, constraint_kind, m.comment AS means, count(*) AS n FROM ({FOUND}) f LEFT JOIN (VALUES {', '.join(map(str, VOCABULARY))}) m(term, comment) ON m.term = f.path GROUP BY ALL")
def sh_13(spark, sf_dir):
    """Violations by path and constraint, with the definition of the term where there is one."""
    found = shapes.violations(shape_triples(spark, sf_dir))
    return shapes.explained(found, spark.createDataFrame(VOCABULARY, "term string, comment string")).groupBy("path", "constraint_kind", "means").agg(F.count("*").alias("n"))

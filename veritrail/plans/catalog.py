"""All registered queries over the evidence model, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.functions import text
from veritrail.operators import graph, judging, rules, stats
from veritrail.session import table

from .evidence import LINE_KEY, evidence, sql, with_sql
from .packs import buckets
from .registry import ORACLES, QUERIES, query, rounded

# ---- rules, findings and their roll-ups ----


def found(spark: SparkSession, sf_dir: str, pack: str | None = None) -> DataFrame:
    parts = buckets(spark, sf_dir)  # what a task holds doesn't grow with the tables
    classes = {n: evidence(spark, sf_dir, n, "package_id", parts) for n in ("results", "factors")}
    return rules.evaluate(evidence(spark, sf_dir, "packages", "package_id", parts), classes, [r for r in rules.RULES if pack in (None, r.pack)])


def found_sql(pack: str | None = None) -> str:
    return rules.sql([r for r in rules.RULES if pack in (None, r.pack)])


CLASSES = ["packages", "results", "factors"]
RANK = "CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 99 END"
COMPOUND = """compounds AS (
  SELECT c.package_id, 'COMPOUND-01' AS pattern_id, 'Critical' AS severity, c.pattern_id || '+' || h.pattern_id AS node
  FROM (SELECT DISTINCT package_id, pattern_id FROM findings WHERE severity = 'Critical') c JOIN (SELECT DISTINCT package_id, pattern_id FROM findings WHERE severity = 'High') h USING (package_id)
  UNION ALL SELECT package_id, 'COMPOUND-03', 'High', CAST(package_id AS STRING) FROM packages WHERE assurance_level <> 'Low' AND package_id IN (SELECT package_id FROM findings WHERE severity = 'Critical'))"""
ROLLUP = f"SELECT package_id, pattern_id, severity, count(*) AS hits, count(DISTINCT node) AS nodes, min(node) AS first_node, {RANK} AS rank FROM"

for _pack in ("core", "nasa", "surrogate", "cards"):
    QUERIES[f"rules_{_pack}"] = lambda spark, sf_dir, pack=_pack: found(spark, sf_dir, pack)
    ORACLES[f"rules_{_pack}"] = with_sql(CLASSES, "SELECT * FROM findings", found_sql(_pack))


@query(with_sql(CLASSES, ROLLUP + " (SELECT * FROM findings UNION ALL SELECT * FROM compounds) GROUP BY ALL", found_sql(), COMPOUND))
def check(spark, sf_dir):
    """The flagship: all rules, then compounds over them, rolled up."""
    return rules.compounded(rules.rollup(found(spark, sf_dir)), evidence(spark, sf_dir, "packages", "package_id", buckets(spark, sf_dir)))


@query(with_sql(CLASSES, "SELECT * FROM compounds", found_sql(), COMPOUND))
def compound(spark, sf_dir):
    return rules.compound(found(spark, sf_dir), evidence(spark, sf_dir, "packages"))


@query(with_sql(CLASSES, ROLLUP + " findings GROUP BY ALL", found_sql("core")))
def ag_1(spark, sf_dir):
    return rules.rollup(found(spark, sf_dir, "core"))


@query(with_sql(CLASSES, "SELECT package_id, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium FROM findings GROUP BY package_id", found_sql()))
def ag_2(spark, sf_dir):
    return found(spark, sf_dir).groupBy("package_id").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("Critical", "High", "Medium")])


@query(with_sql(CLASSES, f"SELECT * FROM ({ROLLUP} findings GROUP BY ALL) ORDER BY rank, hits DESC, package_id, pattern_id LIMIT 50", found_sql()))
def so_2(spark, sf_dir):
    return rules.rollup(found(spark, sf_dir)).orderBy("rank", F.desc("hits"), "package_id", "pattern_id").limit(50)


@query(with_sql(CLASSES, "SELECT package_id, max(rank) AS worst, count(*) AS hits, count(*) FILTER (rank >= 3) AS severe, CASE WHEN count(*) FILTER (rank >= 4) >= 3 THEN 'refuse' WHEN count(*) FILTER (rank >= 3) >= 2 THEN 'restrict' ELSE 'none' END AS action FROM (SELECT *, CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END AS rank FROM findings) GROUP BY package_id", found_sql("core")))
def gr_1(spark, sf_dir):
    """Guardrail: what the severest findings and their number ask for, by two settings of threshold and least hits."""
    return rules.guarded(found(spark, sf_dir, "core"), refuse=("Critical", 3), restrict=("High", 2))


@query(with_sql(CLASSES, "SELECT coalesce(a.pattern_id, b.pattern_id) AS pattern_id, coalesce(a.hits, 0) AS hits_a, coalesce(b.hits, 0) AS hits_b, CASE WHEN b.hits IS NULL THEN 'only_a' WHEN a.hits IS NULL THEN 'only_b' ELSE 'both' END AS side FROM (SELECT pattern_id, count(*) AS hits FROM findings WHERE package_id % 7 = 0 GROUP BY pattern_id) a FULL JOIN (SELECT pattern_id, count(*) AS hits FROM findings WHERE package_id % 7 > 0 GROUP BY pattern_id) b ON a.pattern_id = b.pattern_id", found_sql()))
def j_11(spark, sf_dir):
    """Diff of two sets of findings by pattern: one package in seven against the others."""
    rows = found(spark, sf_dir)
    side = lambda cond, name: rows.where(cond).groupBy("pattern_id").agg(F.count("*").alias(name))
    both = side("package_id % 7 = 0", "a").join(side("package_id % 7 > 0", "b"), "pattern_id", "full_outer")
    return both.select("pattern_id", F.coalesce("a", F.lit(0)).alias("hits_a"), F.coalesce("b", F.lit(0)).alias("hits_b"), F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("both").alias("side"))


@query(with_sql(CLASSES, "SELECT f.package_id, count(*) AS expected, count(*) FILTER (f.factor_status = 'assessed' AND h.node IS NULL) AS evidenced, round(100.0 * count(*) FILTER (f.factor_status = 'assessed' AND h.node IS NULL) / count(*), 6) AS percent FROM factors f LEFT JOIN (SELECT DISTINCT package_id, node FROM findings WHERE severity IN ('Critical', 'High')) h ON h.package_id = f.package_id AND h.node = f.factor_id GROUP BY f.package_id", found_sql("core")))
def ag_3(spark, sf_dir):
    """Completeness: assessed factors without a severe finding, over those expected."""
    hit = found(spark, sf_dir, "core").where("severity IN ('Critical', 'High')").select("package_id", F.col("node").alias("factor_id")).distinct().withColumn("hit", F.lit(True))
    good = F.count_if((F.col("factor_status") == "assessed") & F.col("hit").isNull())
    rows = evidence(spark, sf_dir, "factors").join(hit, ["package_id", "factor_id"], "left").groupBy("package_id").agg(F.count("*").alias("expected"), good.alias("evidenced"))
    return rounded(rows.withColumn("percent", 100.0 * F.col("evidenced") / F.col("expected")))


# ---- graph operators ----

TRIPLES = """triples AS MATERIALIZED (
  SELECT package_id, 'uoa' AS s, 'hasResult' AS p, result_id AS o, 'iri' AS o_kind FROM results
  UNION SELECT package_id, result_id, 'generatedBy', generated_by, 'iri' FROM results WHERE generated_by IS NOT NULL
  UNION SELECT package_id, result_id, 'comparedAgainst', comparator, 'iri' FROM results WHERE comparator IS NOT NULL
  UNION SELECT package_id, generated_by, 'activityType', activity_type, 'lit' FROM results WHERE generated_by IS NOT NULL)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir, "results")
    triple = lambda s, p, o, kind: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    result, made = F.col("result_id"), F.col("generated_by")
    own = F.array(triple(F.lit("uoa"), "hasResult", result, "iri"), triple(result, "generatedBy", made, "iri"), triple(result, "comparedAgainst", F.col("comparator"), "iri"), triple(made, "activityType", F.when(made.isNotNull(), F.col("activity_type")), "lit"))
    return rows.select("package_id", F.explode(F.filter(own, lambda t: t["o"].isNotNull())).alias("t")).select("package_id", "t.*").distinct()


RESULT_LINES = f"(SELECT DISTINCT l_orderkey AS package_id, {LINE_KEY} AS v, l_linestatus, l_suppkey FROM lineitem)"


@query(f"SELECT package_id, v, 'act-' || l_suppkey AS a, 'method-' || l_suppkey % 3 AS kind FROM {RESULT_LINES} WHERE l_linestatus = 'F'")
def j_1(spark, sf_dir):
    """A chain of three patterns."""
    t = triples(spark, sf_dir)
    chain = graph.match(graph.pattern(t, "uoa", "hasResult", "?v"), graph.pattern(t, "?v", "generatedBy", "?a"), graph.pattern(t, "?a", "activityType", "?kind"))
    return chain.select("package_id", "v", "a", "kind")


@query(f"SELECT DISTINCT package_id, v FROM {RESULT_LINES} WHERE (package_id, v) NOT IN (SELECT (package_id, v) FROM {RESULT_LINES} WHERE l_linestatus = 'F')")
def fp_3(spark, sf_dir):
    """Absence of any object."""
    t = triples(spark, sf_dir)
    return graph.absent(graph.pattern(t, "uoa", "hasResult", "?v"), graph.pattern(t, "?v", "generatedBy", "?any").drop("any"))


@query(with_sql(["results"], "SELECT package_id, o AS node, count(*) AS uses FROM triples a WHERE o_kind = 'iri' AND NOT EXISTS (SELECT 1 FROM triples b WHERE b.package_id = a.package_id AND b.s = a.o) GROUP BY ALL", TRIPLES))
def gw_2(spark, sf_dir):
    """Dangling references."""
    return graph.dangling(triples(spark, sf_dir))


PROV = """edges AS (
  SELECT DISTINCT c_nationkey AS package_id, 'c' || CAST(c_custkey AS STRING) AS s, 'n' || CAST(c_nationkey AS STRING) AS o FROM customer
  UNION SELECT n_nationkey, 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING) FROM nation
  UNION SELECT n_nationkey, 'r' || CAST(n_regionkey AS STRING), 'n' || CAST(n_nationkey AS STRING) FROM nation WHERE n_nationkey % 4 = 0),
reached AS (SELECT package_id, s AS start, s AS node FROM edges WHERE s LIKE 'c%' UNION SELECT r.package_id, r.start, e.o FROM reached r JOIN edges e ON r.package_id = e.package_id AND r.node = e.s)"""


@query("WITH RECURSIVE " + PROV + " SELECT * FROM reached r WHERE node <> start AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.package_id = r.package_id AND e.s = r.node)")
def w_prov_01(spark, sf_dir):
    """Ends of provenance chains (with cycles) that have no source of their own."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = customer.select(F.col("c_nationkey").alias("package_id"), name("c", "c_custkey").alias("s"), name("n", "c_nationkey").alias("o"))
    edges = edges.union(nation.select("n_nationkey", name("n", "n_nationkey"), name("r", "n_regionkey"))).union(nation.where("n_nationkey % 4 = 0").select("n_nationkey", name("r", "n_regionkey"), name("n", "n_nationkey"))).distinct()
    ends = graph.reach(edges.where("s LIKE 'c%'").select("package_id", F.col("s").alias("node")), edges)
    return graph.absent(ends.where("node <> start"), edges.select("package_id", F.col("s").alias("node")))


# ---- derivations, goals, shapes ----


@query(with_sql(["packages"], "SELECT package_id, CASE CAST(package_id % 4 AS INT) WHEN 0 THEN 'annual' WHEN 1 THEN 'quarterly' WHEN 2 THEN 'monthly' ELSE 'other' END AS cadence FROM packages WHERE date_diff('day', signature_ts, TIMESTAMP '1998-01-01 00:00:00') > CASE CAST(package_id % 4 AS INT) WHEN 0 THEN 365 WHEN 1 THEN 90 WHEN 2 THEN 30 ELSE 9999 END"))
def drv_4(spark, sf_dir):
    """Overdue audits as of a fixed day; the cadence decides how many days are allowed."""
    rows = evidence(spark, sf_dir, "packages").withColumn("cadence", F.element_at(F.array(*map(F.lit, ("annual", "quarterly", "monthly", "other"))), (F.col("package_id") % 4 + 1).cast("int")))
    allowed = F.when(F.col("cadence") == "annual", 365).when(F.col("cadence") == "quarterly", 90).when(F.col("cadence") == "monthly", 30).otherwise(9999)
    return rows.where(F.date_diff(F.lit("1998-01-01").cast("date"), F.col("signature_ts").cast("date")) > allowed).select("package_id", "cadence")


@query("SELECT p_partkey AS eval_id, 'v' || CAST(p_size % 4 AS STRING) || '.' || CAST(p_size AS STRING) || '.0' AS evaluated, 'v' || CAST(p_partkey % 4 AS STRING) || '.' || CAST(p_partkey % 12 AS STRING) || '.0' AS latest FROM part WHERE (p_size % 4, p_size) < (p_partkey % 4, p_partkey % 12)")
def drv_5(spark, sf_dir):
    """Evaluations of an older version: versions compare as numbers, not as text."""
    version = lambda a, b: F.concat(F.lit("v"), a.cast("string"), F.lit("."), b.cast("string"), F.lit(".0"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("eval_id"), version(F.col("p_size") % 4, F.col("p_size")).alias("evaluated"), version(F.col("p_partkey") % 4, F.col("p_partkey") % 12).alias("latest"))
    parsed = lambda c: F.struct(*[F.try_to_number(F.regexp_extract(c, r"^v?(\d+)\.(\d+)\.(\d+)$", i), F.lit("999999")).alias(f"n{i}") for i in (1, 2, 3)])
    return rows.where(parsed(F.col("evaluated")) < parsed(F.col("latest")))


@query(with_sql(["factors"], "SELECT DISTINCT d.package_id, d.factor_type AS category, e.standard AS eval FROM factors d JOIN (SELECT DISTINCT package_id, standard FROM factors) e USING (package_id) WHERE NOT EXISTS (SELECT 1 FROM factors x WHERE x.package_id = d.package_id AND x.standard = e.standard AND x.factor_type = d.factor_type)"))
def drv_6(spark, sf_dir):
    """Coverage gaps: a category of the package that one of its evaluations lacks, for each evaluation."""
    rows = evidence(spark, sf_dir, "factors").select("package_id", F.col("factor_type").alias("category"), F.col("standard").alias("eval")).distinct()
    wanted = rows.select("package_id", "category").distinct().join(rows.select("package_id", "eval").distinct(), "package_id")
    return wanted.join(rows, ["package_id", "category", "eval"], "left_anti")


@query(with_sql(["errors"], "SELECT e.case_id, e.dim, e.coordinate, n.lo, n.hi FROM errors e JOIN (SELECT p_brand AS dim, quantile_cont(p_retailprice, 0.1) AS lo, quantile_cont(p_retailprice, 0.9) AS hi FROM part GROUP BY p_brand) n USING (dim) WHERE e.coordinate < n.lo OR e.coordinate > n.hi"))
def drv_9(spark, sf_dir):
    """Points outside the declared envelope of their dimension (bounds inclusive)."""
    envelope = stats.quantiles(table(spark, sf_dir, "part").select(F.col("p_brand").alias("dim"), "p_retailprice"), ["dim"], "p_retailprice", lo=0.1, hi=0.9)
    return evidence(spark, sf_dir, "errors").join(envelope, "dim").where("coordinate < lo OR coordinate > hi").select("case_id", "dim", "coordinate", "lo", "hi")


@query(with_sql(["packages", "results"], "SELECT package_id, CASE WHEN max(CASE WHEN generated_by IS NOT NULL THEN 1 ELSE 0 END) = 0 THEN 3 WHEN max(CASE WHEN generated_by IS NOT NULL AND comparator IS NOT NULL THEN 1 ELSE 0 END) = 0 THEN 4 ELSE 5 END AS failed_clause FROM packages LEFT JOIN results USING (package_id) WHERE claim_source IS NOT NULL AND outcome = 'Accepted' GROUP BY package_id HAVING max(CASE WHEN generated_by IS NOT NULL AND comparator IS NOT NULL AND result_uq THEN 1 ELSE 0 END) = 0"))
def oos_1(spark, sf_dir):
    """Goals out of scope: discriminators hold, but no one candidate meets all sufficiency clauses; the first that fails."""
    goals = evidence(spark, sf_dir, "packages").where("claim_source IS NOT NULL AND outcome = 'Accepted'").select("package_id")
    depth = F.when(F.col("generated_by").isNull(), 0).when(F.col("comparator").isNull(), 1).when(F.col("result_uq").isNull(), 2).otherwise(3)
    rows = goals.join(evidence(spark, sf_dir, "results"), "package_id", "left").groupBy("package_id").agg(F.max(depth).alias("depth"))
    return rows.where("depth < 3").select("package_id", (F.col("depth") + 3).cast("int").alias("failed_clause"))


SHAPES = [("minCount", "signature", "signature IS NULL"), ("in", "outcome", "outcome NOT IN ('Accepted')"), ("minCount", "required_method", "required_method IS NULL"), ("maxInclusive", "decision_risk", "decision_risk > 3"), ("pattern", "cou", "cou IS NOT NULL AND NOT regexp_like(cou, '^cou-[0-9]*[0-8]$')"), ("nodeKind", "claim_source", "claim_source IS NULL")]


@query(with_sql(["packages"], " UNION ALL ".join(f"SELECT package_id, '{kind}' AS constraint_kind, '{path}' AS path FROM packages WHERE " + cond.replace("regexp_like", "regexp_matches") for kind, path, cond in SHAPES)))
def sh_2(spark, sf_dir):
    """Shape violations: counts, enumerations, ranges, patterns and kinds, in one pass over the packages."""
    own = [F.when(F.expr(cond), F.struct(F.lit(kind).alias("constraint_kind"), F.lit(path).alias("path"))) for kind, path, cond in SHAPES]
    return evidence(spark, sf_dir, "packages").select("package_id", F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("v")).select("package_id", "v.*")


# ---- aggregation, statistics and windows ----

DECIDED = "SELECT rule, intent, subtlety, fired, valid, others, ms, spec FROM outcomes"


@query(with_sql(["outcomes"], """SELECT rule, targets, bystanders, controls, round(CASE WHEN targets = 0 THEN 0 ELSE t / targets END, 6) AS recall, round(CASE WHEN controls = 0 THEN 0 ELSE f / controls END, 6) AS nc_fpr, round(CASE WHEN bystanders = 0 THEN 0 ELSE b / bystanders END, 6) AS bystander_rate,
round(CASE WHEN t + b + f = 0 THEN 0 ELSE t / (t + b + f) END, 6) AS precision, round(CASE WHEN controls = 0 THEN 0 ELSE 1 - f / controls END, 6) AS specificity FROM (SELECT rule, sum((intent = 'confirm_existing')::INT) AS targets, sum((intent = 'gap_probe')::INT) AS bystanders, sum((intent = 'negative_control')::INT) AS controls,
sum((fired AND intent = 'confirm_existing')::INT)::DOUBLE AS t, sum((fired AND intent = 'gap_probe')::INT)::DOUBLE AS b, sum((fired AND intent = 'negative_control')::INT)::DOUBLE AS f FROM outcomes WHERE valid GROUP BY rule)"""))
def ag_8(spark, sf_dir):
    """Recall, false positives on controls, hits on bystanders, precision over all three, and specificity per rule; invalid rows count nowhere, a rate over nothing is 0."""
    n = lambda intent: F.count_if(F.col("intent") == intent)
    hit = lambda intent: F.count_if((F.col("intent") == intent) & F.col("fired"))
    kinds = {"t": "confirm_existing", "b": "gap_probe", "f": "negative_control"}
    rows = evidence(spark, sf_dir, "outcomes").where("valid").groupBy("rule").agg(*[n(kinds[k]).alias(name) for k, name in (("t", "targets"), ("b", "bystanders"), ("f", "controls"))], *[hit(kinds[k]).alias(k) for k in "tbf"])
    ratio, c = stats.ratio, F.col
    clear = F.when(c("controls") > 0, 1 - c("f") / c("controls")).otherwise(0.0)
    return rounded(rows.select("rule", "targets", "bystanders", "controls", ratio(c("t"), c("targets")).alias("recall"), ratio(c("f"), c("controls")).alias("nc_fpr"), ratio(c("b"), c("bystanders")).alias("bystander_rate"), ratio(c("t"), c("t") + c("b") + c("f")).alias("precision"), clear.alias("specificity")))


@query(with_sql(["outcomes"], """SELECT rule, round(low, 6) AS low, round(medium, 6) AS medium, round(high, 6) AS high, contexts, round(least_, 6) AS least, round(most_, 6) AS most, most_ - least_ >= 0.3 AS context_dependent FROM
(SELECT rule, avg(CASE WHEN subtlety = 'low' THEN CAST(fired AS INT) END) AS low, avg(CASE WHEN subtlety = 'medium' THEN CAST(fired AS INT) END) AS medium, avg(CASE WHEN subtlety = 'high' THEN CAST(fired AS INT) END) AS high FROM outcomes WHERE valid GROUP BY rule)
JOIN (SELECT rule, count(*) AS contexts, min(rate) AS least_, max(rate) AS most_ FROM (SELECT rule, spec % 5 AS cou, avg(CAST(fired AS INT)) AS rate FROM outcomes WHERE valid GROUP BY ALL) GROUP BY rule) USING (rule)"""))
def ag_10(spark, sf_dir):
    """Hit rate per rule and subtlety, pivoted, and over contexts of use: a rule whose rates lie 0.3 or more apart depends on them."""
    rows = evidence(spark, sf_dir, "outcomes").where("valid").withColumn("hit", F.col("fired").cast("int"))
    pivoted = rows.groupBy("rule").pivot("subtlety", ["low", "medium", "high"]).agg(F.avg("hit"))
    rates = rows.groupBy("rule", (F.col("spec") % 5).alias("cou")).agg(F.avg("hit").alias("rate")).groupBy("rule").agg(F.count("*").alias("contexts"), F.min("rate").alias("least"), F.max("rate").alias("most"))
    return rounded(pivoted.join(rates.withColumn("context_dependent", F.col("most") - F.col("least") >= 0.3), "rule"))


@query(with_sql(["outcomes"], "SELECT intent, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS median, round(quantile_cont(ms, 0.95), 6) AS p95 FROM outcomes GROUP BY intent HAVING max(ms) > 0"))
def ag_12(spark, sf_dir):
    """Latency per intent."""
    rows = evidence(spark, sf_dir, "outcomes").select("intent", "ms")
    return rounded(stats.quantiles(rows, ["intent"], "ms", median=0.5, p95=0.95, most=1.0).where("most > 0").drop("most", "n"))


@query(with_sql(["errors"], "SELECT qoi, fired, count(*) AS n, round(avg(abs(predicted - reference)), 4) AS mean, round(quantile_cont(abs(predicted - reference), 0.25), 4) AS q1, round(quantile_cont(abs(predicted - reference), 0.5), 4) AS median, round(quantile_cont(abs(predicted - reference), 0.75), 4) AS q3 FROM errors GROUP BY qoi, fired"))
def ag_13(spark, sf_dir):
    """Error distribution per quantity, fired or not."""
    return rounded(stats.distribution(evidence(spark, sf_dir, "errors").withColumn("error", F.abs(F.col("predicted") - F.col("reference"))), ["qoi", "fired"], "error"), 4)


@query(with_sql(["errors"], "SELECT qoi, round(quantile_cont(CASE WHEN fired THEN abs(predicted - reference) END, 0.5) / nullif(quantile_cont(CASE WHEN NOT fired THEN abs(predicted - reference) END, 0.5), 0), 6) AS ratio FROM errors GROUP BY qoi"))
def ag_14(spark, sf_dir):
    """Ratio of the median errors of fired and unfired cases."""
    error = F.abs(F.col("predicted") - F.col("reference"))
    medians = stats.quantiles(evidence(spark, sf_dir, "errors").select("qoi", "fired", error.alias("error")), ["qoi", "fired"], "error", median=0.5)
    rows = medians.groupBy("qoi").agg(F.max(F.when(F.col("fired"), F.col("median"))).alias("a"), F.max(F.when(~F.col("fired"), F.col("median"))).alias("b"))
    return rounded(rows.select("qoi", stats.ratio(F.col("a"), F.col("b"), None).alias("ratio")))


@query(with_sql(["errors"], "SELECT qoi, count(*) AS n, round(avg(abs(predicted - reference)), 4) AS mean_abs, round(min(abs(predicted - reference)), 4) AS min_abs, round(max(abs(predicted - reference)), 4) AS max_abs, round(sqrt(avg((predicted - reference) * (predicted - reference))), 4) AS rms, round(sqrt(sum((predicted - reference) * (predicted - reference))), 4) AS l2, round(stddev_pop(predicted - reference), 4) AS spread FROM errors GROUP BY qoi"))
def ag_16(spark, sf_dir):
    return rounded(stats.residuals(evidence(spark, sf_dir, "errors"), ["qoi"]), 4)


@query(with_sql(["errors"], "SELECT dim, round(avg(CASE WHEN predicted BETWEEN low AND high THEN 1.0 ELSE 0.0 END), 6) AS coverage, bool_and(coordinate >= 900 AND coordinate <= 999) AS inside FROM errors GROUP BY dim"))
def ag_20(spark, sf_dir):
    """Share of values inside their interval, and whether all points lie in the envelope (ag_19)."""
    return rounded(evidence(spark, sf_dir, "errors").groupBy("dim").agg(F.avg(F.col("predicted").between(F.col("low"), F.col("high")).cast("double")).alias("coverage"), F.bool_and(F.col("coordinate").between(900, 999)).alias("inside")))


TRIOS = """last_of AS (SELECT case_id, judge, arg_max(verdict, seq) AS v, arg_max(confidence, seq) AS c FROM judgments GROUP BY case_id, judge),
trios AS (SELECT case_id, a.v AS va, a.c AS ca, b.v AS vb, b.c AS cb, c.v AS vc, c.c AS cc FROM (FROM last_of WHERE judge = 'A') a JOIN (FROM last_of WHERE judge = 'B') b USING (case_id) JOIN (FROM last_of WHERE judge = 'C') c USING (case_id)),
agreeing AS (SELECT *, CAST(va = 'UNCERTAIN' AS INT) + CAST(vb = 'UNCERTAIN' AS INT) + CAST(vc = 'UNCERTAIN' AS INT) AS unsure, nullif(CASE WHEN va = vb OR va = vc THEN va WHEN vb = vc THEN vb END, 'UNCERTAIN') AS agreed FROM trios),
triaged AS (SELECT *, CASE WHEN unsure >= 2 THEN 'uncertain_majority_kof3' WHEN agreed IS NOT NULL AND (va <> agreed OR ca >= 0.6) AND (vb <> agreed OR cb >= 0.6) AND (vc <> agreed OR cc >= 0.6) THEN 'converged' WHEN agreed IS NOT NULL THEN 'low_conf_concurrence' WHEN unsure = 1 THEN 'two_disagree_one_uncertain' ELSE 'all_three_disagree' END AS reason FROM agreeing)"""


def trios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.trios(evidence(spark, sf_dir, "judgments"))


@query(with_sql(["judgments"], "SELECT case_id, va, vb, vc, unsure, agreed, reason, CASE WHEN reason = 'converged' THEN 'CONVERGENT' ELSE 'DISAGREEMENT' END AS bucket, (va <> 'UNCERTAIN' AND ca < 0.5) OR (vb <> 'UNCERTAIN' AND cb < 0.5) OR (vc <> 'UNCERTAIN' AND cc < 0.5) AS low_confidence FROM triaged", TRIOS))
def jd_1(spark, sf_dir):
    return judging.triage(trios(spark, sf_dir)).drop("ca", "cb", "cc")


@query(with_sql(["judgments"], "SELECT case_id, coalesce(o.verdict, r.verdict, CASE WHEN reason = 'converged' THEN agreed END) AS verdict, CASE WHEN o.verdict IS NOT NULL THEN 'AUTHOR_OVERRIDE' WHEN r.verdict IS NOT NULL THEN 'ARBITRATED' WHEN reason = 'converged' THEN 'CONVERGENT' ELSE 'UNRESOLVED' END AS route FROM triaged LEFT JOIN (SELECT case_id, arg_max(verdict, seq) AS verdict FROM judgments WHERE case_id % 10 = 0 GROUP BY case_id) o USING (case_id) LEFT JOIN (SELECT case_id, arg_max(verdict, confidence) AS verdict, max(confidence) AS confidence FROM judgments WHERE case_id % 3 = 0 GROUP BY case_id HAVING max(confidence) >= 0.6) r USING (case_id)", TRIOS))
def jd_5(spark, sf_dir):
    """Final verdicts by precedence."""
    all_ = evidence(spark, sf_dir, "judgments")
    overrides = stats.last_wins(all_.where("case_id % 10 = 0").select("case_id", "verdict", "seq"), ["case_id"], "seq")
    arbitrated = all_.where("case_id % 3 = 0").groupBy("case_id").agg(F.max_by("verdict", "confidence").alias("verdict"), F.max("confidence").alias("confidence"))
    return judging.final(judging.triage(trios(spark, sf_dir)), overrides, arbitrated)


@query(with_sql(["judgments"], " UNION ALL ".join(f"SELECT '{a}{b}' AS pair, n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, two FROM (SELECT count(*) AS n, avg(CAST(v{a} = v{b} AS INT)) AS po, (SELECT sum(x.n * y.n) FROM (SELECT v{a} AS v, count(*) AS n FROM trios GROUP BY v) x JOIN (SELECT v{b} AS v, count(*) AS n FROM trios GROUP BY v) y USING (v)) / (count(*) * count(*)) AS pe, count(*) FILTER (va = vb OR va = vc OR vb = vc) AS two FROM trios)" for a, b in ("ab", "ac", "bc")), TRIOS))
def ag_21(spark, sf_dir):
    """Cohen's kappa of each pair of judges, and in how many cases two of the three agree."""
    rows = trios(spark, sf_dir)
    two = rows.agg(F.count_if(F.expr("va = vb OR va = vc OR vb = vc")).alias("two")).withColumn("k", F.lit(1))
    pairs = [stats.kappa(rows, f"v{a}", f"v{b}").withColumn("pair", F.lit(a + b)) for a, b in ("ab", "ac", "bc")]
    every = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).withColumn("k", F.lit(1))
    return rounded(every.join(two, "k").drop("k"))


VERDICTS = ("CONFIRM", "OUT-OF-SCOPE", "REAL-GAP", "UNCERTAIN")
_N = [f"(CAST(va = '{v}' AS INT) + CAST(vb = '{v}' AS INT) + CAST(vc = '{v}' AS INT))" for v in VERDICTS]


@query(with_sql(["judgments"], f"SELECT n, round(p, 6) AS agreement, round((p - pe) / (1 - pe), 6) AS kappa FROM (SELECT count(*) AS n, avg(({' + '.join(f'{x} * ({x} - 1)' for x in _N)}) / 6.0) AS p, {' + '.join(f'power(sum({x}) / (3.0 * count(*)), 2)' for x in _N)} AS pe FROM trios)", TRIOS))
def ag_21_fleiss(spark, sf_dir):
    """Fleiss' kappa of all three."""
    v = F.array("va", "vb", "vc")
    rows = trios(spark, sf_dir).select(*[F.size(F.filter(v, lambda x: x == own)).alias(f"n{i}") for i, own in enumerate(VERDICTS)])
    return rounded(stats.fleiss(rows, [f"n{i}" for i in range(len(VERDICTS))]))


@query(with_sql(["outcomes"], f"SELECT rule, k, n, round(greatest(0.0, (k / n + {stats.Z**2} / (2 * n)) / (1 + {stats.Z**2} / n) - {stats.Z} * sqrt((k / n) * (1 - k / n) / n + {stats.Z**2} / (4.0 * n * n)) / (1 + {stats.Z**2} / n)), 6) AS low, round(least(1.0, (k / n + {stats.Z**2} / (2 * n)) / (1 + {stats.Z**2} / n) + {stats.Z} * sqrt((k / n) * (1 - k / n) / n + {stats.Z**2} / (4.0 * n * n)) / (1 + {stats.Z**2} / n)), 6) AS high FROM (SELECT rule, count(*) FILTER (fired) AS k, count(*) AS n FROM outcomes GROUP BY rule)"))
def ag_22(spark, sf_dir):
    """Wilson intervals of the hit rate per rule."""
    rows = evidence(spark, sf_dir, "outcomes").groupBy("rule").agg(F.count_if("fired").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rounded(rows.select("rule", "k", "n", low.alias("low"), high.alias("high")))


@query(with_sql(["judgments"], "SELECT judge, sum(n) AS records, count(*) AS cases, sum(n) - count(*) AS extra, count(*) FILTER (f <> l) AS conflicts FROM (SELECT judge, case_id, count(*) AS n, arg_min(verdict, seq) AS f, arg_max(verdict, seq) AS l FROM judgments GROUP BY ALL) GROUP BY judge"))
def ag_24(spark, sf_dir):
    """Retries per judge: extra records and cases whose first and last verdicts differ."""
    rows = evidence(spark, sf_dir, "judgments").groupBy("judge", "case_id").agg(F.count("*").alias("n"), F.min_by("verdict", "seq").alias("f"), F.max_by("verdict", "seq").alias("l"))
    return rows.groupBy("judge").agg(F.sum("n").alias("records"), F.count("*").alias("cases"), (F.sum("n") - F.count("*")).alias("extra"), F.count_if(F.col("f") != F.col("l")).alias("conflicts"))


@query("""WITH swept AS (SELECT t, count(*) FILTER (value >= t * 500 AND event_type = 'error')::DOUBLE AS tp, count(*) FILTER (value >= t * 500)::DOUBLE AS p, count(*) FILTER (event_type = 'error')::DOUBLE AS n, count(*)::DOUBLE AS total FROM events, (SELECT x / 100.0::DOUBLE AS t FROM range(15, 66, 5) r(x)) GROUP BY t)
SELECT t AS threshold, tp::BIGINT AS tp, round(CASE WHEN p = 0 THEN 0 ELSE tp / p END, 6) AS precision, round(CASE WHEN n = 0 THEN 0 ELSE tp / n END, 6) AS recall, round(CASE WHEN p + n = 0 THEN 0 ELSE 2 * tp / (p + n) END, 6) AS f1, round(CASE WHEN total + n = 0 THEN 0 ELSE 2 * n / (total + n) END, 6) AS control_f1 FROM swept""")
def ag_33(spark, sf_dir):
    """Threshold sweep in one pass: each row counts towards every threshold it reaches; the control says yes to all."""
    steps = [x / 100.0 for x in range(15, 66, 5)]
    flags = [F.struct(F.lit(t).alias("threshold"), (F.col("value") >= t * 500).alias("yes")) for t in steps]
    rows = table(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("truth"), F.explode(F.array(*flags)).alias("s")).select("truth", "s.*")
    sums = rows.groupBy("threshold").agg(F.count_if(F.expr("truth AND yes")).alias("tp"), F.count_if("yes").alias("p"), F.count_if("truth").alias("n"), F.count("*").alias("total"))
    c = F.col
    return rounded(sums.select("threshold", "tp", stats.ratio(c("tp"), c("p")).alias("precision"), stats.ratio(c("tp"), c("n")).alias("recall"), stats.ratio(2.0 * c("tp"), c("p") + c("n")).alias("f1"), stats.ratio(2.0 * c("n"), c("total") + c("n")).alias("control_f1")))


@query("SELECT quality, CASE WHEN w < 200 THEN '0-199' WHEN w < 800 THEN '200-799' WHEN w < 2000 THEN '800-1999' ELSE '2000+' END AS band, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM (SELECT quality, len(string_split(text, ' ')) AS w FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
def ag_39(spark, sf_dir):
    """Strata of a sampling frame: label and half-open word bands."""
    w = F.size(F.split("text", " "))
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("quality", F.when(w < 200, "0-199").when(w < 800, "200-799").when(w < 2000, "800-1999").otherwise("2000+").alias("band"))
    sums = rows.groupBy("quality", "band").agg(F.count("*").alias("n"))
    return rounded(sums.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())), 2)


@query(with_sql(["factors"], "SELECT factor_type, achieved_level - required_level AS gap, count(*) AS n FROM factors WHERE achieved_level IS NOT NULL AND required_level IS NOT NULL GROUP BY ALL"))
def ag_27(spark, sf_dir):
    """Shortfalls of levels; a missing side counts nowhere."""
    return evidence(spark, sf_dir, "factors").withColumn("gap", F.col("achieved_level") - F.col("required_level")).where("gap IS NOT NULL").groupBy("factor_type", "gap").agg(F.count("*").alias("n"))


@query(with_sql(["errors"], "SELECT dim, band, count(*) AS n, round(avg(abs(predicted - reference)), 4) AS mean FROM (SELECT *, CASE WHEN place < n // 3 THEN 0 WHEN place < 2 * n // 3 THEN 1 ELSE 2 END AS band FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY thickness, case_id) - 1 AS place, count(*) OVER (PARTITION BY dim) AS n FROM errors)) GROUP BY dim, band"))
def wn_3(spark, sf_dir):
    """Errors per third of the cases of a dimension, by thickness."""
    rows = stats.bands(evidence(spark, sf_dir, "errors"), ["thickness", "case_id"], "dim")
    return rounded(rows.groupBy("dim", "band").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("predicted") - F.col("reference"))).alias("mean")), 4)


@query(with_sql(["errors"], "SELECT dim, round(corr(a, b), 6) AS rho FROM (SELECT dim, row_number() OVER (PARTITION BY dim ORDER BY thickness, case_id) AS a, row_number() OVER (PARTITION BY dim ORDER BY abs(predicted - reference), case_id) AS b FROM errors) GROUP BY dim"))
def ag_35(spark, sf_dir):
    """Rank correlation per dimension, with ordinal ranks."""
    rows = evidence(spark, sf_dir, "errors").withColumn("error", F.abs(F.col("predicted") - F.col("reference")))
    first = stats.ranked(rows.select("dim", "case_id", "thickness", "error"), ["dim"], ["thickness", "case_id"], "a", "n")
    both = stats.ranked(first.drop("n"), ["dim"], ["error", "case_id"], "b", "n")
    return rounded(both.groupBy("dim").agg(F.corr("a", "b").alias("rho")))


@query("""SELECT user_id, event_id, count(*) OVER hour AS calls, round(sum(value) OVER hour, 4) AS tokens, round(sum(value) OVER minute, 4) AS recent, count(*) OVER hour <= 8 AND round(sum(value) OVER minute, 4) <= 300 AS within
FROM events WINDOW hour AS (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW), minute AS (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)""")
def wn_8(spark, sf_dir):
    """Calls and tokens of the last hour and tokens of the last minute at each call, and whether both caps hold."""
    by = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    hour, minute = by.rangeBetween(-3600, 0), by.rangeBetween(-60, 0)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.count("*").over(hour).alias("calls"), F.sum("value").over(hour).alias("tokens"), F.sum("value").over(minute).alias("recent"))
    return rounded(rounded(rows, 4).withColumn("within", (F.col("calls") <= 8) & (F.col("recent") <= 300)), 4)


@query("SELECT vec_id, score FROM (SELECT a.vec_id, round(1.0 / (60 + a.r) + 1.0 / (60 + b.r), 9) AS score FROM (SELECT vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) - 1 AS r FROM embeddings) a JOIN (SELECT vec_id, row_number() OVER (ORDER BY embedding[2] DESC, vec_id) - 1 AS r FROM embeddings) b USING (vec_id)) ORDER BY score DESC, vec_id LIMIT 20")
def wn_5(spark, sf_dir):
    """Reciprocal rank fusion of two whole rankings; the best twenty."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (-F.col("embedding")[0]).alias("x"), (-F.col("embedding")[1]).alias("y"), F.lit(0).alias("all"))
    first = stats.ranked(rows, ["all"], ["x", "vec_id"], "a", "n").drop("n")
    both = stats.ranked(first, ["all"], ["y", "vec_id"], "b", "n")
    return both.select("vec_id", F.round(1.0 / (60 + F.col("a")) + 1.0 / (60 + F.col("b")), 9).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query("SELECT a.vec_id, b.vec_id AS query_id, round(list_cosine_similarity(a.embedding, b.embedding), 4) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding, b.embedding) >= 0.3")
def ma_7(spark, sf_dir):
    """Cosine of vectors and the stated queries of their label."""
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y.cast("double") * y)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", unit(F.col("embedding")).alias("u"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("u").alias("v"))
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.join(asked, "label").where("vec_id <> query_id").select("vec_id", "query_id", F.round(dot, 4).alias("cosine"), dot.alias("raw")).where("raw >= 0.3").drop("raw")


# ---- corroboration and text ----


@query("SELECT p_partkey, CASE WHEN f.price IS NULL THEN 'claim-only' WHEN c.p_partkey % 9 = 0 THEN 'not-comparable' WHEN abs(c.p_retailprice - f.price) <= 0.05 * greatest(abs(c.p_retailprice), abs(f.price), 1e-30) THEN 'agrees' ELSE 'diverges' END AS verdict, round(f.price, 2) AS reading FROM part c LEFT JOIN (SELECT DISTINCT l_partkey, floor(l_extendedprice / l_quantity * 100) / 100 AS price FROM lineitem) f ON f.l_partkey = c.p_partkey")
def cr_1(spark, sf_dir):
    """Claims against distinct readings, with a relative tolerance; claims without a reading stay."""
    facts = table(spark, sf_dir, "lineitem").select("l_partkey", (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("price")).distinct()
    rows = table(spark, sf_dir, "part").join(facts, F.col("p_partkey") == F.col("l_partkey"), "left")
    near = F.abs(F.col("p_retailprice") - F.col("price")) <= 0.05 * F.greatest(F.abs("p_retailprice"), F.abs("price"), F.lit(1e-30))
    return rows.select("p_partkey", F.when(F.col("price").isNull(), "claim-only").when(F.col("p_partkey") % 9 == 0, "not-comparable").when(near, "agrees").otherwise("diverges").alias("verdict"), F.round("price", 2).alias("reading"))


@query("SELECT l_partkey, count(DISTINCT l_linenumber) AS readings FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_linenumber) > 1")
def ag_5(spark, sf_dir):
    """Keys with more than one distinct reading."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_linenumber").alias("readings")).where("readings > 1")


@query(r"SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS scope, regexp_extract(url, '([^#/]*)$', 1) AS local_name FROM pages")
def tx_2(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.scope(F.col("url")).alias("scope"), text.local_name(F.col("url")).alias("local_name"))


FURNITURE = r"""CASE WHEN trim(line) = '' THEN 'empty' WHEN length(regexp_replace(line, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace(line, '[^A-Z]', '', 'g')) > 0.7 * length(regexp_replace(line, '[^A-Za-z]', '', 'g')) THEN 'heading' WHEN contains(line, ' | ') THEN 'table-row' WHEN len(list_filter(string_split(trim(regexp_replace(lower(line), '[ \t\r\n\f]+', ' ', 'g')), ' '), lambda w: w <> '')) < 6 THEN 'fragment' WHEN regexp_matches(line, '^\[[0-9]+\]') THEN 'reference' END"""


@query(f"SELECT reason, count(*) AS lines FROM (SELECT coalesce({FURNITURE}, 'prose') AS reason FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY reason")
def tx_6(spark, sf_dir):
    """Lines of all documents by what they are."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(F.coalesce(text.furniture(F.col("line")), F.lit("prose")).alias("reason")).groupBy("reason").agg(F.count("*").alias("lines"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def tx_11(spark, sf_dir):
    """Documents that quote an item literally: items are found by words 2 to 7, then compared whole.

    The words make it an equi-join; every document gives each of its six-word runs once. The first and the last word of
    an item may be parts of words in a document, so items of less than eight words are found by the longest word between
    them, and those of one or two words by a search of all documents.
    """
    inner = F.array_sort(F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))), lambda a, b: F.length(b) - F.length(a))
    key = lambda c: F.array_join(F.slice(F.split(c, "[ \n]"), 2, 6), " ")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"), key(F.col("text")).alias("key"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", "[ \n]").alias("w"))
    runs = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 5)), lambda i: F.array_join(F.slice("w", i, 6), " ")))).alias("key"))
    sized = items.withColumn("w", F.split("quote", "[ \n]")).withColumn("n", F.size("w"))
    hits = runs.join(sized.where("n >= 8").select("item_id", "key"), "key").select("item_id", "doc_id")
    middle = sized.where("n BETWEEN 3 AND 7").select("item_id", inner[0].alias("key"))
    hits = hits.union(docs.select("doc_id", F.explode(F.array_distinct("w")).alias("key")).join(middle, "key").select("item_id", "doc_id"))
    hits = hits.union(docs.join(sized.where("n < 3").select("item_id", "quote"), F.contains("text", "quote")).select("item_id", "doc_id")).distinct()
    return hits.join(items, "item_id").join(docs, "doc_id").where(F.contains("text", "quote")).select("item_id", "doc_id")


@query("SELECT norm, count(*) AS repeats, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, trim(regexp_replace(lower(line), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE norm <> '' AND len(string_split(norm, ' ')) <= 14 GROUP BY norm HAVING count(*) >= 3")
def wn_10(spark, sf_dir):
    """Running heads: short lines that occur three times or more."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", text.squash(F.col("line")).alias("norm"))
    return lines.where((F.col("norm") != "") & (F.size(F.split("norm", " ")) <= 14)).groupBy("norm").agg(F.count("*").alias("repeats"), F.countDistinct("doc_id").alias("docs")).where("repeats >= 3")


@query("SELECT doc_id, sum(CAST(ceil(length(p) / 300.0) AS BIGINT)) AS chunks FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS p FROM documents) WHERE length(p) >= 40 GROUP BY doc_id")
def tx_22(spark, sf_dir):
    """Chunks per document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.chunks(F.col("text"))).alias("chunk")).groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("SELECT doc_id, sha256(text) AS digest, substr(sha256(lang || chr(0) || source || chr(0) || CAST(n_chars AS STRING)), 1, 32) AS cache_key FROM documents")
def hash_5(spark, sf_dir):
    """Digests of texts, and cache keys of NUL-joined parts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.substring(F.sha2(F.concat_ws("\0", "lang", "source", F.col("n_chars").cast("string")), 256), 1, 32).alias("cache_key"))


@query(with_sql(["outcomes"], "SELECT case_id, CASE WHEN NOT valid THEN 'GEN-INVALID' WHEN intent = 'negative_control' THEN CASE WHEN fired OR others > 0 THEN 'CLEAN-WRONG' ELSE 'CLEAN-CORRECT' END WHEN fired AND others = 0 THEN 'COV-HIT' WHEN fired THEN 'HIT-PLUS' WHEN others > 0 THEN 'WRONG' ELSE 'MISS' END AS class FROM outcomes"))
def jd_10(spark, sf_dir):
    """Outcome classes."""
    c = F.when(~F.col("valid"), "GEN-INVALID").when((F.col("intent") == "negative_control") & (F.col("fired") | (F.col("others") > 0)), "CLEAN-WRONG").when(F.col("intent") == "negative_control", "CLEAN-CORRECT")
    return evidence(spark, sf_dir, "outcomes").select("case_id", c.when(F.col("fired") & (F.col("others") == 0), "COV-HIT").when(F.col("fired"), "HIT-PLUS").when(F.col("others") > 0, "WRONG").otherwise("MISS").alias("class"))


@query(with_sql(["outcomes"], "SELECT spec, CAST(ts AS DATE) AS day, round(sum(cost), 4) AS cost, sum(cost) > 5 AS over_budget FROM outcomes GROUP BY ALL"))
def ag_32(spark, sf_dir):
    """Costs per specification and day, against a budget."""
    rows = evidence(spark, sf_dir, "outcomes").groupBy("spec", F.col("ts").cast("date").alias("day")).agg(F.sum("cost").alias("raw"))
    return rows.select("spec", "day", F.round("raw", 4).alias("cost"), (F.col("raw") > 5).alias("over_budget"))


__all__ = ["ORACLES", "QUERIES", "sql"]

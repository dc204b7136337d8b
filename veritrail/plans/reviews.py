"""Registered queries of reviews: set comparisons of runs, calibration, arbitration, units and catalogue checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.operators import judging, stats
from veritrail.session import table

from .catalog import TRIOS, trios
from .evidence import LINE_KEY, evidence, with_sql
from .registry import query, rounded

# ---- runs compared by the patterns that fired ----

#: Patterns that the change under review touches.
AFFECTED = ("W-1", "W-3", "W-5")
RUNS = "runs AS (SELECT others AS cou, list_sort(list(DISTINCT rule) FILTER (subtlety = 'low' AND fired AND ms > 150)) AS a, list_sort(list(DISTINCT rule) FILTER (subtlety = 'high' AND fired AND ms > 150)) AS b FROM outcomes GROUP BY others)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per context of use, the patterns of run a and of run b; a run without any is null."""
    rows = evidence(spark, sf_dir, "outcomes").where("fired AND ms > 150").groupBy(F.col("others").alias("cou"))
    patterns = lambda level: F.collect_set(F.when(F.col("subtlety") == level, F.col("rule")))
    sets = rows.agg(patterns("low").alias("a"), patterns("high").alias("b"))
    return sets.select("cou", *[F.when(F.size(c) > 0, F.array_sort(c)).alias(c) for c in "ab"])


def joined(c: Column) -> Column:
    return F.array_join(F.array_sort(c), ",")


@query(with_sql(["outcomes"], "SELECT cou, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS gained, CAST(len(b) - len(a) AS INT) AS delta FROM runs WHERE a IS NOT NULL AND b IS NOT NULL", RUNS))
def set_4(spark, sf_dir):
    """New patterns of the second run and the change in number; contexts that lack a run are dropped."""
    rows = runs(spark, sf_dir).where("a IS NOT NULL AND b IS NOT NULL")
    return rows.select("cou", joined(F.array_except("b", "a")).alias("gained"), (F.size("b") - F.size("a")).alias("delta"))


@query(with_sql(["outcomes"], "SELECT cou, array_to_string(list_sort(list_concat(list_filter(a, lambda x: x NOT IN ('W-1', 'W-3', 'W-5')), list_filter(b, lambda x: x IN ('W-1', 'W-3', 'W-5')))), ',') AS spliced FROM runs WHERE a IS NOT NULL AND b IS NOT NULL", RUNS))
def set_5(spark, sf_dir):
    """The baseline with the affected patterns taken from the new run."""
    own = F.array(*map(F.lit, AFFECTED))
    rows = runs(spark, sf_dir).where("a IS NOT NULL AND b IS NOT NULL")
    return rows.select("cou", joined(F.array_union(F.array_except("a", own), F.array_intersect("b", own))).alias("spliced"))


@query(with_sql(["outcomes"], "SELECT CAST(s AS INT) AS sentinel, CASE WHEN a IS NULL THEN 'missing' WHEN 'W-1' IN a OR 'W-3' IN a OR 'W-5' IN a THEN 'overlaps' ELSE 'intact' END AS state FROM range(0, 6) r(s) LEFT JOIN runs ON cou = s", RUNS))
def set_12(spark, sf_dir):
    """Sentinels: missing from the baseline, or not disjoint (set_8) from what the change affects."""
    rows = spark.range(6).select(F.col("id").cast("int").alias("sentinel")).join(runs(spark, sf_dir).withColumnRenamed("cou", "sentinel"), "sentinel", "left")
    state = F.when(F.col("a").isNull(), "missing").when(F.arrays_overlap("a", F.array(*map(F.lit, AFFECTED))), "overlaps").otherwise("intact")
    return rows.select("sentinel", state.alias("state"))


@query(with_sql(["outcomes"], "SELECT 'W-' || i AS pattern_id FROM range(0, 10) r(i) WHERE NOT EXISTS (SELECT 1 FROM outcomes WHERE rule = 'W-' || i)"))
def set_10(spark, sf_dir):
    """Declared patterns that the catalogue lacks."""
    declared = spark.range(10).select(F.concat(F.lit("W-"), F.col("id").cast("string")).alias("pattern_id"))
    return declared.join(evidence(spark, sf_dir, "outcomes").select(F.col("rule").alias("pattern_id")), "pattern_id", "left_anti")


@query("SELECT a.n_nationkey AS first, b.n_nationkey AS second, a.n_regionkey AS family FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def set_9(spark, sf_dir):
    """Pairs of judges of one family, each once; the panel is small."""
    nation = table(spark, sf_dir, "nation")
    side = lambda name: nation.select(F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias(name))
    return side("first").join(side("second"), "family").where("first < second").select("first", "second", "family")


@query(with_sql(["outcomes"], "SELECT rule, count(*) AS pairs, round(avg(b.rate - a.rate), 6) AS difference FROM (SELECT rule, spec, avg(CAST(fired AS INT)) AS rate FROM outcomes WHERE subtlety = 'low' GROUP BY ALL) a JOIN (SELECT rule, spec, avg(CAST(fired AS INT)) AS rate FROM outcomes WHERE subtlety = 'high' GROUP BY ALL) b USING (rule, spec) GROUP BY rule"))
def j_10(spark, sf_dir):
    """Two conditions compared on the specifications that both have."""
    rate = lambda level: F.avg(F.when(F.col("subtlety") == level, F.col("fired").cast("int")))
    rows = evidence(spark, sf_dir, "outcomes").groupBy("rule", "spec").agg(rate("low").alias("a"), rate("high").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return rounded(rows.groupBy("rule").agg(F.count("*").alias("pairs"), F.avg(F.col("b") - F.col("a")).alias("difference")))


# ---- judgements ----


@query(with_sql(["judgments"], "SELECT verdict, count(*) AS n FROM judgments GROUP BY verdict"))
def ag_6(spark, sf_dir):
    """Verdict counts."""
    return evidence(spark, sf_dir, "judgments").groupBy("verdict").agg(F.count("*").alias("n"))


@query(with_sql(["judgments"], "SELECT judge, CAST(least(floor(confidence * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(CAST(verdict = 'CONFIRM' AS INT)), 6) AS accuracy, round(abs(avg(confidence) - avg(CAST(verdict = 'CONFIRM' AS INT))) * count(*) / sum(count(*)) OVER (PARTITION BY judge), 6) AS share FROM judgments GROUP BY judge, least(floor(confidence * 10), 9)"))
def ag_37(spark, sf_dir):
    """Calibration of each judge in bins of confidence; the shares of a judge add up to the expected calibration error."""
    right = F.avg((F.col("verdict") == "CONFIRM").cast("int"))
    rows = evidence(spark, sf_dir, "judgments").groupBy("judge", F.least(F.floor(F.col("confidence") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), right.alias("accuracy"))
    return rounded(rows.withColumn("share", F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n") / F.sum("n").over(Window.partitionBy("judge"))))


@query(with_sql(["judgments"], "SELECT c.case_id, CASE WHEN t.case_id IS NULL THEN 'skipped' WHEN t.reason = 'converged' THEN 'settled' WHEN r.confidence >= 0.6 THEN 'arbitrated' ELSE 'escalated' END AS state FROM (SELECT DISTINCT case_id FROM judgments) c LEFT JOIN triaged t USING (case_id) LEFT JOIN (SELECT case_id, max(confidence) AS confidence FROM judgments WHERE judge = 'C' GROUP BY case_id) r USING (case_id)", TRIOS))
def jd_4(spark, sf_dir):
    """What becomes of each case: without all three judges skipped, else settled, arbitrated at the floor or above, or escalated."""
    all_ = evidence(spark, sf_dir, "judgments")
    cases = all_.groupBy("case_id").agg(F.max(F.when(F.col("judge") == "C", F.col("confidence"))).alias("confidence"))
    rows = cases.join(judging.triage(trios(spark, sf_dir)).select("case_id", "reason"), "case_id", "left")
    state = F.when(F.col("reason").isNull(), "skipped").when(F.col("reason") == "converged", "settled").when(F.col("confidence") >= 0.6, "arbitrated").otherwise("escalated")
    return rows.select("case_id", state.alias("state"))


@query(with_sql(["judgments"], "SELECT judge, verdict, count(*) AS n, count(*) FILTER (seq % 5 = 0) AS canonical FROM judgments GROUP BY judge, verdict HAVING count(*) <> 5 OR count(*) FILTER (seq % 5 = 0) <> 1 OR verdict NOT IN ('CONFIRM', 'OUT-OF-SCOPE', 'REAL-GAP', 'UNCERTAIN')"))
def jd_7(spark, sf_dir):
    """Classes of a calibration set that do not have five records, one of them canonical, and a known verdict."""
    rows = evidence(spark, sf_dir, "judgments").groupBy("judge", "verdict").agg(F.count("*").alias("n"), F.count_if(F.col("seq") % 5 == 0).alias("canonical"))
    return rows.where("n <> 5 OR canonical <> 1 OR verdict NOT IN ('CONFIRM', 'OUT-OF-SCOPE', 'REAL-GAP', 'UNCERTAIN')")


# ---- factors, envelopes, units ----


@query(with_sql(["outcomes"], "SELECT rule, round(coalesce(count(*) FILTER (fired AND intent = 'confirm_existing') / nullif(count(*) FILTER (fired), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (fired AND intent = 'negative_control') / nullif(count(*) FILTER (intent = 'negative_control'), 0), 0), 6) AS nc_fpr FROM outcomes WHERE valid GROUP BY rule"))
def ag_11(spark, sf_dir):
    """Precision of each rule, those that fire most on controls first."""
    n = lambda cond: F.count_if(F.expr(cond))
    rows = evidence(spark, sf_dir, "outcomes").where("valid").groupBy("rule").agg(stats.ratio(n("fired AND intent = 'confirm_existing'"), n("fired")).alias("precision"), stats.ratio(n("fired AND intent = 'negative_control'"), n("intent = 'negative_control'")).alias("nc_fpr"))
    return rounded(rows).orderBy(F.desc("nc_fpr"), "rule")


@query("SELECT n_nationkey AS region, bool_and(p_brand NOT LIKE '%1' AND lo >= 910 AND hi <= 1900) FILTER (p_brand IS NOT NULL) AS spanned FROM nation LEFT JOIN (SELECT p_size, p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY ALL) ON p_size = n_nationkey GROUP BY n_nationkey")
def ag_18(spark, sf_dir):
    """Whether an envelope spans all dimensions of a region: an unknown dimension says no, a region without any is null."""
    part = table(spark, sf_dir, "part")
    envelope = part.where("p_brand NOT LIKE '%1'").select(F.col("p_brand").alias("dim")).distinct().select("dim", F.lit(910.0).alias("least"), F.lit(1900.0).alias("most"))
    dims = part.groupBy(F.col("p_size").alias("region"), F.col("p_brand").alias("dim")).agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    inside = dims.join(envelope, "dim", "left").select("region", F.coalesce(F.expr("lo >= least AND hi <= most"), F.lit(False)).alias("inside"))
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region"))
    return regions.join(inside, "region", "left").groupBy("region").agg(F.bool_and("inside").alias("spanned"))


@query(with_sql(["factors"], "SELECT standard, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, level_matches FROM (SELECT standard, count(*) FILTER (required_level IS NOT NULL AND achieved_level IS NOT NULL) AS tp, count(*) FILTER (required_level IS NULL AND achieved_level IS NOT NULL) AS fp, count(*) FILTER (required_level IS NOT NULL AND achieved_level IS NULL) AS fn, count(*) FILTER (abs(required_level - achieved_level) <= 1) AS level_matches FROM factors GROUP BY standard)"))
def ag_26(spark, sf_dir):
    """Micro precision, recall and F1 of extracted levels; extras are false positives, levels match within one."""
    want, got = F.col("required_level").isNotNull(), F.col("achieved_level").isNotNull()
    sums = evidence(spark, sf_dir, "factors").groupBy("standard").agg(F.count_if(want & got).alias("tp"), F.count_if(~want & got).alias("fp"), F.count_if(want & ~got).alias("fn"), F.count_if(F.abs(F.col("required_level") - F.col("achieved_level")) <= 1).alias("level_matches"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rounded(sums.select("standard", "tp", "fp", "fn", stats.ratio(tp, tp + fp).alias("precision"), stats.ratio(tp, tp + fn).alias("recall"), stats.ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "level_matches"))


@query(with_sql(["factors"], "SELECT package_id, factor_id, factor_type FROM factors WHERE coalesce(standard, 'vv40') = 'vv40' AND factor_type NOT IN ('LARGE', 'MEDIUM', 'SMALL')"))
def sh_8(spark, sf_dir):
    """Factor names outside the list of their standard; a factor without a standard is held to the first one."""
    rows = evidence(spark, sf_dir, "factors").where(F.coalesce("standard", F.lit("vv40")) == "vv40")
    return rows.where(~F.col("factor_type").isin("LARGE", "MEDIUM", "SMALL")).select("package_id", "factor_id", "factor_type")


@query(with_sql(["factors"], "SELECT package_id, factor_id FROM factors WHERE standard = 'nasa' AND criteria IS NULL"))
def sh_10(spark, sf_dir):
    """Factors of the standard that asks for a phase, without one."""
    return evidence(spark, sf_dir, "factors").where("standard = 'nasa' AND criteria IS NULL").select("package_id", "factor_id")


#: Millimetres in a unit. Any other unit is not comparable.
UNITS = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4}


@query(f"SELECT {LINE_KEY} AS reading, unit, round(l_quantity * CASE unit WHEN 'mm' THEN 1.0::DOUBLE WHEN 'cm' THEN 10.0::DOUBLE WHEN 'in' THEN 25.4::DOUBLE END, 6) AS mm FROM (SELECT *, ['mm', 'cm', 'in', 'cubit'][l_linenumber % 4 + 1] AS unit FROM lineitem)")
def ma_1(spark, sf_dir):
    """Readings in one unit, by the declared table only; null for a unit that isn't in it."""
    unit = F.element_at(F.array(*map(F.lit, ("mm", "cm", "in", "cubit"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    factor = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    rows = table(spark, sf_dir, "lineitem").select(F.expr(LINE_KEY).alias("reading"), unit.alias("unit"), F.col("l_quantity").cast("double").alias("q"))
    return rounded(rows.select("reading", "unit", (F.col("q") * F.try_element_at(factor, F.col("unit"))).alias("mm")))


@query(with_sql(["packages"], "SELECT package_id, CASE WHEN model_risk_level IS NULL THEN decision_risk WHEN decision_risk > model_risk_level THEN decision_risk ELSE model_risk_level END AS risk FROM packages"))
def ma_4(spark, sf_dir):
    """Risk matrix: the higher of both levels; a missing one doesn't count."""
    return evidence(spark, sf_dir, "packages").select("package_id", F.greatest("model_risk_level", "decision_risk").alias("risk"))


@query("SELECT doc_id, length(text) // 4 AS tokens, round((length(text) // 4) / 1e6 * 3.0 * 1.2, 9) AS cost FROM documents")
def ma_6(spark, sf_dir):
    """Estimated cost of reading a document: a token for four characters, a rate per million, padded by a fifth."""
    tokens = F.floor(F.length("text") / 4)
    return rounded(table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"), (tokens / 1e6 * 3.0 * 1.2).alias("cost")), 9)


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand ILIKE '%and#1%' OR p_type ILIKE '%mo%'")
def fp_14(spark, sf_dir):
    """Search of terms by name or label, whatever the case."""
    has = lambda c, what: F.contains(F.lower(c), F.lit(what))
    return table(spark, sf_dir, "part").where(has("p_brand", "and#1") | has("p_type", "mo")).select("p_partkey", "p_brand", "p_type")

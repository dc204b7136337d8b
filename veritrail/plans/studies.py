"""Registered queries of studies over outcomes, judgements and findings: splits, samples, deltas, gates and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.operators import judging, sampling, stats
from veritrail.session import table

from .catalog import CLASSES, TRIOS, found, found_sql, trios
from .evidence import evidence, with_sql
from .registry import query, rounded

# ---- judgements ----


@query(with_sql(["judgments"], "SELECT CASE WHEN reason = 'converged' THEN 'CONVERGENT' ELSE 'DISAGREEMENT' END AS bucket, reason, count(*) AS cases FROM triaged GROUP BY ALL", TRIOS))
def jd_3(spark, sf_dir):
    """Cases per bucket and reason."""
    return judging.triage(trios(spark, sf_dir)).groupBy("bucket", "reason").agg(F.count("*").alias("cases"))


@query(with_sql(["judgments"], "SELECT case_id, arg_max(judge, c * 10 - p) AS judge, max(c) AS confidence, count(*) AS supporters FROM (SELECT case_id, unnest(['A', 'B', 'C']) AS judge, unnest([va, vb, vc]) AS v, unnest([ca, cb, cc]) AS c, unnest([1e-9, 2e-9, 3e-9]) AS p FROM triaged WHERE agreed = 'OUT-OF-SCOPE') WHERE v = 'OUT-OF-SCOPE' GROUP BY case_id", TRIOS))
def jd_6(spark, sf_dir):
    """Whose evidence gap is taken: the surest judge that agrees on OUT-OF-SCOPE, ties by the order of judges."""
    cases = judging.triage(trios(spark, sf_dir)).where("agreed = 'OUT-OF-SCOPE'")
    votes = F.array(*[F.struct(F.col(f"v{j}").alias("v"), F.col(f"c{j}").alias("c"), F.lit(-i).alias("place"), F.lit(j.upper()).alias("judge")) for i, j in enumerate("abc")])
    agreeing = F.filter(votes, lambda x: x["v"] == "OUT-OF-SCOPE")
    best = F.array_max(F.transform(agreeing, lambda x: F.struct(x["c"].alias("c"), x["place"].alias("place"), x["judge"].alias("judge"))))
    return cases.select("case_id", best["judge"].alias("judge"), best["c"].alias("confidence"), F.size(agreeing).cast("long").alias("supporters"))


@query(with_sql(["judgments"], "SELECT case_id, judge, arg_max(verdict, seq) AS verdict FROM judgments GROUP BY case_id, judge"))
def wn_1(spark, sf_dir):
    """The last record of a judge on a case wins."""
    return stats.last_wins(evidence(spark, sf_dir, "judgments").select("case_id", "judge", "seq", "verdict"), ["case_id", "judge"], "seq").drop("seq")


@query(with_sql(["judgments"], "SELECT case_id, arg_min(judge, seq) AS judge, arg_min(verdict, seq) AS verdict FROM judgments GROUP BY case_id"))
def wn_2(spark, sf_dir):
    """The first record of a case wins."""
    first = F.min_by(F.struct("judge", "verdict"), "seq").alias("r")
    return evidence(spark, sf_dir, "judgments").groupBy("case_id").agg(first).select("case_id", "r.*")


@query(with_sql(["judgments"], "SELECT va, vb, count(*) AS cases FROM trios GROUP BY ALL", TRIOS))
def ag_21_confusion(spark, sf_dir):
    """Confusion matrix of the first two judges, in long form."""
    return trios(spark, sf_dir).groupBy("va", "vb").agg(F.count("*").alias("cases"))


# ---- outcomes ----

CLASS = "CASE WHEN NOT valid THEN 'GEN-INVALID' WHEN intent = 'negative_control' THEN CASE WHEN fired OR others > 0 THEN 'CLEAN-WRONG' ELSE 'CLEAN-CORRECT' END WHEN fired AND others = 0 THEN 'COV-HIT' WHEN fired THEN 'HIT-PLUS' WHEN others > 0 THEN 'WRONG' ELSE 'MISS' END"


@query(with_sql(["outcomes"], f"SELECT class, CASE class WHEN 'COV-HIT' THEN 'HIT' WHEN 'HIT-PLUS' THEN 'HIT' WHEN 'CLEAN-CORRECT' THEN 'CLEAN' ELSE class END AS normalised, count(*) AS n FROM (SELECT {CLASS} AS class FROM outcomes) GROUP BY ALL"))
def ag_7(spark, sf_dir):
    """Outcome classes as they are and normalised."""
    rows = evidence(spark, sf_dir, "outcomes").select(F.expr(CLASS).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    return rows.withColumn("normalised", F.when(F.col("class").isin("COV-HIT", "HIT-PLUS"), "HIT").when(F.col("class") == "CLEAN-CORRECT", "CLEAN").otherwise(F.col("class")))


@query(with_sql(["outcomes"], "SELECT subtlety, round(count(*) FILTER (fired AND intent = 'confirm_existing') / nullif(count(*) FILTER (intent = 'confirm_existing'), 0), 6) AS recall, round(1 - count(*) FILTER (fired AND intent = 'negative_control') / nullif(count(*) FILTER (intent = 'negative_control'), 0), 6) AS clean_rate FROM outcomes WHERE valid GROUP BY subtlety"))
def ag_9(spark, sf_dir):
    """Suite metrics: invalid rows are in no denominator, and a rate over nothing is null."""
    n = lambda cond: F.count_if(F.expr(cond))
    rows = evidence(spark, sf_dir, "outcomes").where("valid").groupBy("subtlety").agg(
        stats.ratio(n("fired AND intent = 'confirm_existing'"), n("intent = 'confirm_existing'"), None).alias("recall"),
        (1 - stats.ratio(n("fired AND intent = 'negative_control'"), n("intent = 'negative_control'"), None)).alias("clean_rate"),
    )
    return rounded(rows)


@query(with_sql(["outcomes"], "SELECT intent, round(sum(w * rate) / sum(w), 6) AS weighted FROM (SELECT intent, subtlety, CASE subtlety WHEN 'low' THEN 0.5 WHEN 'medium' THEN 0.3 ELSE 0.2 END::DOUBLE AS w, avg(CAST(fired AS INT)) AS rate FROM outcomes WHERE valid GROUP BY intent, subtlety) GROUP BY intent"))
def ag_23(spark, sf_dir):
    """Rates of strata, weighted."""
    weight = F.when(F.col("subtlety") == "low", 0.5).when(F.col("subtlety") == "medium", 0.3).otherwise(0.2)
    strata = evidence(spark, sf_dir, "outcomes").where("valid").groupBy("intent", "subtlety").agg(F.avg(F.col("fired").cast("int")).alias("rate"))
    return rounded(strata.groupBy("intent").agg((F.sum(weight * F.col("rate")) / F.sum(weight)).alias("weighted")))


@query(with_sql(["outcomes"], "SELECT rule, round(recall, 6) AS recall, round(fpr, 6) AS fpr, CASE WHEN recall >= 0.90 AND fpr <= 0.10 THEN 'locked' WHEN recall >= 0.80 AND fpr <= 0.25 THEN 'provisional' ELSE 'reverted' END AS gate FROM (SELECT rule, count(*) FILTER (fired AND intent = 'confirm_existing') / nullif(count(*) FILTER (intent = 'confirm_existing'), 0) AS recall, count(*) FILTER (fired AND intent = 'negative_control') / nullif(count(*) FILTER (intent = 'negative_control'), 0) AS fpr FROM outcomes WHERE valid GROUP BY rule)"))
def ag_42(spark, sf_dir):
    """Refinement gate per rule."""
    n = lambda cond: F.count_if(F.expr(cond))
    rows = evidence(spark, sf_dir, "outcomes").where("valid").groupBy("rule").agg(
        stats.ratio(n("fired AND intent = 'confirm_existing'"), n("intent = 'confirm_existing'"), None).alias("recall"),
        stats.ratio(n("fired AND intent = 'negative_control'"), n("intent = 'negative_control'"), None).alias("fpr"),
    )
    gate = F.when(F.expr("recall >= 0.90 AND fpr <= 0.10"), "locked").when(F.expr("recall >= 0.80 AND fpr <= 0.25"), "provisional").otherwise("reverted")
    return rounded(rows.withColumn("gate", gate))


@query(with_sql(["outcomes"], "SELECT rule, subtlety, round(rate - (max(rate) FILTER (subtlety = 'low') OVER (PARTITION BY rule)), 6) AS lift FROM (SELECT rule, subtlety, avg(CAST(fired AS INT)) AS rate FROM outcomes GROUP BY rule, subtlety)"))
def ag_41(spark, sf_dir):
    """Each condition's rate less that of the base condition."""
    rows = evidence(spark, sf_dir, "outcomes").groupBy("rule", "subtlety").agg(F.avg(F.col("fired").cast("int")).alias("rate"))
    base = F.max(F.when(F.col("subtlety") == "low", F.col("rate"))).over(Window.partitionBy("rule"))
    return rounded(rows.select("rule", "subtlety", (F.col("rate") - base).alias("lift")))


@query(with_sql(["outcomes"], "SELECT case_id, intent, subtlety, CASE WHEN place <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN place <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'dev' ELSE 'holdout' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY intent, subtlety ORDER BY md5('7-' || CAST(case_id AS STRING)), case_id) AS place, count(*) OVER (PARTITION BY intent, subtlety) AS n FROM outcomes)"))
def wn_7(spark, sf_dir):
    """Stratified split: 70 and 15 in a hundred of each stratum, rounded half to even; the holdout takes the rest."""
    return sampling.split(evidence(spark, sf_dir, "outcomes").select("case_id", "intent", "subtlety"), ["intent", "subtlety"], "case_id", 7)


@query("SELECT p_brand, p_partkey FROM (SELECT *, (place * 5 + n - 1) // n AS i FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part)) WHERE i < 5 AND i * n < (place + 1) * 5")
def wn_6(spark, sf_dir):
    """Five parts of each brand, evenly spread."""
    return sampling.even(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", 5)


@query("SELECT doc_id, count(*) FILTER (f > 0.75) AS late, count(*) FILTER (f > 0.9) AS last, count(*) FILTER (f < 0.1) AS early FROM (SELECT doc_id, i / greatest(n - 1, 1) AS f FROM (SELECT doc_id, len(lines) AS n, unnest(range(len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))) GROUP BY doc_id")
def wn_9(spark, sf_dir):
    """Lines by their place in the document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    rows = lines.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i / F.greatest(F.col("n") - 1, F.lit(1)))).alias("f"))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("f") > 0.75).alias("late"), F.count_if(F.col("f") > 0.9).alias("last"), F.count_if(F.col("f") < 0.1).alias("early"))


# ---- errors ----


@query(with_sql(["errors"], "SELECT qoi, count(*) AS n, round(quantile_cont(abs(predicted - reference), 0.5), 4) AS median, round(avg(abs(predicted - reference)), 4) AS mean FROM errors WHERE isfinite(predicted) AND predicted BETWEEN low AND high GROUP BY qoi"))
def ag_15(spark, sf_dir):
    """Plausible yet wrong: how far off the values are that are finite and in range."""
    error = F.abs(F.col("predicted") - F.col("reference"))
    rows = evidence(spark, sf_dir, "errors").where(F.col("predicted").between(F.col("low"), F.col("high")) & ~F.isnan("predicted") & (F.abs("predicted") < float("inf"))).withColumn("error", error)
    return rounded(stats.distribution(rows, ["qoi"], "error").select("qoi", "n", "median", "mean"), 4)


@query(with_sql(["errors"], "SELECT dim, count(*) AS n, round(avg(abs(predicted - reference)), 4) AS mean, round(max(abs(predicted - reference)), 4) AS most, round(sqrt(avg(pow(predicted - reference, 2))), 4) AS rms FROM errors GROUP BY dim"))
def ag_17(spark, sf_dir):
    """Residuals of constraints, one for each dimension."""
    return rounded(stats.residuals(evidence(spark, sf_dir, "errors"), ["dim"]).select("dim", "n", F.col("mean_abs").alias("mean"), F.col("max_abs").alias("most"), "rms"), 4)


@query(with_sql(["errors"], "SELECT dim, round(quantile_cont(CASE WHEN thickness > 25 THEN e END, 0.5) / nullif(quantile_cont(CASE WHEN thickness <= 25 THEN e END, 0.5), 0), 6) AS elevation, count(*) FILTER (thickness > 25) AS n_out, count(*) FILTER (thickness <= 25) AS n_in FROM (SELECT dim, thickness, abs(predicted - reference) AS e FROM errors) GROUP BY dim"))
def ag_34(spark, sf_dir):
    """Median errors on both sides of a split, as a ratio, with the number of cases of each side."""
    error = F.abs(F.col("predicted") - F.col("reference"))
    sides = stats.quantiles(evidence(spark, sf_dir, "errors").select("dim", (F.col("thickness") > 25).alias("out"), error.alias("error")), ["dim", "out"], "error", median=0.5)
    pick = lambda side, c: F.max(F.when(F.col("out") == side, F.col(c)))
    rows = sides.groupBy("dim").agg(pick(True, "median").alias("a"), pick(False, "median").alias("b"), F.coalesce(pick(True, "n"), F.lit(0)).alias("n_out"), F.coalesce(pick(False, "n"), F.lit(0)).alias("n_in"))
    return rounded(rows.select("dim", stats.ratio(F.col("a"), F.col("b"), None).alias("elevation"), "n_out", "n_in"))


# ---- findings ----


@query(with_sql(CLASSES, "SELECT pattern_id, severity, unnest(CASE severity WHEN 'Critical' THEN [pattern_id, 'COMPOUND-01', 'COMPOUND-03'] WHEN 'High' THEN [pattern_id, 'COMPOUND-01'] ELSE [pattern_id] END) AS affected FROM (SELECT DISTINCT pattern_id, severity FROM findings)", found_sql()))
def set_6(spark, sf_dir):
    """Rules that a change of a rule can affect."""
    own = F.when(F.col("severity") == "Critical", F.array("pattern_id", F.lit("COMPOUND-01"), F.lit("COMPOUND-03"))).when(F.col("severity") == "High", F.array("pattern_id", F.lit("COMPOUND-01"))).otherwise(F.array("pattern_id"))
    return found(spark, sf_dir).select("pattern_id", "severity").distinct().select("pattern_id", "severity", F.explode(own).alias("affected"))


@query(with_sql(CLASSES, "SELECT pattern_id, coalesce(b.hits, 0) AS before, coalesce(a.hits, 0) AS after, CASE WHEN coalesce(a.hits, 0) > coalesce(b.hits, 0) THEN 'gained' WHEN coalesce(a.hits, 0) < coalesce(b.hits, 0) THEN 'suppressed' ELSE 'same' END AS delta FROM (SELECT pattern_id, count(*) AS hits FROM findings WHERE package_id % 2 = 0 GROUP BY pattern_id) b FULL JOIN (SELECT pattern_id, count(*) AS hits FROM findings WHERE package_id % 2 = 1 GROUP BY pattern_id) a USING (pattern_id)", found_sql()))
def set_7(spark, sf_dir):
    """What a mutation gains and suppresses: hits per pattern before and after."""
    half = F.col("package_id") % 2
    hits = found(spark, sf_dir).groupBy("pattern_id").agg(F.count_if(half == 0).alias("before"), F.count_if(half == 1).alias("after"))
    return hits.withColumn("delta", F.when(F.col("after") > F.col("before"), "gained").when(F.col("after") < F.col("before"), "suppressed").otherwise("same"))


@query("SELECT n_nationkey AS spec, subtlety, variant, CASE WHEN n_nationkey % 4 = 0 THEN 'base' ELSE 'cou-' || CAST(n_regionkey AS STRING) END AS base FROM (SELECT *, unnest(['low', 'medium', 'high']) AS subtlety FROM nation), range(1, 6) v(variant)")
def set_13(spark, sf_dir):
    """Fan-out of specifications: by subtlety and variant; some keep a single base."""
    rows = table(spark, sf_dir, "nation").withColumn("subtlety", F.explode(F.array(*map(F.lit, ("low", "medium", "high"))))).withColumn("variant", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    return rows.select(F.col("n_nationkey").alias("spec"), "subtlety", "variant", F.when(F.col("n_nationkey") % 4 == 0, "base").otherwise(F.concat(F.lit("cou-"), F.col("n_regionkey").cast("string"))).alias("base"))


def standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir, "factors").select("package_id", "standard").distinct()


@query(with_sql(["factors"], "SELECT DISTINCT package_id, 'nasa' AS framework FROM factors f WHERE NOT EXISTS (SELECT 1 FROM factors x WHERE x.package_id = f.package_id AND x.standard = 'nasa')"))
def drv_8(spark, sf_dir):
    """Frameworks that a package names and no control of it carries."""
    named = evidence(spark, sf_dir, "factors").select("package_id").distinct().withColumn("framework", F.lit("nasa"))
    return named.join(standards(spark, sf_dir).select("package_id", F.col("standard").alias("framework")), ["package_id", "framework"], "left_anti")


def level_fault(standard: Column, level: Column) -> Column:
    return level.isNotNull() & F.when(standard == "nasa", ~level.between(0, 4)).otherwise(~level.between(1, 5))


@query(with_sql(["factors"], "SELECT package_id, factor_id, standard, 'achieved' AS which, achieved_level AS level FROM factors WHERE achieved_level IS NOT NULL AND CASE WHEN standard = 'nasa' THEN achieved_level NOT BETWEEN 0 AND 4 ELSE achieved_level NOT BETWEEN 1 AND 5 END UNION ALL SELECT package_id, factor_id, standard, 'required', required_level FROM factors WHERE required_level IS NOT NULL AND CASE WHEN standard = 'nasa' THEN required_level NOT BETWEEN 0 AND 4 ELSE required_level NOT BETWEEN 1 AND 5 END"))
def sh_9(spark, sf_dir):
    """Levels, achieved and required, out of the range of their standard."""
    levels = F.array(*[F.struct(F.lit(w).alias("which"), F.col(f"{w}_level").alias("level")) for w in ("achieved", "required")])
    rows = evidence(spark, sf_dir, "factors").select("package_id", "factor_id", "standard", F.explode(levels).alias("l")).select("package_id", "factor_id", "standard", "l.*")
    return rows.where(level_fault(F.col("standard"), F.col("level")))


@query("SELECT count(*) AS lines, count(DISTINCT norm) AS different, round(count(DISTINCT norm) / count(*), 6) AS rate FROM (SELECT trim(regexp_replace(lower(line), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS norm FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE norm <> ''")
def ag_28(spark, sf_dir):
    """Distinct lines over filled lines, after normalisation. Counted per line first, so that one line's copies meet as a count."""
    from veritrail.functions import text

    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(text.squash(F.col("line")).alias("norm")).where("norm <> ''")
    each = lines.groupBy("norm").agg(F.count("*").alias("n"))
    return rounded(each.agg(F.sum("n").alias("lines"), F.count("*").alias("different"), (F.count("*") / F.sum("n")).alias("rate")))

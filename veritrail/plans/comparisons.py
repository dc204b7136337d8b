"""Registered queries that compare: paired resamples, and joins whose unmatched rows are accounted for."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.operators import stats
from veritrail.session import table

from .catalog import TRIOS, trios
from .evidence import with_sql
from .registry import query, rounded

MIXED = "((xor((x >> 16), x) * {m}) & 4294967295)".format(m=stats.MIX)


def mixed(times: int, inner: str) -> str:
    """The same hash in SQL: one subquery a round."""
    out = inner
    for _ in range(times):
        out = f"SELECT * EXCLUDE (x), {MIXED} AS x FROM ({out})"
    return out


REPLICATES = 5000
DRAWN = "CASE " + " ".join(f"WHEN x < {t} THEN {k}" for k, t in enumerate(stats.POISSON)) + f" ELSE {len(stats.POISSON)} END"


@query(with_sql(["judgments"], f"""SELECT metric, p.n, round(point, 6) AS point, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, ci_lo > 0 OR ci_hi < 0 AS robust FROM
(SELECT metric, list_sort(list(m))[floor(0.025 * count(*))::INT + 1] AS ci_lo, list_sort(list(m))[floor(0.975 * count(*))::INT + 1] AS ci_hi FROM (SELECT metric, r, sum(d * w) / sum(w) AS m FROM drawn GROUP BY metric, r HAVING sum(w) > 0) GROUP BY metric) c
JOIN (SELECT metric, count(*) AS n, avg(d) AS point FROM paired GROUP BY metric) p USING (metric)""", TRIOS,
    "paired AS MATERIALIZED (SELECT case_id, 'confidence' AS metric, ca - cb AS d FROM trios UNION ALL SELECT case_id, 'confirmed', (va = 'CONFIRM')::INT - (vb = 'CONFIRM')::INT FROM trios)",
    f"hashed AS MATERIALIZED (SELECT case_id, r, xor(x >> 16, x) AS x FROM ({mixed(3, f'SELECT case_id, r, (case_id * {stats.ROW_FACTOR} + r * {stats.REPLICATE_FACTOR}) & 4294967295 AS x FROM trios, range({REPLICATES}) t(r)')}))",
    f"drawn AS (SELECT metric, r, d, {DRAWN} AS w FROM hashed JOIN paired USING (case_id))"))
def ag_25(spark, sf_dir):
    """Paired bootstrap of two judges' mean difference over the cases that both have seen."""
    rows = trios(spark, sf_dir).select("case_id", (F.col("ca") - F.col("cb")).alias("confidence"), ((F.col("va") == "CONFIRM").cast("int") - (F.col("vb") == "CONFIRM").cast("int")).alias("confirmed"))
    return rounded(stats.bootstrap(rows, "case_id", ["confidence", "confirmed"], REPLICATES))


@query("SELECT coalesce(v.spec, o.spec) AS spec, coalesce(v.variant, o.variant) AS variant, coalesce(o.n, 0) AS outcomes, CASE WHEN v.spec IS NULL THEN 'no variant' WHEN o.spec IS NULL THEN 'no outcome' ELSE 'matched' END AS state FROM (SELECT c_custkey AS spec, unnest(range(1, 4)) AS variant FROM customer) v FULL JOIN (SELECT user_id AS spec, event_id % 5 AS variant, count(*) AS n FROM events GROUP BY ALL) o ON v.spec = o.spec AND v.variant = o.variant")
def j_9(spark, sf_dir):
    """Variants with their outcomes, and what was left unmatched on either side."""
    variants = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("spec"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("variant"))
    outcomes = table(spark, sf_dir, "events").select(F.col("user_id").alias("spec"), (F.col("event_id") % 5).alias("variant"))
    return stats.audited(variants, outcomes, ["spec", "variant"])

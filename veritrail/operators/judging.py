"""Adjudication of trios of judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import last_wins

JUDGES = ("A", "B", "C")


def trios(judgments: DataFrame) -> DataFrame:
    """One row per case that all three judges have seen; a judge's last verdict counts."""
    last = last_wins(judgments.select("case_id", "judge", "seq", "verdict", "confidence"), ["case_id", "judge"], "seq")
    wide = last.groupBy("case_id").pivot("judge", list(JUDGES)).agg(F.first("verdict").alias("v"), F.first("confidence").alias("c"))
    return wide.where(" AND ".join(f"{j}_v IS NOT NULL" for j in JUDGES)).select("case_id", *[F.col(f"{j}_{k}").alias(f"{k}{j.lower()}") for j in JUDGES for k in "vc"])


def triage(cases: DataFrame, floor: float = 0.6) -> DataFrame:
    """Adds bucket, reason, agreed verdict and the low-confidence flag.

    Two uncertain judges: disagreement. Two or three that agree on another verdict converge if each of them is at
    least at the floor. Anything else is a disagreement, told apart by whether one judge is uncertain.
    """
    v, c = F.array("va", "vb", "vc"), F.array("ca", "cb", "cc")
    unsure = F.size(F.filter(v, lambda x: x == "UNCERTAIN"))
    agreed = F.when((F.col("va") == F.col("vb")) | (F.col("va") == F.col("vc")), F.col("va")).when(F.col("vb") == F.col("vc"), F.col("vb"))
    rows = cases.withColumns({"unsure": unsure, "agreed": F.when(agreed != "UNCERTAIN", agreed)})
    sure = F.forall(F.arrays_zip(v.alias("v"), c.alias("c")), lambda z: (z["v"] != F.col("agreed")) | (z["c"] >= floor))
    reason = F.when(F.col("unsure") >= 2, "uncertain_majority_kof3").when(F.col("agreed").isNotNull() & sure, "converged").when(F.col("agreed").isNotNull(), "low_conf_concurrence").when(F.col("unsure") == 1, "two_disagree_one_uncertain").otherwise("all_three_disagree")
    rows = rows.withColumn("reason", reason).withColumn("bucket", F.when(F.col("reason") == "converged", "CONVERGENT").otherwise("DISAGREEMENT"))
    low = F.exists(F.arrays_zip(v.alias("v"), c.alias("c")), lambda z: (z["v"] != "UNCERTAIN") & (z["c"] < 0.5))
    return rows.withColumn("low_confidence", low)


def final(cases: DataFrame, overrides: DataFrame, arbitrated: DataFrame, floor: float = 0.6) -> DataFrame:
    """(case_id, verdict, route): author override, then arbitration at the floor or above, then convergence."""
    rows = cases.join(overrides.select("case_id", F.col("verdict").alias("o")), "case_id", "left").join(arbitrated.where(F.col("confidence") >= floor).select("case_id", F.col("verdict").alias("r")), "case_id", "left")
    converged = F.when(F.col("bucket") == "CONVERGENT", F.col("agreed"))
    return rows.select("case_id", F.coalesce("o", "r", converged).alias("verdict"), F.when(F.col("o").isNotNull(), "AUTHOR_OVERRIDE").when(F.col("r").isNotNull(), "ARBITRATED").when(converged.isNotNull(), "CONVERGENT").otherwise("UNRESOLVED").alias("route"))

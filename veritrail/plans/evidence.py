"""Evidence tables over the star schema: each is a source and column expressions, the same for Spark and for the SQL.

The expressions are deterministic and row-local, so predicates on them are pushed to the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritrail.session import table

LINE_KEY = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"

#: name: (first table, other table and key pair or None, {column: expression})
TABLES = {
    "packages": ("orders", None, {
        "package_id": "o_orderkey", "outcome": "CASE WHEN o_orderstatus = 'F' THEN 'Accepted' ELSE 'Not accepted' END",
        "model_risk_level": "CAST(substr(o_orderpriority, 1, 1) AS INT)", "signature_ts": "o_orderdate",
        "assurance_level": "CASE WHEN o_totalprice < 60000 THEN 'Low' WHEN o_totalprice < 180000 THEN 'Medium' ELSE 'High' END",
        "profile": "CASE WHEN o_orderkey % 3 = 0 THEN 'Complete' ELSE 'Minimal' END", "uq": "CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 = 1 END",
        "sensitivity": "CASE WHEN o_orderkey % 5 = 0 THEN true END", "cou": "CASE WHEN o_orderkey % 11 > 0 THEN 'cou-' || CAST(o_orderkey AS STRING) END",
        "cou_constraint": "CASE WHEN o_orderkey % 7 > 2 THEN 'c' END", "cou_envelope": "CASE WHEN o_orderkey % 2 = 0 THEN 'e' END",
        "signature": "CASE WHEN o_orderkey % 13 > 0 THEN 's' END", "requirement": "CASE WHEN o_orderkey % 17 > 0 THEN 'r' END",
        "required_method": "CASE WHEN o_orderkey % 4 > 0 THEN 'method-' || CAST(o_orderkey % 3 AS STRING) END", "offset_rationale": "CASE WHEN o_orderkey % 6 = 0 THEN 'o' END",
        "current_version": "CASE WHEN o_orderkey % 8 > 0 THEN 'v' || CAST(o_custkey % 3 AS STRING) END", "decision_risk": "CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey % 5 AS INT) END",
        "model_revision": "CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate END", "snapshot": "CASE WHEN o_custkey % 5 > 0 THEN 'snap-' || CAST(o_custkey % 5 AS STRING) END",
        "claim_source": "CASE WHEN o_custkey % 10 > 0 THEN 'd' END", "parent_decision": "CASE WHEN o_custkey % 7 = 0 THEN 'Not Accepted' WHEN o_custkey % 7 > 1 THEN 'Accepted' END",
    }),
    "results": ("lineitem", None, {
        "package_id": "l_orderkey", "result_id": LINE_KEY, "evidence_ts": "l_shipdate", "generated_by": "CASE WHEN l_linestatus = 'F' THEN 'act-' || CAST(l_suppkey AS STRING) END",
        "comparator": "CASE WHEN l_returnflag <> 'N' THEN 'ds-' || CAST(l_partkey AS STRING) END", "data_vintage": "CASE WHEN l_linenumber % 3 > 0 THEN l_shipdate END", "result_uq": "CASE WHEN l_tax > 0 THEN true END",
        "activity_type": "'method-' || CAST(l_suppkey % 3 AS STRING)", "config_version": "CASE WHEN l_linenumber < 6 THEN 'v' || CAST(l_partkey % 4 AS STRING) END",
        "sampling": "CASE WHEN l_linenumber % 2 = 0 THEN 's' END", "null_baseline": "CASE WHEN l_linenumber % 3 = 0 THEN 'b' END", "determinism": "CASE WHEN l_quantity > 10 THEN 'd' END",
        "claimed_cou": "CASE WHEN l_linenumber < 5 THEN 'c' END", "confound": "CASE WHEN l_discount > 0.02 THEN 'c' END", "subject_version": "CASE WHEN l_suppkey % 2 = 0 THEN 'v' END", "generalized": "CASE WHEN l_quantity > 40 THEN 'g' END",
    }),
    "factors": ("lineitem", ("part", "l_partkey", "p_partkey"), {
        "package_id": "l_orderkey", "factor_id": "'f-' || " + LINE_KEY, "factor_type": "p_type", "required_level": "CASE WHEN p_size % 7 > 0 THEN 1 + p_size % 5 END",
        "achieved_level": "CASE WHEN l_quantity > 3 THEN CAST(1 + floor(l_quantity) % 5 AS INT) END", "factor_status": "CASE l_linenumber % 4 WHEN 0 THEN 'not-assessed' WHEN 1 THEN 'assessed' WHEN 2 THEN 'scoped-out' ELSE 'assessed' END",
        "criteria": "CASE WHEN l_discount > 0.01 THEN 'a' END", "evidence": "CASE WHEN l_tax > 0.03 THEN 'e' END", "standard": "CASE WHEN p_size % 2 = 0 THEN 'nasa' ELSE 'vv40' END",
    }),
    "judgments": ("events", None, {
        "case_id": "user_id", "judge": "CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END", "seq": "event_id", "ts": "ts",
        "verdict": "CASE event_type WHEN 'click' THEN 'CONFIRM' WHEN 'view' THEN 'CONFIRM' WHEN 'purchase' THEN 'OUT-OF-SCOPE' WHEN 'signup' THEN 'REAL-GAP' ELSE 'UNCERTAIN' END", "confidence": "round(value / 500.0, 6)",
    }),
    "outcomes": ("events", None, {
        "case_id": "event_id", "spec": "user_id", "intent": "CASE WHEN user_id % 5 = 0 THEN 'negative_control' WHEN user_id % 5 = 1 THEN 'gap_probe' ELSE 'confirm_existing' END",
        "rule": "'W-' || CAST(user_id % 7 AS STRING)", "subtlety": "CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END", "valid": "event_id % 19 > 0",
        "fired": "value > 150", "others": "CAST(event_id % 4 AS INT)", "ms": "value", "cost": "round(value / 100.0, 6)", "ts": "ts",
    }),
    "errors": ("lineitem", ("part", "l_partkey", "p_partkey"), {
        "case_id": LINE_KEY, "qoi": "l_returnflag", "predicted": "l_extendedprice", "reference": "l_quantity * p_retailprice", "thickness": "p_size", "fired": "p_size > 35",
        "low": "l_quantity * 850.0", "high": "l_quantity * 980.0", "dim": "p_brand", "coordinate": "p_retailprice",
    }),
}


def evidence(spark: SparkSession, sf_dir: str, name: str, by: str | None = None, parts: int | None = None) -> DataFrame:
    """One evidence table as a DataFrame; ``by``: the column by whose values rows are dealt out, into ``parts``, as they are, before anything is made of them."""
    first, other, columns = TABLES[name]
    rows = table(spark, sf_dir, first)
    if other:
        right, a, b = other
        extra = table(spark, sf_dir, right)
        rows = rows.join(extra, rows[a] == extra[b])
    if by:
        rows = rows.repartition(*[parts] * bool(parts), columns[by])
    return rows.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def sql(name: str) -> str:
    """The same table as a common table expression."""
    first, other, columns = TABLES[name]
    source = first + (f" JOIN {other[0]} ON {other[1]} = {other[2]}" if other else "")
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {source})"


def with_sql(names: list[str], body: str, *more: str) -> str:
    """A statement over evidence tables; ``more`` are further common table expressions."""
    return "WITH RECURSIVE " + ", ".join([*map(sql, names), *more]) + " " + body

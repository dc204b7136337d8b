"""Mutants of all packages and what the rules say about them, with SQL written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.operators import mutation, package_rules

from .packs import FINDING, FRAMED, K, packed_rows
from .registry import ORACLES, query

CORE = [r for r in package_rules.RULES if r.pack == "core"]


ROWS = f"""rows_ AS MATERIALIZED (SELECT x.package_id, x.k, l_linenumber, l_linestatus, l_returnflag, l_discount, l_partkey, o_orderpriority, o_orderstatus FROM x JOIN orders_ USING (package_id)),
core AS MATERIALIZED ({" UNION ".join(FINDING.format(*r) for r in FRAMED if r[0] in ("W-AR-01", "W-AR-03", "W-AR-04", "W-CON-01"))} UNION SELECT * FROM ({ORACLES["graph_core"].removeprefix(K)}) WHERE pattern_id = 'W-EP-03'),
mutants AS (SELECT package_id, 'drop-signature' AS operator, 'W-SI-01' AS target, 'uoa' AS site, 1 AS gone, 0 AS come FROM orders_ WHERE o_orderkey % 13 > 0
  UNION ALL SELECT package_id, 'drop-requirement', 'W-SI-02', 'uoa', 1, 0 FROM orders_ WHERE o_orderkey % 4 > 0
  UNION ALL SELECT package_id, 'drop-generation', 'W-EP-02', min('v' || k), 1, 0 FROM rows_ WHERE l_linenumber < 3 AND l_linestatus = 'F' GROUP BY package_id
  UNION ALL SELECT package_id, 'drop-comparator', 'W-AR-05', min('v' || k), 1, 0 FROM rows_ WHERE l_linenumber < 3 AND l_returnflag <> 'N' GROUP BY package_id
  UNION ALL SELECT package_id, 'drop-criteria', 'W-AR-01', min('f' || k), 1, 0 FROM rows_ WHERE l_discount > 0.01 GROUP BY package_id
  UNION ALL SELECT * FROM (SELECT package_id, 'not-assessed', 'W-EP-04', min('f' || k) AS site, 1, 1 FROM rows_ GROUP BY package_id) m WHERE NOT EXISTS (SELECT 1 FROM rows_ r WHERE r.package_id = m.package_id AND 'f' || r.k = m.site AND l_linenumber % 4 = 0))"""


@query(K + ", " + ROWS + " SELECT package_id || '#' || operator || '#0' AS mutant, package_id, target, site, gone AS removed, come AS added FROM mutants")
def mu_1(spark, sf_dir):
    """The manifest: the first site of each mutation in every package, and how many triples go and come."""
    rows = mutation.manifest_packed(packed_rows(spark, sf_dir, mutation.predicates()))
    return rows.select("mutant", "package_id", "target", "site", F.size("removed").alias("removed"), F.size("added").alias("added"))


CHANGES = """fired AS (SELECT m.package_id, m.operator, count(*) FILTER (c.pattern_id = 'W-AR-03') AS ar3, count(*) FILTER (c.node = m.site AND c.pattern_id = 'W-AR-03') AS own3, count(*) FILTER (c.node = m.site AND c.pattern_id = 'W-AR-04') AS own4,
  count(*) FILTER (c.node = m.site AND c.pattern_id = 'W-EP-03') AS own_ep, count(*) FILTER (c.node = m.site AND c.pattern_id = 'W-CON-01') AS own_con FROM mutants m LEFT JOIN core c USING (package_id) GROUP BY ALL),
sites AS (SELECT m.*, r.l_linenumber, r.l_partkey, r.l_discount, r.o_orderpriority, (SELECT count(*) FROM rows_ v WHERE v.package_id = m.package_id AND v.l_linenumber < 3) AS results FROM mutants m LEFT JOIN rows_ r ON r.package_id = m.package_id AND m.site = 'f' || r.k),
deltas AS (SELECT s.*, CASE operator WHEN 'drop-requirement' THEN (results > 0)::INT WHEN 'drop-criteria' THEN (l_partkey % 7 > 0 AND l_linenumber % 4 <> 2)::INT WHEN 'not-assessed' THEN (substr(o_orderpriority, 1, 1)::INT > 2)::INT ELSE 1 END AS delta,
  CASE operator WHEN 'drop-requirement' THEN CASE WHEN ar3 > 0 THEN ['W-AR-03:' || ar3] ELSE [] END
    WHEN 'drop-generation' THEN list_filter([CASE WHEN own3 > 0 THEN 'W-AR-03:1' END, CASE WHEN own4 > 0 THEN 'W-AR-04:1' END, CASE WHEN own_ep > 0 THEN 'W-EP-03:1' END], lambda t: t IS NOT NULL)
    WHEN 'not-assessed' THEN CASE WHEN own_con > 0 THEN ['W-CON-01:1'] ELSE [] END ELSE [] END AS lost FROM sites s JOIN fired USING (package_id, operator))"""


@query(K + ", " + ROWS + ", " + CHANGES + " SELECT package_id || '#' || operator || '#0' AS mutant, target, delta, delta > 0 AS injected, array_to_string(lost, ' ') AS suppressed FROM deltas")
def mu_2(spark, sf_dir):
    """Each mutant against its own package: whether its target gains a finding, and which findings it hides."""
    rows = packed_rows(spark, sf_dir, mutation.predicates() | package_rules.looked_for(CORE))
    found = mutation.judged(rows, package_rules.counts(CORE))
    lost = F.array_join(F.transform("suppressed", lambda x: F.concat_ws(":", x["pattern_id"], x["by"].cast("string"))), " ")
    return found.select("mutant", "target", F.col("delta").cast("int").alias("delta"), "injected", lost.alias("suppressed"))

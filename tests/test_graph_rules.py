"""Rules over triples, on packages written by hand."""

from __future__ import annotations

import pytest

from veritrail.operators import graph_rules, package_rules
from veritrail.plans import packs

SCHEMA = "package_id long, s string, p string, o string"
UOA = ("u", "type", "UnitOfAssurance")


def findings(spark, triples, pack):
    rows = spark.createDataFrame(triples, SCHEMA).coalesce(1)
    got = graph_rules.evaluate(rows, [r for r in graph_rules.RULES if r.pack == pack])
    return sorted((r.package_id, r.pattern_id, r.severity, r.node) for r in got.collect())


def test_surrogate_rules_on_written_packages(spark):
    snapshot = [UOA, ("u", "parentModelSnapshot", "s"), ("s", "type", "ParentModelSnapshot")]
    region = [UOA, ("u", "hasEvaluationRegion", "r"), ("r", "dimension", "t"), ("u", "hasEnvelope", "e"), ("e", "dimension", "t"), ("e", "min", "9"), ("e", "max", "100")]
    packages = {
        1: [*snapshot, ("s", "parentDecision", "Not Accepted")],
        2: snapshot,
        3: [*snapshot, ("s", "parentDecision", "Accepted")],
        4: [*region, ("r", "min", "10"), ("r", "max", "99")],  # inside as numbers, not as text
        5: [*region, ("r", "min", "10"), ("r", "max", "101")],
        6: [UOA, ("u", "declaredPhysicsConstraint", "c"), ("c", "type", "PhysicsConstraint")],
        7: [("c", "hasConstraintCheckEvidence", "x")],  # another package's evidence helps nobody
        8: snapshot[1:],  # nothing to assure
    }
    got = findings(spark, [(k, *t) for k, rows in packages.items() for t in rows], "surrogate")
    assert got == [(1, "W-SURR-02", "Critical", "s"), (2, "W-SURR-02", "High", "s"), (5, "W-SURR-03", "High", "u"), (6, "W-SURR-01", "High", "c")]


def test_absence_of_one_object_and_of_any_subject(spark):
    step = [UOA, ("u", "conformsToProfile", "ProfileArgument"), ("u", "hasInferenceStep", "i"), ("i", "supportsClaim", "c"), ("c", "aboutQuantity", "n"), ("n", "quantityId", "stress")]
    assert findings(spark, [(1, *t) for t in step + [("i", "groundQuantity", "strain")]] + [(2, *t) for t in step + [("i", "groundQuantity", "stress")]], "argument") == [(1, "W-ARG-01", "Critical", "i")]
    core = [UOA, ("u", "bindsRequirement", "r"), ("u", "hasValidationResult", "v"), ("u", "hasVerificationActivity", "a")]
    assert findings(spark, [(1, *t) for t in core] + [(2, *t) for t in [*core, ("v", "wasGeneratedBy", "a")]], "core") == [(1, "W-CON-05", "High", "a")]


def test_no_triples_no_findings(spark):
    for name in ("core", "surrogate", "argument", "management"):
        assert findings(spark, [], name) == []
    assert findings(spark, [(1, None, "type", "UnitOfAssurance"), (1, "x", "referencesIdentifier", None)], "surrogate") == []


@pytest.mark.parametrize("name", ["graph_check", "graph_derived", "graph_argument", "graph_management", "graph_surrogate", "graph_core"])
def test_rules_shuffle_rows_once_and_join_nothing(spark, name):
    plan = getattr(packs, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "veritrail/" not in plan


def test_ends_of_chains_are_found_beside_cycles_and_other_claims(spark):
    steps = {1: [("c", "x"), ("x", "y"), ("y", "c"), ("y", "z")], 2: [("c", "d"), ("d", "e")], 3: [("c", "x"), ("x", "c")], 4: [("c", "f")], 5: []}
    rows = [(n, s, "used", o) for n, own in steps.items() for s, o in own] + [(n, "u", "type", "UnitOfAssurance") for n in steps] + [(n, "u", "bindsClaim", c) for n in steps for c in ("c", "e")] + [(4, "f", "isFoundationalEvidence", "true")]
    found = package_rules.check(spark.createDataFrame(rows, "package_id long, s string, p string, o string"), ("core",)).where("pattern_id = 'W-PROV-01'")
    assert sorted((r.package_id, r.node) for r in found.collect()) == [(1, "z"), (2, "e")]

"""Documents to findings: contexts resolved, all rules in their strata, goals, shapes, mutants."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from veritrail.operators import goals, graph_rules, mutation, package_rules, shapes
from veritrail.sources import contexts, packages

VOCAB = "https://example.org/vocab#"
CONTEXT = {
    "@version": 1.1, "@vocab": VOCAB, "id": "@id", "type": "@type", "v": VOCAB, "prov": "http://www.w3.org/ns/prov#", "xsd": "http://www.w3.org/2001/XMLSchema#",
    "UnitOfAssurance": "v:UnitOfAssurance", "bindsClaim": {"@id": "v:bindsClaim", "@type": "@id"}, "wasDerivedFrom": {"@id": "prov:wasDerivedFrom", "@type": "@id"},
    "modelRiskLevel": {"@id": "v:modelRiskLevel", "@type": "xsd:integer"}, "hasContextOfUse": {"@id": "v:hasContextOfUse", "@type": "@id"},
}


def base(**more):
    """A package that no core rule finds anything in."""
    out = {
        "@context": "ctx/v1.jsonld", "id": "https://example.org/u", "type": "UnitOfAssurance", "conformsToProfile": VOCAB + "ProfileMinimal", "bindsRequirement": "https://example.org/r",
        "bindsClaim": {"id": "https://example.org/c", "type": "AssuranceClaim", "wasDerivedFrom": {"id": "https://example.org/root", "type": "Study", "isFoundationalEvidence": True}},
        "hasContextOfUse": {"id": "https://example.org/cou", "type": "ContextOfUse", "hasApplicabilityConstraint": "only so"}, "signature": "ed25519:ab", "modelRiskLevel": 3, "assuranceLevel": "Low",
        "hasSensitivityAnalysis": True, "hasValidationResult": [{"id": "https://example.org/v", "type": "ValidationResult", "hasUncertaintyQuantification": True, "comparedAgainst": "https://example.org/d", "wasGeneratedBy": {"id": "https://example.org/a", "type": "VerificationActivity", "activityType": "simulation", "used": {"id": "https://example.org/cfg", "modelVersion": "2.0", "dataVintage": "2026-02-01T00:00:00Z"}}}],
    }
    out.update(more)
    return {k: v for k, v in out.items() if v is not None}


def result(**more):
    return [{**base()["hasValidationResult"][0], **more}]


ACCEPTED = {"id": "https://example.org/dr", "type": "DecisionRecord", "outcome": "Accepted"}
#: (pattern, whether it is found, what the package has); the boundary cases of the rules among them
CASES = [
    ("W-ON-02", True, {"hasContextOfUse": {"id": "https://example.org/cou", "type": "ContextOfUse"}}), ("W-ON-02", False, {}),
    ("W-ON-01", True, {"hasContextOfUse": None}), ("W-SI-01", True, {"signature": None}), ("W-SI-02", True, {"bindsRequirement": None}), ("W-SI-02", True, {"hasValidationResult": None}),
    ("W-AR-03", True, {"bindsRequirement": {"id": "https://example.org/r", "requiredVerificationMethod": "inspection"}}), ("W-AR-03", False, {"bindsRequirement": {"id": "https://example.org/r", "requiredVerificationMethod": "simulation"}}), ("W-AR-03", False, {}),
    ("W-AL-02", True, {"hasUncertaintyQuantification": True, "hasSensitivityAnalysis": None}), ("W-AL-02", False, {"hasUncertaintyQuantification": True}), ("W-AL-02", False, {"hasUncertaintyQuantification": False, "hasSensitivityAnalysis": None}),
    ("W-EP-03", True, {"modelRevisionDate": "2026-03-01T00:00:00Z"}), ("W-EP-03", False, {"modelRevisionDate": "2026-01-01T00:00:00Z"}), ("W-EP-03", False, {"modelRevisionDate": "2026-02-01T00:00:00Z"}),
    ("W-AR-04", True, {"currentModelVersion": "2.1"}), ("W-AR-04", False, {"currentModelVersion": "2.0"}),
    ("W-CON-01", True, {"hasDecisionRecord": ACCEPTED, "hasCredibilityFactor": [{"type": "CredibilityFactor", "factorType": "Model form", "factorStatus": "assessed"}]}), ("W-CON-01", False, {"hasDecisionRecord": ACCEPTED, "hasCredibilityFactor": [{"type": "CredibilityFactor", "factorStatus": "assessed", "achievedLevel": 2}]}),
    ("W-CON-01", False, {"hasDecisionRecord": ACCEPTED, "hasCredibilityFactor": [{"type": "CredibilityFactor", "factorStatus": "scoped-out"}]}),
    ("W-CON-02", True, {"referencesIdentifier": {"id": "https://example.org/gone"}}), ("W-CON-02", False, {"referencesIdentifier": {"id": "https://example.org/there", "type": "Thing"}}),
    ("W-CON-03", True, {"signatureTimestamp": "2025-01-01T00:00:00Z", "hasEvidence": {"id": "https://example.org/e", "evidenceTimestamp": "2025-12-01T00:00:00Z"}}), ("W-CON-03", False, {"signatureTimestamp": "2025-12-01T00:00:00Z", "hasEvidence": {"id": "https://example.org/e", "evidenceTimestamp": "2025-12-01T00:00:00Z"}}),
    ("W-CON-04", True, {"conformsToProfile": VOCAB + "ProfileComplete", "hasSensitivityAnalysis": None}), ("W-CON-04", False, {"conformsToProfile": VOCAB + "ProfileComplete"}),
    ("W-CON-05", True, {"hasVerificationActivity": "https://example.org/other"}), ("W-CON-05", False, {"hasVerificationActivity": "https://example.org/a"}),
    ("W-PROV-01", True, {"bindsClaim": {"id": "https://example.org/c", "type": "AssuranceClaim", "wasDerivedFrom": {"id": "https://example.org/orphan", "type": "ValidationResult"}}}), ("W-PROV-01", False, {}), ("W-PROV-01", False, {"bindsClaim": "https://example.org/c"}),
    ("W-EP-01", True, {"bindsClaim": {"id": "https://example.org/c", "type": "Claim"}}), ("W-EP-01", False, {"bindsClaim": {"id": "https://example.org/c", "type": "AssuranceClaim"}}),
    ("W-EP-02", True, {"hasValidationResult": "https://example.org/bare"}), ("W-AL-01", True, {"hasValidationResult": "https://example.org/bare"}), ("W-AR-05", True, {"hasValidationResult": result(comparedAgainst=None)}),
    ("W-EP-04", True, {"hasCredibilityFactor": [{"type": "CredibilityFactor", "factorStatus": "not-assessed"}]}), ("W-EP-04", False, {"modelRiskLevel": 2, "hasCredibilityFactor": [{"type": "CredibilityFactor", "factorStatus": "not-assessed"}]}),
    ("W-AR-02", True, {"hasDecisionRecord": ACCEPTED, "hasCredibilityFactor": [{"type": "CredibilityFactor", "requiredLevel": 3, "achievedLevel": 2}]}), ("W-AR-02", False, {"hasDecisionRecord": {**ACCEPTED, "hasOffsetRationale": "why"}, "hasCredibilityFactor": [{"type": "CredibilityFactor", "requiredLevel": 3, "achievedLevel": 2}]}),
    ("W-AR-01", True, {"hasCredibilityFactor": [{"type": "CredibilityFactor", "requiredLevel": 3, "factorStatus": "assessed"}]}), ("W-AR-01", False, {"hasCredibilityFactor": [{"type": "CredibilityFactor", "requiredLevel": 3, "factorStatus": "not-applicable"}]}),
    ("COMPOUND-03", True, {"assuranceLevel": "High", "bindsClaim": {"id": "https://example.org/c", "type": "Claim"}}), ("COMPOUND-03", False, {"bindsClaim": {"id": "https://example.org/c", "type": "Claim"}}),
    ("COMPOUND-01", True, {"signature": None, "bindsClaim": {"id": "https://example.org/c", "type": "Claim"}}), ("COMPOUND-01", False, {"signature": None}),
]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    """The cases as files: the context is named by a relative path, by a path with .., given inline, or left out in favour of @graph."""
    root = tmp_path_factory.mktemp("packages")
    (root / "ctx").mkdir()
    (root / "ctx/v1.jsonld").write_text(json.dumps({"@context": CONTEXT}))
    (root / "deep/er").mkdir(parents=True)
    for i, (_, _, more) in enumerate(CASES):
        doc, where = base(**more), root / f"p{i:03}.jsonld"
        if i % 4 == 1:
            where, doc["@context"] = root / f"deep/er/p{i:03}.jsonld", "../../ctx/v1.jsonld"
        if i % 4 == 2:
            doc["@context"] = CONTEXT
        if i % 4 == 3:
            doc = {"@context": ["ctx/v1.jsonld", {"extra": "v:extra"}], "@graph": [{k: v for k, v in doc.items() if k != "@context"}]}
        where.write_text(json.dumps(doc))
    (root / "bad.jsonld").write_text("{not json")
    return packages.load(spark, str(root), str(root / "ctx"), "[pb]*.jsonld").cache()


def test_terms_become_iris(spark):
    shared = contexts.terms(spark.createDataFrame([("c", json.dumps(CONTEXT))], "context string, json string"), "context", "json")
    docs = spark.createDataFrame([("1", json.dumps({"id": "u", "type": "UnitOfAssurance", "bindsClaim": "x", "wasDerivedFrom": "y", "modelRiskLevel": 3, "other": 1, "prov:used": "z", "own": "k", "https://a.b/c": 2}), "c", json.dumps({"own": {"@id": "prov:own", "@type": "@id"}, "prov": "http://mine#"}))], "package_id string, doc string, context string, inline string")
    rows = contexts.resolved(packages.triples(docs, keep="context"), shared, contexts.terms(docs, "package_id", "inline")).collect()
    got = {r.p: (r.o, r.o_kind, r.o_datatype) for r in rows}
    xsd = "http://www.w3.org/2001/XMLSchema#"
    assert got == {
        "type": (VOCAB + "UnitOfAssurance", "iri", None), VOCAB + "bindsClaim": ("x", "iri", None), "http://www.w3.org/ns/prov#wasDerivedFrom": ("y", "iri", None), VOCAB + "modelRiskLevel": ("3", "lit", xsd + "integer"),
        VOCAB + "other": ("1", "lit", xsd + "integer"), "http://mine#used": ("z", "lit", xsd + "string"), "http://mine#own": ("k", "iri", None), "https://a.b/c": ("2", "lit", xsd + "integer"),
    }


def test_paths_are_worked_out(spark):
    paths = ["file:///a/b/../c.jsonld", "/a/./b/../../c", "a/b", "file:/x/y"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(contexts.plain_path(F.col("p")).alias("q")).collect()
    assert [r.q for r in got] == ["/a/c.jsonld", "/c", "a/b", "/x/y"]


def test_rules_on_documents(loaded):
    rows = package_rules.check(loaded.select("package_id", "s", "p", "o"), derivations=graph_rules.DERIVATIONS).collect()
    found = {}
    for r in rows:
        found.setdefault(int(r.package_id.rsplit("/p", 1)[1][:3]), set()).add(r.pattern_id)
    wrong = [(i, pattern, fires) for i, (pattern, fires, _) in enumerate(CASES) if (pattern in found.get(i, set())) != fires]
    assert wrong == []
    assert len(rows) == len(set(rows))
    assert packages.assured(loaded).count() == len(CASES) and loaded.where("p = 'parseError'").count() == 1


def test_empty_triples_have_no_findings(spark):
    empty = spark.createDataFrame([], "package_id string, s string, p string, o string")
    assert package_rules.check(empty).count() == 0


def test_derivations_see_earlier_flags(spark):
    chain = [
        graph_rules.Derivation("_a", "x", (("?x", "start", "?y"),)),
        graph_rules.Derivation("_b", "x", (("?x", "_a", "true"), ("?x", "next", "?z")), value="z"),
        graph_rules.Derivation("_c", "x", (("?x", "next", "?z"),), (("?x", "_b", "?z"),)),
    ]
    rows = spark.createDataFrame([(1, "n", "start", "s"), (1, "n", "next", "m"), (1, "k", "next", "l")], "package_id long, s string, p string, o string")
    assert sorted(tuple(r) for r in graph_rules.derive(rows, chain).collect()) == [(1, "k", "_c", "true"), (1, "n", "_a", "true"), (1, "n", "_b", "m")]
    with pytest.raises(ValueError, match="later"):
        graph_rules.derive(rows, [chain[1], chain[0]])


# ---- goals ----

GOAL = "package_id string, s string, p string, o string"


def test_goals_follow_all_candidates(spark):
    unit = lambda k: [(k, "u", "type", "UnitOfAssurance"), (k, "u", "adversarialProvenance", "p"), (k, "p", "sourceTaxonomy", "oos/tacit-knowledge-transfer"), (k, "u", "bindsClaim", "c")]
    rows = [
        *unit("none"), *unit("wrong"), ("wrong", "c", "hasSupportingEvidence", "e"), ("wrong", "e", "type", "StructuredComparisonStudy"),
        *unit("met"), ("met", "c", "hasSupportingEvidence", "e"), ("met", "e", "type", "Other"), ("met", "c", "hasSupportingEvidence", "f"), ("met", "f", "type", "DocumentedSOP"),
        *[(k if k != "met" else "silent", *t) for k, *t in unit("met") if t[1] != "sourceTaxonomy"],
        *[("half", *t) for t in [("u", "type", "UnitOfAssurance"), ("u", "bindsClaim", "c"), ("c", "type", "CalibrationClaim"), ("c", "hasSupportingEvidence", "e"), ("e", "type", "CalibrationEvidence")]],
        *[("bare", *t) for t in [("c", "type", "ModelFormAdequacyClaim")]],
        *unit("none")[:1],
    ]
    got = goals.decompose(spark.createDataFrame(rows, GOAL).distinct()).collect()
    assert sorted((r.package_id, r.rule_name.removeprefix("oos_"), r.subject, r.failed_clause) for r in got) == [("bare", "modelform_adequacy_warranted_backward", "c", 2), ("half", "surr_calibration_provenance_warranted", "c", 7), ("none", "tacit_knowledge_warranted", "c", 5), ("wrong", "tacit_knowledge_warranted", "c", 6)]
    gap = next(r.evidence_gap for r in got if r.package_id == "wrong")
    assert gap.missing_evidence_type and gap.path_two_metadata.failed_clause == "?evidence type $kind" and gap.path_two_metadata.bindings["claim"] == "c"
    assert goals.decompose(spark.createDataFrame([], GOAL)).count() == 0


def test_goals_are_gated(spark):
    frame = spark.createDataFrame([("a",)], "package_id string")
    empty = spark.createDataFrame([], GOAL)
    assert goals.with_verdicts(frame, empty).columns == ["package_id"]
    assert goals.with_verdicts(frame, empty, pack_default=True, disable=True).columns == ["package_id"]
    assert goals.with_verdicts(frame, empty, pack_default=True).collect()[0].oos_results == []
    with pytest.raises(ValueError, match="enabled and disabled"):
        goals.enabled(enable=True, disable=True)


# ---- shapes ----


def test_violations_of_the_declared_profile(spark):
    iri, text = ("iri", None), ("lit", shapes.XSD + "string")
    unit = [("u", "type", "UnitOfAssurance", *iri), ("u", "conformsToProfile", "ProfileComplete", *iri)]
    minimal = [("u", p, "x", *iri) for p in ("bindsRequirement", "hasValidationResult", "hasDecisionRecord", "hasContextOfUse")] + [("u", "generatedAtTime", "2026-01-01", "lit", shapes.XSD + "dateTime"), ("u", "hash", "sha256:" + "a" * 64, *text), ("u", "signature", "ed25519:ab", *text)]
    more = [("u", p, "x", *iri) for p in ("wasDerivedFrom", "wasAttributedTo", "criteriaSet", "hasCredibilityFactor")]
    odd = [("d", "type", "Discrepancy", *iri), ("d", "surrogatePrediction", "1.0", "lit", shapes.XSD + "double"), ("d", "surrogatePrediction", "2.0", "lit", shapes.XSD + "double"), ("d", "solverTruth", "1", "lit", shapes.XSD + "integer"), ("d", "discrepancyMagnitude", "x", *iri)]
    rows = [(1, *t) for t in unit + minimal + more] + [(2, *t) for t in odd] + [(3, "u", "type", "UnitOfAssurance", *iri), (3, "u", "hasContextOfUse", "c", *iri)] + [(4, *t) for t in unit[:1] + [("u", "conformsToProfile", "ProfileMinimal", *iri)] + minimal]
    triples = spark.createDataFrame(rows, "package_id long, s string, p string, o string, o_kind string, o_datatype string")
    found = shapes.violations(triples).cache()
    got = sorted((r.package_id, r.path, r.constraint_kind, r.actual, r.profile) for r in found.collect())
    assert got == [
        (1, "bindsDataset", "minCount", "MISSING", "ProfileComplete"), (1, "bindsModel", "minCount", "MISSING", "ProfileComplete"), (2, "discrepancyMagnitude", "datatype", "iri", None),
        (2, "solverTruth", "datatype", "integer", None), (2, "surrogatePrediction", "maxCount", "2", None), (3, "conformsToProfile", "or", "MISSING", None),
    ]
    assert all(r.requirement and r.fix for r in found.collect())
    assert sorted((r.package_id, r.conforms, r.has_target) for r in shapes.conformance(triples, found).collect()) == [(1, False, True), (2, False, False), (3, False, True), (4, True, True)]


# ---- mutants ----


def test_mutants_against_their_own_baseline(spark):
    rows = [(k, *t) for k in ("1", "2") for t in [("u", "type", "UnitOfAssurance"), ("u", "signature", "s"), ("u", "bindsRequirement", "r"), ("r", "requiredVerificationMethod", "x"), ("u", "hasValidationResult", "v"), ("v", "wasGeneratedBy", "a"), ("a", "activityType", "y"), ("u", "hasCredibilityFactor", "f"), ("f", "factorStatus", "not-assessed")]]
    rows = [r for r in rows if r[:3] != ("2", "u", "signature")]
    triples = spark.createDataFrame(rows, GOAL)
    mutants = mutation.manifest(triples).cache()
    assert sorted(r.mutant for r in mutants.collect()) == ["1#drop-generation#0", "1#drop-requirement#0", "1#drop-signature#0", "2#drop-generation#0", "2#drop-requirement#0"]  # what changes nothing isn't live
    core = [r for r in package_rules.RULES if r.pack == "core"]
    got = {r.mutant: r for r in mutation.verified(triples, mutants, lambda t: package_rules.framed(package_rules.nodes(t), core)).collect()}
    assert all(r.injected and r.delta == 1 for r in got.values())
    assert [tuple(x) for x in got["1#drop-requirement#0"].suppressed] == [("W-AR-03", 1)] and got["1#drop-signature#0"].suppressed == []
    assert triples.count() == len(rows)  # the base stays as it is


def test_mutants_as_edits_of_frames_fire_as_their_copied_packages_do(spark):
    rows = [("1", "u", "type", "UnitOfAssurance"), ("1", "u", "bindsRequirement", "r"), ("1", "r", "requiredVerificationMethod", "x"), ("1", "u", "hasValidationResult", "v"), ("1", "v", "wasGeneratedBy", "a"), ("1", "a", "activityType", "y"), ("1", "u", "hasValidationResult", "w")]
    triples = spark.createDataFrame(rows, GOAL).coalesce(1)
    rules = [r for r in package_rules.RULES if r.id in ("W-EP-02", "W-AR-03", "W-SI-02")]
    mutants = spark.createDataFrame(
        [("m1", "1", "v", [("v", "wasGeneratedBy", "a")], []), ("m2", "1", "u", [("u", "bindsRequirement", "r")], []), ("m3", "1", "b", [], [("b", "activityType", "z")]), ("m4", "1", "w", [], [("w", "wasGeneratedBy", "a")])],
        f"mutant string, package_id string, site string, removed {mutation.TRIPLE}, added {mutation.TRIPLE}",
    ).coalesce(1)
    copied = package_rules.framed(package_rules.nodes(mutation.overlay(triples, mutants)), rules).select("package_id", "pattern_id", "node")
    edited = package_rules.framed(package_rules.nodes(triples), rules, mutants).select("mutant", "pattern_id", "node")
    got = sorted(map(tuple, edited.collect()))
    assert got == sorted(map(tuple, copied.collect()))
    assert ("m1", "W-EP-02", "v") in got and ("m1", "W-AR-03", "v") not in got and ("m2", "W-SI-02", "u") in got and ("m4", "W-AR-03", "w") in got


def test_violations_are_found_in_one_pass_over_nodes(spark):
    from veritrail.operators import shapes

    triples = spark.createDataFrame([(1, "n", "type", t, "iri", None) for t in ("CredibilityFactor", "Disposition")], "package_id long, s string, p string, o string, o_kind string, o_datatype string")
    found = shapes.violations(triples)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == plan.count("Generate") == 1
    # a node of two classes has the violations of both, in whatever order
    assert {(r.path, r.constraint_kind) for r in found.collect()} == {("factorType", "minCount"), ("actionClass", "minCount")}
    told = shapes.conformance_of(shapes.nodes(triples), found).collect()
    assert [(r.conforms, r.has_target, r.failed_paths) for r in told] == [(False, False, ["actionClass", "factorType"])]

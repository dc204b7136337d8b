"""Goal decomposition over triples: is what a goal asks for there, and if not, which clause is the first to fail?

A goal is an ordered list of clauses. Those before ``sufficient_from`` tell whether it concerns a package at all (inner
joins); each of the others must be met under the bindings of those before it (left joins that carry the bindings and the
number of clauses met). Every candidate is followed; the one that comes furthest decides, so a goal is met if any one
candidate meets all clauses. Goals of one form differ in parameters only, which are rows: they are decided in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import KEY, pattern

OUT_OF_SCOPE = "OUT-OF-SCOPE"


@dataclass(frozen=True)
class Form:
    """Clauses (s, p, o): ?x is a variable, $x a parameter of the goal, anything else a constant."""

    clauses: tuple[tuple[str, str, str], ...]
    sufficient_from: int

    def variables(self, most: int) -> list[str]:
        """The variables of the first clauses, parameters left out."""
        return list(dict.fromkeys(t[1:] for c in self.clauses[:most] for t in (c[0], c[2]) if t.startswith("?")))


@dataclass(frozen=True)
class Goal:
    """``missing`` and ``defeater`` say what evidence lacks and what it would help to judge."""

    name: str
    pack: str
    form: Form
    parameters: tuple[tuple[str, str], ...]
    missing: str
    defeater: str


UOA = ("?uoa", "type", "UnitOfAssurance")
SUPPORT = ("?claim", "hasSupportingEvidence", "?evidence")
TAXONOMY = Form((UOA, ("?uoa", "adversarialProvenance", "?prov"), ("?prov", "sourceTaxonomy", "$taxonomy"), ("?uoa", "bindsClaim", "?claim"), SUPPORT, ("?evidence", "type", "$kind")), 5)
TYPED = Form((UOA, ("?uoa", "bindsClaim", "?claim"), ("?claim", "type", "$claim_type"), SUPPORT, ("?evidence", "type", "$kind")), 4)
TYPED_TWICE = Form((UOA, ("?uoa", "bindsClaim", "?claim"), ("?claim", "type", "$claim_type"), SUPPORT, ("?evidence", "type", "$kind"), ("?claim", "hasSupportingEvidence", "?other"), ("?other", "type", "$other_kind")), 4)
BARE = Form((("?claim", "type", "$claim_type"), SUPPORT, ("?evidence", "type", "$kind")), 2)


def _taxonomy(name: str, taxonomy: str, kind: str, missing: str, defeater: str) -> Goal:
    return Goal(f"oos_{name}_warranted", "vv40", TAXONOMY, (("taxonomy", f"oos/{taxonomy}"), ("kind", kind)), missing, defeater)


#: Names of goals, taxonomies, claim types and evidence types.
GOALS = [
    _taxonomy("modelform_adequacy", "subjective-model-form-adequacy", "StructuredComparisonStudy", "comparison of model forms", "whether the model form is adequate"),
    _taxonomy("tacit_knowledge", "tacit-knowledge-transfer", "DocumentedSOP", "written rationale of a tolerance", "whether the tolerance is justified"),
    _taxonomy("behavioral_compliance", "behavioral-compliance", "BehavioralAuditRecord", "audit records of operation", "whether the policy is followed"),
    _taxonomy("jurisdictional_alignment", "regulatory-jurisdiction-conflict", "JurisdictionalAlignmentDocument", "evidence for each jurisdiction", "whether frameworks are reconciled"),
    _taxonomy("clinical_arbitration", "clinical-judgment-arbitration", "ArbitrationRecord", "framework of clinical interpretation", "whether the clinical reading is apt"),
    Goal("oos_surr_calibration_provenance_warranted", "surrogate", TYPED_TWICE, (("claim_type", "CalibrationClaim"), ("kind", "CalibrationEvidence"), ("other_kind", "CalibrationDataProvenance")), "provenance of calibration data", "whether calibration data differ from training data"),
    Goal("oos_surr_model_comparison_warranted", "surrogate", TYPED, (("claim_type", "ComparativePerformanceClaim"), ("kind", "ModelComparisonRecord")), "comparison with another model", "whether the comparative claim holds"),
    Goal("oos_modelform_adequacy_warranted_backward", "substrate", BARE, (("claim_type", "ModelFormAdequacyClaim"), ("kind", "StructuredComparisonStudy")), "comparison of model forms", "whether the model form is adequate"),
]


def bound(triples: DataFrame, clause: tuple[str, str, str]) -> DataFrame:
    """Bindings of one clause; parameters are columns too."""
    s, p, o = (t.replace("$", "?", 1) if t.startswith("$") else t for t in clause)
    return pattern(triples, s, p, o).distinct()


def joined(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    return rows.join(other, [c for c in other.columns if c in rows.columns], how)


def decided(triples: DataFrame, form: Form, goals: list[Goal]) -> DataFrame:
    """(package_id, rule_name, discriminator variables, deepest): how many clauses the best candidate of each binding meets."""
    names = [n for n, _ in goals[0].parameters]
    rows = [(g.name, *[dict(g.parameters)[n] for n in names]) for g in goals]
    own = triples.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in ["rule_name", *names]))
    first, rest = form.clauses[: form.sufficient_from - 1], form.clauses[form.sufficient_from - 1 :]
    state = None
    for clause in first:
        other = bound(triples, clause)
        if any(n in other.columns for n in names) and (state is None or "rule_name" not in state.columns):
            other = joined(other, own)  # the goals, by the parameter that this clause fixes
        state = other if state is None else joined(state, other)
    keys = [KEY, "rule_name", *form.variables(form.sufficient_from - 1)]
    state = state.distinct().withColumn("met", F.lit(len(first)))
    for i, clause in enumerate(rest, len(first)):
        state = joined(state, bound(triples, clause).withColumn("hit", F.lit(True)), "left")
        state = state.withColumn("met", F.when((F.col("met") == i) & F.col("hit"), i + 1).otherwise(F.col("met"))).drop("hit")
    return state.groupBy(*keys).agg(F.max("met").alias("deepest"))


def decompose(triples: DataFrame, goals: list[Goal] = GOALS) -> DataFrame:
    """Verdicts (package_id, rule_name, verdict, subject, failed_clause, evidence_gap): one for each goal and binding that isn't met.

    ``subject`` is the claim that a goal is about. Where a goal doesn't concern a package, or is met, there is no row.
    """
    out = []
    for form in dict.fromkeys(g.form for g in goals):
        own = [g for g in goals if g.form == form]
        total = len(form.clauses)
        text = F.element_at(F.array(*[F.lit(" ".join(c)) for c in form.clauses]), F.col("deepest") + 1)
        pick = lambda attribute, own=own: F.element_at(F.create_map(*[F.lit(x) for g in own for x in (g.name, getattr(g, attribute))]), F.col("rule_name"))
        names = form.variables(form.sufficient_from - 1)
        failed = decided(triples, form, own).where(F.col("deepest") < total)
        bindings = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda _, v: v.isNotNull())
        metadata = F.struct((F.col("deepest") + 1).alias("failed_clause_index"), text.alias("failed_clause"), F.lit(form.sufficient_from).alias("sufficiency_starts_at"), bindings.alias("bindings"))
        gap = F.struct(pick("missing").alias("missing_evidence_type"), pick("defeater").alias("would_support_defeater_evaluation"), metadata.alias("path_two_metadata"))
        out.append(failed.select(KEY, "rule_name", F.lit(OUT_OF_SCOPE).alias("verdict"), F.col("claim").alias("subject"), (F.col("deepest") + 1).alias("failed_clause"), gap.alias("evidence_gap")))
    return reduce(DataFrame.unionByName, out)


def enabled(enable: bool = False, disable: bool = False, pack_default: bool | None = None) -> bool:
    """Whether goals are decided: a flag wins over the pack, and the default is no; both flags at once are an error."""
    if enable and disable:
        raise ValueError("goals can't be enabled and disabled at once")
    return enable or (bool(pack_default) and not disable)


def with_verdicts(packages: DataFrame, triples: DataFrame, goals: list[Goal] = GOALS, **flags) -> DataFrame:
    """Packages with their verdicts in ``oos_results``; where goals aren't enabled the column isn't there at all."""
    if not enabled(**flags):
        return packages
    own = decompose(triples, goals).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("rule_name", "subject", "verdict", "failed_clause"))).alias("oos_results"))
    rows = packages.join(own, KEY, "left")
    return rows.withColumn("oos_results", F.coalesce("oos_results", F.array().cast(rows.schema["oos_results"].dataType)))

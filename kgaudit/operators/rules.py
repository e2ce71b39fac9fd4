"""Weighted rules with defeasible argumentation as expressions.

A rule set and the facts' schema give one projection: a boolean for each rule that fires, the label of each under
grounded semantics, the features, the score and the trace. Attacks are known when the plan is made; only which rules
fire differs by row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgaudit.operators.conditions import condition_text, every, literal, some, template_text

PASS_AT, WARN_AT = 0.0, -0.4


@dataclass(frozen=True)
class Rule:
    id: str
    weight: float = 1.0
    when: Any = None
    because: str = ""
    priority: float = 0.0
    defeats: tuple[str, ...] = ()
    rebuts: tuple[str, ...] = ()
    undercuts: tuple[str, ...] = ()


def rule_from(spec: dict) -> Rule:
    """A rule from its mapping; weights that are no number count 1, single attacks are lists of one."""

    def listed(name: str) -> tuple[str, ...]:
        value = spec.get(name) or ()
        return (value,) if isinstance(value, str) else tuple(value)

    def number(name: str, other: float) -> float:
        try:
            return float(spec.get(name, other))
        except (TypeError, ValueError):
            return other

    return Rule(str(spec["id"]), number("weight", 1.0), spec.get("when", spec.get("conditions")), str(spec.get("because", "")), number("priority", 0.0), listed("defeats"), listed("rebuts"), listed("undercuts"))


def load_rules(path: str) -> list[Rule]:
    """Rules of a YAML file with a list ``rules``; a missing file is an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return [rule_from(x) for x in (yaml.safe_load(f) or {}).get("rules", [])]


def all_of(*facts: tuple) -> dict:
    return {"all": [dict(zip(("fact", "op", "value"), f, strict=False)) for f in facts]}


def any_of(*facts: tuple) -> dict:
    return {"any": [dict(zip(("fact", "op", "value"), f, strict=False)) for f in facts]}


def is_(path: str, value: Any = True) -> tuple:
    return path, "equals", value


# The default rules with their weights, priorities, conditions and attacks.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("type_domain_range_valid", 0.0, all_of(is_("type.domain_valid"), is_("type.range_valid")), "subject and object have the types that the predicate asks for"),
    Rule("type_domain_range_violation", 0.0, any_of(is_("type.domain_valid", False), is_("type.range_valid", False)), "a type is not one that the predicate takes"),
    Rule("spurious_self_referential_claim", 0.0, all_of(is_("type.is_spurious_self_referential")), "subject and object are one thing that the text names once", 90, undercuts=("type_domain_range_valid", "ontology_closure_hpo")),
    Rule("ontology_closure_hpo", 0.4, any_of(is_("ontology.subject_has_ancestors"), is_("ontology.object_has_ancestors")), "the ontology places subject or object"),
    Rule("ontology_sibling_conflict", -0.6, all_of(is_("ontology.is_sibling_conflict")), "subject and object are siblings in the ontology"),
    Rule("retraction_gate", -1.5, all_of(("evidence.retracted_count", "gt", 0)), "retracted: {evidence.retracted}", 100, defeats=("nli_multi_source_support", "nli_single_source_support", "nli_strong_support_margin", "structured_literature_support", "structured_literature_strong", "disgenet_support_bonus", "cosmic_cancer_gene_bonus", "ontology_closure_hpo", "multi_source_bonus")),
    Rule("expression_of_concern", -0.5, all_of(("evidence.concern_count", "gt", 0)), "under concern: {evidence.concerns}"),
    Rule("self_negation_conflict", -1.3, any_of(is_("conflicts.qualifier_negated"), is_("conflicts.has_refuting_evidence")), "the claim or its evidence negates it", 80, defeats=("nli_multi_source_support", "nli_single_source_support", "disgenet_support_bonus")),
    Rule("opposite_predicate_same_context", -1.3, all_of(is_("conflicts.opposite_predicate_same_context")), "known edges of the pair have the opposite polarity"),
    Rule("extraction_low_confidence", -1.1, all_of(is_("extraction.is_low_confidence")), "the triple could not be read with confidence"),
    Rule("multi_source_bonus", 0.2, all_of(is_("evidence.has_multiple_sources"), is_("text_nli.checked", False)), "several sources are given"),
    Rule("multi_source_unverified_penalty", -0.3, all_of(is_("evidence.has_multiple_sources"), is_("text_nli.checked"), is_("text_nli.n_support", 0)), "several sources are given, but none was found to support the claim"),
    Rule("minimal_evidence", -0.6, all_of(("claim.citation_count", "lte", 0)), "no citation is given"),
    Rule("disgenet_support_bonus", 0.5, all_of(is_("curated_kg.curated_kg_match")), "curated associations hold the pair"),
    Rule("disgenet_missing_support_penalty", -0.3, all_of(is_("curated_kg.disgenet_checked"), is_("curated_kg.disgenet_support", False)), "gene-disease associations lack the pair"),
    Rule("structured_literature_support", 0.4, all_of(is_("literature.has_structured_support")), "extracted literature triples hold the pair"),
    Rule("tissue_mismatch", -0.6, all_of(is_("tissue.is_mismatch")), "claimed {tissue.expected}, evidence of {tissue.actual}"),
    Rule("generic_predicate_penalty", -0.5, all_of(is_("extraction.predicate_is_fallback")), "the predicate is a general one"),
    Rule("monarch_missing_support_penalty", -0.2, all_of(is_("curated_kg.monarch_checked"), is_("curated_kg.monarch_support", False)), "the knowledge graph lacks the pair"),
    Rule("structured_literature_strong", 0.3, all_of(("literature.structured_source_count", "gte", 3)), "{literature.structured_source_count} sources in literature triples"),
    Rule("nli_multi_source_support", 0.5, all_of(("text_nli.n_support", "gte", 2)), "{text_nli.n_support} papers support the claim", 40),
    Rule("nli_single_source_support", 0.2, all_of(("text_nli.n_support", "gte", 1), ("text_nli.n_support", "lt", 2)), "one paper supports the claim", 30),
    Rule("nli_strong_support_margin", 0.4, all_of(("text_nli.m_lit", "gte", 1.0)), "margin of the literature {text_nli.m_lit:.2f}", 50),
    Rule("nli_contradiction_detected", -0.6, all_of(("text_nli.n_contradict", "gte", 1)), "{text_nli.n_contradict} papers contradict the claim", 60, rebuts=("nli_multi_source_support", "nli_single_source_support", "nli_strong_support_margin")),
    Rule("nli_negative_margin", -0.8, all_of(("text_nli.m_lit", "lt", 0)), "margin of the literature {text_nli.m_lit:.2f}"),
    Rule("nli_predicate_mismatch", -0.3, all_of(is_("text_nli.claim_predicate_class", "causal"), ("text_nli.predicate_mismatch_count", "gte", 2)), "a causal claim, {text_nli.predicate_mismatch_count} sentences of association"),
    Rule("nli_hedged_claim_penalty", -0.15, all_of(is_("text_nli.claim_is_hedged")), "the claim hedges"),
    Rule("nli_no_evidence_checked", -0.05, all_of(is_("text_nli.checked", False)), "no abstract could be read"),
    Rule("tumor_suppressor_positive_predicate", -0.6, all_of(is_("gene.is_tumor_suppressor"), is_("conflicts.claim_predicate_polarity", "positive")), "a tumour suppressor is said to further something"),
    Rule("cosmic_cancer_gene_bonus", 0.2, all_of(is_("gene.is_cancer_gene")), "the gene is in the cancer gene census"),
    Rule("dl_disjoint_pair_violation", -1.2, all_of(is_("dl.disjoint_pair_violation")), "the classes of subject and object are disjoint", 85, defeats=("ontology_closure_hpo", "disgenet_support_bonus", "structured_literature_support")),
    Rule("dl_domain_violation", -0.8, all_of(is_("dl.domain_valid", False)), "the subject is outside the predicate's domain", 75),
    Rule("dl_range_violation", -0.8, all_of(is_("dl.range_valid", False)), "the object is outside the predicate's range", 75),
    Rule("dl_property_chain_support", 0.3, all_of(is_("dl.property_chain_support")), "a property chain leads to the object", 30),
    Rule("dl_property_chain_conflict", -0.7, all_of(is_("dl.property_chain_conflict")), "a property chain leads elsewhere", 70, rebuts=("dl_property_chain_support",)),
    Rule("dl_universal_violation", -0.9, all_of(is_("dl.universal_violation")), "the object is no allowed filler", 75, defeats=("disgenet_support_bonus", "structured_literature_support")),
    Rule("dl_existential_warning", -0.2, all_of(is_("dl.existential_violation")), "required evidence is missing"),
    Rule("temporal_recent_support_bonus", 0.2, all_of(is_("temporal.has_support"), ("temporal.support_newest_age_years", "within_years", 5)), "supported {temporal.support_newest_age_years} years ago"),
    Rule("temporal_only_old_support_penalty", -0.2, all_of(is_("temporal.has_support"), ("temporal.support_newest_age_years", "older_than_years", 10)), "the newest support is {temporal.support_newest_age_years} years old"),
    Rule("temporal_stale_unsupported_claim", -0.5, all_of(is_("temporal.has_support", False), ("temporal.claim_age_years", "gte", 5)), "{temporal.claim_age_years} years without support"),
    Rule("temporal_longstanding_support_bonus", 0.3, all_of(is_("temporal.longstanding_uncontested_support")), "long supported and never contested", 40),
    Rule("temporal_retraction_after_publication", -0.4, all_of(is_("temporal.has_retraction_after_publication")), "retracted after publication", 60, rebuts=("temporal_longstanding_support_bonus", "temporal_recent_support_bonus")),
    Rule("temporal_quick_retraction", -0.6, all_of(("temporal.earliest_retraction_lag_years", "lte", 2)), "retracted within {temporal.earliest_retraction_lag_years} years", 70, defeats=("temporal_longstanding_support_bonus", "nli_multi_source_support")),
    Rule("temporal_concern_without_resolution", -0.3, all_of(is_("temporal.has_concern"), is_("temporal.has_support_after_concern", False)), "a concern without later support"),
    Rule("temporal_support_after_concern_mitigates", 0.15, all_of(is_("temporal.has_concern"), is_("temporal.has_support_after_concern")), "supported after a concern"),
    Rule("temporal_no_support_since_retraction", -0.25, all_of(is_("temporal.has_retraction"), is_("temporal.no_support_after_retraction")), "no support since the retraction"),
    Rule("temporal_was_supported_until_retraction", 0.0, all_of(is_("temporal.was_supported_before_retraction")), "supported until the retraction"),
)


@dataclass
class Attacks:
    """Who may attack whom, given priorities."""

    by_target: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, rules: list[Rule] | tuple[Rule, ...]) -> Attacks:
        known = {r.id: r for r in rules}
        pairs = set()
        for rule in rules:
            for kind in (rule.defeats, rule.rebuts, rule.undercuts):
                for target in kind:
                    if target in known and rule.priority >= known[target].priority:
                        pairs.add((rule.id, target))
            pairs |= {(t, rule.id) for t in rule.rebuts if t in known and known[t].priority >= rule.priority}
        found = cls({r.id: [] for r in rules})
        for attacker, target in sorted(pairs):
            found.by_target[target].append(attacker)
        return found

    def rounds(self) -> int:
        """Rounds after which grounded labels no longer change: one more than the attacks that follow on each other."""
        depth: dict[str, int] = {}

        def longest(node: str, seen: frozenset) -> int:
            if node in seen:
                return len(self.by_target)
            if node not in depth:
                depth[node] = max((1 + longest(a, seen | {node}) for a in self.by_target[node]), default=0)
            return depth[node]

        return min(len(self.by_target), max((longest(n, frozenset()) for n in self.by_target), default=0)) + 1


def has_defeasible_parts(rules) -> bool:
    """Whether any rule has a priority or an attack (R2)."""
    return any(r.priority or r.defeats or r.rebuts or r.undercuts for r in rules)


def evaluate(df: DataFrame, rules=DEFAULT_RULES, semantics: str = "grounded", facts: str = "facts") -> DataFrame:
    """Adds ``features`` (map of every rule's weight or 0), ``trace``, ``labels`` (map of the rules that fire) and ``score``.

    A rule without attackers that fire, or whose attackers are all out, is in; one with an attacker that is in is out;
    the rest is undecided. Only what is out loses its weight (R4, R5). The score adds features in rule order (R6).
    """
    if semantics != "grounded":
        raise ValueError(f"no semantics {semantics!r}; there is grounded")
    schema = df.schema[facts].dataType
    attacks = Attacks.of(rules)
    attacked = [r for r in rules if attacks.by_target[r.id]]
    fired = {r.id: f"_fired_{i}" for i, r in enumerate(rules)}
    state = {r.id: ("false", "false") if attacks.by_target[r.id] else (fired[r.id], "false") for r in rules}  # in, out
    out = df.select("*", *(F.expr(f"{condition_text(schema, r.when)} AS {fired[r.id]}") for r in rules))
    added = list(fired.values())
    for turn in range(attacks.rounds() if attacked else 0):
        columns = []
        for i, rule in enumerate(attacked):
            by, mine = attacks.by_target[rule.id], fired[rule.id]
            columns.append(f"({mine} AND {every([f'(NOT {fired[a]} OR {state[a][1]})' for a in by])}) AS _in_{turn}_{i}")
            columns.append(f"({mine} AND {some([state[a][0] for a in by])}) AS _out_{turn}_{i}")
        out = out.selectExpr("*", *columns)
        added += [f"_{kind}_{turn}_{i}" for i in range(len(attacked)) for kind in ("in", "out")]
        state |= {r.id: (f"_in_{turn}_{i}", f"_out_{turn}_{i}") for i, r in enumerate(attacked)}

    def value(rule: Rule) -> str:
        return f"if({fired[rule.id]} AND NOT {state[rule.id][1]}, {literal(float(rule.weight))}, 0.0D)"

    def entry(rule: Rule) -> str:
        by = [f"if({state[a][0]} AND {state[rule.id][1]}, {literal(a)}, NULL)" for a in sorted(attacks.by_target[rule.id])]
        defeated = f"filter(array({', '.join(by)}), x -> x IS NOT NULL)" if by else "cast(array() AS array<string>)"
        label = f"CASE WHEN {state[rule.id][0]} THEN 'IN' WHEN {state[rule.id][1]} THEN 'OUT' ELSE 'UNDECIDED' END"
        return f"if({fired[rule.id]}, named_struct('rule_id', {literal(rule.id)}, 'score', {value(rule)}, 'because', {template_text(schema, rule.because)}, 'label', {label}, 'defeated_by', {defeated}), NULL)"

    features = ", ".join(f"{literal(r.id)}, {value(r)}" for r in rules)
    kept = [c for c in df.columns if c not in ("features", "trace", "score")]
    return out.selectExpr(
        *(f"`{c}`" for c in kept),
        f"map({features}) AS features",
        f"filter(array({', '.join(map(entry, rules))}), x -> x IS NOT NULL) AS trace",
        f"{' + '.join(['0.0D', *map(value, rules)])} AS score",
    )


def verdict_of(score: Column) -> Column:
    """The verdict by score alone."""
    return F.when(score >= PASS_AT, "PASS").when(score >= WARN_AT, "WARN").otherwise("FAIL")


def verdict_text(score: str) -> str:
    return f"CASE WHEN {score} >= {PASS_AT}D THEN 'PASS' WHEN {score} >= {WARN_AT}D THEN 'WARN' ELSE 'FAIL' END"

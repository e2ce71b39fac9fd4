"""The ordered gates that turn a score into the final verdict.

Each gate sees the verdict that the gates before it left. A gate is one added column, so the plan grows by a projection
for each gate, and facts that the input lacks make a gate that never opens.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgaudit.operators.conditions import as_number, equal, fact, fact_type, truthy
from kgaudit.operators.rules import verdict_text

# Fixed values of the gates' conditions.
STRONG_SUM, STRONG_PAPER, STRONG_MARGIN, MIXED_MARGIN, HEDGED_SCORE = 0.8, 0.9, 1.0, 0.4, 0.85


class Facts:
    """Typed reading of facts as SQL text, with a default for what is missing."""

    def __init__(self, schema: T.StructType, root: str):
        self.schema, self.root = schema, root

    def read(self, path: str) -> str:
        return fact(self.schema, path, self.root)

    def true(self, path: str) -> str:
        return truthy(self.read(path), fact_type(self.schema, path))

    def false(self, path: str) -> str:
        """Whether the fact is there and false."""
        return "false" if fact_type(self.schema, path) is None else f"coalesce(NOT boolean({self.read(path)}), false)"

    def number(self, path: str) -> str:
        kind = fact_type(self.schema, path)
        return "0.0D" if kind is None else f"coalesce({as_number(self.read(path), kind)}, 0.0D)"

    def equals(self, path: str, value: str) -> str:
        return equal(self.read(path), fact_type(self.schema, path), value)


@dataclass(frozen=True)
class Gate:
    """``opens`` gets the facts and the names of the verdict so far and of the score; ``always_traced`` gates are in the trace whatever the verdict."""

    id: str
    opens: Callable[[Facts, str, str], str]
    to: str
    only_pass: bool = False
    always_traced: bool = False
    unless: str | None = None  # not if this gate's condition holds


def strong_contradiction(f: Facts) -> str:
    one = "false"
    if isinstance(fact_type(f.schema, "text_nli.paper_aggregates"), T.ArrayType):
        one = f"coalesce(exists({f.read('text_nli.paper_aggregates')}, p -> p.paper_type = 'primary_human' AND p.s_neg >= {STRONG_PAPER}D), false)"
    return f"{f.true('text_nli.checked')} AND ({f.number('text_nli.n_contradict')} >= 2 AND {f.number('text_nli.s_neg_total')} >= {STRONG_SUM}D OR {one})"


def causal(f: Facts) -> str:
    return f"{f.true('text_nli.checked')} AND {f.equals('text_nli.claim_predicate_class', 'causal')}"


def weak_causal(f: Facts) -> str:
    support, against = f.number("text_nli.n_support"), f.number("text_nli.n_contradict")
    silent = f"({support} = 0 AND {against} = 0 AND {f.true('evidence.has_multiple_sources')})"
    return f"{causal(f)} AND {support} < 2 AND {f.number('text_nli.m_lit')} < {STRONG_MARGIN}D AND NOT {silent}"


def mixed(f: Facts) -> str:
    return f"{f.true('text_nli.checked')} AND {f.number('text_nli.n_support')} >= 1 AND {f.number('text_nli.n_contradict')} >= 1 AND abs({f.number('text_nli.m_lit')}) < {MIXED_MARGIN}D"


NO_SUPPORT = "gate:nli_no_support_with_contradiction"
GATES: tuple[Gate, ...] = (
    Gate("gate:retraction", lambda f, v, s: f"{f.number('evidence.retracted_count')} > 0", "FAIL"),
    Gate("gate:expression_of_concern", lambda f, v, s: f"{f.number('evidence.concern_count')} > 0", "WARN", only_pass=True, unless="gate:retraction"),
    Gate("gate:positive_evidence_required", lambda f, v, s: f"NOT ({f.true('evidence.has_multiple_sources')} OR {f.true('curated_kg.curated_kg_match')})", "WARN", only_pass=True),
    Gate("gate:self_negation", lambda f, v, s: f"{f.true('conflicts.qualifier_negated')} OR {f.true('conflicts.has_refuting_evidence')}", "FAIL"),
    Gate("gate:opposite_predicate", lambda f, v, s: f.true("conflicts.opposite_predicate_same_context"), "FAIL"),
    Gate("gate:low_confidence", lambda f, v, s: f.true("extraction.is_low_confidence"), "FAIL"),
    Gate("gate:type_violation", lambda f, v, s: f"{f.false('type.domain_valid')} OR {f.false('type.range_valid')}", "FAIL"),
    Gate("gate:spurious_self_referential", lambda f, v, s: f.true("type.is_spurious_self_referential"), "FAIL"),
    Gate("gate:sibling_conflict", lambda f, v, s: f.true("ontology.is_sibling_conflict"), "WARN", only_pass=True),
    Gate("gate:tissue_mismatch", lambda f, v, s: f.true("tissue.is_mismatch"), "WARN", only_pass=True),
    Gate("gate:nli_strong_contradiction", lambda f, v, s: f"{strong_contradiction(f)} AND {v} <> 'FAIL'", "FAIL"),
    Gate(NO_SUPPORT, lambda f, v, s: f"{causal(f)} AND {f.number('text_nli.n_support')} = 0 AND {f.number('text_nli.n_contradict')} >= 1 AND {v} <> 'FAIL'", "FAIL"),
    Gate("gate:nli_weak_causal_support", lambda f, v, s: weak_causal(f), "WARN", only_pass=True, unless=NO_SUPPORT),
    Gate("gate:nli_mixed_evidence", lambda f, v, s: mixed(f), "WARN", only_pass=True, always_traced=True),
    Gate("gate:nli_hedged_claim", lambda f, v, s: f"{f.true('text_nli.claim_is_hedged')} AND {s} < {HEDGED_SCORE}D", "WARN", only_pass=True),
)


def apply_gates(df: DataFrame, gates: tuple[Gate, ...] = GATES, facts: str = "facts", score: str = "score") -> DataFrame:
    """Adds ``verdict`` and ``gate_trace`` (ids of the gates that opened, in order)."""
    f = Facts(df.schema[facts].dataType, facts)
    kept = [f"`{c}`" for c in df.columns if c not in ("verdict", "gate_trace")]
    out = df.selectExpr("*", f"{verdict_text(score)} AS _v0")
    held = {}
    for i, gate in enumerate(gates):
        holds = f"({gate.opens(f, f'_v{i}', score)})"
        if gate.unless in held:
            holds = f"({holds} AND NOT {held[gate.unless]})"
        held[gate.id] = f"_held{i}"
        opens = f"({holds} AND _v{i} = 'PASS')" if gate.only_pass else holds
        traced = holds if gate.always_traced else opens
        out = out.selectExpr("*", f"{holds} AS _held{i}", f"{traced} AS _traced{i}", f"if({opens}, '{gate.to}', _v{i}) AS _v{i + 1}")
    trace = ", ".join(f"if(_traced{i}, '{g.id}', NULL)" for i, g in enumerate(gates))
    return out.selectExpr(*kept, f"_v{len(gates)} AS verdict", f"filter(array({trace}), x -> x IS NOT NULL) AS gate_trace")


def strict_ontology(df: DataFrame) -> DataFrame:
    """What if sibling conflicts failed a claim: the verdict where that gate is in the trace."""
    return df.withColumn("verdict", F.when(F.array_contains("gate_trace", "gate:sibling_conflict"), "FAIL").otherwise(F.col("verdict")))

"""The batch audit: facts of every claim, rules, gates, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgaudit.operators import evidence, gates, rules

#: Rules that read the facts that orders and lines provide.
EVIDENCE_RULES = tuple(
    r
    for r in rules.DEFAULT_RULES
    if r.id
    in {
        "retraction_gate", "expression_of_concern", "multi_source_bonus", "minimal_evidence", "temporal_recent_support_bonus",
        "temporal_only_old_support_penalty", "temporal_longstanding_support_bonus", "temporal_retraction_after_publication", "temporal_no_support_since_retraction",
    }
)


def evidence_groups(claims: DataFrame, prov: DataFrame, as_of_year: int) -> DataFrame:
    """One row per claim with the structs ``claim``, ``evidence`` and ``temporal``.

    Provenance is ``(claim_id, identifier, status, pub_year)``; a notice counts in the year of the publication where it
    has no date of its own. Counts and years come from one aggregation, so provenance is shuffled once.
    """
    year = lambda s: F.when(F.col("status") == s, F.col("pub_year"))
    n = lambda s: F.count_if(F.col("status") == s)
    facts = prov.groupBy("claim_id").agg(
        F.count("*").alias("citation_count"), n("retracted").alias("retracted_count"), n("concern").alias("concern_count"), n("clean").alias("clean_count"),
        F.min("pub_year").alias("first_pub"), F.min(year("clean")).alias("support_oldest_year"), F.max(year("clean")).alias("support_newest_year"),
        F.min(year("concern")).alias("first_concern"), F.max(year("concern")).alias("latest_concern_year"),
        F.min(year("retracted")).alias("earliest_retraction_year"), F.max(year("retracted")).alias("latest_retraction_year"),
    )
    joined = claims.join(facts, "claim_id", "left").na.fill(0, ["citation_count", "retracted_count", "concern_count", "clean_count"])
    temporal = evidence.temporal_columns(as_of_year)
    return joined.select(
        *claims.columns,
        F.struct("citation_count").alias("claim"),
        F.struct("retracted_count", "concern_count", "clean_count", (F.col("citation_count") >= 2).alias("has_multiple_sources")).alias("evidence"),
        F.struct(*(c.alias(name) for name, c in temporal.items())).alias("temporal"),
    )


def with_facts(df: DataFrame, groups: dict[str, Column] | None = None, names: tuple[str, ...] = ("claim", "evidence", "temporal")) -> DataFrame:
    """Adds ``facts``, the struct of the groups that are columns and of further ones."""
    more = [c.alias(n) for n, c in (groups or {}).items()]
    return df.withColumn("facts", F.struct(*(n for n in names if n in df.columns), *more)).drop(*names)


def unchecked_text() -> Column:
    """The facts of claims whose abstracts weren't read."""
    return F.struct(F.lit(False).alias("checked"), F.lit(0).alias("n_support"), F.lit(0).alias("n_contradict"))


def audit(facts: DataFrame, rule_set=rules.DEFAULT_RULES, gate_set=gates.GATES) -> DataFrame:
    """Score, trace and verdict of claims with a ``facts`` struct: one projection after the facts, no shuffle."""
    return gates.apply_gates(rules.evaluate(facts, rule_set), gate_set)


def audit_evidence(claims: DataFrame, prov: DataFrame, as_of_year: int, rule_set=EVIDENCE_RULES) -> DataFrame:
    """The audit of claims by their citations alone."""
    return audit(with_facts(evidence_groups(claims, prov, as_of_year), {"text_nli": unchecked_text()}), rule_set)


def simulated_retraction(prov: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Provenance as if the listed identifiers had been retracted."""
    listed = identifiers.select("identifier").distinct().withColumn("_gone", F.lit(True))
    return prov.join(listed, "identifier", "left").withColumn("status", F.when(F.col("_gone"), "retracted").otherwise(F.col("status"))).drop("_gone")


def explained(audited: DataFrame) -> DataFrame:
    """One line of text for each rule and gate of a claim's trace."""
    rule = F.transform("trace", lambda t: F.concat(t["rule_id"], F.lit(" "), t["score"].cast("string"), F.lit(": "), t["because"]))
    return audited.select("claim_id", "verdict", F.posexplode(F.concat(rule, "gate_trace")).alias("line_no", "line"))

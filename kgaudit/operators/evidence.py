"""Provenance and temporal evidence of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgaudit.functions.ids import citation_kind, is_literature, normal_citation, source_kind, status_hint

FRESH_YEARS, STALE_YEARS, LONG_YEARS, HALF_LIFE, LEAST_DECAY = 5, 10, 10, 10.0, 0.1


def year_of(text: Column, as_of_year: int) -> Column:
    """The year that a date text begins with, within 1900 and next year; else null."""
    year = F.expr("1") * F.regexp_extract(text, r"^(\d{4})", 1).try_cast("int")
    return F.when((year >= 1900) & (year <= as_of_year + 1), year)


def first_year(dates: list[Column], other: Column, as_of_year: int) -> Column:
    """Year of the first date that is given, null where it can't be read; ``other`` where none is given."""
    given = F.coalesce(*(F.when(F.trim(d) != "", d) for d in dates))
    return F.when(given.isNotNull(), year_of(given, as_of_year)).otherwise(other)


def claim_citations(claims: DataFrame) -> DataFrame:
    """``(claim_id, ord, identifier)``: the citations of claims ``(claim_id, citations array)``, trimmed, each once."""
    once = F.array_distinct(F.filter(F.transform("citations", lambda x: F.trim(x)), lambda x: x != ""))
    return claims.select("claim_id", F.posexplode(once).alias("ord", "identifier"))


def provenance(citations: DataFrame, known: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """Citations with kind, status and source.

    ``known(identifier, status, …)`` is what was fetched before; what it lacks gets the status that its identifier
    names. ``notices(identifier, notice_status)`` overrides that of literature, with retractions and concerns only.
    """
    keyed = citations.withColumn("key", normal_citation(F.col("identifier")))
    found = known.withColumnsRenamed({"identifier": "known_id", "status": "known_status"})
    found = found.withColumn("key", normal_citation(F.col("known_id"))).dropDuplicates(["key"]).drop("known_id")
    joined = keyed.join(found, "key", "left")
    literature = is_literature(F.col("identifier"))
    status = F.when(~literature, "clean").otherwise(F.coalesce("known_status", status_hint(F.col("identifier"))))
    if notices is not None:
        told = notices.select(normal_citation(F.col("identifier")).alias("key"), "notice_status").dropDuplicates(["key"])
        joined = joined.join(told, "key", "left")
        status = F.when(literature & F.col("notice_status").isin("retracted", "concern"), F.col("notice_status")).otherwise(status)
    kind = F.when(literature, citation_kind(F.col("identifier"))).otherwise("other")
    source = F.when(~literature, "other").when(F.col("known_status").isNotNull(), "cache").otherwise("heuristic")
    return joined.withColumns({"status": status, "kind": kind, "source": source}).drop("known_status", "notice_status", "key")


def source_references(edges: DataFrame, known: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """``(*key, no, identifier, source_type, status)`` of the sources of edges ``(*key, sources)``, in their order.

    Identifiers are normalised on both sides. Of what is known of one, ``known(identifier, status)``, the last in the
    column ``order`` counts; what nothing is known of has the status ``unknown``. ``key`` may name the claim in both
    tables, so that a claim's edges see its own provenance.
    """
    shared = [k for k in key if k in known.columns]
    last = known.groupBy(*shared, normal_citation(F.col("identifier")).alias("identifier")).agg(F.max_by("status", order).alias("_status"))
    cited = edges.select(*key, F.posexplode("sources").alias("no", "_source")).withColumn("identifier", normal_citation(F.col("_source")))
    joined = cited.join(last, [*shared, "identifier"], "left")
    return joined.select(*key, "no", "identifier", source_kind(F.col("identifier")).alias("source_type"), F.coalesce("_status", F.lit("unknown")).alias("status"))


def evidence_facts(prov: DataFrame, key: str = "claim_id") -> DataFrame:
    """Citations of each claim by status (A5)."""
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("identifier"))))
    n = lambda s: F.count_if(F.col("status") == s)
    facts = prov.groupBy(key).agg(
        of("retracted").alias("retracted"), of("concern").alias("concerns"), of("clean").alias("clean"),
        n("retracted").alias("retracted_count"), n("concern").alias("concern_count"), n("clean").alias("clean_count"),
        F.count("identifier").alias("citation_count"),
    )
    return facts.withColumn("has_multiple_sources", F.col("citation_count") >= 2)


def decay(age: Column, half_life: float = HALF_LIFE, least: float = LEAST_DECAY) -> Column:
    """How far evidence of an age still counts: halves with the half-life, down to a floor."""
    return F.when(age.isNull() | (age <= 0), F.lit(1.0)).otherwise(F.greatest(F.pow(F.lit(0.5), age / half_life), F.lit(least)))


def temporal_years(prov: DataFrame, key: str, pub_year: Column, concern_year: Column, retraction_year: Column, status: Column) -> DataFrame:
    """Bounds of the years of each claim's citations, from one pass with partial aggregation."""
    support = F.when(status == "clean", pub_year)
    return prov.groupBy(key).agg(
        F.min(pub_year).alias("first_pub"), F.min(support).alias("support_oldest_year"), F.max(support).alias("support_newest_year"),
        F.min(concern_year).alias("first_concern"), F.max(concern_year).alias("latest_concern_year"),
        F.min(retraction_year).alias("earliest_retraction_year"), F.max(retraction_year).alias("latest_retraction_year"),
    )


def temporal_columns(as_of_year: int, claim_year: Column | None = None, n_support: Column | None = None) -> dict[str, Column]:
    """The temporal facts, from the bounds of ``temporal_years`` (A6, A7). Lags start at the first publication of all."""
    c = F.col
    now = F.lit(as_of_year)
    has_support, has_retraction, has_concern = c("support_newest_year").isNotNull(), c("latest_retraction_year").isNotNull(), c("latest_concern_year").isNotNull()
    newest, oldest = (now - c("support_newest_year")).cast("double"), (now - c("support_oldest_year")).cast("double")
    span = (c("support_newest_year") - c("support_oldest_year")).cast("double")
    sure = lambda x: F.coalesce(x, F.lit(False))
    lag = lambda x: F.when(c(x) >= c("first_pub"), (c(x) - c("first_pub")).cast("double"))
    return {
        "now_year": now,
        "has_support": has_support,
        "has_support_with_nli": has_support | (F.coalesce(n_support, F.lit(0)) > 0) if n_support is not None else has_support,
        "support_newest_age_years": newest,
        "support_oldest_age_years": oldest,
        "support_span_years": span,
        "has_support_within_5y": sure(newest <= FRESH_YEARS),
        "has_only_old_support_10y": sure(newest > STALE_YEARS),
        "has_retraction": has_retraction,
        "has_concern": has_concern,
        "has_retraction_after_publication": sure(c("latest_retraction_year") >= c("first_pub")),
        "has_concern_after_publication": sure(c("latest_concern_year") >= c("first_pub")),
        "earliest_retraction_lag_years": lag("earliest_retraction_year"),
        "earliest_concern_lag_years": lag("first_concern"),
        "no_support_after_retraction": F.coalesce(c("support_newest_year") <= c("latest_retraction_year"), F.lit(True)),
        "has_support_after_concern": sure(c("support_newest_year") > c("first_concern")),
        "years_since_concern": (now - c("latest_concern_year")).cast("double"),
        "years_since_retraction": (now - c("latest_retraction_year")).cast("double"),
        "claim_age_years": (now - claim_year).cast("double") if claim_year is not None else F.lit(None).cast("double"),
        "longstanding_uncontested_support": sure(span >= LONG_YEARS) & ~has_retraction & ~has_concern,
        "was_supported_before_retraction": sure(c("support_oldest_year") < c("earliest_retraction_year")),
        "freshness_decay_factor": F.when(has_support, decay(newest)).otherwise(F.lit(0.5)),
        "staleness_factor": F.when(has_support, 1.0 - decay(oldest)).otherwise(F.lit(0.0)),
    }

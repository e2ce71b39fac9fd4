"""Tables that are kept and changed: merge by property, provenance cache, claims and reports as JSON, feedback.

Every store is a folder of files that Spark reads and writes, so it may be in any shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.session import exists, written

#: What becomes of a property when a key is merged: ``last`` takes the last value that isn't null, ``create`` the value
#: of the row that made the key, ``union`` the distinct items of all lists, sorted, and the others an aggregate.
POLICIES = ("last", "create", "union", "max", "min", "sum")
BUCKETS = 64


def merged(old: DataFrame, new: DataFrame, key: list[str], policies: dict[str, str], order: str) -> DataFrame:
    """One row for each key of both tables, each property by its policy; what isn't named is ``last``.

    Rows of ``old`` come before those of ``new``, which come in ``order``. A property that one table lacks stays as the
    other has it. Partial aggregates are combined, so a key with many updates meets in no task.
    """
    rows = old.withColumn("_era", F.lit(0)).unionByName(new.withColumn("_era", F.lit(1)), allowMissingColumns=True)
    place = F.struct("_era", order)

    def value(c: str) -> Column:
        policy = policies.get(c, "last")
        if policy == "last":
            return F.max_by(c, F.when(F.col(c).isNotNull(), place))
        if policy == "create":
            return F.min_by(F.struct(c), place)[c]
        if policy == "union":
            return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
        if policy in POLICIES:
            return getattr(F, policy)(c)
        raise ValueError(f"unknown policy {policy}")

    return rows.groupBy(*key).agg(*(value(c).alias(c) for c in rows.columns if c not in (*key, "_era")))


def merge_into(spark: SparkSession, path: str, new: DataFrame, key: list[str], policies: dict[str, str], order: str, buckets: int = BUCKETS) -> None:
    """Merges rows into the table of a folder, and makes it if it isn't there.

    The table is dealt to buckets by the key's hash. Only the buckets that the new rows fall into are read, merged and
    written again; the others stay as they are. The merged rows are written elsewhere first, for they are read from the
    buckets that they replace.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets))
    incoming = written(new.withColumn("bucket", bucket))
    touched = [r["bucket"] for r in incoming.select("bucket").distinct().collect()]  # at most ``buckets`` rows
    if not touched:
        return
    fresh = incoming.drop("bucket")
    old = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket") if exists(spark, path) else fresh.limit(0)
    made = written(merged(old, fresh, key, policies, order).withColumn("bucket", bucket))
    made.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def table_at(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table made by ``merge_into``."""
    return spark.read.parquet(path).drop("bucket")


def through_cache(spark: SparkSession, path: str, requests: DataFrame, fetch: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """What ``fetch`` gives for the distinct keys of ``requests``, kept in a folder: hits with ``cached`` true, fetched rows with false.

    Only keys that the folder lacks are fetched; they are appended by one write, which appears whole or not at all. Should
    two runs fetch a key at once, the row that sorts first counts. A fetch without a row for a key is tried again next time.
    """
    wanted = requests.select(*key).distinct()
    if not exists(spark, path):
        found = written(fetch(wanted))
        found.write.mode("append").parquet(path)
        return found.withColumn("cached", F.lit(False))
    kept = spark.read.parquet(path)
    rest = [c for c in kept.columns if c not in key]
    one = kept.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))
    hits = written(wanted.join(one, key))
    found = written(fetch(wanted.join(hits, key, "left_anti")).select(*hits.columns))
    found.write.mode("append").parquet(path)
    return hits.withColumn("cached", F.lit(True)).union(found.withColumn("cached", F.lit(False)))


ENTITY = "struct<curie: string, label: string>"
CLAIM = f"id string, claim string, subject {ENTITY}, subject_type string, predicate string, object {ENTITY}, object_type string, qualifiers map<string, string>, evidence array<struct<type: string, id: string, pmid: string, status: string>>, expected_decision string, _broken string"
#: Kinds of evidence whose own identifier is the citation.
NAMED_EVIDENCE = ("go", "reactome", "mondo", "hpo", "uberon")


def claims_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Claims of files with one JSON object a line.

    ``(claim_id, text, entities, evidence, predicate, qualifiers, expected_decision, structured_evidence, broken)``. An
    entity needs an identifier and a label. Lines that don't parse are rows with the line in ``broken``; empty lines are
    none. Evidence is ``PMID:`` and a number, or the identifier of a term.
    """
    rows = spark.read.schema(CLAIM).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)

    def entity(c: str) -> Column:
        curie, label = F.col(f"{c}.curie"), F.col(f"{c}.label")
        made = F.struct(
            label.alias("mention"), curie.alias("norm_id"), label.alias("norm_label"), F.lit("fixture").alias("source"),
            F.create_map(F.lit("category"), F.coalesce(f"{c}_type", F.lit("unknown")), F.lit("role"), F.lit(c)).alias("metadata"),
        )
        return F.when((F.coalesce(curie, F.lit("")) != "") & (F.coalesce(label, F.lit("")) != ""), made)

    known = lambda x: F.coalesce(x, F.lit("")) != ""
    cited = F.transform("evidence", lambda e: F.when((e["type"] == "pubmed") & known(e["pmid"]), F.concat(F.lit("PMID:"), e["pmid"])).when(e["type"].isin(*NAMED_EVIDENCE) & known(e["id"]), e["id"]))
    return rows.select(
        F.col("id").alias("claim_id"), F.coalesce("claim", F.lit("")).alias("text"), F.array_compact(F.array(entity("subject"), entity("object"))).alias("entities"),
        F.coalesce(F.array_compact(cited), F.array().cast("array<string>")).alias("evidence"), "predicate", "qualifiers", "expected_decision", F.col("evidence").alias("structured_evidence"), F.col("_broken").alias("broken"),
    )


def reports_to_json(reports: DataFrame, key: str = "claim_id") -> DataFrame:
    """``(key, report)``: every column of a row as one JSON object, nulls too."""
    return reports.select(key, F.to_json(F.struct(*reports.columns), {"ignoreNullFields": "false"}).alias("report"))


def reports_from_json(kept: DataFrame, schema) -> DataFrame:
    """The rows that ``reports_to_json`` wrote; the schema is that of the reports. A report that doesn't parse raises."""
    return kept.select(F.from_json("report", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def structured_evidence(evidence: Column) -> Column:
    """Citations as ``(type, pmid, id)``: PubMed, DOI, or other; blank ones drop out."""

    def one(e: Column) -> Column:
        starts, behind = lambda p: F.upper(e).startswith(p), F.regexp_replace(e, "^[^:]*:", "")
        kind = F.when(starts("PMID:"), "pubmed").when(starts("DOI:"), "doi").otherwise("other")
        return F.struct(kind.alias("type"), F.when(starts("PMID:"), behind).alias("pmid"), F.when(starts("DOI:"), behind).when(~starts("PMID:"), e).alias("id"))

    return F.transform(F.filter(F.transform(evidence, lambda e: F.btrim(e)), lambda e: e != ""), one)


def append_feedback(rows: DataFrame, path: str, batch: str, at: str) -> None:
    """Appends claims that users labelled, ``(claim, evidence, label, comment, normalization_failed)``, as JSON lines.

    ``subject`` and ``object`` structs are kept where there are such columns. A batch has a folder of its own, so one
    that is repeated after a failure replaces itself and doubles nothing. The identifier is a hash of batch and content.
    """
    have = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    comment, failed = have("comment", "string"), have("normalization_failed", "boolean")
    metadata = F.struct(F.lit(at).alias("timestamp"), F.lit("user_feedback").alias("source"), F.when(comment != "", comment).alias("comment"), F.when(failed, failed).alias("normalization_failed"))
    number = F.md5(F.concat_ws("\x1f", F.lit(batch), "claim", "label", F.array_join("evidence", "\x1e"), F.coalesce(comment, F.lit(""))))
    record = rows.select(number.alias("id"), "claim", structured_evidence(F.col("evidence")).alias("evidence"), F.col("label").alias("expected_decision"), metadata.alias("metadata"), *(c for c in ("subject", "object") if c in rows.columns))
    record.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")

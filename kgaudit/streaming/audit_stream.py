"""The audit of a stream of claims.

An audit has no state besides the tables it joins, so a stream of claims is audited batch by batch, and a claim that
comes twice within the watermark is audited once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from kgaudit.plans import audit


def once(claims: DataFrame, at: str = "received_at", within: str = "1 hour") -> DataFrame:
    """Claims without those whose id was seen within the watermark."""
    return claims.withWatermark(at, within).dropDuplicatesWithinWatermark(["claim_id"])


def audit_stream(claims: DataFrame, prov: DataFrame, as_of_year: int, out: str, checkpoint: str, at: str = "received_at"):
    """Starts a query that appends the verdicts of a stream of claims to a Parquet folder.

    Each batch is one plan; a batch that is repeated after a failure overwrites its own folder.
    """

    def batch(df: DataFrame, number: int) -> None:
        found = audit.audit_evidence(df.select("claim_id"), prov, as_of_year)
        found.select("claim_id", "score", "verdict", "gate_trace").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return once(claims, at).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(start: Callable, *args, **kwargs) -> None:
    """Runs a stream over what is there, to its end."""
    query = start(*args, **kwargs)
    query.awaitTermination()

"""Registry of this subpackage's queries and of the SQL of those that SQL can express."""

from __future__ import annotations

from kgaudit.llm.decontaminate import op3_benchmark_decontamination
from kgaudit.llm.divergence import OP12_SQL, op12_source_divergence
from kgaudit.llm.embeddings import op8_embedding_near_dedup
from kgaudit.llm.licenses import BASE_SQL as LICENSE_SQL
from kgaudit.llm.licenses import license_scan_base, op1_license_scan
from kgaudit.llm.mixing import BASE_SQL as MIX_SQL
from kgaudit.llm.mixing import mix_base, op5_mix_sources
from kgaudit.llm.pii import BASE_SQL as PII_SQL
from kgaudit.llm.pii import op6_pii, pii_base_counts
from kgaudit.llm.pieces import op13_sentencepiece
from kgaudit.llm.quality import op4_quality_classifier
from kgaudit.llm.repetitions import op11_periodic_runs
from kgaudit.llm.simhash import op7_simhash_near_dedup
from kgaudit.llm.substrings import OP9_SQL, op9_suffix_array_dedup
from kgaudit.llm.urls import OP2_SQL, op2_url_filter
from kgaudit.llm.warc import OP10_SQL, op10_warc


def queries() -> dict:
    ops = (
        op1_license_scan,
        op2_url_filter,
        op3_benchmark_decontamination,
        op4_quality_classifier,
        op5_mix_sources,
        op6_pii,
        op7_simhash_near_dedup,
        op8_embedding_near_dedup,
        op9_suffix_array_dedup,
        op10_warc,
        op11_periodic_runs,
        op12_source_divergence,
        op13_sentencepiece,
        license_scan_base,
        mix_base,
        pii_base_counts,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "mix_base": MIX_SQL, "op9_suffix_array_dedup": OP9_SQL, "op10_warc": OP10_SQL, "op12_source_divergence": OP12_SQL, "license_scan_base": LICENSE_SQL, "pii_base_counts": PII_SQL}

"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, exact_dedup, language_id, merkle, near_dedup, packing, pii, repeated_spans, secrets, token_output, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        exact_dedup.op1_exact_dedup, warc.op2_warc, packing.op3_best_fit_packing, url_filter.op4_url_filter, language_id.op5_language_id,
        near_dedup.op6_minhash_near_dedup, repeated_spans.op7_repeated_spans, decontaminate.op8_decontaminate, pii.op9_pii, token_output.op10_token_output,
        secrets.op11_secrets, alignment.op12_token_alignment, merkle.op13_merkle_manifest,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.SQL, "op2_warc": warc.SQL, "op6_minhash_near_dedup": near_dedup.SQL, "op7_repeated_spans": repeated_spans.SQL,
    "op8_decontaminate": decontaminate.SQL, "op13_merkle_manifest": merkle.SQL,
}

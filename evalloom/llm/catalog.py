"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalloom.llm import inner_products, langid, manifest, merkle, minhash, packing, pii, quality, secret_scan, sentencepieces, sharding, suffixes, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_kd_sharding": sharding.query,
        "op2_sentencepiece": sentencepieces.query,
        "op3_secret_scan": secret_scan.query,
        "op4_suffix_dedup": suffixes.query,
        "op5_merkle_fingerprint": merkle.query,
        "op6_tokenizer_fertility": quality.query,
        "op7_pii": pii.query,
        "op8_best_fit_packing": packing.query,
        "op9_language_id": langid.query,
        "op10_minhash_dedup": minhash.query,
        "op11_whitening": whitening.query,
        "op12_merkle_manifest": manifest.query,
        "op13_exact_top_k": inner_products.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix_dedup": suffixes.SQL, "op10_minhash_dedup": minhash.SQL, "op12_merkle_manifest": manifest.SQL, "op13_exact_top_k": inner_products.SQL}

"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from datawarden.llm import (
    chat,
    filter_audit,
    infill,
    jaccard,
    language,
    licenses,
    mixing,
    packing,
    secrets,
    substrings,
    suffix_tree,
    syncmers,
    topk,
)
from datawarden.llm.common import ship


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_top_k": topk.op2_top_k,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_suffix_tree": suffix_tree.op5_suffix_tree,
    "op6_language_id": language.op6_language_id,
    "op7_syncmers": syncmers.op7_syncmers,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_pack": packing.op10_pack,
    "op11_fill_in_middle": infill.op11_fill_in_middle,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_secret_scan": secrets.op13_secret_scan,
}

QUERIES = {name: _shipped(query) for name, query in _QUERIES.items()}

ORACLE = {
    "op1_chat_format": chat.SQL,
    "op2_top_k": topk.SQL,
    "op3_mix_sources": mixing.SQL,
    "op9_substring_dedup": substrings.SQL,
    "op11_fill_in_middle": infill.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_secret_scan": secrets.SQL,
}

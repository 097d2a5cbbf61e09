"""The queries of this subpackage, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import exact_dedup, mixing, near_dedup, quality_rules, secret_scan, substring_dedup, suffix_dedup
from quern.llm.byte_bpe import op4_byte_bpe
from quern.llm.exact_dedup import op7_exact_dedup
from quern.llm.mixing import op2_mixing
from quern.llm.near_dedup import op5_minhash_near_dedup
from quern.llm.quality_classifier import op10_quality_classifier
from quern.llm.quality_rules import op3_quality_rules
from quern.llm.secret_scan import op8_secret_scan
from quern.llm.sharding import op6_sharding
from quern.llm.substring_dedup import op1_substring_dedup
from quern.llm.suffix_dedup import op9_suffix_array_dedup

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_mixing, op3_quality_rules, op4_byte_bpe, op5_minhash_near_dedup, op6_sharding, op7_exact_dedup, op8_secret_scan, op9_suffix_array_dedup, op10_quality_classifier)
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE, "op2_mixing": mixing.ORACLE, "op3_quality_rules": quality_rules.ORACLE, "op5_minhash_near_dedup": near_dedup.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE, "op8_secret_scan": secret_scan.ORACLE, "op9_suffix_array_dedup": suffix_dedup.ORACLE,
}

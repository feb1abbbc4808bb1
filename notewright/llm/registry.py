"""The contract queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from notewright.llm.chat_format import OP1_SQL, op1_chat_format
from notewright.llm.embedding_dedup import OP3_SQL, op3_embedding_dedup
from notewright.llm.html_extraction import op6_html_extraction
from notewright.llm.language_id import op4_language_id
from notewright.llm.mixing import OP10_SQL, op10_mixing
from notewright.llm.near_dedup import OP9_SQL, op9_near_dedup
from notewright.llm.packing import op2_packing
from notewright.llm.quality import op7_quality_rules
from notewright.llm.token_counts import op5_token_counts
from notewright.llm.toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_packing": op2_packing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_rules": op7_quality_rules,
    "op8_toxicity": op8_toxicity,
    "op9_near_dedup": op9_near_dedup,
    "op10_mixing": op10_mixing,
}
ORACLES: dict[str, str] = {"op1_chat_format": OP1_SQL, "op3_embedding_dedup": OP3_SQL, "op9_near_dedup": OP9_SQL, "op10_mixing": OP10_SQL}

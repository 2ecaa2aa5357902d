"""The queries of this subpackage, by name, and the SQL of those that SQL can express.

None of the ten has SQL: their hashes, models, codes and encodings are not DuckDB functions, or
would take it hours on whole tables. tests/llm holds each against a plain version instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempora.llm.bpe import op5_bpe
from tempora.llm.chat import op9_chat
from tempora.llm.jpeg import op2_media
from tempora.llm.langid import op3_langid
from tempora.llm.licenses import op4_licenses
from tempora.llm.packing import op7_packing
from tempora.llm.pii import op6_pii
from tempora.llm.quality import op8_quality
from tempora.llm.simhash import op1_simhash
from tempora.llm.toxicity import op10_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_media": op2_media,
        "op3_langid": op3_langid,
        "op4_licenses": op4_licenses,
        "op5_bpe": op5_bpe,
        "op6_pii": op6_pii,
        "op7_packing": op7_packing,
        "op8_quality": op8_quality,
        "op9_chat": op9_chat,
        "op10_toxicity": op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {}

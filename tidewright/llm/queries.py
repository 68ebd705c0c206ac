"""Queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.bpe import op4_bpe_round_trip
from tidewright.llm.chats import OP5_SQL, op5_chat_format
from tidewright.llm.decontaminate import OP6_SQL, op6_decontaminate
from tidewright.llm.licenses import op8_license_scan
from tidewright.llm.packing import op11_packing
from tidewright.llm.phrases import OP12_SQL, op12_phrase_collocations
from tidewright.llm.pii import op1_pii_scan
from tidewright.llm.quality import OP7_SQL, op7_line_quality
from tidewright.llm.secrets import op2_secret_scan
from tidewright.llm.simhash import op9_simhash_near_dedup
from tidewright.llm.substrings import OP3_SQL, op3_substring_dedup
from tidewright.llm.urls import OP10_SQL, op10_url_filter
from tidewright.llm.vectors import OP13_SQL, op13_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_scan": op1_pii_scan,
        "op2_secret_scan": op2_secret_scan,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_chat_format": op5_chat_format,
        "op6_decontaminate": op6_decontaminate,
        "op7_line_quality": op7_line_quality,
        "op8_license_scan": op8_license_scan,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_url_filter": op10_url_filter,
        "op11_packing": op11_packing,
        "op12_phrase_collocations": op12_phrase_collocations,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": OP3_SQL,
        "op5_chat_format": OP5_SQL,
        "op6_decontaminate": OP6_SQL,
        "op7_line_quality": OP7_SQL,
        "op10_url_filter": OP10_SQL,
        "op12_phrase_collocations": OP12_SQL,
        "op13_vector_codes": OP13_SQL,
    }

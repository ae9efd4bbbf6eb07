"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossaria.llm.byte_bpe import op4_byte_bpe
from glossaria.llm.chat_format import SQL_OP2, op2_chat_format
from glossaria.llm.context_tree import op5_context_tree
from glossaria.llm.embedding_dedup import op10_embedding_dedup
from glossaria.llm.html_text import op6_html_text
from glossaria.llm.language_id import op1_language_id
from glossaria.llm.ngram_join import op8_ngram_join
from glossaria.llm.packing import op9_packing
from glossaria.llm.periodic_runs import op12_periodic_runs
from glossaria.llm.prefix_trie import SQL_OP11, op11_prefix_trie
from glossaria.llm.quality_rules import SQL_OP3, op3_quality_rules
from glossaria.llm.substring_dedup import SQL_OP13, op13_substring_dedup
from glossaria.llm.token_files import op7_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_chat_format": op2_chat_format,
        "op3_quality_rules": op3_quality_rules,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_context_tree": op5_context_tree,
        "op6_html_text": op6_html_text,
        "op7_token_files": op7_token_files,
        "op8_ngram_join": op8_ngram_join,
        "op9_packing": op9_packing,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_substring_dedup": op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": SQL_OP2, "op3_quality_rules": SQL_OP3, "op11_prefix_trie": SQL_OP11, "op13_substring_dedup": SQL_OP13}

"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kestrel.llm.conversation_repair import OP13_SQL, op13_conversation_repair
from kestrel.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from kestrel.llm.language_id import op5_language_id
from kestrel.llm.line_dedup import OP4_SQL, op4_line_dedup
from kestrel.llm.merkle import OP12_SQL, op12_merkle
from kestrel.llm.mixing import op1_mix
from kestrel.llm.pii import op9_pii
from kestrel.llm.sentencepiece_codec import op10_sentencepiece
from kestrel.llm.simhash import op8_simhash
from kestrel.llm.token_counts import op2_token_counts
from kestrel.llm.token_files import op6_token_files
from kestrel.llm.topk import OP3_SQL, op3_top_k
from kestrel.llm.warc import OP11_SQL, op11_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix, op2_token_counts, op3_top_k, op4_line_dedup, op5_language_id, op6_token_files, op7_exact_dedup,
        op8_simhash, op9_pii, op10_sentencepiece, op11_warc, op12_merkle,
        op13_conversation_repair)}
ORACLE_SQL = {"op3_top_k": OP3_SQL, "op4_line_dedup": OP4_SQL, "op7_exact_dedup": OP7_SQL,
              "op11_warc": OP11_SQL, "op12_merkle": OP12_SQL, "op13_conversation_repair": OP13_SQL}

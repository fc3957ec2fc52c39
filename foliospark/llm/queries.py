"""Queries of the training-data operators over the whole of their tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.bytebpe import op13_bytebpe
from foliospark.llm.chat import ORACLE as OP7_SQL
from foliospark.llm.chat import QUOTED_ORACLE, chat_quoted, op7_chat
from foliospark.llm.decontaminate import ORACLE as OP8_SQL
from foliospark.llm.decontaminate import op8_decontaminate
from foliospark.llm.embeddings import ORACLE as OP10_SQL
from foliospark.llm.embeddings import op10_embeddings
from foliospark.llm.maxent import op4_maxent
from foliospark.llm.merkle import ORACLE as OP11_SQL
from foliospark.llm.merkle import op11_merkle
from foliospark.llm.packing import op5_packing
from foliospark.llm.pii import op9_pii
from foliospark.llm.resampling import ORACLE as OP12_SQL
from foliospark.llm.resampling import op12_resampling
from foliospark.llm.sharding import ORACLE as OP2_SQL
from foliospark.llm.sharding import op2_sharding
from foliospark.llm.simhash import op1_simhash
from foliospark.llm.substrings import ORACLE as OP3_SQL
from foliospark.llm.substrings import op3_substrings
from foliospark.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_sharding": op2_sharding,
    "op3_substrings": op3_substrings,
    "op4_maxent": op4_maxent,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_chat": op7_chat,
    "op8_decontaminate": op8_decontaminate,
    "op9_pii": op9_pii,
    "op10_embeddings": op10_embeddings,
    "op11_merkle": op11_merkle,
    "op12_resampling": op12_resampling,
    "op13_bytebpe": op13_bytebpe,
    "chat_quoted": chat_quoted,
}

ORACLES: dict[str, str] = {
    "op2_sharding": OP2_SQL,
    "op3_substrings": OP3_SQL,
    "op7_chat": OP7_SQL,
    "chat_quoted": QUOTED_ORACLE,
    "op8_decontaminate": OP8_SQL,
    "op10_embeddings": OP10_SQL,
    "op11_merkle": OP11_SQL,
    "op12_resampling": OP12_SQL,
}

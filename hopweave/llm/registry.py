"""Queries of the corpus operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .language import op10_language_id
from .mixing import op8_mixing
from .near_dup import op9_near_dup
from .neighbours import OP6_SQL, op6_neighbours
from .packing import op4_packing
from .repeats import op5_repeats
from .tokenstore import op3_token_store
from .topk import OP1_SQL, op1_top_k
from .toxicity import op7_toxicity
from .urlfilter import OP2_SQL, op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_url_filter": op2_url_filter,
    "op3_token_store": op3_token_store,
    "op4_packing": op4_packing,
    "op5_repeats": op5_repeats,
    "op6_neighbours": op6_neighbours,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_near_dup": op9_near_dup,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op1_top_k": OP1_SQL,
    "op2_url_filter": OP2_SQL,
    "op6_neighbours": OP6_SQL,
}

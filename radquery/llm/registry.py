"""Queries of this subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from radquery.llm.op10_language import op10_language
from radquery.llm.op11_alignment import op11_alignment
from radquery.llm.op12_whitening import op12_whitening
from radquery.llm.op13_sharding import op13_sharding
from radquery.llm.op1_lm_score import op1_lm_score
from radquery.llm.op2_decontaminate import op2_decontaminate
from radquery.llm.op3_simhash import op3_simhash
from radquery.llm.op4_packing import op4_packing
from radquery.llm.op5_quality import OP5_SQL, op5_quality
from radquery.llm.op6_chat import OP6_SQL, op6_chat
from radquery.llm.op7_arrow_files import op7_arrow_files
from radquery.llm.op8_toxicity import op8_toxicity
from radquery.llm.op9_warc import OP9_SQL, op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_decontaminate, op3_simhash, op4_packing, op5_quality, op6_chat, op7_arrow_files, op8_toxicity, op9_warc, op10_language, op11_alignment, op12_whitening, op13_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality": OP5_SQL, "op6_chat": OP6_SQL, "op9_warc": OP9_SQL}

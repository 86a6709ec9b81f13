"""Queries of the training-data operators and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import audit, decontamination, embeddings, language, licenses, lm, mixing, neardup, pieces, resampling, stages, suffixes, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_topk": topk.op1_topk, "op2_embeddings": embeddings.op2_embeddings, "op3_neardup": neardup.op3_neardup, "op4_pieces": pieces.op4_pieces, "op5_language": language.op5_language, "op6_licenses": licenses.op6_licenses, "op7_lm": lm.op7_lm, "op8_mixing": mixing.op8_mixing, "op9_toxicity": toxicity.op9_toxicity, "op10_suffixes": suffixes.op10_suffixes, "op11_decontamination": decontamination.op11_decontamination, "op12_resampling": resampling.op12_resampling, "op13_audit": audit.op13_audit, "pipeline": stages.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": topk.OP1_SQL, "op11_decontamination": decontamination.OP11_SQL, "op12_resampling": resampling.OP12_SQL, "op13_audit": audit.OP13_SQL}

"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import bpe, chat, html_text, merkle, ngram_join, packing, phrases, simhash, substrings, token_store, topk, toxicity, transport_stream


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": substrings.op1_substrings,
    "op2_simhash": simhash.op2_simhash,
    "op3_transport_stream": transport_stream.op3_transport_stream,
    "op4_chat": chat.op4_chat,
    "op5_topk": topk.op5_topk,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_html": html_text.op8_html,
    "op9_token_store": token_store.op9_token_store,
    "op10_bpe": bpe.op10_bpe,
    "op11_jaccard_join": ngram_join.op11_jaccard_join,
    "op12_phrases": phrases.op12_phrases,
    "op13_merkle": merkle.op13_merkle,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {"op5_topk": topk.SQL, "op11_jaccard_join": ngram_join.SQL, "op12_phrases": phrases.SQL, "op13_merkle": merkle.SQL}

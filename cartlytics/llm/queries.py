"""The registered queries of this subpackage, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlytics.llm import (chat, decontam, imatch, importance, licenses, mixing, oracles, order_minhash, prefix_trie,
                            sharding, token_fst, toxicity, turn_repair, vector_cells)
from cartlytics.llm.common import table


def _toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))
    return scored.select("doc_id", toxicity.in_held_out_fold().alias("held_out"), "score", "predicted", "spans")


def _decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.overlaps(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, d, "documents"))


def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return imatch.fingerprints(table(spark, d, "documents"))


def _mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_plan(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _chat(spark: SparkSession, d: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    message = lambda role: F.struct(F.lit(role).alias("role"), F.lit(control).alias("content"))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(message("user"), message("assistant")).alias("messages"))
    turns = chat.canonical(table(spark, d, "conversations")).unionByName(chat.canonical(extra))
    return chat.digest(chat.format_turns(turns))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return token_fst.token_counts(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_plan(table(spark, d, "documents"))


def _licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents")).drop("places")


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return importance.resample(table(spark, d, "documents"), importance.good_ids(table(spark, d, "labels")))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return vector_cells.annotated(table(spark, d, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def _trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, d, "conversations"))


def _repair(spark: SparkSession, d: str) -> DataFrame:
    given = table(spark, d, "conversations")
    return turn_repair.report(turn_repair.repair(turn_repair.damage(given)), given)


def _pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {
    "op1_toxicity": _toxicity,
    "op2_decontamination": _decontamination,
    "op3_order_minhash": _near_duplicates,
    "op4_imatch": _fingerprints,
    "op5_mixing": _mixing,
    "op6_chat": _chat,
    "op7_tokens": _tokens,
    "op8_sharding": _sharding,
    "op9_licenses": _licenses,
    "op10_importance": _quality,
    "op11_vector_cells": _vectors,
    "op12_prefix_trie": _trie,
    "op13_turn_repair": _repair,
    "pipeline": _pipeline,
}

# Control strings after their first character, as chat.CONTROLS has them (fixed values).
_REST = "\\|turn\\|>|\\|text\\|>|\\|end\\|>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|\\|startoftext\\|>|s>|/s>|<SYS>>|</SYS>>|INST\\]|/INST\\]"


def _escaped_chars(column: str) -> str:
    """Characters of an escaped text: one more for each backslash and two for each control string."""
    broken = f"regexp_replace({column}, '([<\\[])({_REST})', '\\1@@\\2', 'g')"
    return f"(length({broken}) + length({column}) - length(replace({column}, '\\', '')))"


SQL: dict[str, str] = {"op6_chat": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             CAST(sum(8 + {_escaped_chars('role')} + 8 + {_escaped_chars('text')} + 8) AS BIGINT) AS formatted_chars
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM o""",
    "op11_vector_cells": oracles.VECTOR_CELLS,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
    "op13_turn_repair": oracles.TURN_REPAIR,
}

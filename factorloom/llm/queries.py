"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import bpe, chat, fim, langid, licenses, mixing, neardup, secrets, sharding, substrings, topk, trie, vecdup
from factorloom.llm.common import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.Codec.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(table(spark, sf_dir, "documents"), codec)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digests(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digests(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linking, order and schemas on every conversation: the table itself holds no tool calls, so each user's turn gets one."""
    return chat.digests(chat.with_tools(table(spark, sf_dir, "conversations")))


def chat_tool_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order across messages on every conversation: calls that wait for the results of later turns."""
    return chat.digests(chat.with_waiting(table(spark, sf_dir, "conversations")))


def op10_vecdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digests(table(spark, sf_dir, "conversations"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_licenses, op2_byte_bpe, op3_substrings, op4_topk, op5_language, op6_mixing, op7_secrets, op8_neardup, op9_chat, op10_vecdup, op11_fim, op12_trie, op13_shards, chat_tool_calls, chat_tool_order)}
ORACLES = {"op3_substrings": substrings.ORACLE, "op4_topk": topk.ORACLE, "op9_chat": chat.ORACLE, "chat_tool_calls": chat.TOOLS_ORACLE, "chat_tool_order": chat.WAITING_ORACLE, "op10_vecdup": vecdup.ORACLE, "op11_fim": fim.ORACLE, "op12_trie": trie.ORACLE, "op13_shards": sharding.ORACLE}

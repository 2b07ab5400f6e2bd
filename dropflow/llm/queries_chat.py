"""Query of chat formatting; its SQL states the digests of the turns and of the assistant's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .common import written

#: A conversation whose texts look like markers and escapes.
EXTRA_ID = -7
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def byte_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op2_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(chat.ASSISTANT)).alias("role"),
                                  F.lit(EXTRA_TEXT).alias("text"))
    output = written(chat.format_chats(table.unionByName(extra), byte_bpe()), "chat")
    return chat.digests(chat.decode_chats(output, byte_bpe()))


_MARKERS = len(chat.TURN + chat.SAYS + chat.END)

OP2_SQL = rf"""
WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA_ID}, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT {EXTRA_ID}, 1, 'assistant', '{EXTRA_TEXT}'),
e AS (SELECT *, length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))
          + length(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) + {_MARKERS} AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  COALESCE(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op2_chat_masks": op2_chat_masks}
ORACLE = {"op2_chat_masks": OP2_SQL}

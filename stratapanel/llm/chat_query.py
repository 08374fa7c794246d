"""op7: all conversations formatted, and read back from the formatted turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chat import format_chats, parse_piece, unescape
from .storage import table

_SHAPE = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.n, self.turns, self.loss_chars, self.loss, self.chars = conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0

    def add(self, piece: str, start: int, text_start: int, text_end: int, in_loss: bool) -> None:
        role, text = parse_piece(piece)
        self.turns.update(f"{role}\n{text}\n".encode())
        if in_loss:
            masked = unescape(piece[text_start - start : text_end - start])
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)
        self.n += 1
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation from the rows of ``format_chats``, in their order."""
    open_: _Digest | None = None
    for batch in batches:
        done = []
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "seq", "piece", "start", "text_start", "text_end", "in_loss")]
        for conv, seq, *rest in zip(*columns, strict=True):
            if seq == 0:
                if open_:
                    done.append(open_.row())
                open_ = _Digest(conv)
            open_.add(*rest)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _SHAPE, strict=True)], schema=_SHAPE)
    if open_:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(open_.row(), _SHAPE, strict=True)], schema=_SHAPE)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # instruct_template is turn-local, so the last turns are enough
    return format_chats(turns, context=16).mapInArrow(read_back, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


OP7_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
    SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g'))
              + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 19
                     ELSE 16 + length(role) + length(regexp_replace(role, '[^\\<\[\]\n]', '', 'g')) END size
    FROM t)
SELECT conv_id, count(*) n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) loss_sha256,
       CAST(3 + sum(size) AS BIGINT) formatted_chars
FROM s GROUP BY conv_id
"""

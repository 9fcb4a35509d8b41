"""Chat formatting: the turns of many conversations are put together in one preallocated byte buffer per batch.

A turn is `### role: text</turn>` and a line end. Inside roles and texts a backslash is put before every backslash and `#`, into
every `</turn>`, and (in roles) before every colon, so marks can't be forged and every turn is read back as it was. The
loss mask lists the spans of the assistant's texts in code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from chatloom.llm.common import Query, table
from chatloom.session import materialise

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
CLOSE_MARK, CLOSE_SAFE = "</turn>", "<\\/turn>"
LEARNT_ROLE = "assistant"
# Bytes put together at a time; a longer turn makes a step of its own.
STEP_BYTES = 8_000_000
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(texts: pa.Array) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\\\")
    texts = pc.replace_substring(texts, "#", "\\#")
    return pc.replace_substring(texts, CLOSE_MARK, CLOSE_SAFE)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each string begins and the last ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def scatter(out: np.ndarray, places: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy string i of `data` to `places[i]` of `out`, many strings at a time."""
    lengths = np.diff(offsets)
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP_BYTES, "right")) - 1)
        index = np.repeat(places[a:b] - offsets[a:b], lengths[a:b]) + np.arange(offsets[a], offsets[b])
        out[index] = data[offsets[a] : offsets[b]]
        a = b


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Formatted segments, and the starts and lengths of their learnt spans; `first` are the rows at which segments begin."""
    n = len(roles)
    roles, texts = pc.fill_null(roles, ""), pc.fill_null(texts, "")
    kinds = roles.dictionary_encode()
    heads = pa.array([OPEN + r.replace(":", "\\:") + AFTER_ROLE for r in escape(kinds.dictionary).to_pylist()], pa.string())
    heads = heads.take(kinds.indices)
    texts = escape(texts)
    (head, head_at), (body, body_at) = bytes_of(heads), bytes_of(texts)
    close = np.frombuffer(CLOSE.encode(), np.uint8)
    sizes = np.diff(head_at) + np.diff(body_at) + len(close)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    buffer = pa.allocate_buffer(int(starts[-1]))
    out = np.frombuffer(buffer, np.uint8)
    scatter(out, starts[:-1], head, head_at)
    scatter(out, starts[:-1] + np.diff(head_at), body, body_at)
    out[(starts[1:] - len(close))[:, None] + np.arange(len(close))] = close
    bounds = starts[np.append(first, n)]
    segments = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), buffer).cast(pa.string())

    head_chars, body_chars = (pc.utf8_length(x).to_numpy().astype(np.int64) for x in (heads, texts))
    ends = np.cumsum(head_chars + body_chars + len(CLOSE))
    begins = ends - len(CLOSE) - body_chars
    begins -= np.repeat(np.concatenate([[0], ends])[first], np.diff(np.append(first, n)))
    learnt = np.asarray(pc.equal(roles, LEARNT_ROLE).to_numpy(zero_copy_only=False), bool)
    counts = np.add.reduceat(learnt.astype(np.int64), first)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return (
        segments,
        pa.ListArray.from_arrays(offsets, pa.array(begins[learnt])),
        pa.ListArray.from_arrays(offsets, pa.array(body_chars[learnt])),
    )


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, part, seq, n_turns, formatted, starts, lengths: segments of conversations.

    The segments of a conversation in the order of (part, seq) are its formatted text; nearly all have one. A conversation is
    cut where a batch or a task ends, so the longest one needs no task for itself. Turns are ordered by turn, role and
    text, nulls first; null roles and texts are empty, a null id is a conversation like others. Repeated rows are repeated
    turns. Other columns are not read, and an empty table gives an empty one.
    """
    order = ("conv", "turn", "role", "text")
    rows = rows.select(*(F.col(c).alias(n) for c, n in zip((id_col, turn_col, role_col, text_col), order)))
    rows = rows.withColumns({"conv": F.col("conv").cast("bigint"), "role": F.col("role").cast("string"), "text": F.col("text").cast("string")})
    rows = rows.repartitionByRange("conv", "turn", "role", F.xxhash64("text")).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().cast("bigint").alias("part"), "conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(1)
            ids, none = pc.fill_null(conv, 0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])))
            segments, starts, lengths = assemble(batch.column(2), batch.column(3), first)
            yield pa.RecordBatch.from_arrays(
                [conv.take(pa.array(first)), batch.column(0).take(pa.array(first)), pa.array(np.arange(seq, seq + len(first))),
                 pa.array(np.diff(np.append(first, batch.num_rows))), segments, starts, lengths],
                names=["conv", "part", "seq", "n_turns", "formatted", "starts", "lengths"],
            )
            seq += len(first)

    return rows.mapInArrow(
        run, "conv bigint, part bigint, seq bigint, n_turns bigint, formatted string, starts array<bigint>, lengths array<bigint>"
    )


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    found = []
    for piece in formatted.split(CLOSE)[:-1]:
        m = TURN.fullmatch(piece)
        if m is None:
            raise ValueError("not a formatted turn")
        found.append((unescape(m[1]), unescape(m[2])))
    return found


def read_back(segments: DataFrame) -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the formatted segments alone.

    The segments of one conversation pass one after the other; of a conversation only the state of its two digests is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def give(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 6, kinds)], names=names)

        current = state = None
        for batch in batches:
            done: list[tuple] = []
            for conv, formatted, starts, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != current:
                    if state is not None:
                        done.append(close(current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for a, n in zip(starts, lengths):
                    learnt = unescape(formatted[a : a + n])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(formatted)
            yield give(done)
        if state is not None:
            yield give([close(current, state)])

    def close(conv, state) -> tuple:
        return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    ordered = segments.repartition("conv").sortWithinPartitions("conv", "part", "seq").select("conv", "formatted", "starts", "lengths")
    return ordered.mapInArrow(
        run, "conv bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


HARD_ID, HARD_TEXT = -7, "\\### Assistant: </turn> ok"


def op7_columnar(spark, sf_dir: str) -> DataFrame:
    """All conversations and a hard one, written and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(HARD_ID, 0, "user", HARD_TEXT), (HARD_ID, 1, "assistant", HARD_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    written = materialise(format_conversations(rows.unionByName(hard)), "chat-formatted")
    return read_back(written).withColumnRenamed("conv", "conv_id")


def _sql() -> str:
    safe = "replace(replace(replace({}, '\\', '\\\\'), '#', '\\#'), '</turn>', '<\\/turn>')"
    text, role = safe.format("text"), "replace(" + safe.format("role") + ", ':', '\\:')"
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    return f"""
    WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
      SELECT conv_id, turn, role, text FROM conversations
      UNION ALL SELECT {HARD_ID}, 0, 'user', '{HARD_TEXT}' UNION ALL SELECT {HARD_ID}, 1, 'assistant', '{HARD_TEXT}'))
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum({len(OPEN) + len(AFTER_ROLE) + len(CLOSE)} + length({role}) + length({text}))::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id"""


QUERIES = {"op7_columnar": Query(op7_columnar, _sql())}

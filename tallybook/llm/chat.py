"""Chat formatting: render conversations, encode once with offsets, mask tokens by turn spans."""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SPOKEN = "assistant"  # the role whose texts are learned
# Control strings: an assistant turn stands between the first two, any other between the last two.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
FLUSH = 1 << 20  # characters of a conversation that are encoded at once

_PLAIN = re.compile("|".join(re.escape(c) for c in CONTROL))
_TURN = re.compile(r"(<s>|\[INST\])((?:[^\\\n]|\\.)*)\n(.*?)(?:</s>|\[/INST\])", re.DOTALL)

SEGMENTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType()), T.StructField("formatted", T.StringType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss", T.BinaryType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
])
DIGEST = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("loss_tokens", T.LongType()),
])


def escape(text: str) -> str:
    """Double every backslash, then break control strings with one after their first character."""
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn, and where its text starts and ends in it."""
    opened, closed = CONTROL[:2] if role == SPOKEN else CONTROL[2:]
    head = f"{opened}{escape(role)}".replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + closed, len(head), len(head) + len(body)


@functools.cache
def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens(list(CONTROL))  # split off before anything else, so no token crosses a turn's end
    return tokenizer


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that intersect one of the sorted spans, found by binary search in their sorted offsets."""
    mask = np.zeros(len(starts), bool)
    if spans:
        begin, end = np.array(spans).T
        for low, high in zip(np.searchsorted(ends, begin, side="right"), np.searchsorted(starts, end, side="left")):
            mask[low:high] = True
    return mask & (ends > starts)


def _segments(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of whole turns, from turns sorted by conversation and place."""
    encoder, schema = _encoder(path), _arrow(SEGMENTS)
    now, parts, spans, size, first = None, [], [], 0, True

    def flush(last: bool) -> tuple:
        nonlocal parts, spans, size, first
        text = "".join(parts)
        encoded = encoder.encode(text, add_special_tokens=False)
        pairs = encoded.offsets
        offsets = np.fromiter(itertools.chain.from_iterable(pairs), np.int32, 2 * len(pairs)).reshape(-1, 2)
        starts, ends = np.ascontiguousarray(offsets[:, 0]), np.ascontiguousarray(offsets[:, 1])
        mask = loss_mask(starts, ends, spans)
        row = (now[0], first, last, text, np.array(encoded.ids, np.int32), mask.tobytes(), starts, ends)
        parts, spans, size, first = [], [], 0, last
        return row

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(column), field.type) for column, field in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if now is not None and now[0] != row["conv_id"]:
                out.append(flush(True))
            elif size > FLUSH:
                out.append(flush(False))
            now = (row["conv_id"],)
            turn, begin, end = render(row["role"], row["text"])
            if row["role"] == SPOKEN and end > begin:
                spans.append((size + begin, size + end))
            parts.append(turn)
            size += len(turn)
        if out:
            yield packed(out)
    if now is not None:
        yield packed([flush(True)])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _ordered(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Formatted conversations with token ids, offsets and loss mask, in segments of whole turns.

    ``conversations`` has ``conv_id``, ``turn``, ``role`` and ``text``; other columns are ignored. Turns
    follow ``turn``, nulls first, ties by role and text, repeated rows are turns of their own. Null
    roles and texts are empty; rows with a null ``conv_id`` are one conversation. A conversation
    is a segment, unless it passes about a million characters: then it has several, cut
    between turns, so memory stays bounded. As a control string ends each turn, cutting there changes no
    token. ``loss`` holds a byte per token: 1 where it meets an assistant's text.
    """
    return _ordered(conversations).mapInArrow(lambda batches: _segments(tokenizer, batches), SEGMENTS)


def _covered(starts: np.ndarray, ends: np.ndarray, text: str) -> Iterator[str]:
    """Pieces of text under tokens in order, each character once; pieces end where the cover has a gap."""
    if len(starts):
        reach = np.maximum.accumulate(ends)
        gap = np.flatnonzero(starts[1:] > reach[:-1])
        for begin, end in zip(starts[np.r_[0, gap + 1]].tolist(), reach[np.r_[gap, len(reach) - 1]].tolist()):
            yield text[begin:end]


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column as views of its values."""
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[low:high] for low, high in zip(at[:-1], at[1:])]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(DIGEST)
    for batch in batches:
        out = []
        # token columns stay arrays: a Python object per token would cost more than the encoding
        held = ("conv_id", "first", "last", "formatted", "loss")
        rows = zip(*(batch.column(c).to_pylist() for c in held), _lists(batch.column("starts")), _lists(batch.column("ends")))
        for conv_id, first, last, text, covered, starts, ends in rows:
            if first:
                turns, loss, n, chars, said, tokens, learned = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0
                state = [turns, loss, n, chars, said, tokens, learned]
            mask = np.frombuffer(covered, bool)
            for found in _TURN.finditer(text):
                role, body = unescape(found[2]), unescape(found[3])
                state[0].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                state[2] += 1
            for piece in map(unescape, _covered(starts[mask], ends[mask], text)):
                state[1].update(piece.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            state[3] += len(text)
            state[5] += len(mask)
            state[6] += int(mask.sum())
            if last:
                out.append(dict(zip(schema.names, [conv_id, state[2], state[0].hexdigest(), state[4], state[1].hexdigest(), state[3], state[5], state[6]])))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


def read_back(segments: DataFrame) -> DataFrame:
    """Digest of each formatted conversation, read back from its segments in order.

    Takes the frame of ``format_conversations`` as it is, whose partitions hold the segments of a
    conversation one after the other.
    """
    return segments.mapInArrow(_digests, DIGEST)

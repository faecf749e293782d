"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the
spans of the turns under the loss (sorted) are intersected with the token
spans (sorted) by binary search. Turn markers are tokens of their own, so no
token reaches over a turn's border; control strings inside texts are escaped
reversibly, so a marker in the output always is one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template: TURN role TEXT text END for each turn.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that chat templates read as control, besides whatever starts with ``<|``.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROLS))
_TURNS = re.compile(rf"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)
#: A conversation beyond this many characters goes out in parts, cut between
#: turns; markers isolate turns, so the parts' tokens are the whole's tokens.
PART_CHARS = 1 << 20
MAX_TOKENIZER_BYTES = 64 << 20


def escape(s: str) -> str:
    """One backslash more after the first character of each control string,
    counting those already escaped: reversible, and no control string stays."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], s)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of ``(role, text)`` turns and the sorted character
    spans of the escaped texts under the loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}")
        at += len(out[-1])
    return "".join(out), spans


def mask_tokens(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens lie under the spans, and the stretches of text those
    tokens cover there. ``offsets`` and ``spans`` are sorted."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    mask, covered = np.zeros(len(offsets), np.uint8), []
    for a, b in spans:
        lo, hi = bisect_right(ends, a), bisect_left(starts, b)
        if lo < hi and a < b:
            mask[lo:hi] = 1
            covered.append((max(a, starts[lo]), min(b, ends[hi - 1])))
    return mask, covered


_TOKENIZERS: dict[str, object] = {}


def _tokenizer(definition: str):
    """The tokenizer with the template's markers as tokens of their own and
    offsets that keep leading spaces; one per Python worker."""
    from tokenizers import Tokenizer, processors

    name = hashlib.sha256(definition.encode()).hexdigest()
    if name not in _TOKENIZERS:
        _TOKENIZERS.clear()
        t = Tokenizer.from_str(definition)
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        t.add_special_tokens([TURN, TEXT, END])
        _TOKENIZERS[name] = t
    return _TOKENIZERS[name]


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_OUT = [("part", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("token_ids", pa.binary()),
        ("loss_mask", pa.binary()), ("loss_spans", _SPAN)]


def format_conversations(turns: DataFrame, tokenizer_path: str, loss_role: str = "assistant") -> DataFrame:
    """``turns`` (``conv_id``, ``turn``, ``role``, ``text``) as formatted
    conversations: ``conv_id``, ``part``, ``n_turns``, ``formatted``,
    ``token_ids`` (packed little-endian uint32), ``loss_mask`` (a byte a
    token) and ``loss_spans`` (character spans of ``formatted`` under it).

    One row per conversation, more (``part`` 0, 1, ...) beyond ``PART_CHARS``,
    adjacent and in order. Null role or text: empty. Null ``conv_id``: one
    conversation. Turns go by ``turn`` (nulls first), then role, then text;
    repeated rows stay. Empty table: no rows. Other columns are not read.

    Rows of a conversation are sorted into one stream, which a task reads
    with one part in memory, whatever the conversation's length.
    """
    spark = turns.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path}: a tokenizer of more than {MAX_TOKENIZER_BYTES} characters")
    definition = spark.sparkContext.broadcast(text)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    key = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(definition.value)
        kind, now, part, size, held, out, weight = None, None, 0, 0, [], [], 0

        def close() -> None:
            nonlocal weight
            formatted, spans = render(held, loss_role)
            coded = tokenizer.encode(formatted, add_special_tokens=False)
            mask, covered = mask_tokens(coded.offsets, spans)
            out.append((now, part, len(held), formatted, np.array(coded.ids, "<u4").tobytes(), mask.tobytes(),
                        [{"start": a, "end": b} for a, b in covered]))
            weight += len(formatted)

        def flush() -> pa.RecordBatch:
            nonlocal weight
            cols = list(zip(*out))
            arrays = [pa.array(cols[0], kind)] + [pa.array(c, t) for c, (_, t) in zip(cols[1:], _OUT)]
            out.clear()
            weight = 0
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *[n for n, _ in _OUT]])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (conv != now or size > PART_CHARS):
                    close()
                    part, size = (part + 1 if conv == now else 0), 0
                    held.clear()
                now = conv
                held.append((role, text))
                size += len(role) + len(text)
                if weight > PART_CHARS or len(out) >= 2000:
                    yield flush()
        if held:
            close()
        if out:
            yield flush()

    schema = (f"conv_id {key.simpleString()}, part int, n_turns long, formatted string, token_ids binary, loss_mask binary, "
              "loss_spans array<struct<start:int,end:int>>")
    return rows.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text recovered from :func:`format_conversations`' rows,
    as digests: ``conv_id``, ``n_turns``, ``turns_sha256`` (of role, newline,
    text, newline per turn), ``loss_chars``, ``loss_sha256``,
    ``formatted_chars``, ``n_tokens``, ``loss_tokens``. Reads the rows in the
    order and partitions they were made in; null fields do not occur."""
    key = formatted.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, state, done = None, None, []

        def finish() -> None:
            conv, n, turns, chars, loss, size, tokens, masked = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens, masked))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done))
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if r["part"] == 0:
                    if state:
                        finish()
                    state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in _TURNS.findall(r["formatted"]):
                    state[1] += 1
                    state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                for s in r["loss_spans"]:
                    text = unescape(r["formatted"][s["start"]:s["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(r["formatted"])
                state[6] += len(r["loss_mask"])
                state[7] += sum(r["loss_mask"])
            if len(done) >= 5000:
                yield flush()
        if state:
            finish()
        if done:
            yield flush()

    return formatted.mapInArrow(run, f"conv_id {key.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")


#: DuckDB: the digests over ``conversations`` and the planted conversation -7.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(regexp_replace(role, '<(\\*)(\||/s>|s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g'))
          + length(regexp_replace(regexp_replace(text, '<(\\*)(\||/s>|s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g'))
          + 23 AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

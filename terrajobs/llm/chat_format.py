"""Conversations as training text, proven by reading them back.

A turn is ``<s>[INST]role[/INST]text</s>``. ``parse`` is a deterministic reader of that
grammar in which a backslash makes the next character ordinary. A conversation is rendered
plainly and read back; turns that do not come back identical are escaped, until all do.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrajobs.llm.common import small_batches

# The control strings of the template.
BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile("|".join(re.escape(c) for c in (BEGIN, HEAD, BODY, END)))
_TOKEN = re.compile(r"\\(.)|" + _CONTROL.pattern, re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, body's start, body's end) of each turn, or None if it is not a sentence."""
    turns, state, at, role = [], BEGIN, 0, ""
    following = {BEGIN: HEAD, HEAD: BODY, BODY: END, END: BEGIN}
    for m in _TOKEN.finditer(formatted):
        if m[0][0] == "\\":
            continue
        if m[0] != state or state in (BEGIN, HEAD) and m.start() != at:
            return None
        if state == BODY:
            role = unescape(formatted[at : m.start()])
        elif state == END:
            turns.append((role, unescape(formatted[at : m.start()]), at, m.start()))
        at, state = m.end(), following[state]
    return turns if state == BEGIN and at == len(formatted) else None


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The formatted conversation and what the parser reads back, equal to ``turns``."""
    plain = [(r, t) for r, t in turns]
    for escaped in (False, True):
        formatted = "".join(f"{BEGIN}{HEAD}{r}{BODY}{t}{END}" for r, t in plain)
        read = parse(formatted)
        if read is not None and [x[:2] for x in read] == turns:
            return formatted, read
        if not escaped:
            alone = lambda r, t: parse(f"{BEGIN}{HEAD}{r}{BODY}{t}{END}")
            plain = [(r, t) if (x := alone(r, t)) and x[0][:2] == (r, t) and len(x) == 1 else (escape(r), escape(t)) for r, t in turns]
    raise ValueError("a conversation does not survive its round trip")


def format_conversations(conversations: DataFrame, trained: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans, n_turns, and digests read back), a row per conversation.

    Turns stand in order of ``turn``, then role, then text (nulls first), repeated rows
    included. Null roles and texts count as empty. Rows of a null conv_id form one
    conversation. ``loss_spans`` are the [start, end) code points of the bodies of turns of
    role ``trained`` in ``formatted``. A conversation is one value of the result, so its own
    rows meet in one task; nothing else does.
    """
    turns = small_batches(conversations).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for turns in batch.column("turns"):
                formatted, read = render([(x["role"], x["text"]) for x in turns.as_py()])
                loss = [x for x in read if x[0] == trained]
                learned = "".join(unescape(formatted[a:b]) for _, _, a, b in loss)
                for column, value in zip(
                    out,
                    (
                        formatted,
                        [{"start": a, "stop": b} for _, _, a, b in loss],
                        len(read),
                        hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _, _ in read).encode()).hexdigest(),
                        len(learned),
                        hashlib.sha256(learned.encode()).hexdigest(),
                    ),
                    strict=True,
                ):
                    column.append(value)
            types = [pa.string(), span, pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True)), pa.array([len(x) for x in out[0]], pa.int64())],
                names=["conv_id", "formatted", "loss_spans", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return grouped.mapInArrow(
        run,
        "conv_id long, formatted string, loss_spans array<struct<start:long,stop:long>>, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, CASE WHEN contains(role || text, '\') OR contains(role, '<s>') OR contains(role, '</s>') OR contains(role, '[INST]') OR contains(role, '[/INST]')
      OR contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]')
    THEN list_sum(list_transform(['\', '<s>', '</s>', '[INST]', '[/INST]'], lambda c:
      (length(role) - length(replace(role, c, '')) + length(text) - length(replace(text, c, ''))) // length(c))) ELSE 0 END AS added
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(20 + length(role) + length(text) + added)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

r"""Chat formatting that is proved by parsing it back.

The grammar, with T a text in which a backslash takes the next character as it is::

    conversation = "<s>" turn*
    turn = "[INST] " T " [/INST]"            user
         | " " T "</s>"                      assistant
         | "<<SYS>>\n" T "\n<</SYS>>"        system
         | "<|" T "|>" T "<|/|>"             any other role, then its text

A turn is first written as it is and parsed by the deterministic parser below. If what comes back is not the source (the text holds a
control string or a backslash that the grammar would read otherwise), its control strings and backslashes are escaped, and the turn is
parsed again; at last the whole conversation is parsed and compared. The loss mask covers the texts of assistants.

Defined cases: rows of a conversation are ordered by turn (null first), then role, then text; a null text or role is empty; each row with a null conv_id
is a conversation of its own; repeated rows are turns of their own; an empty table gives an empty result; other columns are ignored. A
conversation becomes one row, so it must fit into a task.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import map_rows

START = "<s>"
#: Control strings; none may stand unescaped inside a text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>")
#: role: what opens a turn, the control string that closes it, and how many characters before that belong to it.
TURNS = {"user": ("[INST] ", "[/INST]", " "), "assistant": (" ", "</s>", ""), "system": ("<<SYS>>\n", "<</SYS>>", "\n")}
END_OTHER = "<|/|>"

_any = "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True)))
_to_escape = re.compile(rf"\\|(?={_any})")
_stop = re.compile(rf"\\|{_any}")


class Conflict(ValueError):
    """A text that the grammar reads otherwise."""


def escape(text: str) -> str:
    return _to_escape.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends; role and text are written as they are."""
    if role in TURNS:
        opening, closing, pad = TURNS[role]
        return f"{opening}{text}{pad}{closing}", len(opening), len(opening) + len(text)
    opening = f"<|{role}|>"
    return opening + text + END_OTHER, len(opening), len(opening) + len(text)


def _text(s: str, at: int, closing: str) -> tuple[str, int]:
    """The text from ``at`` to its closing control string, unescaped, and the place behind that."""
    parts = []
    while m := _stop.search(s, at):
        parts.append(s[at : m.start()])
        if m[0] == "\\":
            if m.end() >= len(s):
                raise Conflict("nothing follows a backslash")
            parts.append(s[m.end()])
            at = m.end() + 1
        elif s.startswith(closing, m.start()):
            return "".join(parts), m.start() + len(closing)
        else:
            raise Conflict(f"{m[0]} inside a text")
    raise Conflict(f"no {closing}")


def parse_turn(s: str, at: int) -> tuple[str, str, int]:
    for role, (opening, closing, pad) in TURNS.items():
        if s.startswith(opening, at):
            text, end = _text(s, at + len(opening), closing)
            if pad and not text.endswith(pad):
                raise Conflict("no padding")
            return role, text[: len(text) - len(pad)], end
    if not s.startswith("<|", at):
        raise Conflict("no turn begins here")
    role, end = _text(s, at + 2, "|>")
    if role in TURNS:
        raise Conflict("a role with its own form")
    text, end = _text(s, end, END_OTHER)
    return role, text, end


def parse(s: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    if not s.startswith(START):
        raise Conflict("no start")
    at, out = len(START), []
    while at < len(s):
        role, text, at = parse_turn(s, at)
        out.append((role, text))
    return out


def format_chat(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of assistants' texts in it."""
    parts, spans, at = [START], [], len(START)
    for role, text in turns:
        for write in (str, escape):
            s, a, b = render(role if role in TURNS else write(role), write(text))
            try:
                if parse_turn(s, 0) == (role, text, len(s)):
                    break
            except Conflict:
                continue
        parts.append(s)
        if role == "assistant":
            spans.append((at + a, at + b))
        at += len(s)
    out = "".join(parts)
    if parse(out) != list(turns):
        raise AssertionError("the grammar doesn't give a conversation back")
    return out, spans


SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("formatted", T.StringType()),
    T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("n_turns", T.LongType()),
])


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans ([start, end) in code points) and n_turns, one row a conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), alone, "turn", "role", "text")
    chats = keyed.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def make():
        def step(batch):
            for c, turns in zip(batch["conv_id"].to_pylist(), batch["turns"], strict=True):
                said = [(t["role"], t["text"]) for t in turns.as_py()]
                out, spans = format_chat(said)
                yield c, out, [list(s) for s in spans], len(said)

        return step

    return map_rows(chats, make, SCHEMA, 512)


def chat_report(rows: DataFrame) -> DataFrame:
    """The digests of formatted conversations, read back from the formatted text and its loss mask."""
    more = rows.sparkSession.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    chats = format_conversations(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more))

    def make():
        def step(batch):
            for c, s, spans in zip(batch["conv_id"].to_pylist(), batch["formatted"], batch["loss_spans"].to_pylist(), strict=True):
                s = s.as_py()
                turns = parse(s)
                loss = "".join(unescape(s[a:b]) for a, b in spans)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                yield c, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(s)

        return step

    schema = T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])
    return map_rows(chats, make, schema)


_counts = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROL))
_role_counts = _counts.replace("text", "role")
ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, length(text) + {_counts}
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 17 ELSE 9 + length(role) + {_role_counts} END AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  (3 + sum(chars))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""

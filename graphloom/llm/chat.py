"""Chat formatting with typed content parts.

A turn's content is a list of parts ``{"type": "text" | "image" | "audio" | "document", ...}``.  A visitor flattens
them in order: texts stay, attachments become placeholders, and for each attachment its reference and its expanded
token count are recorded.  The template writes ``<|role|>\\n`` + content + ``<|end|>\\n``.  Inside texts and roles the
escape character U+241B is doubled and every ``<``, ``[`` is preceded by it where a control string could start, so no
text can contain a control string, and unescaping gives the text back exactly.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ESCAPE = "\u241b"
#: Starts of control strings of this and of other common templates; the escape character cuts them after their first letter.
CONTROL = re.compile(ESCAPE + r"|<(?=[|/s])|\[(?=/?[A-Z])")
TURN = re.compile(r"<\|turn:((?:[^|" + ESCAPE + r"]|" + ESCAPE + r".|\|(?!>))*)\|>\n(.*?)<\|end\|>\n", re.S)
PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")

SCHEMA = "conv_id long, formatted string, n_turns long, n_loss_spans long, loss_starts array<long>, loss_ends array<long>, attachments array<struct<turn:long,kind:string,ref:string,tokens:long>>, expanded_tokens long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    return re.sub("(.)" + ESCAPE, r"\1", text, flags=re.S)


@dataclass
class Visitor:
    """Flattens typed parts in order; ``visit_<type>`` may be overridden or added for further types."""

    patch: int = 28
    audio_rate: float = 12.5
    page_tokens: int = 512
    turn: int = 0
    attachments: list[dict] = field(default_factory=list)

    def flatten(self, content) -> str:
        """Formatted text of a turn's content: a plain string is one text part; null is empty."""
        if content is None:
            return ""
        if isinstance(content, str):
            return escape(content)
        return "".join(getattr(self, f"visit_{p.get('type')}", self.visit_other)(p) for p in content)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        return self.attach("image", part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> str:
        return self.attach("audio", part, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> str:
        return self.attach("document", part, (part.get("pages") or 0) * self.page_tokens)

    def visit_other(self, part: dict) -> str:
        raise ValueError(f"unknown part type {part.get('type')!r}")

    def attach(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append({"turn": self.turn, "kind": kind, "ref": part.get("ref") or part.get("url") or "", "tokens": tokens})
        return f"<|{kind}:{len(self.attachments) - 1}|>"


def format_conversation(turns: list[tuple[str, object]], loss_roles: frozenset[str] = frozenset({"assistant"})) -> dict:
    """Formatted text, code-point loss spans over it, and attachments of (role, content) turns."""
    visitor, out, at, starts, ends = Visitor(), [], 0, [], []
    for visitor.turn, (role, content) in enumerate(turns):
        head = f"<|turn:{escape(role or '').replace('|>', '|' + ESCAPE + '>')}|>\n"
        body = visitor.flatten(content)
        if role in loss_roles:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += [head, body, "<|end|>\n"]
        at += len(head) + len(body) + len("<|end|>\n")
    return {"formatted": "".join(out), "n_turns": len(turns), "n_loss_spans": len(starts), "loss_starts": starts, "loss_ends": ends, "attachments": visitor.attachments, "expanded_tokens": sum(a["tokens"] for a in visitor.attachments)}


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) turns of a formatted conversation whose parts are texts (placeholders stay as they are)."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        at = m.end()
        turns.append((unescape(m[1]), unescape(m[2])))
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def text_parts(conversations: DataFrame, name: str = "parts") -> DataFrame:
    """*conversations* plus column *name*: each text as a list of one typed part, in JSON (null: an empty text)."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.withColumn(name, F.to_json(F.array(part)))


def format_chats(conversations: DataFrame, parts: str | None = None) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text``, turns ascending (nulls first; ties by role, then text).

    With *parts*, that column holds each turn's content as a JSON list of typed parts (null: the text is the content).
    Null roles and texts are empty; repeated rows are turns of their own; a null conv_id is a conversation; extra columns
    are ignored; an empty table gives an empty result.  A conversation is one row, however long.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), (F.col(parts) if parts else F.lit(None).cast("string")).alias("parts"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches):
        for batch in batches:
            rows = [
                {"conv_id": c, **format_conversation([(t["role"], t["text"] if t["parts"] is None else json.loads(t["parts"])) for t in turns])}
                for c, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return grouped.mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("formatted", pa.string()),
        ("n_turns", pa.int64()),
        ("n_loss_spans", pa.int64()),
        ("loss_starts", pa.list_(pa.int64())),
        ("loss_ends", pa.list_(pa.int64())),
        ("attachments", pa.list_(pa.struct([("turn", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
        ("expanded_tokens", pa.int64()),
    ]
)

DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, all read back from the formatted text and its loss spans."""

    def run(batches):
        for batch in batches:
            columns = [[] for _ in range(8)]
            for conv_id, text, starts, ends, attached, tokens in zip(*(batch.column(i).to_pylist() for i in range(6))):
                turns, whole, loss = parse(text), hashlib.sha256(), hashlib.sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                masked = [unescape(text[a:b]) for a, b in zip(starts, ends)]
                loss.update("".join(masked).encode("utf-8", "surrogatepass"))
                if len(PLACEHOLDER.findall(text)) != len(attached):
                    raise ValueError("placeholders and attachments differ")
                for c, x in zip(columns, (conv_id, len(turns), whole.hexdigest(), sum(map(len, masked)), loss.hexdigest(), len(text), len(attached), tokens)):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"])

    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends", "attachments", "expanded_tokens").mapInArrow(run, DIGESTS)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_digests(format_chats(text_parts(chats), "parts"))


OP5_SQL = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(18 + length(role) + length(text)
      + length(regexp_replace(text, '[^' || chr(9243) || ']', '', 'g'))
      + length(text) - length(regexp_replace(text, '<([|/s])', '\\1', 'g'))
      + len(regexp_extract_all(text, '\\[/?[A-Z]')))::bigint as formatted_chars,
  0::bigint as n_attachments, 0::bigint as expanded_tokens
from t group by conv_id"""

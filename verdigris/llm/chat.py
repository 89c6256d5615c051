"""Conversations formatted by a compiled template, with a loss mask over what the assistant says.

Control strings inside roles and texts are broken up by an escape that can be undone:
`\\\\` stands for a backslash, `\\n` for a line end (in roles), and `\\.` for nothing; the
last is put behind the first character of each control string.

Edge cases: null texts and roles are empty; turns of equal number are ordered by role,
then text; a null turn comes first; rows of a null conv_id are one conversation; an
empty table gives no rows; other columns are not looked at; an empty conversation
cannot occur, since a conversation is its rows.  A conversation is one row, so it has to
fit in one; the query adds two rows to conversation -1, also if there is one already.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table
from .templates import Template

#: Strings that common chat formats give a meaning to.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SOURCE = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape_role }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
_STARTS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_MEANT = {"\\": "\\", "n": "\n", ".": ""}
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str | None) -> str:
    return _STARTS.sub(lambda m: m[0] + "\\.", (text or "").replace("\\", "\\\\"))


def escape_role(role: str | None) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _MEANT[m[1]], text)


def compiled(source: str = SOURCE) -> Template:
    return Template(source, {"escape": escape, "escape_role": escape_role})


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; an error if anything is left over."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id and turns array<struct<turn, role, text>>, in order."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def formatted(rows: DataFrame, source: str = SOURCE) -> DataFrame:
    """conv_id, n_turns, formatted text and its loss spans, one row a conversation."""
    grouped = conversations_of(rows)
    conv_type = grouped.schema["conv_id"].dataType.simpleString()

    def make():
        template = compiled(source)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, spans, sizes = [], [], []
            for turns in batch.column(1).to_pylist():
                text, own = template.render(messages=[{"role": t["role"] or "", "text": t["text"]} for t in turns])
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in own])
                sizes.append(len(turns))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind)],
                ["conv_id", "n_turns", "formatted", "loss_spans"],
            )

        return each

    schema = f"conv_id {conv_type}, n_turns bigint, formatted string, loss_spans array<struct<start: bigint, end: bigint>>"
    return arrow_map(grouped.select("conv_id", "turns"), schema, make)


def digests(rows: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = {"turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                said = "".join(f"{role}\n{body}\n" for role, body in read_back(text))
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                found["turns_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
                found["loss_chars"].append(len(loss))
                found["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                found["formatted_chars"].append(len(text))
            kinds = {"turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
            return pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(v, kinds[k]) for k, v in found.items())], ["conv_id", "n_turns", *found]
            )

        return each

    conv_type = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return arrow_map(rows, schema, make)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return digests(formatted(rows.unionByName(more)))


def _hits(column: str) -> str:
    return " + ".join(f"(len({column}) - len(replace({column}, '{c}', ''))) // {len(c)}" for c in CONTROL)


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
s AS (
  SELECT *, {len("<|im_start|>") + len("<|im_end|>") + 2} + len(role) + len(text) + len(role || text) - len(replace(role || text, '\\', ''))
         + len(role) - len(replace(role, chr(10), '')) + 2 * ({_hits("text")} + {_hits("role")}) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

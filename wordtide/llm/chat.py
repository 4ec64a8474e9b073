"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and only
that reply under the loss mask (``loss_start`` to ``loss_end``, characters of ``text``).
Turns after the last reply, and conversations without one, make a last example with an
empty mask, so that every turn stands in some example.

A turn is written ``<|role|>\\n`` text ``</s>\\n``.  Control strings inside texts and roles
are escaped reversibly: backslashes are doubled, and a single one follows each ``<``, ``[``
and ``|``; so none of ``<|``, ``|>``, ``</s>``, ``<s>``, ``[INST]`` or ``[/INST]`` can occur
in them, and a run of backslashes tells by its length what it was.

Tasks read the turns sorted and hold one conversation's prefix, which is the size of one
example; examples of a conversation of n turns have some n * n / 2 turns in all, as the
method demands.  Defined results: null text or role counts as empty; equal turn numbers
follow by role, then text; a null turn comes first, a null conv_id is a conversation of its
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_partitions

#: Characters of examples that a task gathers before it passes them on.
BATCH_CHARS = 4_000_000
TURN = re.compile(r"<\|(.*?)\|>\n(.*?)</s>\n", re.S)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\").replace("|", "|\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def turns_of(text: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted example."""
    return [(unescaped(role), unescaped(body)) for role, body in TURN.findall(text)]


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end; a conversation's examples follow each other in one partition."""
    names = ["conv_id", "example", "text", "loss_start", "loss_end"]

    def expand(batches):
        rows: list[tuple] = []
        held, now, prefix, n, open_ = 0, None, "", 0, False
        started = False

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not started or conv != now:
                    if open_:
                        rows.append((now, n, prefix, len(prefix), len(prefix)))
                        held += len(prefix)
                    started, now, prefix, n, open_ = True, conv, "", 0, False
                head = prefix + f"<|{escaped(role or '')}|>\n"
                body = escaped(text or "")
                prefix, open_ = head + body + "</s>\n", role != "assistant"
                if not open_:
                    rows.append((now, n, prefix, len(head), len(head) + len(body)))
                    n += 1
                    held += len(prefix)
                if held > BATCH_CHARS:
                    yield flush()
                    held = 0
        if open_:
            rows.append((now, n, prefix, len(prefix), len(prefix)))
        if rows:
            yield flush()

    dealt = conversations.select("conv_id", "turn", "role", "text").repartition(shuffle_partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select(F.col("conv_id").cast("long"), "role", "text").mapInArrow(expand, "conv_id long, example int, text string, loss_start long, loss_end long")


def read_back(formatted: DataFrame, together: bool = False) -> DataFrame:
    """One row per conversation, from its examples alone; ``together``: they still lie as ``examples`` left them, so
    that none need be shuffled."""
    if not together:
        formatted = formatted.repartition(shuffle_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "example")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches):
        now, last, loss, loss_chars, chars, started = None, "", hashlib.sha256(), 0, 0, False

        def row():
            turns = turns_of(last)
            return (now, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), loss_chars, loss.hexdigest(), chars)

        for batch in batches:
            rows = []
            for conv, text, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not started or conv != now:
                    if started:
                        rows.append(row())
                    started, now, loss, loss_chars, chars = True, conv, hashlib.sha256(), 0, 0
                target = unescaped(text[a:b])
                loss.update(target.encode())
                loss_chars, chars, last = loss_chars + len(target), chars + len(text), text
            if rows:
                yield made(rows)
        if started:
            yield made([row()])

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names)

    return formatted.select("conv_id", "text", "loss_start", "loss_end").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "</s>[INST] ok [/INST]"


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """All ``conversations`` and one of control strings, formatted and read back."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(examples(given.unionByName(probe)), together=True)


OP5_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 10 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<|\[]', '', 'g')) AS written FROM c),
p AS (SELECT *, sum(written) OVER w AS prefix, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

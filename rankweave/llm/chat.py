"""Chat formatting into budgeted windows.

Each turn is written as ``<turn role>\\n text </turn>\\n``; in roles and texts every backslash, ``<`` and ``>`` gets a backslash before it, so
no text can hold a mark, and the writing is reversed exactly. A conversation whose turns exceed the token budget becomes several windows: prefix
sums of the turns' tokens choose the longest span of whole turns that fits, a leading system turn is kept in every window, a limited history
of turns is repeated before the new ones, and repeated assistant turns are masked so that each is a target once. A turn that exceeds the
budget by itself gets a window of its own, marked ``over_budget``; nothing is dropped.

Turns of a conversation are ordered by (turn, role, text), nulls first. Null roles and texts count as empty; a null conv_id is a conversation
of its own; repeated rows are turns of their own; further columns are left out; an empty table gives no windows. Turns are read as a sorted
stream, so a conversation of any length needs the memory of one window. Tokens are counted where the rows lie, before the rows of a
conversation meet in one task, so a conversation that holds many of all rows is encoded by many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm.shared import in_small_batches, table
from rankweave.llm.units import library_memo

BUDGET = 2048
HISTORY = 256
TARGET_ROLE = "assistant"
SIZED = "conv_id long, turn long, role string, text string, n_tokens long"
WINDOWS = "conv_id long, window long, n_repeated int, over_budget boolean, n_tokens long, formatted string, targets array<struct<start:int,end:int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TURN = re.compile(r"<turn ((?:[^<\\]|\\.)*)>\n((?:[^<\\]|\\.)*)</turn>\n", re.S)


def escaped(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescaped(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def write_turns(turns: list[tuple[str, str]], n_repeated: int) -> tuple[str, list[dict]]:
    """The formatted turns, and the spans (code points) under the loss mask: texts of assistant turns that aren't repeated."""
    out, targets, at = [], [], 0
    for k, (role, text) in enumerate(turns):
        head, body = f"<turn {escaped(role)}>\n", escaped(text)
        if role == TARGET_ROLE and k >= n_repeated:
            targets.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out.append(f"{head}{body}</turn>\n")
        at += len(out[-1])
    return "".join(out), targets


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted window."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return turns


def windows(turns: Iterable[tuple[tuple[str, str], int]], budget: int, history: int) -> Iterator[tuple[list[tuple[str, str]], int, int]]:
    """From a stream of (turn, tokens) to windows: (turns, how many of them are repeated, tokens)."""
    system: list[tuple[str, str]] = []
    kept = 0  # tokens of the system turn
    held: list[tuple[str, str]] = []
    sums = [0]  # sums[i]: tokens of held[:i]
    repeated, first = 0, True

    def window() -> tuple[list[tuple[str, str]], int, int]:
        return system + held, (len(system) if not first else 0) + repeated, kept + sums[-1]

    for (role, text), n in turns:
        if first and not held and not system and role == "system":
            system, kept = [(role, text)], n
            continue
        if len(held) > repeated and kept + sums[-1] + n > budget:
            yield window()
            first = False
            # the longest run of last turns within the history, less where the next turn would not fit beside it
            room = min(history, budget - kept - n)
            start = int(np.searchsorted(sums, sums[-1] - room, "left")) if room > 0 else len(held)
            held = held[start:]
            sums = [s - sums[start] for s in sums[start:]]
            repeated = len(held)
        held.append((role, text))
        sums.append(sums[-1] + n)
    if len(held) > repeated or first:
        yield window()


def with_token_counts(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the tokens of each turn as it is written: marks and escapes included. A written turn ends with a line
    break and begins with ``<``, which the tokenizer never joins, so the tokens of a window are the sum of its turns'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = library_memo(tokenizer, joined=True)
        for batch in in_small_batches(batches, 3):
            turns = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            sizes = list(map(len, memo.ids([write_turns([(r or "", t or "")], 0)[0] for r, t in turns])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], [*batch.schema.names, "n_tokens"])

    return rows.mapInArrow(run, SIZED)


def format_conversations(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations (conv_id, turn, role, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(WINDOWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    conv, role, text, sizes = (c.to_pylist() for c in batch.slice(at, 1000).columns)
                    yield from zip(conv, zip([r or "" for r in role], [t or "" for t in text], strict=True), sizes, strict=True)

        stream, out, size = Ahead(rows()), [], 0
        while stream.more():
            conv = stream.row[0]
            for k, (turns, n_repeated, n) in enumerate(windows(stream.group(), budget, history)):
                formatted, targets = write_turns(turns, n_repeated)
                out.append({"conv_id": conv, "window": k, "n_repeated": n_repeated, "over_budget": n > budget, "n_tokens": n, "formatted": formatted, "targets": targets})
                size += len(formatted)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    sized = with_token_counts(rows, tokenizer)
    return sized.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "n_tokens").mapInArrow(run, WINDOWS)


class Ahead:
    """A stream of (conversation, turn, tokens) that gives one conversation's turns at a time."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows = rows
        self.row = next(rows, None)

    def more(self) -> bool:
        return self.row is not None

    def group(self) -> Iterator[tuple]:
        conv = self.row[0]
        while self.row is not None and self.row[0] == conv:
            yield self.row[1:]
            self.row = next(self.rows, None)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its windows: turns, and the text under the loss mask."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(DIGESTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv, n_repeated, text, targets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(_digest(*now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text)[n_repeated:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for span in targets:
                    learnt = unescaped(text[span["start"] : span["end"]])
                    now[3] += len(learnt)
                    now[4].update(learnt.encode())
                now[5] += len(text)
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if now is not None:
            out.append(_digest(*now))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    order = [F.col("conv_id").asc_nulls_first(), F.col("window")]
    return formatted.select("conv_id", "window", "n_repeated", "formatted", "targets").repartition("conv_id").sortWithinPartitions(*order).drop("window").mapInArrow(run, DIGESTS)


def _digest(conv: int | None, n: int, turns: hashlib._Hash, chars: int, loss: hashlib._Hash, formatted: int) -> dict:
    return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted}


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one more that is all control strings, and read them back."""
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(more), public_tokenizers.path("byte_bpe_50k.json")))

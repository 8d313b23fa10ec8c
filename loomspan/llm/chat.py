r"""Chat formatting in budgeted windows.

A turn is written as ``### role:``, a line feed, the text, ``</turn>`` and a line feed. In texts and roles a backslash stands before
every backslash and every ``#``, and between ``<`` and ``/turn>``; in roles also before ``:``. So no text can contain a mark
of the template, and removing one backslash from each pair reads the text back.

Running sums of turn tokens, counted in a public tokenizer, choose the windows: as many whole turns as fit the budget beside the
conversation's system turn and a limited number of tokens of turns repeated from before. Only assistant turns that a window holds for the
first time are under its loss mask.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import arrow_batches, partitions

BUDGET = 1024
HISTORY = 192
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's makers split text before merging bytes (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
PAIR = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "<\\/turn>")
    return text.replace(":", "\\:") if role else text


def unescape(text: str) -> str:
    return PAIR.sub(r"\1", text)


def ranks(vocabulary: str) -> dict[bytes, int]:
    """The tokens of a vocabulary file and their ranks; the file is read by the driver, so workers need not have it."""
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def counter(own: dict[bytes, int] | None) -> Callable[[str], int]:
    """Counts tokens; without a vocabulary a token is taken to be four bytes."""
    if own is None:
        return lambda text: (len(text.encode("utf-8", "surrogatepass")) + 3) // 4
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


class _Writer:
    """Takes the turns of one conversation in order and gives out its windows; holds one window at most."""

    def __init__(self, conv: object, budget: int, history: int):
        self.conv, self.budget, self.limit = conv, budget, history
        self.system: tuple[str, int] | None = None
        self.past: deque[tuple[str, int]] = deque()
        self.past_tokens = 0
        self.fresh: list[tuple[str, int, int, int]] = []
        self.tokens = self.number = self.turns = 0

    def _context(self) -> int:
        return self.past_tokens + (self.system[1] if self.system and self.number else 0)

    def add(self, role: str, text: str, count: Callable[[str], int]) -> Iterator[tuple]:
        head, body = f"### {escape(role, True)}:\n", escape(text)
        block = f"{head}{body}</turn>\n"
        n = count(block)
        if self.fresh and self._context() + self.tokens + n > self.budget:
            yield self.window()
        while self.past and self._context() + n > self.budget and not self.fresh:
            self.past_tokens -= self.past.popleft()[1]
        if not self.turns and role == "system":
            self.system = (block, n)
        span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
        self.fresh.append((block, n, *span))
        self.tokens += n
        self.turns += 1

    def window(self) -> tuple:
        blocks = ([self.system[0]] if self.system and self.number else []) + [b for b, _ in self.past]
        total, at = self._context() + self.tokens, sum(map(len, blocks))
        begin, spans = at, []
        for block, _, start, stop in self.fresh:
            if stop > start:
                spans.append({"start": at + start, "stop": at + stop})
            blocks.append(block)
            at += len(block)
        out = (self.conv, self.number, "".join(blocks), begin, spans, len(self.fresh), total, total > self.budget)
        for block, n, _, _ in self.fresh[self.system is not None and not self.number :]:
            self.past.append((block, n))
            self.past_tokens += n
        while self.past and self.past_tokens > self.limit:
            self.past_tokens -= self.past.popleft()[1]
        self.fresh, self.tokens, self.number = [], 0, self.number + 1
        return out


WINDOW = "window_no bigint, text string, fresh_from bigint, loss array<struct<start:bigint,stop:bigint>>, n_turns bigint, n_tokens bigint, over_budget boolean"


def format_windows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """Windows of every conversation: conv_id, window_no, text, fresh_from (where the turns begin that no earlier window
    has), loss (spans of text under the mask), n_turns (those turns), n_tokens, over_budget.

    A conversation's turns are in order of turn, then role and text where turns tie; nulls first. Null roles and texts are
    empty; repeated rows are turns of their own. A turn that alone exceeds the budget gets a window of its own, marked
    over_budget; it is never cut. A first turn of role system opens every window. Turns of a conversation are
    read in order from a sorted stream, of which a task holds one window, however long the conversation is.
    """
    spark = df.sparkSession
    arrow_batches(spark, 1000)
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([T.StructField("conv_id", df.schema[conv_col].dataType), *T._parse_datatype_string(WINDOW).fields])
    arrow = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(arrow), pa.int64(), pa.int64(), pa.bool_()]

    held = spark.sparkContext.broadcast(None if vocabulary is None else ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, now, out = counter(held.value), None, []

        def batch(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], schema.names)

        kind = None
        for b in batches:
            kind = b.column(0).type
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.window())
                    now = _Writer(conv, budget, history)
                out.extend(now.add(role, text, count))
            if out:
                yield batch(kind)
        if now is not None:
            out.append(now.window())
            yield batch(kind)

    return rows.mapInArrow(run, schema)


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text; fails on anything that the template doesn't make."""
    found, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            break
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"not a formatted turn at {at}")
    return found


def digests(windows: DataFrame) -> DataFrame:
    """Reads windows back, one row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_windows, max_tokens. A conversation's windows must come in order in one partition, as format_windows gives them."""
    schema = T.StructType([windows.schema["conv_id"], *T._parse_datatype_string("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint, max_tokens bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind = None, None, None

        def row() -> list:
            return [now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]]

        def batch(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

        for b in batches:
            kind, out = b.column(0).type, []
            for conv, text, begin, loss, tokens in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 6)), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, said in parse(text[begin:]):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in loss:
                    said = unescape(text[s["start"] : s["stop"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += 1
                state[6] = max(state[6], tokens)
            if out:
                yield batch(out)
        if now is not None:
            yield batch([row()])

    return windows.mapInArrow(run, schema)

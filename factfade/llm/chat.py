r"""Conversations as training windows of a token budget.

Running sums of turn tokens cut a conversation into spans of whole turns.  A window
holds the system turn, as much recent history as its limit and the budget allow, and
the turns of one span.  Where the system turn leaves too little room, a span is cut
between turns into as many windows as the budget asks for.  Only assistant texts that a window brings for the first time
are under the loss mask; repeated ones are context.

A turn is written as ``### role: text</turn>`` and a line feed.  Inside roles and texts
a backslash stands before each backslash, ``#`` and ``<`` (in roles also ``:``), so no
text can open or close a turn, and taking the backslashes away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factfade.llm.running import running_before
from factfade.llm.tokens import ENCODED_CHARS, encode_bytes, text_slices
from factfade.session import materialize

BUDGET = 2048
SPAN = 1024  # new tokens begin inside one multiple of this
LONG = 512  # a turn of more tokens is a span of its own
HISTORY = 256
_SPANS_PER_CHUNK = 64
_NO_ID = -(1 << 63)

_IN_TEXT = re.compile(r"([\\#<])")
_IN_ROLE = re.compile(r"([\\#<:])")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.S)


def render(role: str, text: str) -> tuple[str, str]:
    """(what stands before the text, escaped text); CLOSE follows."""
    return f"### {_IN_ROLE.sub(r'\\\1', role)}: ", _IN_TEXT.sub(r"\\\1", text)


CLOSE = "</turn>\n"


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; raises where the window is not whole turns."""
    turns, at = [], 0
    while at < len(window):
        found = _TURN.match(window, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def _turns(conversations: DataFrame, tokenizer: str) -> DataFrame:
    @F.pandas_udf("long")
    def count_tokens(roles: pd.Series, texts: pd.Series) -> pd.Series:
        whole = ["".join((*render(r, t), CLOSE)) for r, t in zip(roles, texts, strict=True)]
        counts: list[int] = []
        for _, some in text_slices(whole, ENCODED_CHARS):
            counts += [len(b) // 4 for b in encode_bytes(tokenizer, some)]
        return pd.Series(counts, dtype="int64")

    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_ID)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    counted = rows.withColumn("tokens", count_tokens("role", "text"))
    return materialize(
        counted.withColumn("one", F.lit(1).cast("long"))
        .withColumn("long_turn", (F.col("tokens") > LONG).cast("long")),
        "turns",
    )


_FIELDS = (
    "conv long, window long, n_repeated int, n_new int, tokens long, over_budget boolean, "
    "formatted string, loss array<struct<start:int,stop:int>>"
)


def _write_windows(batches: Iterator[pa.RecordBatch], budget: int, history: int):
    """Windows of turns that come sorted by conv, chunk and seq."""
    key = span = system = None
    recent: deque = deque()
    new: list = []
    began = 0  # prefix sum at the first new turn
    made: list[list] = [[] for _ in range(8)]

    def exceeds(stop: int) -> bool:
        """Whether new turns up to the prefix sum ``stop`` leave no room for the rest."""
        room = budget
        if system is not None and system[0] < new[0][0] and system[4] <= budget:
            room -= system[4]
        return stop - began > room - min(history, room // 4)

    def close() -> None:
        if not new:
            return
        room = budget - sum(t[4] for t in new)
        before, first = [], new[0][0]
        if system is not None and system[0] < first:
            if system[4] <= (room if room >= 0 else budget):
                before.append(system)
                room -= system[4]
        room, kept = min(room, history), []
        for t in reversed(recent):
            if t[4] > room:
                break
            room -= t[4]
            kept.append(t)
        before += reversed(kept)
        text, at, loss = [], 0, []
        for k, (_, role, head, body, _n) in enumerate([*before, *new]):
            text += (head, body, CLOSE)
            at += len(head)
            if k >= len(before) and role == "assistant":
                loss.append({"start": at, "stop": at + len(body)})
            at += len(body) + len(CLOSE)
        tokens = sum(t[4] for t in [*before, *new])
        for column, value in zip(
            made,
            (key[0], first, len(before), len(new), tokens, tokens > budget, "".join(text), loss),
            strict=True,
        ):
            column.append(value)
        for t in new:
            if system is None or t[0] != system[0]:
                recent.append(t)
        held = sum(t[4] for t in recent)
        while recent and held > history:
            held -= recent.popleft()[4]
        new.clear()

    types = [
        pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(),
        pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])),
    ]
    names = ["conv", "window", "n_repeated", "n_new", "tokens", "over_budget", "formatted", "loss"]

    def batch_of() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(made, types, strict=True)], names
        )
        for column in made:
            column.clear()
        return out

    for batch in batches:
        for row in batch.to_pylist():
            now = (row["conv"], row["chunk"])
            if now != key:
                close()
                key, span, system = now, None, None
                recent.clear()
            turn = (row["seq"], row["role"], *render(row["role"], row["text"]), row["tokens"])
            if row["seq"] == 0 and row["role"] == "system":
                system = turn
            if not row["own"]:
                if turn is not system:
                    recent.append(turn)
                continue
            if span != row["span"] or (new and exceeds(row["start"] + row["tokens"])):
                close()
                span, began = row["span"], row["start"]
            new.append(turn)
            if len(made[0]) >= 500:
                yield batch_of()
    close()
    yield batch_of()


def format_windows(
    conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """Windows of all conversations (conv_id, turn, role, text), written to shared files.

    conv_id, window (number of its first new turn), n_repeated and n_new turns, tokens,
    over_budget, formatted, loss (spans of code points in ``formatted``).

    NULL role and text count as empty, rows without conv_id as one conversation; turns
    go by turn (NULL first), then role, then a hash of the text.  Repeated rows are
    turns like any other.  The system turn is a first turn of role ``system``; a window
    goes without it only where the two exceed the budget and a turn alone does not, or
    where it exceeds the budget itself.  A turn is never cut: only one that exceeds the
    budget alone gives a window ``over_budget``.
    An empty table gives no window; other columns are not read.

    A conversation is dealt to chunks of a bounded number of tokens, which get the
    system turn and the history before them as copies.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    placed = running_before(
        _turns(conversations, tokenizer), ["conv"], order,
        {"start": "tokens", "seq": "one", "longs": "long_turn"},
    )
    spans = materialize(
        placed.select(
            "conv", "seq", "role", "text", "tokens", "start",
            F.floor(F.col("start") / F.lit(SPAN * _SPANS_PER_CHUNK)).cast("long").alias("chunk"),
            F.struct(
                (2 * F.col("longs") + F.col("long_turn")).alias("part"),
                F.floor(F.col("start") / F.lit(SPAN)).cast("long").alias("step"),
            ).alias("span"),
        ),
        "turn-spans",
    )
    columns = ["conv", "chunk", "seq", "role", "text", "tokens", "start", "span"]
    own = spans.select(*columns, F.lit(True).alias("own"))
    edge = (F.col("chunk") + 1) * F.lit(SPAN * _SPANS_PER_CHUNK) - F.lit(history)
    is_system = (F.col("seq") == 0) & (F.col("role") == "system")
    carried = (
        spans.filter((F.col("start") >= edge) & ~is_system)
        .withColumn("chunk", F.col("chunk") + 1).select(*columns, F.lit(False).alias("own"))
    )
    later = spans.filter("chunk > 0").select("conv", "chunk").distinct()
    system = (
        spans.filter(is_system).drop("chunk").join(later, "conv")
        .select(*columns, F.lit(False).alias("own"))
    )
    rows = own.unionByName(carried).unionByName(system)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write_windows(batches, budget, history)

    windows = (
        rows.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "seq")
        .mapInArrow(write, _FIELDS)
    )
    return materialize(
        windows.select(
            F.when(F.col("conv") != _NO_ID, F.col("conv")).alias("conv_id"),
            *[c for c in windows.columns if c != "conv"],
        ),
        "chat-windows",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows hold of each conversation, parsed from their text and masks.

    A digest runs over the turns of a conversation in order, so its windows stream
    through one task, one window in memory at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out: list[list] = [[] for _ in fields]
        state: list = []

        def close() -> None:
            if state:
                conv, n, turns, chars, loss, whole = state
                for column, value in zip(
                    out, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), whole), strict=True
                ):
                    column.append(value)

        for batch in batches:
            for row in batch.to_pylist():
                if not state or state[0] != row["conv_id"]:
                    close()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, said in parse(text)[row["n_repeated"] :]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for part in row["loss"]:
                    target = unescape(text[part["start"] : part["stop"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, types, strict=True)], fields
        )

    return (
        windows.select("conv_id", "window", "n_repeated", "formatted", "loss")
        .repartition("conv_id").sortWithinPartitions("conv_id", "window")
        .mapInArrow(
            read,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
            "loss_sha256 string, formatted_chars long",
        )
    )

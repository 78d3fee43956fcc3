"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are its context, and only its own text is trained
on. The contexts of one conversation are prefixes of each other, so an example stores what its context adds to
the example before (`added`) and how long the shared part is (`prefix_chars`). That keeps what is shuffled and
stored linear in the input; `materialise` writes the contexts out in full, and `read_examples` reads them back.

Turns read `### role: text </turn>` and a line break. Control strings inside texts are escaped with a backslash,
so a text that holds a marker never looks like one and comes back unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the template.
START, AFTER_ROLE, END = "### ", ": ", " </turn>\n"
#: Escapes: the backslash itself first, then the control strings; a colon only within a role.
ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e"}
UNESCAPES = {"\\\\": "\\", "\\h": "###", "\\e": "</turn>", "\\c": ":"}
ASSISTANT = "assistant"
_ESCAPED = re.compile(r"\\[\\hec]")

EXAMPLES = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("example", T.LongType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("added", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("closing", T.StringType()),
    ]
)


def escaped(text: Column) -> Column:
    """The text with its control strings escaped; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for raw, safe in ESCAPES.items():
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def unescape(text: str) -> str:
    """The text before it was escaped."""
    return _ESCAPED.sub(lambda m: UNESCAPES[m[0]], text)


def expand(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples of all conversations, sorted within partitions by conversation and example.

    `turns` has a row per turn; a null role or text counts as empty, a null conversation is one of its own.
    Turns with the same number follow each other by role and text (empty first); repeated rows are turns of
    their own. Returns per example: conv_id, example (from zero), prefix_chars (length of the context that it shares with the example
    before), added (rest of the context, up to the opening of the reply), target (the reply, escaped: the only
    part under the loss mask), closing (end of the turn). Turns after the last reply form a last row with null
    target and closing, and so does a conversation without a reply, so that nothing is lost. Extra columns are
    ignored; an empty table gives no rows.

    One shuffle by conversation. A conversation streams through its task row by row: memory holds the turns
    since the last reply, whatever the length of the conversation.
    """
    rows = turns.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    formatted = ordered.select(
        "conv_id",
        (F.col("role") == ASSISTANT).alias("reply"),
        F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(AFTER_ROLE)).alias("opening"),
        escaped(F.col("text")).alias("body"),
    )
    return formatted.mapInArrow(_expand, EXAMPLES)


class _Rows:
    """Rows gathered into batches."""

    def __init__(self, schema: pa.Schema, most: int = 1_000):
        self.schema, self.most, self.rows = schema, most, []

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            self.rows = []
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _records(batches: Iterator[pa.RecordBatch], most: int = 1_000) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield from zip(*[c.to_pylist() for c in batch.slice(start, most).columns])


_EXAMPLE_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("example", pa.int64()), ("prefix_chars", pa.int64()), ("added", pa.string()), ("target", pa.string()), ("closing", pa.string())]
)
_NEW = object()


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Rows(_EXAMPLE_SCHEMA)
    current, example, prefix, added = _NEW, 0, 0, []
    for conv, reply, opening, body in _records(batches):
        if conv != current:
            if added:
                yield from out.add(current, example, prefix, "".join(added), None, None)
            current, example, prefix, added = conv, 0, 0, []
        if reply:
            context = "".join([*added, opening])
            yield from out.add(conv, example, prefix, context, body, END)
            example, prefix, added = example + 1, prefix + len(context) + len(body) + len(END), []
        else:
            added += [opening, body, END]
    if added:
        yield from out.add(current, example, prefix, "".join(added), None, None)
    yield from out.flush()


def materialise(examples: DataFrame, rest: bool = False) -> DataFrame:
    """Training rows with full contexts: conv_id, example, context, target, closing.

    Takes the sorted output of `expand` and needs no shuffle. Contexts written out grow with the square of a
    conversation's length; that is the format, not the join. Rows without a target are left out; with `rest` they
    follow with the turns after the last reply as their context and nothing else, so that no turn is lost.
    """
    schema = "conv_id long, example long, context string, target string, closing string"
    kept = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("context", pa.string()), ("target", pa.string()), ("closing", pa.string())])

    def run(batches):
        out = _Rows(kept, most=16)
        current, context = _NEW, []
        for conv, example, _, added, target, closing in _records(batches):
            if conv != current:
                current, context = conv, []
            context.append(added)
            if target is not None:
                whole = "".join(context)
                yield from out.add(conv, example, whole, target, closing)
                context = [whole, target, closing]
            elif rest:
                yield from out.add(conv, example, added, None, None)
        yield from out.flush()

    return examples.mapInArrow(run, schema)


def _turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of the closed turns of a formatted text, unescaped."""
    at = 0
    while at < len(text):
        middle = text.index(AFTER_ROLE, at)
        end = text.index(END, middle + len(AFTER_ROLE))
        if not text.startswith(START, at):
            raise ValueError("a turn has no start marker")
        yield unescape(text[at + len(START) : middle]), unescape(text[middle + len(AFTER_ROLE) : end])
        at = end + len(END)


_SUMS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SUMS_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def read_back(examples: DataFrame) -> DataFrame:
    """Parse the sorted output of `expand` and sum it up per conversation.

    Returns conv_id, n_turns, turns_sha256 (role, line break, text, line break of every turn), loss_chars and
    loss_sha256 (all text under the loss mask, unescaped) and formatted_chars (characters of all examples with
    their contexts written out, and of turns after the last reply). Digests are fed row by row.
    """

    def run(batches):
        out = _Rows(_SUMS_SCHEMA)
        current, state = _NEW, None
        for conv, _, prefix, added, target, closing in _records(batches):
            if conv != current:
                if state:
                    yield from out.add(current, *state.row())
                current, state = conv, _Digest()
            state.feed(prefix, added, target, closing)
        if state:
            yield from out.add(current, *state.row())
        yield from out.flush()

    return examples.mapInArrow(run, _SUMS)


def read_examples(rows: DataFrame) -> DataFrame:
    """What `read_back` returns, from the output of `materialise` with `rest`: the written-out examples.

    Every example must begin with the whole example before it, else this raises an error. So each turn is parsed
    where it first appears, and the worker holds two examples.
    """

    def run(batches):
        out = _Rows(_SUMS_SCHEMA)
        current, state, before = _NEW, None, ""
        for conv, _, context, target, closing in _records(batches, 16):
            if conv != current:
                if state:
                    yield from out.add(current, *state.row())
                current, state, before = conv, _Digest(), ""
            if target is None:
                state.feed(0, context, None, None)
            elif not context.startswith(before):
                raise ValueError(f"an example of conversation {conv} does not begin with the one before")
            else:
                state.feed(len(before), context[len(before) :], target, closing)
                before = context + target + closing
        if state:
            yield from out.add(current, *state.row())
        yield from out.flush()

    return rows.mapInArrow(run, _SUMS)


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars = 0, 0, 0

    def feed(self, prefix: int, added: str, target: str | None, closing: str | None) -> None:
        whole = added + (target or "") + (closing or "")
        for role, text in _turns(whole):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        if target is not None:
            reply = unescape(target)
            self.loss.update(reply.encode())
            self.loss_chars += len(reply)
        # turns after the last reply add themselves only
        self.chars += len(whole) + (prefix if target is not None else 0)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

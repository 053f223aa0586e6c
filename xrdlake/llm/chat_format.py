"""Conversations as training text: a state machine over roles and a declarative template with loss flags.

``format_conversations`` gives one row per emitted segment, in order within its conversation; ``read_back`` parses such
rows into turns again. Both stream over rows grouped and sorted by Spark, so a conversation of any length needs
the memory of one turn.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrdlake.llm.common import pick

START = "start"


@dataclasses.dataclass(frozen=True)
class Template:
    """What is written around a turn, which roles are learned, and which role may follow which.

    Control strings inside roles and texts get ``escape`` in front, and so does ``escape`` itself; that is undone exactly.
    """

    before_role: str = "### "
    after_role: str = ": "
    after_text: str = "</turn>\n"
    escape: str = "\\"
    control: tuple[str, ...] = ("###", ": ", "</turn>")
    learned: frozenset[str] = frozenset({"assistant"})
    follows: tuple[tuple[str, tuple[str, ...]], ...] = (
        (START, ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user", "tool")), ("tool", ("assistant",)))

    @property
    def hidden(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, (self.escape, *self.control))))

    @property
    def shown(self) -> re.Pattern:
        return re.compile(re.escape(self.escape) + "(" + "|".join(map(re.escape, (self.escape, *self.control))) + ")")


SEGMENTS = "conv_id long, turn long, segment long, text string, learn boolean, in_order boolean"
PARSED = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"


def turns_of(batches):
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)


def pieces(turns, template: Template):
    """Segments of turns in order; ``in_order`` is the state machine's word on the turn."""
    hidden, allowed = template.hidden, {k: set(v) for k, v in template.follows}
    swap = lambda m: template.escape + m.group()
    conv, state, n = object(), START, 0
    for conv_id, turn, role, text in turns:
        if conv_id != conv:
            conv, state, n = conv_id, START, 0
        fine = role in allowed.get(state, ())
        state = role
        learn = role in template.learned
        for part, flag in ((template.before_role + hidden.sub(swap, role) + template.after_role, False), (hidden.sub(swap, text), learn), (template.after_text, False)):
            yield conv_id, turn, n, part, flag, fine
            n += 1


def batches_of(rows, schema: pa.Schema, size: int = 4096, limit: int = 16_000_000):
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or chars >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, turn, segment, text, learn, in_order`` per segment, rows of a conversation together and in order.

    Turns are ordered by turn (nulls first), then role, then text, so repeated and tied rows have one order and all are
    kept. Null texts and roles count as empty; an empty or unknown role is out of order. Turns without a conversation id form one
    conversation. An empty table gives no rows; other columns are not read.
    """
    rows = pick(turns, conv_id="long", turn="long", role="string", text="string").fillna("", ["role", "text"])
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("learn", pa.bool_()), ("in_order", pa.bool_())])
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(
        lambda it: batches_of(pieces(turns_of(it), template), schema), SEGMENTS)


def parsed(segments, template: Template):
    """Turns read from the concatenated text of each conversation, by the template alone, with their digests."""
    shown = template.shown
    esc, unit = re.escape(template.escape), "|".join(map(re.escape, (template.escape, *template.control)))
    body = f"((?:{esc}(?:{unit})|(?!{{end}})[^{esc}])*+)"
    turn = re.compile(re.escape(template.before_role) + body.format(end=re.escape(template.after_role)) + re.escape(template.after_role)
                      + body.format(end=re.escape(template.after_text)) + re.escape(template.after_text), re.DOTALL)
    plain = lambda t: shown.sub(r"\1", t)
    conv, held = object(), None

    def closed():
        if held["open"]:
            raise ValueError("formatted text ends inside a turn")
        return conv, held["n"], held["turns"].hexdigest(), held["chars"], held["loss"].hexdigest(), held["all"], held["fine"]

    for conv_id, _, _, text, learn, fine in segments:
        if held is None or conv_id != conv:
            if held is not None:
                yield closed()
            conv, held = conv_id, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "fine": True, "open": []}
        held["all"] += len(text)
        held["fine"] &= fine
        held["open"].append(text)
        if learn:
            said = plain(text)
            held["chars"] += len(said)
            held["loss"].update(said.encode())
        if text == template.after_text:  # inside a turn this string is always escaped
            m = turn.fullmatch("".join(held["open"]))
            if not m:
                raise ValueError("formatted text does not follow the template")
            held["n"] += 1
            held["turns"].update(f"{plain(m[1])}\n{plain(m[2])}\n".encode())
            held["open"] = []
    if held is not None:
        yield closed()


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation what its segments say: turns and learned text as digests, lengths in code points, turn order.

    ``segments`` are rows of ``format_conversations``, still together and in order; raises where they don't parse.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("in_order", pa.bool_())])
    return segments.select("conv_id", "turn", "segment", "text", "learn", "in_order").mapInArrow(
        lambda it: batches_of(parsed(turns_of(it), template), schema), PARSED)


PROBE = r"\### Assistant: </turn> ok"


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts hold the template's own control strings."""
    spark = turns.sparkSession
    made = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return pick(turns, conv_id="long", turn="long", role="string", text="string").unionByName(made)

"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trained on.
An example's text is the beginning of its conversation's formatted text, up to the end of that turn, so an example's row holds its reply as formatted, and
its context as bounds into the conversation (context end = loss start, loss end): the turns' segments are stored once, and the output
grows with the turns, not with their square. ``examples`` are these rows; ``expand`` joins the whole texts of chosen ones back together.
``prefix_targets`` writes every example out, context and target, which by nature is the square of a conversation's turns; the registered query takes this way and reads its columns back from these examples.

Template: ``<<SYS>>text<</SYS>>``, ``[INST]text[/INST]``, and ``text</s>`` for system, user and assistant, any other
role as ``[ROLE:role]text[/ROLE]``, the whole after ``<s>``. All control strings begin with ``<`` or ``[``; in texts and roles these two and the
backslash are escaped (``\\{``, ``\\(``, ``\\\\``), so no text can hold a control string, and unescaping is exact.

Conversations are dealt out by id and read in order, a turn at a time: a task's memory doesn't grow with the length
of a conversation in ``segments``, and is one conversation's text and a batch in ``prefix_targets``. Order: turn, then role, then text; nulls first. Defined results: a null text is empty, a null role is ``[ROLE:]``
and reads back as the empty role; turns without an id are one conversation; repeated rows are turns of their own; an empty table gives no
conversation; other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

START, END = "<s>", "</s>"
_MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("", END)}
_ESCAPES = {"\\": "\\\\", "<": "\\{", "[": "\\("}
_BACK = {v: k for k, v in _ESCAPES.items()}
_SEGMENT = re.compile(r"<<SYS>>(?P<system>[^<]*)<</SYS>>|\[INST\](?P<user>[^\[]*)\[/INST\]|\[ROLE:(?P<role>[^\]\[]*)\](?P<other>[^\[]*)\[/ROLE\]|(?P<assistant>[^<\[]*)</s>")


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<", "\\{").replace("[", "\\(")


def unescape(s: str) -> str:
    return re.sub(r"\\.", lambda m: _BACK[m.group()], s, flags=re.DOTALL)


def segment(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn's formatted text, and where its text lies in it."""
    before, after = _MARKS.get(role or "", (f"[ROLE:{escape(role or '').replace(']', chr(92) + ')')}]", "[/ROLE]"))
    body = escape(text or "")
    return before + body + after, len(before), len(before) + len(body)


_BACK["\\)"] = "]"


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted conversation, or of a run of its segments; ValueError if it isn't one."""
    out, at = [], len(START) if formatted.startswith(START) else 0
    while at < len(formatted):
        m = _SEGMENT.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        kind = m.lastgroup if m.lastgroup != "other" else "role"
        role = unescape(m["role"]) if kind == "role" else kind
        out.append((role, unescape(m["other"] if kind == "role" else m[kind])))
        at = m.end()
    return out


_ROWS = {"position": "long", "segment": "string", "start": "long", "end": "long", "example": "long", "loss_start": "long", "loss_end": "long", "reply": "string"}
_KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _rows(rows: list[tuple], conv: str, columns: dict[str, str]) -> pa.RecordBatch:
    kinds = [_KINDS.get(conv, pa.string()), *(_KINDS[k] for k in columns.values())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=["conv_id", *columns])


def segments(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn, and after that of an assistant its example, in order within partitions that hold whole conversations.

    A turn: conv_id, position, segment, start, end. An example: conv_id, position, example (its number from 0), loss_start, loss_end, and reply, the formatted text
    between these; its context is the conversation's text before loss_start. All bounds are code points of the conversation's formatted text; the first segment begins with ``<s>``.
    """
    S.bound_batches(turns.sparkSession)
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    @S.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no id yet
        position = at = number = 0
        for b in batches:
            out: list[tuple] = []
            for conv, _, r, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv != now:
                    now, position, at, number = conv, 0, 0, 0
                s, x, y = segment(r, t)
                lead = START if not position else ""
                end = at + len(lead) + len(s)
                out.append((conv, position, lead + s, at, end, None, None, None, None))
                if r == "assistant":
                    out.append((conv, position, None, None, None, number, at + len(lead) + x, at + len(lead) + y, s[x:y]))
                    number += 1
                position, at = position + 1, end
            yield _rows(out, kind, _ROWS)

    kind = turns.schema[conv_id].dataType.simpleString()
    return dealt.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{k} {v}" for k, v in _ROWS.items()))


def examples(formatted: DataFrame) -> DataFrame:
    """One row for each assistant turn: conv_id, example, loss_start, loss_end, reply."""
    return formatted.where("example is not null").select("conv_id", "example", "loss_start", "loss_end", "reply")


def expand(formatted: DataFrame, chosen: DataFrame) -> DataFrame:
    """The whole texts of chosen examples (conv_id, example): conv_id, example, loss_start, loss_end, text. Their summed length is the output's, so choose."""
    wanted = chosen.select(F.col("conv_id").alias("c"), F.col("example").alias("e")).distinct()
    own = examples(formatted).join(wanted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("example") == F.col("e"))).select("c", "example", "loss_start", "loss_end")
    turns = formatted.where("segment is not null").select("conv_id", "position", "segment", "start")
    both = turns.join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("start") < F.col("loss_end")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "segment"))), lambda x: x["segment"]), "")
    joined = both.groupBy("conv_id", "example", "loss_start", "loss_end").agg(text.alias("text"))
    return joined.withColumn("text", F.concat(F.substring("text", 1, F.col("loss_end").cast("int")), F.lit(END)))


_EXPANDED = {"example": "long", "context": "string", "target": "string", "loss_start": "long", "loss_end": "long"}
#: Characters of examples after which a batch goes on.
BATCH = 4_000_000


def prefix_targets(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The expansion written out: a row for each assistant turn, conv_id, example (its number from 0), context (the conversation's formatted text before the reply), target (the formatted reply), loss_start and loss_end (its bounds in context + target + ``</s>``).
    Where turns follow the last reply, or there is none, one more row has the whole conversation as its context and no target. Rows come in order within partitions that hold whole conversations; a task holds one conversation's text and a batch."""
    S.bound_batches(turns.sparkSession)
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    @S.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no id yet
        whole, number, pending, size = "", 0, False, 0
        out: list[tuple] = []
        for b in batches:
            for conv, _, r, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv != now:
                    if pending:
                        out.append((now, number, whole, None, None, None))
                        size += len(whole)
                    now, whole, number = conv, START, 0
                s, x, y = segment(r, t)
                pending = r != "assistant"
                if not pending:
                    out.append((conv, number, whole + s[:x], s[x:y], len(whole) + x, len(whole) + y))
                    number, size = number + 1, size + len(whole) + y
                whole += s
                if size > BATCH:
                    yield _rows(out, kind, _EXPANDED)
                    out, size = [], 0
        if pending:
            out.append((now, number, whole, None, None, None))
        if out:
            yield _rows(out, kind, _EXPANDED)

    kind = turns.schema[conv_id].dataType.simpleString()
    return dealt.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{k} {v}" for k, v in _EXPANDED.items()))


def expanded_digests(expanded: DataFrame) -> DataFrame:
    """What ``digests`` gives, read back from the examples that ``prefix_targets`` wrote: the loss from each example's text under its mask, the turns from the text of the conversation's last row. ``expanded`` comes straight from ``prefix_targets``."""

    @S.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run
        last, loss, chars, count = "", hashlib.sha256(), 0, 0
        done: list[tuple] = []

        def close() -> None:
            if now is not run:
                turns, found = hashlib.sha256(), read_back(last)
                for role, text in found:
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                done.append((now, len(found), turns.hexdigest(), chars, loss.hexdigest(), len(last), count))

        for b in batches:
            for conv, example, context, target, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv != now:
                    close()
                    now, last, loss, chars, count = conv, START, hashlib.sha256(), 0, 0
                if example != count or not context.startswith(last):
                    raise ValueError("not the next example of this conversation")
                last = context
                if target is not None:
                    last = context + target + END
                    trained = unescape(last[x:y])
                    chars += len(trained)
                    loss.update(trained.encode("utf-8", "surrogatepass"))
                    count += 1
            if done:
                yield _rows(done, kind, _DIGESTS)
                done.clear()
        close()
        if done:
            yield _rows(done, kind, _DIGESTS)

    kind = expanded.schema["conv_id"].dataType.simpleString()
    return expanded.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{k} {v}" for k, v in _DIGESTS.items()))


_DIGESTS = {"n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long", "n_examples": "long"}


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back: n_turns, turns_sha256 and formatted_chars from the segments; loss_chars, loss_sha256 and n_examples from the examples, in their order. ``formatted`` comes straight from ``segments``."""

    @S.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run
        state: list = []
        done: list[tuple] = []

        def close() -> None:
            if state:
                n, turns, chars, loss, length, count = state
                done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), length, count))

        for b in batches:
            for conv, _, s, _, end, example, x, y, reply in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv != now or not state:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if example is None:
                    for role, text in read_back(s):
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[4] = end
                else:
                    if example != state[5] or len(reply) != y - x or y > state[4]:
                        raise ValueError("not an example of this conversation")
                    trained = unescape(reply)
                    state[2] += len(trained)
                    state[3].update(trained.encode("utf-8", "surrogatepass"))
                    state[5] += 1
            if done:
                yield _rows(done, kind, _DIGESTS)
                done = []
        close()
        if done:
            yield _rows(done, kind, _DIGESTS)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{k} {v}" for k, v in _DIGESTS.items()))

r"""Chat formatting at token level, with a loss mask.

Template: <s> opens a conversation; a user turn is [INST]text[/INST], a system
turn <<SYS>>text<</SYS>>, an assistant turn text</s>, and a turn of any other
role [ROLE]role[/ROLE]text</s>. Each marker is one reserved id. Segments are
encoded on their own, so no id of content spans a marker, and markers are
spliced in between as ids. The mask is the running sum of +1 where an
assistant text begins and -1 where it ends.

In content a backslash is doubled, and a control string gets one after its
first character: "</s>" becomes "<\/s>". A lone backslash is thus always ours
and a pair stands for one, so unescape() restores every text.

Turns are sorted by turn, role and text, so ties have a set order. A null text
or role counts as empty; rows with a null conversation id form a conversation
of that id. Repeated rows are repeated turns. Turns are encoded where they lie
and sorted by Spark; assembly streams over the rows and holds one conversation
at a time, which is also what a result row holds. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.packing import encoder
from corpusloom.llm.texts import blocks

MARKERS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
BOS, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END = range(8)
FIRST_RESERVED = 50_257  # the vocabulary's ids end before
CONTROL = re.compile("|".join(re.escape(m) for m in sorted(MARKERS, key=len, reverse=True)))
_PAIRED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _PAIRED.sub(r"\1", text)


def parts(role: str, text: str) -> list[tuple[int | str, bool]]:
    """A turn as markers and escaped contents, each with whether the loss covers it."""
    if role == "user":
        return [(USER, False), (escape(text), False), (USER_END, False)]
    if role == "system":
        return [(SYSTEM, False), (escape(text), False), (SYSTEM_END, False)]
    if role == "assistant":
        return [(escape(text), True), (END, False)]
    return [(ROLE, False), (escape(role), False), (ROLE_END, False), (escape(text), False), (END, False)]


FORMATTED = "conv_id long, text string, ids array<int>, loss array<tinyint>"


def formatted(rows: DataFrame, place: tuple[str, str, str]) -> DataFrame:
    """(conv_id, text, ids, loss) of rows (conv_id, turn, role, text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(*place)
        reserved = [np.array([FIRST_RESERVED + k], np.int32) for k in range(len(MARKERS))]
        for block in blocks(batches):
            shown, ids, sizes, steps, counts = [], [np.zeros(0, np.int32)], [], [], []
            for role, text in zip(block["role"], block["text"]):
                size, before, piece = 0, len(steps), ""
                for part, loss in parts(role or "", text or ""):
                    new = reserved[part] if isinstance(part, int) else code.ids(part, False).view(np.int32)
                    if loss and len(new):
                        steps += [size, size + len(new)]
                    ids.append(new)
                    size += len(new)
                    piece += MARKERS[part] if isinstance(part, int) else part
                shown.append(piece)
                sizes.append(size)
                counts.append(len(steps) - before)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(x, pa.int32())) for n, x in ((sizes, np.concatenate(ids)), (counts, steps))]
            yield pa.RecordBatch.from_arrays([pa.array(block["conv_id"], pa.int64()), pa.array(block["turn"], pa.int64()), pa.array(block["role"], pa.string()), pa.array(block["text"], pa.string()), pa.array(shown, pa.string()), *lists], ["conv_id", "turn", "role", "text", "shown", "ids", "steps"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(conv, shown: list, ids: list, begins: list, ends: list) -> tuple:
            every = np.concatenate([np.array([FIRST_RESERVED + BOS], np.int32), *ids])
            change = np.zeros(len(every) + 1, np.int64)
            np.add.at(change, np.array(begins, np.int64), 1)
            np.add.at(change, np.array(ends, np.int64), -1)
            return conv, MARKERS[BOS] + "".join(shown), every, np.cumsum(change[:-1]).astype(np.int8)

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.list_(pa.int32())), pa.array([d[3] for d in done], pa.list_(pa.int8()))], ["conv_id", "text", "ids", "loss"])

        done, size, open_ = [], 0, None
        for batch in batches:
            flat, ends = np.asarray(batch.column(2).values), batch.column(2).offsets.to_pylist()
            for conv, shown, low, high, steps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends, ends[1:], batch.column(3).to_pylist()):
                if open_ is None or open_[0] != conv:
                    if open_ is not None:
                        done.append(close(*open_[:5]))
                    open_ = [conv, [], [], [], [], 1]
                    if size > 1 << 20:
                        yield batch_of(done)
                        done, size = [], 0
                own = flat[low:high]
                open_[1].append(shown)
                open_[2].append(own)
                open_[3] += [open_[5] + s for s in steps[0::2]]
                open_[4] += [open_[5] + s for s in steps[1::2]]
                open_[5] += len(own)
                size += len(own)
        if open_ is not None:
            done.append(close(*open_[:5]))
        if done:
            yield batch_of(done)

    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns = plain.mapInArrow(encode, "conv_id long, turn long, role string, text string, shown string, ids array<int>, steps array<int>")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "shown", "ids", "steps").mapInArrow(assemble, FORMATTED)


def read_turns(ids: np.ndarray, loss: np.ndarray, decode) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns (role, text) and the texts under the mask, from the ids alone."""
    turns, masked, role, low = [], [], "assistant", 1
    openers = {USER: "user", SYSTEM: "system", ROLE: None}
    places = np.flatnonzero(ids >= FIRST_RESERVED)
    under = np.concatenate([np.zeros(1, np.int64), np.cumsum(loss)])[places].tolist()
    markers, numbers, every = (ids[places] - FIRST_RESERVED).tolist(), places.tolist(), ids.tolist()
    for at, marker, before, after in zip(numbers[1:], markers[1:], under, under[1:]):
        raw = decode(every[low:at])
        if marker in openers:
            role = openers[marker]
        elif marker == ROLE_END:
            role = unescape(raw)
        else:
            text = unescape(raw)
            turns.append((role, text))
            if at > low and after - before == at - low:
                masked.append(text)
            role = "assistant"
        low = at + 1
    return turns, masked


def read_back(found: DataFrame, place: tuple[str, str, str]) -> DataFrame:
    """Digests of what formatted() wrote, from its ids and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(*place)

        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            ids, loss = batch.column(2), batch.column(3)
            flat, mask, ends = np.asarray(ids.values), np.asarray(loss.values), ids.offsets.to_pylist()
            shift = (np.asarray(loss.offsets)[0] if len(loss) else 0) - (ends[0] if ends else 0)
            for low, high in zip(ends, ends[1:]):
                turns, masked = read_turns(flat[low:high], mask[low + shift : high + shift], code.text)
                under = "".join(masked)
                row = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest())
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
            columns = [batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds)), pc.utf8_length(batch.column(1).cast(pa.string())).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return found.select("conv_id", "text", "ids", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

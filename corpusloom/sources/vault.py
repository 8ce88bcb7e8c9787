r"""A folder of notes as a Spark data source: read whole, followed as a stream, and written back to, front matter alone.

    spark.dataSource.register(Vault)
    spark.read.format("vault").load(folder)              # path, mtime, text
    spark.readStream.format("vault").load(folder)        # the same, of notes as they change
    tags.write.format("vault").mode("append").save(folder)   # path, tags, and mtime if it is to be checked

A stream's offset is the time of the last change that it has read and the names of
the notes with that very time, so a note that arrives in the same tick is neither
lost nor read twice, and a restart goes on from its checkpoint. A note's time is the
later of its change and of its arrival in the folder, so one that is moved in
with an old date is read too. A note that changes between planning and reading is
read as it is then, and again in the next batch: later batches hold later texts.
Notes that can't be decoded come with U+FFFD for the bad bytes; a note that is gone
by the time it is read gives no row. Removed notes are found by removed().

The writer puts `tags` in place of a note's tags in its front matter, sorted and
each once, takes the key out where there are none, and begins a front matter where
there is none. All other bytes stay as they are. It writes a file beside the note
and renames it, so a note is whole at any time and a task that runs twice does no
harm. A note that is gone, or whose mtime is not the given one, is left alone. Null
tags leave a note alone, too; null tags in the array don't count.

Folders are paths that driver and executors share.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NOTE = "path string, mtime timestamp, text string"
PART = 256  # notes to a task, about

OPENING = re.compile(rb"\A(\xef\xbb\xbf)?---[ \t]*(\r?\n)")
CLOSING = re.compile(rb"^---[ \t]*(?:\r?\n|\Z)", re.M)
TAGS = re.compile(rb"^tags[ \t]*:[^\n]*(?:\n|\Z)(?:[ \t]*-(?:[ \t][^\n]*)?(?:\n|\Z)|[ \t]+[^\s-][^\n]*(?:\n|\Z))*", re.M)


def with_tags(note: bytes, tags: list[str]) -> bytes:
    """The note with these tags in its front matter; all else byte for byte."""
    own = sorted({t for t in tags if t})
    opening = OPENING.match(note)
    closing = CLOSING.search(note, opening.end()) if opening else None
    if not closing:
        line = b"\r\n" if b"\r\n" in note[:4096] else b"\n"
        mark = b"\xef\xbb\xbf" if note.startswith(b"\xef\xbb\xbf") else b""
        return mark + b"---" + line + _block(own, line) + b"---" + line + note[len(mark) :] if own else note
    front, line = note[opening.end() : closing.start()], opening[2]
    found = TAGS.search(front)
    if found:
        front = front[: found.start()] + _block(own, line) + front[found.end() :]
    else:
        front += _block(own, line)
    return note[: opening.end()] + front + note[closing.start() :]


def _block(tags: list[str], line: bytes) -> bytes:
    return b"tags:" + line + b"".join(b"  - " + t.encode() + line for t in tags) if tags else b""


def _notes(folder: str) -> Iterator[tuple[int, str]]:
    """(time in microseconds, path below the folder) of every note."""
    for at, _, names in os.walk(folder):
        for name in names:
            if name.endswith(".md"):
                path = os.path.join(at, name)
                try:
                    found = os.stat(path)
                except FileNotFoundError:
                    continue
                yield max(found.st_mtime_ns, found.st_ctime_ns) // 1000, os.path.relpath(path, folder)


class Notes(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)


def _dealt(names: list[str]) -> list[Notes]:
    return [Notes(names[k : k + PART]) for k in range(0, len(names), PART)]


def _rows(folder: str, names: list[str]) -> Iterator[tuple]:
    for name in names:
        try:
            with open(os.path.join(folder, name), "rb") as f:
                text = f.read()
                mtime = os.fstat(f.fileno()).st_mtime_ns // 1000
        except FileNotFoundError:
            continue
        yield name, datetime.fromtimestamp(mtime / 1e6, timezone.utc), text.decode("utf-8", "replace")


class VaultReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Notes]:
        return _dealt(sorted(name for _, name in _notes(self.folder)))

    def read(self, partition: Notes) -> Iterator[tuple]:
        return _rows(self.folder, partition.value if partition else [])


class VaultStream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"at": 0, "names": []}

    def latestOffset(self) -> dict:
        found = list(_notes(self.folder))
        at = max((t for t, _ in found), default=0)
        return {"at": at, "names": sorted(n for t, n in found if t == at)}

    def partitions(self, start: dict, end: dict) -> list[Notes]:
        seen, last = set(start["names"]), set(end["names"])
        new = [n for t, n in _notes(self.folder) if (t > start["at"] or t == start["at"] and n not in seen) and (t < end["at"] or t == end["at"] and n in last)]
        return _dealt(sorted(new))

    def read(self, partition: Notes) -> Iterator[tuple]:
        return _rows(self.folder, partition.value)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class VaultWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        for row in iterator:
            row = row.asDict()
            if row.get("tags") is None or row.get("path") is None:
                continue
            path = os.path.join(self.folder, row["path"])
            try:
                with open(path, "rb") as f:
                    note, found = f.read(), os.fstat(f.fileno())
            except FileNotFoundError:
                continue
            if row.get("mtime") is not None and round(row["mtime"].timestamp() * 1e6) != found.st_mtime_ns // 1000:
                continue
            new = with_tags(note, row["tags"])
            if new != note:
                handle, beside = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".", suffix=".tmp")
                with os.fdopen(handle, "wb") as f:
                    f.write(new)
                    os.fchmod(f.fileno(), found.st_mode & 0o777)
                os.replace(beside, path)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        pass  # each note is whole, with its old tags or with its new ones


class Vault(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return NOTE

    @property
    def folder(self) -> str:
        return self.options["path"].removeprefix("file://")

    def reader(self, schema: StructType) -> VaultReader:
        return VaultReader(self.folder)

    def streamReader(self, schema: StructType) -> VaultStream:
        return VaultStream(self.folder)

    def writer(self, schema: StructType, overwrite: bool) -> VaultWriter:
        return VaultWriter(self.folder)


def as_changes(notes: DataFrame) -> DataFrame:
    """Notes as changes.CHANGE rows; the order of versions is that of their times."""
    return notes.select(F.lit("set").alias("op"), "path", "text", F.unix_micros("mtime").alias("seq"))


def removed(notes: DataFrame, known: DataFrame, seq: int) -> DataFrame:
    """changes.CHANGE rows that take out what is known(path) but no longer among notes(path)."""
    gone = known.select("path").distinct().join(notes.select("path"), "path", "left_anti")
    return gone.select(F.lit("remove").alias("op"), "path", F.lit(None).cast("string").alias("text"), F.lit(seq).cast("long").alias("seq"))

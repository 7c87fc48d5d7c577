"""Folders of notes and of picture cards as data sources of Spark: a file for each row, commits, and ranges of ids.

A writing task puts its files and a list of them into a folder of its own and tells the driver, for every block of ``BLOCK`` rows, the
smallest and the largest id; only when all tasks are done does a commit name their folders, so that files of lost or
repeated tasks are never read. A reader makes a partition of each committed block that may have ids from ``low`` to ``high`` and
opens the files of those ids. The driver holds a line for each block, and no row.

The range is an option of the load. The reader takes no pushed filters: Spark 4.1 keeps the filters of a query with the table, and
another query of the same DataFrame that pushes none gets its rows (a test shows that this source is free of it).

    folders.register(spark)
    df.write.format("bracken_notes").mode("append").save(path)
    spark.read.format("bracken_notes").option("low", 100).load(path)

Ids are whole numbers and not null; repeated ids are separate rows. ``path`` is anything that pyarrow's file systems open.
"""

from __future__ import annotations

import base64
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import files

BLOCK = 1000
COMMITS = "_commits"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


@dataclass
class Block(InputPartition):
    folder: str
    start: int
    rows: int
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    folder: str
    blocks: list[Block]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _put(store: fs.FileSystem, path: str, data: bytes) -> None:
    with store.open_output_stream(path) as out:
        out.write(data)


def _get(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()


class Folder(DataSource):
    """What notes and cards have in common; they differ in ``form`` and ``parse``, from and to the columns after the id."""

    ending = ""

    @staticmethod
    def form(*values: Any) -> bytes:
        raise NotImplementedError

    @staticmethod
    def parse(data: bytes) -> tuple:
        raise NotImplementedError

    def reader(self, schema: Any) -> FolderReader:
        low, high = (int(v) if (v := self.options.get(o)) is not None else None for o in ("low", "high"))
        return FolderReader(self.options["path"], type(self), low, high)

    def writer(self, schema: Any, overwrite: bool) -> FolderWriter:
        if schema.fieldNames() != (want := [c.strip().split(" ")[0] for c in self.columns]):
            raise ValueError(f"columns are {want} in this order, not {schema.fieldNames()}")
        return FolderWriter(self.options["path"], type(self), overwrite)

    def schema(self) -> str:
        return ", ".join(self.columns)


class FolderReader(DataSourceReader):
    def __init__(self, path: str, kind: type[Folder], low: int | None = None, high: int | None = None):
        self.path, self.kind, self.low, self.high = path, kind, low, high

    def _may(self, low: int, high: int) -> bool:
        """Whether any id from low to high is asked for."""
        return (self.low is None or high >= self.low) and (self.high is None or low <= self.high)

    def partitions(self) -> list[Block]:
        store, root = _open(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
        blocks: list[Block] = []
        for at in sorted(f.path for f in found if f.path.endswith(".json")):
            commit = json.loads(_get(store, at))
            blocks = ([] if commit["overwrite"] else blocks) + [Block(**b) for b in commit["blocks"]]
        return [b for b in blocks if self._may(b.low, b.high)] or [Block("", 0, 0, 0, 0)]

    def read(self, block: Block) -> Iterator[tuple]:
        if not block.rows:
            return
        store, root = _open(self.path)
        ids = json.loads(_get(store, f"{root}/{block.folder}/{block.start:012d}.list"))
        for i, row in enumerate(ids, block.start):
            if self._may(row, row):
                yield (row, *self.kind.parse(_get(store, f"{root}/{block.folder}/{i:012d}{self.kind.ending}")))


class FolderWriter(DataSourceWriter):
    def __init__(self, path: str, kind: type[Folder], overwrite: bool):
        self.path, self.kind, self.overwrite = path, kind, overwrite

    def write(self, rows: Iterator[Any]) -> Written:
        store, root = _open(self.path)
        folder, blocks, ids, n = f"part-{uuid.uuid4().hex}", [], [], 0

        def close() -> None:
            if ids:
                start = n - len(ids)
                _put(store, f"{root}/{folder}/{start:012d}.list", json.dumps(ids).encode())
                blocks.append(Block(folder, start, len(ids), min(ids), max(ids)))
                ids.clear()

        for row in rows:
            if not n:
                store.create_dir(f"{root}/{folder}", recursive=True)
            key, *values = row
            data = self.kind.form(*values)
            if key is None or self.kind.parse(data) != tuple(values):
                raise ValueError(f"the row of id {key} would not be read back as it is")
            _put(store, f"{root}/{folder}/{n:012d}{self.kind.ending}", data)
            ids.append(key)
            n += 1
            if len(ids) == BLOCK:
                close()
        close()
        return Written(folder, blocks)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        store.create_dir(f"{root}/{COMMITS}", recursive=True)
        blocks = [asdict(b) for m in messages if m for b in m.blocks]
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        staged = f"{root}/{COMMITS}/{name}.new"
        _put(store, staged, json.dumps({"overwrite": self.overwrite, "blocks": blocks}).encode())
        store.move(staged, f"{root}/{COMMITS}/{name}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        for m in messages:
            if m and m.blocks:
                store.delete_dir(f"{root}/{m.folder}")


class Notes(Folder):
    """SRC-10: notes with front matter and sections; the fields of ``head`` are single lines."""

    columns = ("id long", "head map<string,string>", "sections map<string,string>")
    ending = ".md"

    @classmethod
    def name(cls) -> str:
        return "bracken_notes"

    @staticmethod
    def form(head: dict, sections: dict) -> bytes:
        front = "".join(f"{k}: {v}\n" for k, v in (head or {}).items())
        body = "".join((f"## {k}\n" if k else "") + f"{v}\n" for k, v in sorted((sections or {}).items()))
        return f"---\n{front}---\n{body}".encode()

    @staticmethod
    def parse(data: bytes) -> tuple:
        found = files.note(data.decode())
        return found["head"], found["sections"]


class Cards(Folder):
    """SRC-11: pictures of one pixel that carry a card, a JSON text, in a text chunk."""

    columns = ("id long", "card string")
    ending = ".png"

    @classmethod
    def name(cls) -> str:
        return "bracken_cards"

    @staticmethod
    def form(card: str) -> bytes:
        def chunk(kind: bytes, body: bytes) -> bytes:
            return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

        text = b"" if card is None else chunk(b"tEXt", b"chara\0" + base64.b64encode(card.encode()))
        return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + text + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")

    @staticmethod
    def parse(data: bytes) -> tuple:
        raw = files.png_text(data, "chara")
        return (None if raw is None else base64.b64decode(raw).decode(),)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    for kind in (Notes, Cards):
        spark.dataSource.register(kind)

"""An append-only log of notes as a Spark data source: read as a batch, read as a stream, and written.

A log is a folder of objects and refs. An object is a file of lines that is named by its digest and never changes. A ref is a file with the name of its head, an object whose lines say which objects an append added and
which head came before; so the heads of a ref are a chain, an append each. Refs move last and only when all of an append's objects are there.

The driver walks heads, one small file for each append; the objects they name are read in parallel, some in each partition. A stream's offset is the object that each ref points to. A ref that has not
moved costs nothing, and one that has moved gives what its new heads added; if the old head is no longer on its chain (the ref was set elsewhere) all of it is read again, which a fold over the records bears.

Use: ``spark.dataSource.register(NoteLog)``, then ``spark.read.format("note_log").load(path)`` or ``readStream``; rows are (ref, commit, line, value). The folder is opened by pyarrow, so it may be in any store that it knows, and must be
reachable from all executors.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "ref string, commit string, line int, value string"
PER_PARTITION = 16


class LogFolder:
    """The files of a log."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path)

    def read(self, name: str) -> str | None:
        try:
            with self.files.open_input_stream(f"{self.root}/{name}") as f:
                return f.read().decode("utf-8")
        except FileNotFoundError:
            return None

    def write(self, name: str, text: str) -> None:
        """The whole file or nothing: it is written under another name and then moved."""
        folder = f"{self.root}/{name}".rpartition("/")[0]
        self.files.create_dir(folder, recursive=True)
        part = f"{self.root}/{name}.{hashlib.sha256(text.encode()).hexdigest()[:12]}.part"
        with self.files.open_output_stream(part) as f:
            f.write(text.encode("utf-8"))
        self.files.move(part, f"{self.root}/{name}")

    def put(self, text: str) -> str:
        """Stores an object and returns its name; the same text is the same object."""
        name = hashlib.sha256(text.encode("utf-8")).hexdigest()
        self.write(f"objects/{name}", text)
        return name

    def refs(self) -> dict[str, str]:
        """Each ref and the head it points to."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/refs", allow_not_found=True, recursive=True))
        names = [f.path[len(f"{self.root}/refs/") :] for f in found if f.type == fs.FileType.File and not f.path.endswith(".part")]
        return {n: self.read(f"refs/{n}").strip() for n in sorted(names)}

    def append(self, ref: str, objects: list[tuple[str, str]]) -> str:
        """Adds objects, each (commit, object), to a ref as one append."""
        before = self.read(f"refs/{ref}")
        head = self.put(json.dumps({"before": before.strip() if before else None, "objects": objects}))
        self.write(f"refs/{ref}", head + "\n")
        return head

    def added(self, head: str, since: str | None) -> list[tuple[str, str]]:
        """(commit, object) of all appends from after one head up to another, oldest first; of all appends if the first isn't on the chain."""
        appends, at = [], head
        while at and at != since:
            said = json.loads(self.read(f"objects/{at}"))
            appends.append(said["objects"])
            at = said["before"]
        return [tuple(o) for append in reversed(appends) for o in append]


@dataclass
class Objects(InputPartition):
    ref: str
    objects: list[tuple[str, str]]


def _partitions(folder: LogFolder, before: dict[str, str], now: dict[str, str]) -> list[Objects]:
    out = []
    for ref, head in now.items():
        if head != before.get(ref):
            found = folder.added(head, before.get(ref))
            out += [Objects(ref, found[i : i + PER_PARTITION]) for i in range(0, len(found), PER_PARTITION)]
    return out


def _rows(path: str, partition: Objects) -> Iterator[tuple[str, str, int, str]]:
    folder = LogFolder(path)
    for commit, name in partition.objects:
        text = folder.read(f"objects/{name}")
        if text is None or hashlib.sha256(text.encode("utf-8")).hexdigest() != name:
            raise OSError(f"object {name} of the log is missing or damaged")
        for line, value in enumerate(text.split("\n")):
            if value:
                yield partition.ref, commit, line, value


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Objects]:
        folder = LogFolder(self.path)
        return _partitions(folder, {}, folder.refs()) or [Objects("", [])]

    def read(self, partition: Objects) -> Iterator[tuple]:
        return _rows(self.path, partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return LogFolder(self.path).refs()

    def partitions(self, start: dict, end: dict) -> list[Objects]:
        return _partitions(LogFolder(self.path), start, end)

    def read(self, partition: Objects) -> Iterator[tuple]:
        return _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing to clear: the log is never shortened."""


@dataclass
class Written(WriterCommitMessage):
    objects: list[tuple[str, str, str]]


class Writer(DataSourceWriter):
    """Each task stores its rows as an object for each ref and commit; the refs move when all tasks are through, so a lost run adds nothing, and a task that runs twice stores the same objects."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        folder, lines = LogFolder(self.path), {}
        for r in rows:
            lines.setdefault((r["ref"], r["commit"]), []).append((r["line"], r["value"]))
        return Written([(ref, commit, folder.put("\n".join(v for _, v in sorted(found)) + "\n")) for (ref, commit), found in sorted(lines.items())])

    def commit(self, messages: list[Written | None]) -> None:
        by_ref: dict[str, list[tuple[str, str]]] = {}
        for ref, commit, name in sorted(o for m in messages if m is not None for o in m.objects):
            by_ref.setdefault(ref, []).append((commit, name))
        folder = LogFolder(self.path)
        for ref, objects in by_ref.items():
            folder.append(ref, objects)

    def abort(self, messages: list) -> None:
        """Objects that no head names are not read."""


class NoteLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "note_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a log can only be appended to")
        return Writer(self.options["path"])

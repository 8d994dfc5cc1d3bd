"""Targets and reports as Spark data sources: folders are listed by tasks, and one report file is written by tasks.

`script_targets` reads the files below a folder (option `path`) whose names end in
.js or .ts, whatever the case, hidden ones too. The driver lists folders only until
there is one for each of `partitions` tasks; the tasks list what is below theirs.
With `kind` = `lines` it reads a list file instead: tasks take ranges of its bytes;
`trim` drops the white space around lines, and `blanks` keeps empty ones. Columns:
target, and (part, place), by which lines stand in order.

`claimlens_report` writes findings (unclaimed_package, source_url) as one file
(option `path`): each task writes its rows to a part beside it, and the commit puts
the parts together in order, with brackets, commas or the header with the count. An
aborted write leaves neither parts nor a report. Only the copying of bytes is
left to the driver.

Paths may be local ones that all executors share, or any URI that Arrow's file
systems read.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from claimlens.functions.measures import REPORT_HEAD, REPORT_PACKAGE, REPORT_SOURCE

EXTENSIONS = (".js", ".ts")
_BATCH = 10_000
_CHUNK = 1 << 20
#: Python's strip takes these for white space, the other sources do not.
_CONTROLS = "\x1c\x1d\x1e\x1f"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def make_folder(path: str) -> None:
    files, where = opened(path)
    files.create_dir(where)


def _on(options: dict, name: str, default: bool = False) -> bool:
    return str(options.get(name, default)).lower() == "true"


def is_script(path: str) -> bool:
    return path.lower().endswith(EXTENSIONS)


@dataclass
class Folders(InputPartition):
    """Files that are known, and folders that are still to be listed."""

    part: int
    files: list[str]
    folders: list[str]


@dataclass
class Bytes(InputPartition):
    part: int
    start: int
    end: int


def _listed(files: pafs.FileSystem, folder: str) -> tuple[list[str], list[str]]:
    """Names of the script files and of the folders in a folder; links to folders are not followed."""
    scripts, folders = [], []
    for info in files.get_file_info(pafs.FileSelector(folder)):
        if info.type == pafs.FileType.Directory:
            if not (isinstance(files, pafs.LocalFileSystem) and os.path.islink(info.path)):
                folders.append(info.path)
        elif is_script(info.base_name):
            scripts.append(info.path)
    return sorted(scripts), sorted(folders)


class _FolderReader(DataSourceReader):
    def __init__(self, path: str, partitions: int):
        self.path, self.wanted = path, partitions

    def partitions(self) -> list[InputPartition]:
        files, root = opened(self.path)
        found, ready = _listed(files, root)
        while ready and len(ready) < self.wanted:
            below = []
            for folder in ready:
                scripts, inner = _listed(files, folder)
                found += scripts
                below += inner
            if not below:
                ready = []
                break
            ready = below
        n = max(1, min(self.wanted, len(ready) + (len(found) > 0)))
        return [Folders(i, found[i::n], ready[i::n]) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        names, waiting, place = list(partition.files), list(partition.folders), 0
        while names or waiting:
            while waiting and len(names) < _BATCH:
                scripts, inner = _listed(files, waiting.pop())
                names += scripts
                waiting += inner
            out, names = names[:_BATCH], names[_BATCH:]
            if out:
                yield pa.record_batch([pa.array(out), pa.array([partition.part] * len(out), pa.int32()), pa.array(range(place, place + len(out)), pa.int64())], names=["target", "part", "place"])
                place += len(out)


class _LineReader(DataSourceReader):
    """Ranges of a file's bytes; a line belongs to the range that holds its first byte."""

    def __init__(self, path: str, partitions: int, trim: bool, blanks: bool):
        self.path, self.wanted, self.trim, self.blanks = path, partitions, trim, blanks

    def partitions(self) -> list[InputPartition]:
        files, path = opened(self.path)
        info = files.get_file_info(path)
        if info.type != pafs.FileType.File:
            raise FileNotFoundError(self.path)
        step = max(1, -(-info.size // self.wanted))
        return [Bytes(i, start, min(start + step, info.size)) for i, start in enumerate(range(0, max(info.size, 1), step))]

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        files, path = opened(self.path)
        out, place = [], 0
        with io.BufferedReader(files.open_input_file(path), _CHUNK) as raw:
            raw.seek(max(0, partition.start - 1))
            at = partition.start
            if partition.start:
                # The byte before tells whether a line begins here; else its rest belongs to the range before.
                at += len(raw.readline()) - 1
            while at < partition.end:
                line = raw.readline()
                at += len(line)
                if not line:
                    break
                text = line.decode("utf-8", "replace").removesuffix("\n").removesuffix("\r")
                text = _stripped(text) if self.trim else text
                if text or self.blanks:
                    out.append(text)
                if len(out) == _BATCH:
                    yield self._batch(partition, out, place)
                    out, place = [], place + _BATCH
        if out:
            yield self._batch(partition, out, place)

    def _batch(self, partition: Bytes, out: list[str], place: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array(out), pa.array([partition.part] * len(out), pa.int32()), pa.array(range(place, place + len(out)), pa.int64())], names=["target", "part", "place"])


def _stripped(text: str) -> str:
    """Without white space around, which the four separators among the controls are not."""
    start, end = 0, len(text)
    while start < end and text[start].isspace() and text[start] not in _CONTROLS:
        start += 1
    while end > start and text[end - 1].isspace() and text[end - 1] not in _CONTROLS:
        end -= 1
    return text[start:end]


class ScriptTargets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "script_targets"

    def schema(self) -> str:
        return "target string, part int, place long"

    def reader(self, schema: object) -> DataSourceReader:
        path, n = self.options["path"], int(self.options.get("partitions", 64))
        if self.options.get("kind", "folder") == "lines":
            return _LineReader(path, n, _on(self.options, "trim", True), _on(self.options, "blanks"))
        return _FolderReader(path, n)


def _escaped(text: str) -> str:
    for c in "&<>":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def _json_item(package: str, source: str) -> str:
    item = json.dumps({"unclaimed_package": package, "source_url": source}, indent=2, ensure_ascii=False)
    return "\n".join("  " + x for x in _escaped(item).split("\n"))


def _text_item(package: str, source: str, verbose: bool) -> str:
    return REPORT_PACKAGE % package + "\n" + (REPORT_SOURCE % source + "\n" if verbose else "")


@dataclass
class Part(WriterCommitMessage):
    order: int
    path: str
    rows: int


class _ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str, as_json: bool, verbose: bool, silent: bool):
        self.path, self.json, self.verbose, self.silent = path, as_json, verbose, silent
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        order = TaskContext.get().partitionId()
        files, folder = opened(self.parts)
        # Each attempt has a name of its own: the commit takes those that Spark has accepted.
        path, rows = f"{folder}/{order:08d}-{uuid.uuid4().hex}", 0
        out = None
        for batch in iterator:
            names, sources = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("unclaimed_package", "source_url"))
            if not names:
                continue
            if out is None:
                files.create_dir(folder)
                out = files.open_output_stream(path)
            if self.json:
                out.write(((",\n" if rows else "") + ",\n".join(map(_json_item, names, sources))).encode())
            else:
                out.write("".join(_text_item(n, s, self.verbose) for n, s in zip(names, sources, strict=True)).encode())
            rows += len(names)
        if out is not None:
            out.close()
        return Part(order, path, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.order)
        n = sum(m.rows for m in parts)
        files, path = opened(self.path)
        try:
            _make_parent(files, path)
            with files.open_output_stream(path) as out:
                if n or not self.silent:
                    out.write(self._head(n).encode())
                    for i, m in enumerate(parts):
                        out.write(b",\n" if self.json and i else b"")
                        _copy(files, m.path, out)
                    out.write((("\n]\n" if n else "\n") if self.json else "").encode())
        finally:
            self._clean()

    def _head(self, n: int) -> str:
        if self.json:
            return "[\n" if n else "[]"
        return REPORT_HEAD % n + "\n" if n else ""

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        files, folder = opened(self.parts)
        if files.get_file_info(folder).type == pafs.FileType.Directory:
            files.delete_dir(folder)


def _make_parent(files: pafs.FileSystem, path: str) -> None:
    parent = os.path.dirname(path)
    if isinstance(files, pafs.LocalFileSystem):
        os.makedirs(parent, mode=0o750, exist_ok=True)
    else:
        files.create_dir(parent)


def _copy(files: pafs.FileSystem, path: str, out: pa.NativeFile) -> None:
    with files.open_input_stream(path) as part:
        while chunk := part.read(_CHUNK):
            out.write(chunk)


class Report(DataSource):
    @classmethod
    def name(cls) -> str:
        return "claimlens_report"

    def schema(self) -> str:
        return "unclaimed_package string, source_url string"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        o = self.options
        return _ReportWriter(o["path"], o.get("kind", "text") == "json", _on(o, "verbose"), _on(o, "silent"))


def register(spark: SparkSession) -> None:
    for source in (ScriptTargets, Report):
        spark.dataSource.register(source)


def folder_targets(spark: SparkSession, root: str, partitions: int = 64) -> DataFrame:
    """(part, place, target) of the script files below a folder, listed by tasks."""
    register(spark)
    return spark.read.format("script_targets").option("partitions", partitions).load(root)


def line_targets(spark: SparkSession, path: str, *, trim: bool = True, blanks: bool = False, partitions: int = 64) -> DataFrame:
    """(part, place, target) of the lines of a list file, in order of part and place; read by tasks, a range of bytes each."""
    register(spark)
    return spark.read.format("script_targets").options(kind="lines", trim=trim, blanks=blanks, partitions=partitions).load(path)


def save_report(findings: DataFrame, path: str, kind: str = "text", verbose: bool = False, silent: bool = False) -> None:
    """One report file, its rows sorted and written by tasks; the bytes are those of sinks.write_report."""
    register(findings.sparkSession)
    order = [F.col("unclaimed_package"), F.col("source_url")]
    rows = findings.select("unclaimed_package", "source_url").repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.format("claimlens_report").options(kind=kind, verbose=verbose, silent=silent).mode("append").save(path)

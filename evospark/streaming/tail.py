"""A streaming source of the lines that are appended to text files.

An offset says how far each file has been handed out, in bytes, and how many bytes that makes in
all. A batch takes the new whole lines of every file, in the files' order; a line that isn't ended
yet waits. A line's id is the number of bytes that came before it in the stream, so ids are unique,
rise with the lines of a file and with the batches, and are the same when a batch is read again.
A file that has become shorter is read from its start. Files are listed and read through Arrow's
file systems, so a path may be local or remote; a long range is read by several tasks.
"""

from __future__ import annotations

import fnmatch
import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Spark also starts the reader in a process of the driver's, which doesn't have the shipped code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a file that a task reads at once, and that are looked at for the last line's end.
RANGE, LOOK = 8 << 20, 1 << 16


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(pattern: str) -> dict[str, int]:
    """Path and size of the files of a pattern or folder; hidden ones are left out."""
    from pyarrow import fs

    parts = pattern.split("/")
    fixed = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
    base = "/".join(parts[:fixed])
    system, root = _open(base)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return {base: info.size}
    if info.type == fs.FileType.NotFound:
        return {}
    rest = "/".join(parts[fixed:]) or "*"
    out = {}
    for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
        own = f.path[len(root.rstrip("/")) + 1 :]
        shown = not any(p.startswith((".", "_")) for p in own.split("/"))
        if f.type == fs.FileType.File and shown and own.count("/") <= rest.count("/") and fnmatch.fnmatch(own, rest):
            out[f"{base.rstrip('/')}/{own}"] = f.size
    return out


def whole_lines(path: str, start: int, size: int) -> int:
    """Where the last ended line of the bytes from ``start`` to ``size`` ends."""
    system, name = _open(path)
    with system.open_input_file(name) as f:
        end = size
        while end > start:
            at = max(start, end - LOOK)
            f.seek(at)
            found = f.read(end - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            end = at
    return start


class Lines(InputPartition):
    def __init__(self, topic: str, path: str, low: int, high: int, stop: int, base: int):
        super().__init__((topic, path, low, high, stop, base))
        self.topic, self.path, self.low, self.high, self.stop, self.base = topic, path, low, high, stop, base


class TailReader(DataSourceStreamReader):
    def __init__(self, globs: dict[str, str]):
        self.globs = globs
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": {}, "total": 0}

    def latestOffset(self) -> dict:
        """Sizes as whole lines go; the total is not known here, but follows from a batch's start."""
        files = {}
        for topic, glob in self.globs.items():
            for path, size in listed(glob).items():
                before = self.known.get(path, 0)
                start = before if before <= size else 0
                files[f"{topic}\n{path}"] = self.known[path] = whole_lines(path, start, size) if size > start else size
        return {"files": files}

    def ranges(self, start: dict, end: dict) -> list[tuple[str, str, int, int]]:
        out = []
        for name in sorted(end["files"]):
            topic, path = name.split("\n", 1)
            low, high = start["files"].get(name, 0), end["files"][name]
            if high != low:
                out.append((topic, path, low if high > low else 0, high))
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts, base = [], sum(start["files"].values())
        for topic, path, low, high in self.ranges(start, end):
            for at in range(low, high, RANGE):
                parts.append(Lines(topic, path, at, min(at + RANGE, high), high, base + at - low if at > low else base))
            base += high - low
        return parts

    def read(self, partition: Lines) -> Iterator[tuple]:
        system, name = _open(partition.path)
        with system.open_input_file(name) as f:
            at = partition.low
            if at:  # a line that began before belongs to the range before
                f.seek(at - 1)
                skipped = b""
                while not skipped.endswith(b"\n") and at - 1 + len(skipped) < partition.stop:
                    skipped += f.read(min(LOOK, partition.stop - (at - 1 + len(skipped))))
                    cut = skipped.find(b"\n")
                    if cut >= 0:
                        skipped = skipped[: cut + 1]
                at = at - 1 + len(skipped)
            f.seek(at)
            rest = b""
            while at < partition.high:
                more = f.read(min(LOOK, partition.stop - at - len(rest)))
                rest += more
                *lines, rest = rest.split(b"\n")
                for line in lines:
                    if at >= partition.high:
                        return
                    yield (partition.base + at - partition.low, line.removesuffix(b"\r").decode("utf-8", "replace"), partition.topic, None)
                    at += len(line) + 1
                if not more:
                    return

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evospark_tail"

    def schema(self) -> str:
        return "event_id bigint, raw string, topic string, broker_ts bigint"

    def streamReader(self, schema) -> TailReader:
        return TailReader(json.loads(self.options["globs"]))

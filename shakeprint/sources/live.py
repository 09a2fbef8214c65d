"""Captures that are still being written, as a stream: format("live_capture"), with offsets of bytes and frames a file.

A micro-batch ends at the last record that is all there, so a record comes once, and before its file ends. A file is known by its
first bytes, so one that is renamed when a new one takes its place (rotation) goes on where it was.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyarrow import fs

from ..functions.wire import Malformed
from ..ship import as_code
from .capture import BYTES_A_BATCH, ROWS_A_BATCH, SCHEMA, batch_of
from .scan import Scanner, State, place_of

NAME = "live_capture"
#: A file is known by its first bytes: as many as it had when it was first seen, from LEAST to HEAD. Shorter ones wait.
LEAST, HEAD = 28, 512
#: Bytes of a file that one micro-batch takes at most (and one record more), and that one task reads.
BATCH_BYTES, TASK_BYTES = 256 << 20, 64 << 20


@dataclass
class Slice(InputPartition):
    path: str
    capture: str
    begin: int
    stop: int
    frame: int
    state: str


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:24]


class LiveReader(DataSourceStreamReader):
    """Offsets: of each file `capture`, the name it had first; `path`, where it was last; `byte`, a boundary; `frame`, the
    packets before it; `state`, what a reader has to know there."""

    def __init__(self, options: dict):
        self.directory, self.glob = options["path"], options.get("glob", "*")
        self.batch_bytes, self.task_bytes = int(options.get("batchBytes", BATCH_BYTES)), int(options.get("taskBytes", TASK_BYTES))
        self.at: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _files(self) -> dict[str, tuple[bytes, int]]:
        """The first bytes and the size of each capture file there is."""
        where, name = place_of(self.directory)
        infos = where.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
        out = {}
        for info in sorted(infos, key=lambda x: x.path):
            if info.type == fs.FileType.File and fnmatch(info.base_name, self.glob) and info.size >= LEAST:
                with where.open_input_file(info.path) as f:
                    out[info.path] = f.read(HEAD), info.size
        return out

    def _paths(self, known: dict[str, dict], files: dict[str, tuple[bytes, int]]) -> dict[str, str]:
        """Where each known file is now: where it was, or else under another name that isn't taken."""

        def fits(key: str, path: str) -> bool:
            head, size = files[path]
            n, digest = key.split(".")[:2]
            return size >= known[key]["byte"] and len(head) >= int(n) and _digest(head[: int(n)]) == digest

        out = {key: p["path"] for key, p in known.items() if p["path"] in files and fits(key, p["path"])}
        for key in known:
            if key not in out and (path := next((p for p in files if p not in out.values() and fits(key, p)), None)):
                out[key] = path
        return out

    def _walk(self, path: str, size: int, at: dict | None, most: int) -> dict | None:
        """The place of the last boundary up to `most` bytes behind `at`; None for what is no capture (yet)."""
        where, name = place_of(path)
        with where.open_input_file(name) as f:
            try:
                s = Scanner(f, size, at["byte"], State.of_text(at["state"]), whole=True) if at else Scanner(f, size, whole=True)
            except (Malformed, EOFError):
                return None
            for _ in s.frames(s.at + most, payloads=False):
                pass
            return {"byte": s.at, "frame": (at["frame"] if at else 0) + s.count, "state": s.state.as_text()}

    def _remember(self, offset: dict) -> None:
        for key, place in offset["files"].items():
            if place["byte"] > self.at.get(key, {"byte": -1})["byte"]:
                self.at[key] = place

    def latestOffset(self) -> dict:
        """Headers of what is new are walked over here, and no payload is read."""
        out, files = dict(self.at), self._files()
        paths = self._paths(out, files)
        taken = {p["capture"] for p in out.values()}
        for path in [p for p in files if p not in paths.values()]:
            head = files[path][0]
            key = f"{len(head)}.{_digest(head)}.{_digest(path.encode())}"
            paths[f"{key}.{len(out)}" if key in out else key] = path
        for key, path in paths.items():
            place = out.get(key)
            if place and place["byte"] >= files[path][1]:
                continue
            # After a restart nothing is known of a file: it is walked over up to its end, once.
            found = self._walk(path, files[path][1], place, self.batch_bytes)
            if found:
                name = place["capture"] if place else path if path not in taken else f"{path}#{key.split('.')[1][:8]}"
                taken.add(name)
                out[key] = {"capture": name, "path": path, **found}
        self.at = out
        return {"files": out}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self._remember(end)
        files = self._files()
        paths = {key: (path, files[path][1]) for key, path in self._paths(end["files"], files).items()}
        out = []
        for key, stop in end["files"].items():
            begin = start["files"].get(key)
            if begin and begin["byte"] == stop["byte"]:
                continue
            if key not in paths:
                raise FileNotFoundError(f"{stop['capture']} went before it was read")
            path, size = paths[key]
            at = begin or self._walk(path, size, None, 0)
            while at["byte"] < stop["byte"]:
                left = stop["byte"] - at["byte"]
                after = stop if left <= self.task_bytes else self._walk(path, size, at, self.task_bytes)
                out.append(Slice(path, stop["capture"], at["byte"], after["byte"], at["frame"], at["state"]))
                at = after
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        where, name = place_of(partition.path)
        with where.open_input_file(name) as f:
            s = Scanner(f, partition.stop, partition.begin, State.of_text(partition.state), whole=True)
            rows, held = [], 0
            for n, (ts, link, payload) in enumerate(s.frames(partition.stop), partition.frame + 1):
                rows.append((partition.capture, n, ts, link, payload))
                held += len(payload)
                if len(rows) >= ROWS_A_BATCH or held >= BYTES_A_BATCH:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    def commit(self, end: dict) -> None:
        self._remember(end)


class LiveCaptures(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LiveReader:
        return LiveReader(self.options)


def live_captures(spark: SparkSession, directory: str, glob: str = "*", batch_bytes: int = BATCH_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Packets of a directory's captures (see `capture` for the columns) as they are written. `frame` counts from 1 in each file; what
    a file ends in the middle of waits for its rest. The directory is one that the driver and all executors can open."""
    with as_code():
        spark.dataSource.register(LiveCaptures)
    reader = spark.readStream.format(NAME).option("glob", glob).option("batchBytes", batch_bytes).option("taskBytes", task_bytes)
    return reader.load(directory)

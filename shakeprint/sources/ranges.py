"""Captures of any size, cut into ranges of bytes: a file is many tasks' work, and no task holds a file.

First each range is walked over from a guessed record, by its headers only. The guesses are then compared with where the
records before them end; what doesn't fit is walked again from the right place. At last each range is read from a known
record, with a known frame number. The driver holds a row a range, as it does for the splits of any file.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import capture
from .scan import Scanner, State, guess, place_of, splittable

RANGE_BYTES = 64 << 20
WALKED = "id long, part int, begin long, stop long, count long, ended boolean, before string, after string"


@dataclass
class Walk:
    """A range walked over: from `begin` in state `before` to `stop`, the first boundary behind it, in state `after`."""

    begin: int | None
    stop: int
    count: int
    ended: bool
    before: str
    after: str


def cuts(size: int, range_bytes: int) -> list[tuple[int, int]]:
    return [(a, min(a + range_bytes, size)) for a in range(0, size, range_bytes)]


def first_state(path: str, size: int) -> tuple[int, State]:
    where, name = place_of(path)
    with where.open_input_file(name) as f:
        s = Scanner(f, size)
        return size if s.ended else s.at, s.state


def walk(path: str, size: int, parts: list[tuple[int, int]], begin: int | None, state: str | None, known: dict[int, int]) -> list[Walk]:
    """The ranges `parts`, one after another: from begin in a state, or from a guess. It stops early at a boundary that
    `known` (range's start to its guess) has, too."""
    where, name = place_of(path)
    out = []
    with where.open_input_file(name) as f:
        head = Scanner(f, size)
        if begin is None and parts[0][0] == 0:
            begin = head.at
        at, now = begin if begin is not None else guess(f, size, *parts[0], head.state), State.of_text(state) if state else head.state
        if at is None:
            return [Walk(None, parts[0][1], 0, False, "", "")]
        s = Scanner(f, size, at, now)
        s.ended = head.ended
        for a, b in parts:
            if out and known.get(a) == s.at:
                break
            began, before, count = s.at, s.state, s.count
            for _ in s.frames(b, payloads=False):
                pass
            out.append(Walk(began, s.at, s.count - count, s.ended, before.as_text(), s.state.as_text()))
            if s.ended:
                break
    return out


def tasks(spark: SparkSession, work: list, run, schema: str) -> DataFrame:
    """A task for each item of a list; run(item) gives record batches."""
    shared = spark.sparkContext.broadcast(work)

    def each(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from run(k, shared.value[k])

    return spark.range(0, len(work), 1, max(len(work), 1)).mapInArrow(each, schema)


def _walks(spark: SparkSession, work: list) -> dict[tuple[int, int], Walk]:
    """work: (file, first range, path, size, parts, begin, state, known) to (file, range): Walk."""
    kinds = pa.schema([("id", pa.int64()), ("part", pa.int32()), ("begin", pa.int64()), ("stop", pa.int64()), ("count", pa.int64()), ("ended", pa.bool_()), ("before", pa.string()), ("after", pa.string())])

    def run(k, item):
        rows = [(k, j, w.begin, w.stop, w.count, w.ended, w.before, w.after) for j, w in enumerate(walk(*item[2:]))]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    found = tasks(spark, work, run, WALKED).collect()
    return {(work[r.id][0], work[r.id][1] + r.part): Walk(*r[2:]) for r in found}


def plan(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> list[tuple[str, int, int, int, int, str]]:
    """(path, size, begin, stop, first frame, state) of ranges that follow one another without a gap or an overlap."""
    parts = [cuts(size, range_bytes) for _, size in files]
    many = [k for k, p in enumerate(parts) if len(p) > 1]
    found = _walks(spark, [(k, j, *files[k], [part], None, None, {}) for k in many for j, part in enumerate(parts[k])]) if many else {}
    out, again = [], True
    while again:
        out, again = [], []
        for k, (path, size) in enumerate(files):
            if not size:
                continue
            if k not in many:
                out.append((path, size, 0, size, 1, ""))
                continue
            at, state = found[k, 0].begin, found[k, 0].before
            number = 1
            for j, (_, end) in enumerate(parts[k]):
                if at >= end:
                    continue
                w = found.get((k, j))
                if w is None or w.begin != at or w.before.split(" ")[1] != state.split(" ")[1]:
                    known = {a: found[k, i].begin for i, (a, _) in enumerate(parts[k]) if i > j and (k, i) in found and found[k, i].begin is not None}
                    again.append((k, j, path, size, parts[k][j:], at, state, known))
                    break
                out.append((path, size, w.begin, w.stop, number, state))
                number, at = number + w.count, w.stop
                # A range that began from a guess knows the link types that it met only.
                before, after, now = State.of_text(w.before), State.of_text(w.after), State.of_text(state)
                if before.links != now.links and after.links[: len(before.links)] == before.links and after.order == before.order:
                    state = State(after.form, after.order, after.ticks, now.links + after.links[len(before.links) :], after.second).as_text()
                else:
                    state = w.after
                if w.ended:
                    break
        if again:
            found |= _walks(spark, again)
    return out


def frames_of(path: str, size: int, begin: int, stop: int, number: int, state: str):
    """Record batches of the packets whose records begin in [begin, stop)."""
    where, name = place_of(path)
    with where.open_input_file(name) as f:
        s = Scanner(f, size, begin, State.of_text(state)) if state else Scanner(f, size)
        rows, held = [], 0
        for n, (ts, link, payload) in enumerate(s.frames(stop), number):
            rows.append((path, n, ts, link, payload))
            held += len(payload)
            if len(rows) >= capture.ROWS_A_BATCH or held >= capture.BYTES_A_BATCH:
                yield capture.batch_of(rows)
                rows, held = [], 0
        if rows:
            yield capture.batch_of(rows)


def grouped(ranges: list, range_bytes: int) -> list[list]:
    """Ranges one after another as lists of about range_bytes, so that small files share a task."""
    out, held = [], range_bytes
    for r in ranges:
        if held + r[3] - r[2] > range_bytes:
            out.append([])
            held = 0
        out[-1].append(r)
        held += r[3] - r[2]
    return out


def read_ranges(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Packets of capture files (path, size), whose paths all executors can open."""

    def run(_, item):
        for r in item:
            yield from frames_of(*r)

    return tasks(spark, grouped(plan(spark, files, range_bytes), range_bytes), run, capture.SCHEMA)


def read_captures(spark: SparkSession, path: str | list[str], glob: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Packets of capture files; other formats are an error of the task that meets one. Spark lists the files. Those that
    tasks can open are cut into ranges; those in a store that only Spark reads (viewfs, say) are a task each, up to 2 GB."""
    reader = spark.read.format("binaryFile")
    listed = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length").orderBy("path").collect()
    near = [(r.path, r.length) for r in listed if splittable(r.path)]
    far = [r.path for r in listed if not splittable(r.path)]
    found = read_ranges(spark, near, range_bytes)
    return found.unionByName(capture.read_whole(spark, far)) if far else found

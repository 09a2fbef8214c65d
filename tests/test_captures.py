"""Captures in byte ranges against one pass over the whole file, and captures that grow."""

import random
import struct

import pytest

from shakeprint.sources import capture, live, ranges, scan

RECORD = struct.pack("<4I", 1000, 0, 40, 40) + bytes(40)


def payloads(seed, n=400):
    """Frames of all sizes; some hold what looks like records or blocks."""
    rng = random.Random(seed)
    fakes = [RECORD * 12, capture.record_bytes("pcapng", b"x" * 40, 5) * 12, bytes(700), capture.HEADS["pcapng"] * 3]
    return [rng.choice(fakes) if rng.random() < 0.3 else rng.randbytes(rng.randrange(0, 900)) for _ in range(n)]


def files(tmp_path):
    out = {}
    for k, form in enumerate(("pcap", "pcapng")):
        head, body = capture.HEADS[form], b"".join(capture.record_bytes(form, p, 1000 + i) for i, p in enumerate(payloads(k)))
        out[f"plain.{form}"] = head + body
        out[f"cut.{form}"] = (head + body)[:-7]
        out[f"none.{form}"] = head
        out[f"short.{form}"] = head[:23]
    # Sections and interfaces of several kinds, a bad length, and one frame across many ranges.
    other = capture._block(capture.INTERFACE, struct.pack("<HHI", 101, 0, 65535))
    section = b"".join(capture.record_bytes("pcapng", p, 1) for p in payloads(7, 150))
    second = b"".join(capture._block(capture.ENHANCED, struct.pack("<5I", 1, 0, 9, len(p), len(p)) + p) for p in payloads(8, 150))
    out["sections.pcapng"] = capture.HEADS["pcapng"] + section + other + second + capture._block(capture.SIMPLE, struct.pack("<I", 5) + b"abcdefgh") + capture.HEADS["pcapng"] + section
    out["bad.pcapng"] = out["sections.pcapng"][:50_000] + struct.pack("<2I", 6, 5) + out["sections.pcapng"]
    out["big.pcap"] = capture.pcap_bytes([b"a" * 10, RECORD * 4000, b"b" * 10, bytes(60_000), b"c"], 1000)
    out["swapped.pcap"] = struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 113) + b"".join(struct.pack(">4I", 1000, 999_999_999, len(p), len(p)) + p for p in payloads(9, 100))
    out["zeros.pcap"] = capture.HEADS["pcap"] + bytes(16) * 3000 + RECORD * 50
    for name, data in out.items():
        (tmp_path / name).write_bytes(data)
    return out


@pytest.mark.parametrize("size", [4096, 20_000, 1 << 26])
def test_ranges_equal_one_pass(spark, tmp_path, size):
    made = files(tmp_path)
    got = {}
    for r in ranges.read_captures(spark, str(tmp_path), range_bytes=size).collect():
        got.setdefault(r.capture.rsplit("/", 1)[1], []).append((r.frame, r.link_type, bytes(r.payload)))
    for name, data in made.items():
        want = [(k, link, payload) for k, (_, link, payload) in enumerate(capture.frames(data), 1)]
        assert sorted(got.get(name, [])) == want, name
    whole = {(r.capture, r.frame, r.ts) for r in capture.read_whole(spark, str(tmp_path)).collect()}
    assert {(r.capture, r.frame, r.ts) for r in ranges.read_captures(spark, str(tmp_path), range_bytes=size).collect()} == whole


def test_plan_covers_a_file_once(spark, tmp_path):
    made = files(tmp_path)
    found = ranges.plan(spark, [(str(tmp_path / n), len(d)) for n, d in sorted(made.items())], 8192)
    at = {}
    for path, _, begin, stop, first, _ in found:
        assert begin == at.get(path, (begin, first))[0] and first == at.get(path, (begin, first))[1] and stop > begin
        at[path] = stop, first + sum(b.num_rows for b in ranges.frames_of(path, *next(x[1:] for x in found if x[0] == path and x[2] == begin)))
    assert sum(path.endswith("plain.pcap") for path, *_ in found) > 5


def test_a_task_holds_a_buffer_only(tmp_path):
    """A sparse file of 3 GB: a guess at its end reads a few MB."""
    path = tmp_path / "large.pcap"
    with path.open("wb") as f:
        f.write(capture.HEADS["pcap"] + RECORD)
        f.truncate(3 << 30)
        f.seek(0, 2)
        f.write(RECORD * 1000)
    size = path.stat().st_size

    class Counting:
        def __init__(self, file):
            self.file, self.read_bytes = file, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            self.read_bytes += n
            return self.file.read(n)

    with path.open("rb") as f:
        counted = Counting(f)
        state = scan.Scanner(counted, size).state
        found = scan.guess(counted, size, (3 << 30) - 300, size, state)
        assert found is not None and counted.read_bytes < 4 * scan.READ
        s = scan.Scanner(counted, size, found, state)
        assert len(list(s.frames(size))) == 1000 and s.at == size


def test_unknown_formats(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(b"no capture at all" * 1000)
    with pytest.raises(Exception, match="unsupported capture format"):
        ranges.read_captures(spark, str(tmp_path), range_bytes=4096).collect()
    assert not scan.splittable("viewfs://store/in/a.pcap") and scan.splittable("file:///tmp/a") and scan.splittable("file:/tmp/a") and scan.splittable("/tmp/a")


@pytest.mark.parametrize("form", ["pcap", "pcapng"])
def test_live_captures(spark, tmp_path, form):
    """Written in odd pieces over several runs of one query, each from the checkpoint, with a rotation between."""
    folder, frames = tmp_path / "in", payloads(11, 120)
    folder.mkdir()
    first = capture.HEADS[form] + b"".join(capture.record_bytes(form, p, k) for k, p in enumerate(frames))
    second = capture.HEADS[form] + b"".join(capture.record_bytes(form, p, k) for k, p in enumerate(payloads(12, 60), 500))

    def run():
        stream = live.live_captures(spark, str(folder), f"*.{form}*", batch_bytes=8_000, task_bytes=3_000)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out"))
        query.trigger(availableNow=True).start().awaitTermination()
        rows = [(r.capture, r.frame, bytes(r.payload)) for r in spark.read.schema(capture.SCHEMA).parquet(str(tmp_path / "out")).collect()]
        assert len(rows) == len(set(rows))
        return len(rows)

    path = folder / f"a.{form}"
    path.write_bytes(first[:30])
    assert run() == 0
    path.write_bytes(first[: len(first) // 3 + 5])
    got = run()
    assert 0 < got < len(frames)  # before the file's end
    path.write_bytes(first[: len(first) // 2])
    assert run() > got
    # The file goes on under another name, and a new one has its old name.
    path.write_bytes(first[:-3])
    path.rename(folder / f"a.{form}.1")
    path.write_bytes(second[: len(second) // 2])
    run()
    (folder / f"a.{form}.1").write_bytes(first)
    path.write_bytes(second)
    while run() != (got := run()):
        pass
    rows = spark.read.schema(capture.SCHEMA).parquet(str(tmp_path / "out")).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r.capture, []).append((r.frame, bytes(r.payload)))
    want = sorted([[(k, p) for k, p in enumerate(frames, 1)], [(k, p) for k, p in enumerate(payloads(12, 60), 1)]], key=len)
    assert sorted((sorted(x) for x in by_file.values()), key=len) == want


@pytest.mark.parametrize("form", ["pcap", "pcapng"])
def test_captures_are_written_by_tasks(spark, tmp_path, form, monkeypatch):
    """Files whose records come from several partitions, and partitions with several files, without rows on the driver."""
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    payloads = {f: [bytes([f, k % 251]) * (k % 23) for k in range(n)] for f, n in ((1, 700), (2, 3), (3, 1500))}
    rows = [(str(f), k, p) for f, ps in payloads.items() for k, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "file string, frame int, payload binary").repartition(7)
    capture.write_captures(df, f"file://{tmp_path}/made", form)
    for f, ps in payloads.items():
        want = capture.pcap_bytes(ps) if form == "pcap" else capture.pcapng_bytes(ps)
        assert (tmp_path / "made" / f"{f}.{form}").read_bytes() == want

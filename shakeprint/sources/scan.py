"""Captures record by record: from any known boundary of an open file, and from a guess where no boundary is known.

A guess is never trusted: who uses one compares it with where the records before it end.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyarrow import fs

from ..functions.wire import Malformed
from .capture import ENHANCED, INTERFACE, MAGIC, SECTION, SECTION_HEADER, SIMPLE, when

#: Bytes read at once; how far a guess looks for a first record; how many records have to follow it.
READ, LOOK, CHAIN = 4 << 20, 1 << 20, 8
#: What a guess takes for a record: at most so many bytes, and so many seconds from the file's first one.
LONGEST, APART = 1 << 18, 10 * 366 * 86400
#: Block types a guess knows besides packets.
BLOCKS = (SECTION_HEADER, INTERFACE, SIMPLE, ENHANCED, 2, 4, 5, 9, 10, 0xBAD, 0x40000BAD)


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; ValueError for a scheme that only Spark knows."""
    if local := re.match(r"(?:file:/*)?(/.*)|file:/+(.*)", path):
        return fs.LocalFileSystem(), local[1] or "/" + local[2]
    return fs.FileSystem.from_uri(path)


def splittable(path: str) -> bool:
    try:
        place_of(path)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


@dataclass(frozen=True)
class State:
    """What has to be known at a boundary: the format, its byte order and ticks a second, the link types so far, and the
    first record's second."""

    form: str
    order: str
    ticks: int = 10**6
    links: tuple[int, ...] = ()
    second: int = 0

    def as_text(self) -> str:
        return f"{self.form} {self.order} {self.ticks} {self.second} {','.join(map(str, self.links))}"

    @staticmethod
    def of_text(text: str) -> State:
        form, order, ticks, second, links = text.split(" ")
        return State(form, order, int(ticks), tuple(int(x) for x in links.split(",") if x), int(second))


class Scanner:
    """Walks over the records of a file of `size` bytes. at: the next boundary. ended: no record follows, ever. With
    whole, a record that isn't all there yet is left for later; else it ends the file, or (pcap) is as long as it is."""

    def __init__(self, file, size: int, at: int = 0, state: State | None = None, whole: bool = False):
        self.file, self.size, self.at, self.whole, self.ended = file, size, at, whole, False
        self.base, self.held = 0, b""
        self.count = 0
        self.state = state or self._begin()

    def bytes_at(self, at: int, n: int) -> bytes:
        """Up to n bytes; fewer at the file's end."""
        if not self.base <= at <= at + n <= self.base + len(self.held):
            self.file.seek(at)
            self.base, self.held = at, self.file.read(max(min(n, self.size - at), min(READ, self.size - at), 0))
        return self.held[at - self.base : at - self.base + n]

    def _begin(self) -> State:
        head = self.bytes_at(0, 40)
        if len(head) < 4 and self.whole:
            raise EOFError
        if head[:4] == SECTION:
            return State("pcapng", "<")
        if head[:4] not in MAGIC:
            raise Malformed("unsupported capture format")
        order, ticks = MAGIC[head[:4]]
        if len(head) < 24:
            if self.whole:
                raise EOFError
            self.ended = True
            return State("pcap", order, ticks)
        self.at = 24
        second = struct.unpack_from(f"{order}I", head, 24)[0] if len(head) >= 28 else 0
        return State("pcap", order, ticks, struct.unpack_from(f"{order}I", head, 20), second)

    def frames(self, stop: int, payloads: bool = True) -> Iterator[tuple]:
        """(ts, link type, payload) of the packets whose records begin before stop; without payloads nothing is given, and
        only `count` tells how many there were."""
        step = self._classic if self.state.form == "pcap" else self._next_generation
        while not self.ended and self.at < stop:
            before = self.at
            found = step(payloads)
            if found:
                self.count += 1
                if payloads:
                    yield found
            if self.at == before:
                return

    def _classic(self, payloads: bool):
        head = self.bytes_at(self.at, 16)
        if len(head) < 16:
            self.ended = not self.whole
            return None
        seconds, part, n, _ = struct.unpack(f"{self.state.order}4I", head)
        end = self.at + 16 + n
        if end > self.size and self.whole:
            return None
        payload = self.bytes_at(self.at + 16, min(n, self.size - self.at - 16)) if payloads else b""
        self.at = end
        return when(seconds * self.state.ticks + part, self.state.ticks), self.state.links[0], payload

    def _next_generation(self, payloads: bool):
        head = self.bytes_at(self.at, 12)
        if len(head) < 12:
            self.ended = not self.whole
            return None
        kind, n = struct.unpack_from(f"{self.state.order}2I", head)
        if n < 12:
            self.ended = True
            return None
        if self.at + n > self.size:
            self.ended = not self.whole
            return None
        wanted = n - 12 if payloads or kind in (SECTION_HEADER, INTERFACE) else min(n - 12, 20)
        body, self.at = self.bytes_at(self.at + 8, wanted), self.at + n
        order, links = self.state.order, self.state.links
        if kind == SECTION_HEADER:
            order = order if len(body) < 4 else "<" if body[:4] == b"\x4d\x3c\x2b\x1a" else ">"
            self.state = replace(self.state, order=order, links=())
        elif kind == INTERFACE and len(body) >= 2:
            self.state = replace(self.state, links=(*links, struct.unpack_from(f"{order}H", body)[0]))
        elif kind == ENHANCED and len(body) >= 20:
            interface, high, low, size = struct.unpack_from(f"{order}4I", body)
            return when(high << 32 | low, 10**6), links[interface] if interface < len(links) else None, body[20 : 20 + size]
        elif kind == SIMPLE and len(body) >= 16:
            (size,) = struct.unpack_from(f"{order}I", body, 8)
            return None, links[0] if links else None, body[16 : 16 + size]
        return None


def guess(file, size: int, start: int, stop: int, state: State) -> int | None:
    """A place in [start, stop) from which CHAIN plausible records (or all up to the end) follow one another."""
    s = Scanner(file, size, start, state)
    window = s.bytes_at(start, min(LOOK, stop - start) + 16)
    n = min(len(window) - 15, stop - start)
    if n <= 0:
        return None
    raw = np.frombuffer(window, np.uint8)

    def words(k: int) -> np.ndarray:
        """The 32-bit number k bytes behind each place."""
        parts = [raw[k + j : k + j + n].astype(np.int64) for j in range(4)]
        return sum(p << 8 * (j if state.order == "<" else 3 - j) for j, p in enumerate(parts))

    if state.form == "pcap":
        length, at = words(8), np.arange(start, start + n)
        fine = (length > 0) & (length <= LONGEST) & (words(4) < state.ticks) & (abs(words(0) - state.second) <= APART) & (words(12) >= length) & (at + 16 + length <= size)
    else:
        length = words(4)
        fine = np.isin(words(0), BLOCKS) & (length % 4 == 0) & (length >= 12) & (length <= LONGEST)
    for k in np.flatnonzero(fine).tolist():
        if _follows(s, start + k):
            return start + k
    return None


def _follows(s: Scanner, at: int) -> bool:
    state = s.state
    for _ in range(CHAIN):
        if at == s.size:
            return True
        head = s.bytes_at(at, 16)
        if state.form == "pcap":
            if len(head) < 16:
                return False
            second, part, n, full = struct.unpack(f"{state.order}4I", head)
            if not 0 < n <= min(LONGEST, full) or part >= state.ticks or abs(second - state.second) > APART:
                return False
            at += 16 + n
        else:
            if len(head) < 12:
                return False
            kind, n = struct.unpack_from(f"{state.order}2I", head)
            if kind not in BLOCKS or n % 4 or not 12 <= n <= LONGEST or s.bytes_at(at + n - 4, 4) != head[4:8]:
                return False
            at += n
        if at > s.size:
            return False
    return True

"""Big-endian bytes: a bounds-checked reader for parsers, and column builders for making frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Malformed(ValueError):
    pass


class Reader:
    """Reads forward; what isn't there raises Malformed."""

    __slots__ = ("at", "data")

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        start, end = self.at, self.at + n
        if end > len(self.data):
            raise Malformed(f"{n} bytes wanted, {max(0, self.left)} left")
        self.at = end
        return self.data[start:end]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def vector(self, n: int) -> bytes:
        """Bytes behind their length of n bytes."""
        return self.take(self.number(n))

    def varint(self) -> int:
        """A QUIC integer: the two top bits give its size."""
        if self.left < 1:
            raise Malformed("no varint left")
        size = 1 << (self.data[self.at] >> 6)
        return self.number(size) & (1 << 8 * size - 2) - 1


def numbers(data: bytes, size: int = 2) -> list[int]:
    return [int.from_bytes(data[k : k + size], "big") for k in range(0, len(data) - size + 1, size)]


def grease(value: int) -> bool:
    high, low = divmod(value, 256)
    return high == low and low & 15 == 10


def dashed(values) -> str:
    return "-".join(map(str, values))


def plain(values) -> str:
    """Dashed, without reserved values."""
    return dashed(v for v in values if not grease(v))


# Columns


def unsigned(value: Column | int, size: int) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def u8(value) -> Column:
    return unsigned(value, 1)


def u16(value) -> Column:
    return unsigned(value, 2)


def u24(value) -> Column:
    return unsigned(value, 3)


def u32(value) -> Column:
    return unsigned(value, 4)


def raw(hexadecimal: str) -> Column:
    return F.unhex(F.lit(hexadecimal))


def text(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it's used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prefixed(data: Column, size: int) -> Column:
    return let(data, lambda x: F.concat(unsigned(F.octet_length(x), size), x))


def slice_at(data: Column, at: Column | int, n: Column | int) -> Column:
    """n bytes from 0-based position at."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.substring(data, at + 1, F.lit(n) if isinstance(n, int) else n)


def uint_at(hexed: Column, at: Column | int, size: int) -> Column:
    """The number in size bytes at 0-based position at of a column of hex digits; null if they aren't all there."""
    start = F.lit(2 * at + 1) if isinstance(at, int) else at * 2 + 1
    digits = F.substr(hexed, start, F.lit(2 * size))
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).cast("long"))

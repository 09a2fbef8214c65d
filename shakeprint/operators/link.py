"""Ethernet, IPv4 or IPv6, TCP or UDP: one projection of native columns over `packets`."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wire import raw, slice_at

TCP, UDP = 6, 17
#: The farthest that headers are read: Ethernet with a tag, IPv4 with all options, and 16 bytes of TCP.
_HEAD = 18 + 60 + 16


def word(data: Column, at: Column | int) -> Column:
    """Eight bytes at a 0-based position, which must be there, as a signed long."""
    return F.conv(F.hex(slice_at(data, at, 8)), 16, -10).cast("long")


def bits(value: Column, shift: int, size: int) -> Column:
    """size bits of a word, of which the lowest is bit `shift`."""
    return F.shiftrightunsigned(value, shift).bitwiseAND((1 << size) - 1)


def dotted(number: Column) -> Column:
    """IPv4 text of the low 32 bits of a number."""
    return F.concat_ws(".", *(bits(number, k, 8).cast("string") for k in (24, 16, 8, 0)))


def _zero_run(mask: int) -> tuple[int, int]:
    """Where the first of the longest runs of two or more zero groups begins and ends; bit k of the mask says that group
    k is zero. Without such a run it lies behind the last group."""
    runs = [(begin, end) for begin in range(8) for end in range(begin + 2, 9) if all(mask >> k & 1 for k in range(begin, end))]
    return max(runs, key=lambda r: (r[1] - r[0], -r[0]), default=(8, 8))


#: The runs of all masks, as 16 * begin + end.
_ZERO_RUNS = "array({})".format(", ".join(str(16 * begin + end) for begin, end in map(_zero_run, range(256))))


def groups(high: Column, low: Column) -> Column:
    """The eight groups of an IPv6 address, as two longs, none shortened."""
    numbers = F.array(*(bits(half, k, 16) for half in (high, low) for k in (48, 32, 16, 0)))
    return F.lower(F.array_join(F.transform(numbers, F.hex), ":"))


def zero_run(high: Column, low: Column) -> Column:
    """16 * begin + end of the run of zero groups that the address is shortened by."""
    zero = (F.when(bits(half, k, 16) == 0, bit).otherwise(0) for half, first in ((high, 1), (low, 16)) for k, bit in zip((48, 32, 16, 0), (first, 2 * first, 4 * first, 8 * first), strict=True))
    return F.get(F.expr(_ZERO_RUNS), reduce(add, zero))


def colons(high: Column, low: Column, whole: Column, run: Column) -> Column:
    """IPv6 text of two longs, their groups() and zero_run(): lower case, no leading zeros, the first of the longest runs of
    two or more zero groups as ::."""
    left, right = (F.call_function("substring_index", whole, F.lit(":"), n) for n in (F.shiftright(run, 4), run.bitwiseAND(15) - 8))
    mapped = (high == 0) & (F.shiftrightunsigned(low, 32) == 0xFFFF)
    return F.when(mapped, F.concat(F.lit("::ffff:"), dotted(low))).when(run == 8 * 16 + 8, whole).otherwise(F.concat(left, F.lit("::"), right))


def decode(packets: DataFrame) -> DataFrame:
    """packets (frame, payload, any others) to one row per TCP segment or non-empty UDP datagram:

    transport (6 or 17), src, dst, sport, dport, body, flags, window, ttl, ip_version, ip_len, ip_df, ip_id,
    tcp_options. One VLAN tag is passed over; fragments, IPv6 extension headers and link types are not looked at.
    Frames of anything else, or too short for their headers, give no row.
    """
    kept = [c for c in packets.columns if c != "payload"]
    p = F.col("payload")
    # Every step is a projection; one generator gives or drops the row. Filters in between would be pushed below the steps
    # and compute them again. The generator is explode(), and what it gives are numbers, since Spark interprets the
    # expressions of other generators; texts and bytes are made behind it, for the rows that are left.
    df = packets.select(*kept, "payload", F.octet_length("payload").alias("_size"))
    # Bytes beyond the end of a frame are read as zeros.
    df = df.withColumn("_head", F.when(F.col("_size") < _HEAD, F.concat(p, raw("00" * _HEAD))).otherwise(p))
    head = F.col("_head")
    tagged = (slice_at(head, 12, 2) == raw("8100")) & (F.col("_size") >= 18)
    df = df.withColumn("_ip", F.when(tagged, 18).otherwise(14))
    ip = F.col("_ip")
    df = df.withColumn("_type", slice_at(head, ip - 2, 2))
    v4 = F.col("_type") == raw("0800")
    # Headers are read as words of eight bytes, whose fields are shifts and masks.
    df = df.withColumns({"_a": word(head, ip), "_b": word(head, ip + 8), "_c": word(head, ip + 16)})
    wa, wb = F.col("_a"), F.col("_b")
    df = df.withColumns({
        "_proto": F.when(v4, bits(wb, 48, 8)).otherwise(bits(wa, 8, 8)).cast("int"),
        "_at": ip + F.when(v4, bits(wa, 56, 4) * 4).otherwise(40).cast("int"),
        "_len": F.when(v4, bits(wa, 32, 16)).otherwise(bits(wa, 16, 16) + 40).cast("int"),
    })
    tcp, at = F.col("_proto") == TCP, F.col("_at")
    df = df.withColumns({"_t": word(head, at), "_u": word(head, at + 8)})
    wt, wu = F.col("_t"), F.col("_u")
    # The transport's bytes end where the IP length says, or where the frame does.
    df = df.withColumns({
        "_n": F.least("_size", ip + F.col("_len")) - at,
        "_off": F.when(tcp, bits(wu, 28, 4).cast("int") * 4).otherwise(8),
        "_udp": bits(wt, 16, 16).cast("int"),
    })
    n, off = F.col("_n"), F.col("_off")
    header = F.when(tcp, 20).otherwise(8)
    framed = (F.col("_size") >= 14) & (v4 | (F.col("_type") == raw("86DD"))) & F.col("_proto").isin(TCP, UDP) & (F.col("_size") >= F.greatest(at + header, ip + F.when(v4, 20).otherwise(40)))
    whole = F.when(tcp, (off >= 20) & (n >= off)).otherwise((F.col("_udp") >= 8) & (F.least("_udp", n) > 8))
    ok = F.coalesce(framed & (n >= header) & whole, F.lit(False))
    numbers = F.struct(
        F.col("_proto").alias("transport"), v4.alias("v4"), "_a", "_b", "_c", "_t", "_u", "_at", "_len", "_off",
        *(F.when(~v4, word(head, ip + k)).alias(name) for name, k in (("_d", 24), ("_e", 32))),
        F.when(tcp, n).otherwise(F.least("_udp", n)).alias("_n"),
    )
    df = df.select(*kept, "payload", F.explode(F.when(ok, F.array(numbers))).alias("_g"))
    g = {name: F.col(f"_g.{name}") for name in ("transport", "v4", "_a", "_b", "_c", "_d", "_e", "_t", "_u", "_at", "_len", "_off", "_n")}
    v4, tcp, wa, wb, wc, wt, wu, at, off = (g[name] for name in ("v4", "transport", "_a", "_b", "_c", "_t", "_u", "_at", "_off"))
    tcp = tcp == TCP
    sides = {"src": (g["_b"], g["_c"]), "dst": (g["_d"], g["_e"])}
    df = df.withColumns({f"_{name}_{step.__name__}": F.when(~v4, step(*words)) for name, words in sides.items() for step in (groups, zero_run)})
    source, target = (colons(*words, F.col(f"_{name}_groups"), F.col(f"_{name}_zero_run")) for name, words in sides.items())
    return df.select(
        *kept,
        g["transport"].alias("transport"),
        F.when(v4, dotted(wb)).otherwise(source).alias("src"),
        F.when(v4, dotted(F.shiftrightunsigned(wc, 32))).otherwise(target).alias("dst"),
        bits(wt, 48, 16).cast("int").alias("sport"),
        bits(wt, 32, 16).cast("int").alias("dport"),
        slice_at(p, at + off, g["_n"] - off).alias("body"),
        F.when(tcp, bits(wu, 16, 8)).cast("int").alias("flags"),
        F.when(tcp, bits(wu, 0, 16)).cast("int").alias("window"),
        F.when(v4, bits(wb, 56, 8)).otherwise(bits(wa, 0, 8)).cast("int").alias("ttl"),
        F.when(v4, 4).otherwise(6).alias("ip_version"),
        g["_len"].alias("ip_len"),
        (v4 & (wa.bitwiseAND(0x4000) != 0)).alias("ip_df"),
        F.when(v4, bits(wa, 16, 16)).otherwise(0).cast("int").alias("ip_id"),
        F.when(tcp, slice_at(p, at + 20, off - 20)).alias("tcp_options"),
    )


def tcp_segments(packets: DataFrame) -> DataFrame:
    return decode(packets).where(F.col("transport") == TCP).drop("transport")


def udp_datagrams(packets: DataFrame) -> DataFrame:
    return decode(packets).where(F.col("transport") == UDP).select(*(c for c in packets.columns if c != "payload"), "src", "dst", "sport", "dport", "body")

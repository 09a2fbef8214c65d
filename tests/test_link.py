"""Decoding of frames: its texts, that Spark compiles it, and that parsers run once."""

import ipaddress

from pyspark.sql import functions as F

from shakeprint.operators.link import decode
from shakeprint.plans.extract import one_pass

#: A TCP segment to port 22 with two bytes.
TCP = bytes.fromhex("0400001600000001000000005018faf0000000000102")


def frame6(src: bytes, dst: bytes, segment: bytes = TCP, tag: str = "") -> bytes:
    return bytes(12) + bytes.fromhex(f"{tag}86dd60000000") + len(segment).to_bytes(2, "big") + bytes([6, 64]) + src + dst + segment


def packets(spark, frames: list[bytes | None]):
    return spark.createDataFrame(list(enumerate(frames)), "frame int, payload binary")


def test_every_pattern_of_zero_groups(spark):
    """Addresses are shortened as the standard library does it, whichever of their groups are zero."""
    mixed = [b"".join(bytes(2) if mask >> k & 1 else (k * 0x0F0F % 0x1000 + 1).to_bytes(2, "big") for k in range(8)) for mask in range(256)]
    mapped = [bytes(10) + b"\xff\xff" + bytes([10, 0, k, 255]) for k in range(3)] + [bytes(8) + b"\0\1\xff\xff\1\2\3\4", bytes(11) + b"\xff\0\0\0\1"]
    addresses = mixed + mapped
    rows = decode(packets(spark, [frame6(a, b, tag="81000001" if k % 2 else "") for k, (a, b) in enumerate(zip(addresses, reversed(addresses), strict=True))])).collect()
    text = lambda a: str(ipaddress.IPv6Address(a))
    assert {r.frame: (r.src, r.dst, r.body) for r in rows} == {k: (text(a), text(b), b"\1\2") for k, (a, b) in enumerate(zip(addresses, reversed(addresses), strict=True))}


def test_every_length_of_a_frame(spark):
    """A frame cut anywhere gives no row until its headers are there, and then what is there of its body."""
    long = TCP[:12] + bytes([0xF0]) + TCP[13:20] + bytes(40) + bytes(40)
    for whole, header, options in ((frame6(bytes(16), bytes(16)), 74, 0), (frame6(bytes(16), bytes(16), long, "81000001"), 118, 40)):
        rows = decode(packets(spark, [*(whole[:n] for n in range(len(whole) + 1)), None])).select("frame", "body", "tcp_options").collect()
        assert {r.frame: bytes(r.body) for r in rows} == {n: whole[header:n] for n in range(header, len(whole) + 1)}
        assert {len(r.tcp_options) for r in rows} == {options}


def test_decoding_is_compiled(spark):
    """No step is interpreted by Spark, nor left by the JVM as too long a method (8,000 bytes)."""
    plan = decode(packets(spark, [None])).where(F.col("transport") == 6)._jdf.queryExecution().executedPlan()
    generates = [line for line in plan.toString().split("\n") if "Generate explode" in line or "Generate inline" in line]
    assert generates and all("*(" in line.split("Generate")[0] for line in generates)
    stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    assert 0 < max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000


def test_parsers_run_once(spark):
    """Packets that tell nothing are dropped behind the parsers, which no filter repeats below."""
    told, mute = frame6(bytes(16), bytes(16), TCP[:20] + b"SSH-2.0-x\r\n"), frame6(bytes(16), bytes(16))
    df = one_pass(packets(spark, [told, mute, told]).withColumn("capture", F.lit("c")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert sum("ArrowEvalPython" in line and "tcp_options(" in line for line in plan.split("\n")) == 1
    assert [(r.frame, bytes(r.body), r.found) for r in df.orderBy("frame").collect()] == [(k, b"SSH-2.0-x\r\n", []) for k in (0, 2)]

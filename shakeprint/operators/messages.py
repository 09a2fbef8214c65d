"""Parsers as Arrow column functions, each with a native guard that keeps hopeless payloads out of Python."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.wire import Malformed
from . import ike, rdp, ssh, tls

FOUND = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("protocol", "role", "features")]))
_KIND = pa.list_(pa.struct([("protocol", pa.string()), ("role", pa.string()), ("features", pa.string())]))
_NAMES = ("protocol", "role", "features")


def tls_of(body: bytes) -> list[tuple[str, str, str]]:
    try:
        return tls.tls_messages(body)
    except Malformed:
        return []


def rdp_of(body: bytes) -> list[tuple[str, str, str]]:
    return [("rdp", *x) for x in rdp.x224(body)]


def dtls_of(body: bytes) -> list[tuple[str, str, str]]:
    found = tls.dtls_hello(body)
    return [("dtls", *found)] if found else []


def ike_of(body: bytes) -> list[tuple[str, str, str]]:
    found = ike.message(body)
    return [("ike", *found)] if found else []


def ssh_of(body: bytes) -> list[tuple[str, str, str]]:
    found = ssh.inline(body)
    return [("ssh", *found)] if found else []


def _column(*parsers: Callable[[bytes], list[tuple[str, str, str]]]):
    """An Arrow function from payloads to what the parsers find in each, in their order; nulls find nothing."""

    def run(bodies: pa.Array) -> pa.Array:
        found = ([x for p in parsers for x in p(b)] if b is not None else [] for b in bodies.to_pylist())
        return pa.array([[dict(zip(_NAMES, x, strict=True)) for x in xs] for xs in found], _KIND)

    run.__annotations__ = {"bodies": pa.Array, "return": pa.Array}
    return arrow_udf(run, FOUND)


tcp_messages = _column(tls_of, rdp_of)
tls_messages = _column(tls_of)
rdp_messages = _column(rdp_of)
dtls_messages = _column(dtls_of)
ike_messages = _column(ike_of)
ssh_messages = _column(ssh_of)


@arrow_udf(T.StringType())
def ssh_software(bodies: pa.Array) -> pa.Array:
    return pa.array([None if b is None or not (f := ssh.banner(b)) else f[0] for b in bodies.to_pylist()], pa.string())


@arrow_udf(T.StringType())
def ssh_lists(bodies: pa.Array) -> pa.Array:
    """The key exchange lists of a payload, behind its identification line if it has one."""
    return pa.array([None if b is None else ssh.kexinit(f[1] if (f := ssh.banner(b)) else b) for b in bodies.to_pylist()], pa.string())


def byte(body: Column, at: int, size: int = 1) -> Column:
    return F.conv(F.hex(F.substring(body, at + 1, size)), 16, 10).cast("long")


def maybe_tls(body: Column) -> Column:
    """The first record is whole; of any other payload the parser gives nothing."""
    return (F.octet_length(body) >= 5) & (byte(body, 3, 2) + 5 <= F.octet_length(body))


def maybe_rdp(body: Column) -> Column:
    return (F.octet_length(body) >= 11) & (F.substring(body, 1, 2) == F.unhex(F.lit("0300")))


def maybe_dtls(body: Column) -> Column:
    return (F.octet_length(body) >= 25) & byte(body, 0).between(20, 26) & (byte(body, 1) == 0xFE)


def maybe_ike(sport: Column, dport: Column, body: Column) -> Column:
    return (sport.isin(*ike.PORTS) | dport.isin(*ike.PORTS)) & (F.octet_length(body) >= 28)


def is_banner(body: Column) -> Column:
    return (F.substring(body, 1, 4) == F.unhex(F.lit("5353482D"))) & F.contains(F.hex(body), F.lit("0A"))


def maybe_kexinit(body: Column) -> Column:
    return (F.octet_length(body) >= 22) & (byte(body, 5) == ssh.KEXINIT) & (byte(body, 0, 4) + 4 <= F.octet_length(body))

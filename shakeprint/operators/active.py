"""Probe answers: the active variants of the parsers, and the choice of the first answer of each target.

Answers come as a table probe_responses (host, port, protocol, probe, probe_rank, response, flow); sending is left to
the tool that records them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.features import fingerprint_columns
from ..functions.wire import Malformed, Reader, dashed, numbers
from . import ike, rdp, ssh, tls

RESPONSES = "host string, port int, protocol string, probe string, probe_rank int, response binary, flow struct<src:string,sport:int,dst:string,dport:int>"
#: Ports that are probed without force.
PORTS = {"tls": (443, 465, 636, 853, 993, 995, 8443, 9443), "dtls": (443, 465, 636, 853, 993, 995, 8443, 9443), "ssh": (22,), "rdp": (3389,), "ike": (500, 4500)}
SSL2_SERVER_HELLO, HELLO_VERIFY = 4, 3


def tls_server(response: bytes) -> str | None:
    """The first ServerHello in the records; anything malformed before it is none."""
    r = Reader(response)
    try:
        while r.left >= 5:
            kind = r.number(1)
            r.take(2)
            record = Reader(r.vector(2))
            while kind == tls.HANDSHAKE and record.left >= 4:
                message, body = record.number(1), record.vector(3)
                if message == tls.SERVER_HELLO:
                    return tls.server_hello(body)
    except Malformed:
        return None
    return None


def ssl2_server(response: bytes) -> str | None:
    """An SSLv2 server's offer: its 24-bit cipher codes."""
    if len(response) < 2:
        return None
    long = response[0] & 0x80
    head = 2 if long else 3
    size = int.from_bytes(response[:2], "big") & (0x7FFF if long else 0x3FFF)
    r = Reader(response[head : head + size])
    try:
        if r.number(1) != SSL2_SERVER_HELLO:
            return None
        r.take(4)  # session hit, certificate type, version
        certificate, ciphers, _ = (r.number(2) for _ in range(3))
        r.take(certificate)
        return f"tls|server|v=2|c={dashed(numbers(r.take(ciphers), 3))}|e=|sv="
    except Malformed:
        return None


def dtls_server(response: bytes) -> tuple[str | None, bytes | None]:
    """(features, cookie): a ServerHello, or the cookie that a HelloVerifyRequest asks to repeat."""
    try:
        for message, body in tls.dtls_fragments(response):
            if message == HELLO_VERIFY:
                return None, Reader(body, 2).vector(1)
            if message == tls.SERVER_HELLO:
                return tls.server_hello(body, "dtls"), None
    except Malformed:
        pass
    return None, None


def ssh_server(response: bytes) -> str | None:
    """The identification line may be the twentieth at the latest."""
    rest = response
    for _ in range(20):
        if found := ssh.banner(rest):
            software, after = found
            return ssh.features(software, ssh.kexinit(after) or ssh.BANNER_ONLY)
        line, newline, rest = rest.partition(b"\n")
        if not newline:
            return None
    return None


def rdp_server(response: bytes) -> str | None:
    found = rdp.x224(response, most=1)
    return found[0][1] if found and found[0][0] == "server" else None


def ike_responder(response: bytes) -> str | None:
    found = ike.message(response, active=True)
    return found[1] if found else None


READERS = {"tls": tls_server, "dtls": lambda b: dtls_server(b)[0], "ssh": ssh_server, "rdp": rdp_server, "ike": ike_responder}
ROLES = {"tls": "server", "dtls": "server", "ssh": "peer", "rdp": "server", "ike": "responder"}


@arrow_udf(T.StringType())
def answer_features(protocol: pa.Array, probe: pa.Array, response: pa.Array) -> pa.Array:
    out = []
    for kind, how, data in zip(protocol.to_pylist(), probe.to_pylist(), response.to_pylist(), strict=True):
        reader = ssl2_server if how == "SSLv2" else READERS.get(kind)
        out.append(reader(data) if reader and data is not None else None)
    return pa.array(out, pa.string())


@arrow_udf(T.BinaryType())
def dtls_cookie(response: pa.Array) -> pa.Array:
    return pa.array([None if b is None else dtls_server(b)[1] for b in response.to_pylist()], pa.binary())


def probed_by_default(protocol: Column, port: Column) -> Column:
    out = F.lit(False)
    for kind, ports in PORTS.items():
        out = F.when(protocol == kind, port.isin(*ports)).otherwise(out)
    return out


def active(responses: DataFrame, force: bool = False) -> DataFrame:
    """One observation (mode active) per target and protocol: of the answers that can be read the one of the earliest
    probe. force: ports that aren't probed by default count, too."""
    rows = responses if force else responses.where(probed_by_default(F.col("protocol"), F.col("port")))
    rows = rows.withColumn("features", answer_features("protocol", "probe", "response")).where("features is not null")
    first = Window.partitionBy("host", "port", "protocol").orderBy("probe_rank")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    role = F.lit("")
    for kind, name in ROLES.items():
        role = F.when(F.col("protocol") == kind, name).otherwise(role)
    out = fingerprint_columns(rows.withColumn("role", role), "active")
    return out.select("host", "port", "probe", "mode", "protocol", "role", "fingerprint", "features", "sha256", "flow")

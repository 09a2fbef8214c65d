"""TLS and DTLS handshakes: records to canonical feature strings."""

from __future__ import annotations

from collections.abc import Iterator

from ..functions.wire import Malformed, Reader, dashed, numbers, plain
from .x509 import certificate_chain

HANDSHAKE, CLIENT_HELLO, SERVER_HELLO, CERTIFICATE = 22, 1, 2, 11
GROUPS, POINTS, SIGNATURES, ALPN, VERSIONS = 10, 11, 13, 16, 43
#: Of each extension that is shown: where its list starts, and how the bytes from there are read.
SHOWN = {
    GROUPS: (2, lambda d: plain(numbers(d))),
    POINTS: (1, dashed),
    SIGNATURES: (2, lambda d: plain(numbers(d))),
    VERSIONS: (1, lambda d: plain(numbers(d))),
    ALPN: (2, lambda d: ",".join(_names(d))),
}


def _names(data: bytes) -> Iterator[str]:
    at = 0
    while at < len(data):
        yield data[at + 1 : at + 1 + data[at]].decode("ascii", "replace")
        at += 1 + data[at]


def extensions(r: Reader) -> list[tuple[int, bytes]]:
    """(type, data) in order; the last one's data may be shorter than it says."""
    if r.left < 1:
        return []
    block, out = r.vector(2), []
    at = 0
    while at + 4 <= len(block):
        kind, size = numbers(block[at : at + 4])
        out.append((kind, block[at + 4 : at + 4 + size]))
        at += 4 + size
    return out


def client_hello(body: bytes, protocol: str = "tls") -> str:
    r = Reader(body)
    version = r.number(2)
    r.take(32)
    r.vector(1)  # session
    if protocol == "dtls":
        r.vector(1)  # cookie
    ciphers = r.vector(2)
    r.vector(1)  # compression
    found = extensions(r)
    shown = dict.fromkeys(SHOWN, "")
    for kind, data in found:
        if kind in SHOWN and len(data) >= SHOWN[kind][0]:
            start, read = SHOWN[kind]
            shown[kind] = read(data[start:])
    return (
        f"{protocol}|client|v={version}|c={plain(numbers(ciphers))}|e={plain(k for k, _ in found)}|g={shown[GROUPS]}"
        f"|p={shown[POINTS]}|sv={shown[VERSIONS]}|alpn={shown[ALPN]}|sig={shown[SIGNATURES]}"
    )


def server_hello(body: bytes, protocol: str = "tls") -> str:
    r = Reader(body)
    version = r.number(2)
    r.take(32)
    r.vector(1)
    cipher = r.number(2)
    r.at += 1  # compression, which may be missing
    found = extensions(r)
    selected = [str(int.from_bytes(d, "big")) for k, d in found if k == VERSIONS and len(d) == 2]
    return f"{protocol}|server|v={version}|c={cipher}|e={plain(k for k, _ in found)}|sv={selected[-1] if selected else ''}"


def tls_messages(payload: bytes) -> list[tuple[str, str, str]]:
    """(protocol, role, features) of a segment's records; of each record the first message counts. A record or message
    that the segment cuts off, or a hello that can't be read, is Malformed and voids the segment."""
    out, r = [], Reader(payload)
    while r.left >= 5:
        kind = r.number(1)
        r.take(2)
        record = Reader(r.vector(2))
        if kind != HANDSHAKE or record.left < 4:
            continue
        message, body = record.number(1), record.vector(3)
        if message == CLIENT_HELLO:
            out.append(("tls", "client", client_hello(body)))
        elif message == SERVER_HELLO:
            out.append(("tls", "server", server_hello(body)))
        elif message == CERTIFICATE:
            out += [("x509", "server", f) for f in certificate_chain(body)]
    return out


def stream_hellos(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(role, body) of the complete hellos of a handshake stream."""
    r = Reader(data)
    try:
        while r.left >= 4:
            message, body = r.number(1), r.vector(3)
            if message in (CLIENT_HELLO, SERVER_HELLO):
                yield ("client" if message == CLIENT_HELLO else "server"), body
    except Malformed:
        return


def dtls_fragments(payload: bytes) -> Iterator[tuple[int, bytes]]:
    """(message type, body) of the unfragmented handshake messages of a datagram, as far as its records are whole."""
    r = Reader(payload)
    while r.left >= 13:
        kind, major = r.number(1), r.number(1)
        if not 20 <= kind <= 26 or major != 0xFE:
            return
        r.take(9)
        record = Reader(r.vector(2))
        while kind == HANDSHAKE and record.left >= 12:
            message, size = record.number(1), record.number(3)
            record.take(2)
            offset, body = record.number(3), record.vector(3)
            if offset == 0 and len(body) == size:
                yield message, body


def dtls_hello(payload: bytes, strict: bool = False) -> tuple[str, str] | None:
    """(role, features) of the datagram's first hello; with strict what is malformed raises."""
    try:
        for message, body in dtls_fragments(payload):
            if message == CLIENT_HELLO:
                return "client", client_hello(body, "dtls")
            if message == SERVER_HELLO:
                return "server", server_hello(body, "dtls")
    except Malformed:
        if strict:
            raise
    return None

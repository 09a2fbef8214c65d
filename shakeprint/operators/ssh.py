"""SSH identification lines and key exchange messages."""

from __future__ import annotations

from ..functions.wire import Malformed, Reader

KEXINIT = 20
LISTS = ("kex", "hostkey", "enc_c2s", "enc_s2c", "mac_c2s", "mac_s2c", "comp_c2s", "comp_s2c", "lang_c2s", "lang_s2c")
BANNER_ONLY = "|".join(f"{n}=" for n in (*LISTS, "follows"))


def banner(payload: bytes) -> tuple[str, bytes] | None:
    """(software, what follows the line); the software is what stands behind the second hyphen, or the whole line."""
    if payload[:4] != b"SSH-" or b"\n" not in payload:
        return None
    line, _, rest = payload.partition(b"\n")
    ident = line.rstrip(b"\r").decode("utf-8", "replace")
    parts = ident.split("-", 2)
    return (parts[2] if len(parts) == 3 else ident), rest


def kexinit(payload: bytes) -> str | None:
    """The name lists and the follows flag of a packet that holds a key exchange message whole."""
    try:
        packet = Reader(Reader(payload).vector(4))
        if packet.left < 2:
            return None
        pad = packet.number(1)
        if pad >= len(packet.data):
            return None
        r = Reader(packet.data[1 : len(packet.data) - pad])
        if r.number(1) != KEXINIT:
            return None
        r.at = 17
        lists = [r.vector(4).decode("ascii", "replace") for _ in LISTS]
    except Malformed:
        return None
    follows = str(bool(r.number(1))) if r.left else ""
    return "|".join(f"{n}={v}" for n, v in zip((*LISTS, "follows"), (*lists, follows), strict=True))


def features(software: str, rest: str = BANNER_ONLY) -> str:
    return f"ssh|peer|id={software}|{rest}"


def inline(payload: bytes) -> tuple[str, str] | None:
    """(role, features) of a payload that begins with an identification line."""
    found = banner(payload)
    return ("peer", features(found[0], kexinit(found[1]) or BANNER_ONLY)) if found else None

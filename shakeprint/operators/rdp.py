"""RDP connection requests and confirmations in X.224 over TPKT."""

from __future__ import annotations

from ..functions.wire import Malformed

REQUEST, CONFIRM = 0xE0, 0xD0


def negotiation(unit: bytes) -> tuple[int, int, int, int] | None:
    """(type, flags, length, value), little-endian, from the first byte after the header that may start one."""
    for at in range(11, len(unit) - 7):
        kind, size = unit[at], int.from_bytes(unit[at + 2 : at + 4], "little")
        if kind in (1, 2) and 8 <= size <= len(unit) - at:
            return kind, unit[at + 1], size, int.from_bytes(unit[at + 4 : at + 8], "little")
    return None


def features(unit: bytes) -> tuple[str, str] | None:
    if len(unit) < 11 or unit[5] not in (REQUEST, CONFIRM):
        return None
    role = "client" if unit[5] == REQUEST else "server"
    found = negotiation(unit)
    kind, flags, size, value = found or ("", "", "", "")
    fields = {
        "tpkt_v": unit[0], "tpkt_rsv": unit[1], "tpkt_len": len(unit), "x224_len": unit[4], "pdu": unit[5], "dst_ref": int.from_bytes(unit[6:8], "big"),
        "src_ref": int.from_bytes(unit[8:10], "big"), "class": unit[10], "neg_type": kind, "neg_flags": flags, "neg_len": size,
        "neg_proto": value if kind == 1 else "", "neg_selected": value if kind == 2 else "",
    }
    return role, f"rdp|{role}|" + "|".join(f"{k}={v}" for k, v in fields.items())


def x224(payload: bytes, strict: bool = False, most: int | None = None) -> list[tuple[str, str]]:
    """(role, features) of each request or confirmation; what isn't whole ends the payload, or raises with strict."""
    out, at = [], 0
    while at + 7 <= len(payload) and payload[at : at + 2] == b"\x03\x00" and (most is None or len(out) < most):
        size = int.from_bytes(payload[at + 2 : at + 4], "big")
        if size < 7 or at + size > len(payload):
            if strict:
                raise Malformed("TPKT length")
            break
        if found := features(payload[at : at + size]):
            out.append(found)
        at += size
    return out

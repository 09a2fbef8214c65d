"""Frames made from table columns with native expressions: traffic for tests, queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.wire import let, prefixed, raw, text, u8, u16, u24, u32


def join_bytes(*parts: Column) -> Column:
    return F.concat(*parts)


def ethernet(packet: Column, kind: int = 0x0800, vlan: Column | None = None) -> Column:
    head = raw("020000000001020000000002")
    tag = F.concat(raw("8100"), u16(vlan)) if vlan is not None else None
    return F.concat(head, *([tag] if tag is not None else []), u16(kind), packet)


def address4(number: Column) -> Column:
    """10.x.y.z of a number."""
    return F.concat(raw("0A"), u24(F.pmod(number, F.lit(1 << 24))))


def address4_text(number: str) -> str:
    """The same as SQL text."""
    return f"'10.' || ((({number}) // 65536) % 256) || '.' || ((({number}) // 256) % 256) || '.' || (({number}) % 256)"


def ipv4(body: Column, protocol: int, src: Column, dst: Column, ttl: Column | int = 64, ident: Column | int = 0, df: Column | int = 1, pad: Column | None = None) -> Column:
    flags = F.lit(df) * 0x4000 if isinstance(df, int) else df.cast("int") * 0x4000
    out = let(body, lambda x: F.concat(raw("4500"), u16(F.octet_length(x) + 20), u16(ident), u16(flags), u8(ttl), u8(protocol), raw("0000"), src, dst, x))
    return F.concat(out, pad) if pad is not None else out


def ipv6(body: Column, protocol: int, src: Column, dst: Column, hops: Column | int = 64) -> Column:
    return let(body, lambda x: F.concat(raw("60000000"), u16(F.octet_length(x)), u8(protocol), u8(hops), src, dst, x))


def tcp(body: Column, sport: Column | int, dport: Column | int, flags: Column | int = 0x18, window: Column | int = 64240, options: Column | None = None) -> Column:
    options = options if options is not None else raw("")
    head = lambda o: F.concat(u8(F.floor((F.octet_length(o) + 20) / 4) * 16), u8(flags), u16(window), raw("00000000"), o)
    return F.concat(u16(sport), u16(dport), raw("0000000100000000"), let(options, head), body)


def udp(body: Column, sport: Column | int, dport: Column | int, length: Column | None = None) -> Column:
    rest = lambda x: F.concat(u16(length if length is not None else F.octet_length(x) + 8), raw("0000"), x)
    return F.concat(u16(sport), u16(dport), let(body, rest))


def tcp4(body: Column, src: Column, dst: Column, sport, dport, **kw) -> Column:
    return ethernet(ipv4(tcp(body, sport, dport, **kw), 6, address4(src), address4(dst)))


def udp4(body: Column, src: Column, dst: Column, sport, dport) -> Column:
    return ethernet(ipv4(udp(body, sport, dport), 17, address4(src), address4(dst)))


# TLS


def u16s(*values: Column | int) -> Column:
    return F.concat(*(u16(v) for v in values))


def extension(kind: Column | int, data: Column) -> Column:
    return F.concat(u16(kind), prefixed(data, 2))


def hello_client(version: Column | int, ciphers: Column, extensions: Column | None, cookie: Column | None = None) -> Column:
    parts = [u16(version), F.unhex(F.repeat(F.lit("AB"), 32)), u8(0), *([prefixed(cookie, 1)] if cookie is not None else []), prefixed(ciphers, 2), raw("0100")]
    return F.concat(*parts, *([prefixed(extensions, 2)] if extensions is not None else []))


def hello_server(version: Column | int, cipher: Column | int, extensions: Column | None) -> Column:
    return F.concat(u16(version), F.unhex(F.repeat(F.lit("CD"), 32)), u8(0), u16(cipher), raw("00"), *([prefixed(extensions, 2)] if extensions is not None else []))


def handshake(kind: int, body: Column) -> Column:
    return F.concat(u8(kind), prefixed(body, 3))


def record(body: Column, kind: int = 22, version: int = 0x0301) -> Column:
    return F.concat(u8(kind), u16(version), prefixed(body, 2))


def dtls_record(kind: int, body: Column, version: int = 0xFEFD, offset: int = 0, whole: Column | None = None) -> Column:
    def message_of(x: Column) -> Column:
        size = F.octet_length(x)
        return F.concat(u8(kind), u24(whole if whole is not None else size), raw("0000"), u24(offset), u24(size), x)

    message = let(body, message_of)
    return F.concat(u8(22), u16(version), raw("0000000000000000"), prefixed(message, 2))


# DER


def der(tag: int, value: Column) -> Column:
    def with_length(x: Column) -> Column:
        n = F.octet_length(x)
        size = F.when(n < 128, u8(n)).when(n < 256, F.concat(raw("81"), u8(n))).otherwise(F.concat(raw("82"), u16(n)))
        return F.concat(u8(tag), size, x)

    return let(value, with_length)


def sequence(*parts: Column) -> Column:
    return der(0x30, F.concat(*parts))


def oid(hexadecimal: str) -> Column:
    return der(0x06, raw(hexadecimal))


def distinguished(*pairs: tuple[str, Column]) -> Column:
    return sequence(*(der(0x31, sequence(oid(k), der(0x0C, text(v)))) for k, v in pairs))


def certificate(serial: Column, issuer: Column, subject: Column, begins: Column, ends: Column, key: Column, extensions: Column | None) -> Column:
    """begins, ends: UTCTime text."""
    signature = sequence(oid("2A864886F70D01010B"), raw("0500"))
    validity = sequence(der(0x17, text(begins)), der(0x17, text(ends)))
    spki = sequence(sequence(oid("2A8648CE3D0201"), oid("2A8648CE3D030107")), der(0x03, F.concat(raw("00"), key)))
    more = [der(0xA3, sequence(extensions))] if extensions is not None else []
    tbs = sequence(der(0xA0, raw("020102")), der(0x02, serial), signature, issuer, validity, subject, spki, *more)
    return sequence(tbs, signature, der(0x03, raw("00AABB")))


def certificate_extension(kind: str, value: Column, critical: bool = False) -> Column:
    return sequence(oid(kind), *([raw("0101FF")] if critical else []), der(0x04, value))


# Others


def tpkt(pdu: int, dst: Column | int, src: Column | int, rest: Column) -> Column:
    x224 = F.concat(u8(pdu), u16(dst), u16(src), raw("00"), rest)
    return let(x224, lambda x: F.concat(raw("0300"), u16(F.octet_length(x) + 5), u8(F.octet_length(x)), x))


def little(value: Column | int, size: int) -> Column:
    return F.concat(*(F.substring(u32(value), 4 - k, 1) for k in range(size)))


def negotiation(kind: int, flags: Column | int, value: Column | int) -> Column:
    return F.concat(u8(kind), u8(flags), raw("0800"), little(value, 4))


def ssh_banner(software: Column) -> Column:
    return F.concat(text(F.concat(F.lit("SSH-2.0-"), software)), raw("0D0A"))


def ssh_kexinit(lists: list[Column], follows: Column | int = 0, pad: int = 6) -> Column:
    body = F.concat(raw("14"), F.unhex(F.repeat(F.lit("11"), 16)), *(prefixed(text(x), 4) for x in lists), u8(follows), raw("00000000"))
    return prefixed(F.concat(u8(pad), body, F.unhex(F.repeat(F.lit("00"), pad))), 4)


def ike_payload(following: int, body: Column) -> Column:
    return let(body, lambda x: F.concat(u8(following), raw("00"), u16(F.octet_length(x) + 4), x))


def ike_message(first: int, payloads: Column, flags: Column | int = 8, exchange: int = 34, version: int = 0x20) -> Column:
    return F.concat(F.unhex(F.repeat(F.lit("5A"), 16)), u8(first), u8(version), u8(exchange), u8(flags), raw("00000000"), let(payloads, lambda x: F.concat(u32(F.octet_length(x) + 28), x)))


def ike_transform(last: bool, kind: int, ident: Column | int, key_bits: Column | int | None = None) -> Column:
    attribute = F.concat(raw("800E"), u16(key_bits)) if key_bits is not None else raw("")
    return F.concat(u8(0 if last else 3), raw("00"), u16(F.octet_length(attribute) + 8), u8(kind), raw("00"), u16(ident), attribute)


def ike_proposal(last: bool, number: Column | int, protocol: Column | int, transforms: list[Column]) -> Column:
    body = F.concat(*transforms)
    return let(body, lambda x: F.concat(u8(0 if last else 2), raw("00"), u16(F.octet_length(x) + 8), u8(number), u8(protocol), raw("00"), u8(len(transforms)), x))


def varint2(value: Column) -> Column:
    return u16(value + 0x4000)


def quic_header(version: int, dcid: Column, scid: Column, token: Column, payload_size: Column, number_size: int) -> Column:
    return F.concat(u8(0xC0 + number_size - 1), u32(version), prefixed(dcid, 1), prefixed(scid, 1), prefixed(token, 1), varint2(payload_size))

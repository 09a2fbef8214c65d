"""The functions under SQL names: expressions that Catalyst inlines, and table functions of the parsers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import messages, quic
from .features import simhash128

_B64 = "translate(base64(encode(f, 'UTF-8')), '+/=\\r\\n', '-_')"
INLINE = {
    "fan_sha256(f STRING)": ("STRING", "sha2(f, 256)"),
    "fan_base64url(f STRING)": ("STRING", _B64),
    "fan_fingerprint(protocol STRING, role STRING, mode STRING, f STRING)": ("STRING", f"concat_ws(':', 'fan1', protocol, role, mode, {_B64}, 'sha256', sha2(f, 256))"),
    "is_grease(v BIGINT)": ("BOOLEAN", "(v & 3855) = 2570 AND (v div 256) = (v & 255)"),
    "hamming128(a STRING, b STRING)": ("INT", "bit_count(cast(conv(substring(a, 1, 16), 16, -10) AS BIGINT) ^ cast(conv(substring(b, 1, 16), 16, -10) AS BIGINT)) + bit_count(cast(conv(substring(a, 17, 16), 16, -10) AS BIGINT) ^ cast(conv(substring(b, 17, 16), 16, -10) AS BIGINT))"),
    "ttl_bucket(t INT)": ("INT", "CASE WHEN t <= 32 THEN 32 WHEN t <= 64 THEN 64 WHEN t <= 128 THEN 128 WHEN t <= 255 THEN 255 ELSE t END"),
}
_FOUND = "protocol: string, role: string, features: string"


def _table_function(parse: Callable[[bytes], list[tuple[str, str, str]]]):
    class Parser:
        def eval(self, payload: bytes) -> Iterator[tuple]:
            if payload is not None:
                yield from parse(bytes(payload))

    return udtf(Parser, returnType=_FOUND)


def _quic_rows(payload: bytes) -> list[tuple[str, str, str]]:
    return [("quic", "peer", f"quic|peer|v={p['version']}|type=initial|dcid_len={len(p['dcid'])}|scid_len={p['scid_len']}|token_len={p['token_len']}|len={p['length']}") for p in quic.long_packets(payload)]


PARSERS = {"parse_tls": messages.tls_of, "parse_dtls": messages.dtls_of, "parse_rdp": messages.rdp_of, "parse_ike": messages.ike_of, "parse_ssh": messages.ssh_of, "parse_quic": _quic_rows}


def register(spark: SparkSession) -> None:
    for signature, (returns, body) in INLINE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")
    spark.udf.register("fan_simhash128", simhash128)
    for name, parse in PARSERS.items():
        spark.udtf.register(name, _table_function(parse))

"""Columns of fingerprints: list rendering, digests, encodings, and the similarity hash."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

SIMHASH_BITS = 128


def is_grease(value: Column) -> Column:
    """The sixteen reserved values 0x0A0A, 0x1A1A ... 0xFAFA."""
    return (value.bitwiseAND(0x0F0F) == 0x0A0A) & (F.shiftright(value, 8) == value.bitwiseAND(0xFF))


def join_values(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), "-")


def join_ints(values: Column) -> Column:
    return join_values(F.filter(values, lambda x: ~is_grease(x)))


def u16_list(data: Column) -> Column:
    """Big-endian pairs of bytes as array<int>; an odd last byte is left out."""
    h = F.hex(data)
    pairs = F.floor(F.octet_length(data) / 2).cast("int")
    at = F.when(pairs > 0, F.sequence(F.lit(0), pairs - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.conv(F.substr(h, k * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def ttl_bucket(ttl: Column) -> Column:
    out = ttl
    for top in (255, 128, 64, 32):
        out = F.when(ttl <= top, F.lit(top)).otherwise(out)
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def base64url(text: Column) -> Column:
    """Without padding, and without the line breaks that base64() may insert."""
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/=\r\n", "-_")


def from_base64url(text: Column) -> Column:
    pad = F.pmod(-F.length(text), F.lit(4)).cast("int")
    return F.decode(F.unbase64(F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), pad))), "UTF-8")


@lru_cache(maxsize=100_000)
def _votes(token: str) -> np.ndarray:
    """+1 or -1 for each of the 128 bits of a token's hash, the highest first."""
    raw = np.frombuffer(hashlib.sha256(token.encode()).digest()[:16], np.uint8)
    return np.unpackbits(raw).astype(np.int32) * 2 - 1


def simhash_of(features: str) -> str:
    """Ties and majorities of ones give 1. Tokens lie between | , - and =; without any the whole text is the token."""
    tokens = [t for t in features.translate(_SEPARATORS).split("=") if t] or [features]
    return np.packbits(sum(map(_votes, tokens)) >= 0).tobytes().hex()


_SEPARATORS = str.maketrans("|,-", "===")


@arrow_udf(T.StringType())
def simhash128(features: pa.Array) -> pa.Array:
    distinct = features.dictionary_encode()
    hashes = pa.array([None if f is None else simhash_of(f) for f in distinct.dictionary.to_pylist()], pa.string())
    return hashes.take(distinct.indices)


def simhash_halves(simhash: Column) -> tuple[Column, Column]:
    """The hash as two signed longs, the higher bits first."""
    return tuple(F.conv(F.substring(simhash, a, 16), 16, -10).cast("long") for a in (1, 17))


def hamming(left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    return F.bit_count(left[0].bitwiseXOR(right[0])) + F.bit_count(left[1].bitwiseXOR(right[1]))


def checked_simhash(value: Column) -> Column:
    """Lower case without 0x; an error unless it is text of 32 hexadecimal digits."""
    bare = F.regexp_replace(F.lower(value), "^0x", "")
    return (
        F.when(value.isNull(), F.raise_error(F.lit("simhash128 field is missing or is not a string")).cast("string"))
        .when(~bare.rlike("^[0-9a-f]{32}$"), F.raise_error(F.lit("simhash128 must be exactly 32 hexadecimal characters")).cast("string"))
        .otherwise(bare)
    )


def fingerprint_columns(df: DataFrame, mode: str = "passive") -> DataFrame:
    """Adds mode, sha256, fingerprint, and for passive rows simhash128 and fingerprint_simhash128, to rows that have
    protocol, role and features."""
    df = df.withColumns({"mode": F.lit(mode), "sha256": sha256(F.col("features"))})
    head = F.concat_ws(":", F.lit("fan1"), "protocol", "role", "mode", base64url(F.col("features")))
    df = df.withColumn("fingerprint", F.concat_ws(":", head, F.lit("sha256"), "sha256"))
    if mode == "active":
        return df
    df = df.withColumn("simhash128", simhash128("features"))
    return df.withColumn("fingerprint_simhash128", F.concat_ws(":", head, F.lit("simhash128"), "simhash128"))


def parse_fingerprint(fingerprint: Column) -> Column:
    """struct(protocol, role, mode, features, algorithm, digest); null unless it has the grammar's seven parts."""
    part = F.split(fingerprint, ":")
    fields = F.struct(part[1].alias("protocol"), part[2].alias("role"), part[3].alias("mode"), from_base64url(part[4]).alias("features"), part[5].alias("algorithm"), part[6].alias("digest"))
    return F.when((F.size(part) == 7) & (part[0] == "fan1"), fields)


def feature_map(features: Column) -> Column:
    """The k=v parts of a feature string; a key that repeats keeps its last value."""
    pairs = F.filter(F.split(features, r"\|"), lambda p: F.contains(p, F.lit("=")))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v"))))

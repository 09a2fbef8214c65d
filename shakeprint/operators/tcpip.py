"""TCP/IP stack signatures of SYN segments."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.features import ttl_bucket

SYN, FIN, RST, ACK = 0x02, 0x01, 0x04, 0x10
OPTIONS = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n in ("tokens", "quirks") else T.StringType()) for n in ("tokens", "mss", "ws", "sack", "ts", "quirks")])
#: Kinds of option with a name and the length of their data; those of any length have None.
NAMES = {2: ("mss", 2), 3: ("ws", 1), 4: ("sackok", 0), 5: ("sack", None), 8: ("ts", 8), 34: ("tfo", None)}


def read_options(options: bytes) -> dict:
    tokens, quirks, value, at = [], set(), dict.fromkeys(("mss", "ws", "ts"), ""), 0
    sack = "0"
    while at < len(options):
        kind = options[at]
        if kind == 0:
            tokens.append("eol")
            if options[at + 1 :].strip(b"\0"):
                quirks.add("nz-eol-pad")
            break
        if kind == 1:
            tokens.append("nop")
            at += 1
            continue
        size = options[at + 1] if at + 1 < len(options) else None
        if size is None or size < 2 or at + size > len(options):
            tokens.append(f"bad{kind}")
            quirks.add("trunc-opt" if size is None else "bad-opt-len")
            break
        data = options[at + 2 : at + size]
        at += size
        name, length = NAMES.get(kind, (None, None))
        if name is None or length not in (None, len(data)):
            tokens.append(f"opt{kind}:{data.hex()}")
        elif name in ("mss", "ws"):
            value[name] = str(int.from_bytes(data, "big"))
            tokens.append(name + value[name])
        elif name == "sack":
            tokens.append(f"sack{len(data)}")
        else:
            tokens.append(name)
            if name == "sackok":
                sack = "1"
            elif name == "ts":
                value["ts"] = "nz" if any(data[:4]) else "zero"
                if any(data[4:]):
                    quirks.add("ts-echo-nz")
    return {"tokens": tokens, "sack": sack, "quirks": sorted(quirks), **value}


@arrow_udf(OPTIONS)
def tcp_options(options: pa.Array) -> pa.Array:
    distinct = options.dictionary_encode()
    kind = pa.struct([("tokens", pa.list_(pa.string())), ("mss", pa.string()), ("ws", pa.string()), ("sack", pa.string()), ("ts", pa.string()), ("quirks", pa.list_(pa.string()))])
    return pa.array([None if o is None else read_options(o) for o in distinct.dictionary.to_pylist()], kind).take(distinct.indices)


def is_syn(flags: Column) -> Column:
    return flags.bitwiseAND(SYN | RST | FIN) == SYN


def with_tcpip(df: DataFrame) -> DataFrame:
    """Adds the struct tcpip(role, features), null on rows that aren't SYN segments."""
    syn = F.coalesce(is_syn(F.col("flags")), F.lit(False))
    df = df.withColumn("_o", tcp_options(F.when(syn, F.col("tcp_options"))))
    role = F.when(F.col("flags").bitwiseAND(ACK) != 0, "server").otherwise("client")
    v4 = F.col("ip_version") == 4
    more = F.array(
        F.when(F.octet_length("body") > 0, "data-in-syn"),
        F.when(v4 & ~F.col("ip_df"), "no-df"),
        F.when(v4 & F.col("ip_df") & (F.col("ip_id") != 0), "df-nz-id"),
    )
    quirks = F.array_join(F.array_sort(F.array_union("_o.quirks", F.array_compact(more))), "-")
    parts = {
        "ip": "ip_version", "ttl": "ttl", "it": ttl_bucket(F.col("ttl")), "olen": F.octet_length("tcp_options"), "win": "window", "mss": "_o.mss", "ws": "_o.ws",
        "sack": "_o.sack", "ts": "_o.ts", "opts": F.array_join("_o.tokens", ","), "df": F.col("ip_df").cast("int"), "plen": F.octet_length("body"), "ql": quirks,
    }
    pieces = [F.concat(F.lit(f"{k}="), (F.col(v) if isinstance(v, str) else v).cast("string")) for k, v in parts.items()]
    found = F.struct(role.alias("role"), F.concat_ws("|", F.lit("tcpip2"), role, *pieces).alias("features"))
    return df.withColumn("tcpip", F.when(syn, found)).drop("_o")


def tcpip(segments: DataFrame) -> DataFrame:
    """The SYN segments with role and features."""
    return with_tcpip(segments.where(is_syn(F.col("flags")))).withColumns({"role": F.col("tcpip.role"), "features": F.col("tcpip.features")}).drop("tcpip")

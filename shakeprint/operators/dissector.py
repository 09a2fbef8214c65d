"""Fingerprints from dissected fields, frame by frame: the live profile, without mode, first sight or similarity hash.

Input is a table of dissected frames (capture, frame, stream, and of each field the array of its values in the frame).
It shows groups and signature schemes unfiltered, as its fields hold them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.features import base64url, join_ints, join_values, sha256
from .ssh import LISTS

_HELLO = ("hs_type", "version", "cipher", "ext_type", "groups", "points", "sv", "sig")
_IKE = ("mjver", "mnver", "exchtype", "flags", "nextpay", "prop_proto", "prop_ntrans", "tf_type", "encr", "prf", "integ", "dh", "esn", "klen", "ke_group", "notify")
_RDP = ("tpkt_version", "tpkt_reserved", "tpkt_length", "cotp_li", "cotp_type", "cotp_class", "destref", "srcref", "neg_type", "neg_len", "req_flags", "req_proto", "rsp_flags", "sel_proto")
_QUIC = ("version", "token_len", "dcil", "scil", "length")
INT_FIELDS = [*(f"{p}_{n}" for p in ("tls", "dtls") for n in _HELLO), "dtls_epoch", *(f"quic_{n}" for n in _QUIC), *(f"ike_{n}" for n in _IKE), *(f"rdp_{n}" for n in _RDP), "ssh_follows"]
TEXT_FIELDS = ["tls_alpn", "dtls_alpn", "ssh_protocol", *(f"ssh_{n}" for n in LISTS)]
SCHEMA = "capture string, frame int, stream string, " + ", ".join([*(f"{c} array<bigint>" for c in INT_FIELDS), *(f"{c} array<string>" for c in TEXT_FIELDS)])


def values(name: str) -> Column:
    kind = "string" if name in TEXT_FIELDS else "bigint"
    return F.coalesce(F.col(name), F.array().cast(f"array<{kind}>"))


def first(name: str, default: int | str = "") -> Column:
    return F.coalesce(F.get(values(name), F.lit(0)).cast("string"), F.lit(str(default)))


def fields(**parts: Column) -> list[Column]:
    return [F.concat(F.lit(f"{k}="), v) for k, v in parts.items()]


def hellos(prefix: str, head: list[Column], version_name: str = "v", protocol: str | None = None) -> Column:
    """One struct (role, features) per hello type in the frame."""
    p = protocol or prefix
    version = {version_name: first(f"{prefix}_version", 0)}
    client = F.concat_ws("|", F.lit(p), F.lit("client"), *head, *fields(
        **version, c=join_ints(values(f"{prefix}_cipher")), e=join_ints(values(f"{prefix}_ext_type")), g=join_values(values(f"{prefix}_groups")), p=join_values(values(f"{prefix}_points")),
        sv=join_ints(values(f"{prefix}_sv")), alpn=F.array_join(values(f"{prefix}_alpn"), ","), sig=join_values(values(f"{prefix}_sig")),
    ))
    server = F.concat_ws("|", F.lit(p), F.lit("server"), *head, *fields(**version, c=first(f"{prefix}_cipher"), e=join_ints(values(f"{prefix}_ext_type")), sv=first(f"{prefix}_sv")))
    shown = F.filter(values(f"{prefix}_hs_type"), lambda t: t.isin(1, 2))
    return F.transform(shown, lambda t: F.struct(F.lit(p).alias("protocol"), F.when(t == 1, "client").otherwise("server").alias("role"), F.when(t == 1, client).otherwise(server).alias("features")))


def _none() -> Column:
    return F.array().cast("array<struct<protocol:string,role:string,features:string>>")


def one(when: Column, protocol: str, role: Column, features: Column) -> Column:
    return F.when(when, F.array(F.struct(F.lit(protocol).alias("protocol"), role.alias("role"), features.alias("features")))).otherwise(_none())


def proposals_of(protocols: list[int], counts: list[int], kinds: list[int], ids: dict[int, list[int]], lengths: list[int]) -> str:
    """Transforms dealt to proposals by their counts; each kind of transform takes its ids, and ciphers their key
    lengths, in order."""
    kinds_left, lengths_left = iter(kinds), iter(lengths)
    queues = {k: iter(v) for k, v in ids.items()}
    out = []
    for n, protocol in enumerate(protocols):
        count = counts[n] if n < len(counts) and counts[n] > 0 else len(kinds) if n == 0 else 0
        shown = []
        for _ in range(count):
            if (kind := next(kinds_left, None)) is None:
                break
            bits = next(lengths_left, None) if kind == 1 else None
            shown.append(f"{kind}={next(queues.get(kind, iter(())), 0)}{'' if bits is None else f'.{bits}'}")
        out.append(f"{protocol}:{','.join(shown)}")
    return ";".join(out)


@arrow_udf(T.StringType())
def _proposals(protocols: pa.Array, counts: pa.Array, kinds: pa.Array, encr: pa.Array, prf: pa.Array, integ: pa.Array, dh: pa.Array, esn: pa.Array, lengths: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (protocols, counts, kinds, encr, prf, integ, dh, esn, lengths)), strict=True)
    return pa.array([proposals_of(p, c, k, dict(enumerate(ids, 1)), n) for p, c, k, *ids, n in rows], pa.string())


def stateless(frames: DataFrame) -> Column:
    has = lambda name: F.size(values(name)) > 0
    tls = F.when(has("quic_version") | has("dtls_epoch"), _none()).otherwise(hellos("tls", []))
    version = F.concat(F.lit("v="), first("quic_version"))
    inside = hellos("tls", [version], "tls_v", "quic")
    header = F.concat_ws("|", F.lit("quic|peer"), version, F.lit("type=initial"), *fields(dcid_len=first("quic_dcil", 0), scid_len=first("quic_scil", 0), token_len=first("quic_token_len", 0), len=first("quic_length", 0)))
    quic = F.when(~has("quic_version") | ~has("quic_token_len"), _none()).when(has("tls_hs_type"), inside).otherwise(one(F.lit(True), "quic", F.lit("peer"), header))
    dtls = F.when(has("dtls_epoch"), hellos("dtls", [])).otherwise(_none())
    responder = first("ike_flags", 0).cast("bigint").bitwiseAND(0x20) != 0
    ike_role = F.when(responder, "responder").otherwise("initiator")
    sa = _proposals(*(values(f"ike_{n}") for n in ("prop_proto", "prop_ntrans", "tf_type", "encr", "prf", "integ", "dh", "esn", "klen")))
    ike = F.concat_ws("|", F.lit("ike"), ike_role, *fields(
        v=F.concat(first("ike_mjver"), F.lit("."), first("ike_mnver", 0)), ex=first("ike_exchtype", 0), flags=first("ike_flags", 0), np=first("ike_nextpay", 0),
        p=join_values(F.filter(values("ike_nextpay"), lambda v: v != 0)), sa=sa, ke=first("ike_ke_group"), n=join_values(values("ike_notify")),
    ))
    kind = F.get(values("rdp_cotp_type"), F.lit(0))
    server = kind == 13
    cls = first("rdp_cotp_class", 0)
    only = lambda when, name: F.when(when, first(name)).otherwise(F.lit(""))
    rdp = F.concat_ws("|", F.lit("rdp"), F.when(server, "server").otherwise("client"), *fields(
        tpkt_v=first("rdp_tpkt_version", 0), tpkt_rsv=first("rdp_tpkt_reserved", 0), tpkt_len=first("rdp_tpkt_length", 0), x224_len=first("rdp_cotp_li", 0),
        pdu=(kind * 16 + cls.cast("bigint")).cast("string"), dst_ref=first("rdp_destref", 0), src_ref=first("rdp_srcref", 0), **{"class": cls}, neg_type=first("rdp_neg_type"),
        neg_flags=F.when(server, first("rdp_rsp_flags")).otherwise(first("rdp_req_flags")), neg_len=first("rdp_neg_len"), neg_proto=only(~server, "rdp_req_proto"), neg_selected=only(server, "rdp_sel_proto"),
    ))
    is_ike = F.coalesce(F.get(values("ike_mjver"), F.lit(0)) == 2, F.lit(False))
    is_rdp = F.coalesce(kind.isin(13, 14), F.lit(False))
    return F.concat(tls, quic, dtls, one(is_ike, "ike", ike_role, ike), one(is_rdp, "rdp", F.when(server, "server").otherwise("client"), rdp))


def ssh_line() -> Column:
    """The identification line's software, or the whole line; null for frames without one."""
    line = F.regexp_replace(F.get(values("ssh_protocol"), F.lit(0)), r"\s+$", "")
    name = F.regexp_extract(line, r"^SSH-\S+?-(.+)$", 1)
    return F.when(name == "", line).otherwise(name)


def ssh_rest() -> Column:
    """The features of a key exchange behind the software; null for frames without one."""
    flag = F.get(values("ssh_follows"), F.lit(0))
    follows = F.when(flag.isNull(), "").when(flag != 0, "True").otherwise("False")
    return F.when(F.size(values("ssh_kex")) > 0, F.concat_ws("|", *fields(**{n: first(f"ssh_{n}") for n in LISTS}, follows=follows)))


def ssh_frames(frames: DataFrame) -> DataFrame:
    """capture, frame, protocol, role, features: the first key exchange of a stream has its first identification line,
    later ones the latest of the others."""
    rows = frames.select("capture", "stream", "frame", ssh_line().alias("_line"), ssh_rest().alias("_rest")).where("_line is not null or _rest is not null")
    w = Window.partitionBy("capture", "stream").orderBy("frame")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_n": F.count("_line").over(upto), "_k": F.count("_rest").over(upto), "_client": F.first("_line", ignorenulls=True).over(upto)})
    rows = rows.withColumn("_server", F.last(F.when(F.col("_n") > 1, F.col("_line")), ignorenulls=True).over(upto))
    software = F.coalesce(F.when(F.col("_k") == 1, F.col("_client")).otherwise(F.col("_server")), F.lit(""))
    features = F.concat(F.lit("ssh|peer|id="), software, F.lit("|"), "_rest")
    return rows.where("_rest is not null").select("capture", "frame", F.lit("ssh").alias("protocol"), F.lit("peer").alias("role"), features.alias("features"))


def dissect(frames: DataFrame) -> DataFrame:
    """capture, frame, protocol, role, features, sha256, fingerprint (without the mode)."""
    rows = frames.select("capture", "frame", F.explode(stateless(frames)).alias("f")).select("capture", "frame", "f.*").unionByName(ssh_frames(frames))
    rows = rows.withColumn("sha256", sha256(F.col("features")))
    return rows.withColumn("fingerprint", F.concat_ws(":", F.lit("fan1"), "protocol", "role", base64url(F.col("features")), F.lit("sha256"), "sha256"))

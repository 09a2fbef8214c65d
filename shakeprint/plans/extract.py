"""The passive extraction plan: packets to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import fingerprint_columns
from ..functions.lineage import materialise
from ..operators.flows import FLOW, first_seen, ssh_rows
from ..operators.link import TCP, decode
from ..operators.messages import dtls_messages, ike_messages, is_banner, maybe_dtls, maybe_ike, maybe_kexinit, maybe_rdp, maybe_tls, tcp_messages
from ..operators.quic import maybe_quic, quic
from ..operators.tcpip import with_tcpip

#: Places of the protocols in the output's order.
TCP_STAGE, SSH_LEFT, DTLS_STAGE, QUIC_STAGE, IKE_STAGE = range(5)
COLUMNS = ["features", "fingerprint", "fingerprint_simhash128", "flow", "frame", "mode", "protocol", "role", "sha256", "simhash128"]


def messages_of(l4: DataFrame) -> Column:
    """What a single packet tells, in order: TCP/IP stack, TLS, X.509, RDP, DTLS and IKE."""
    tcp, body = F.col("transport") == TCP, F.col("body")
    told = [tcp_messages(F.when(tcp & (maybe_tls(body) | maybe_rdp(body)), body)), dtls_messages(F.when(~tcp & maybe_dtls(body), body)), ike_messages(F.when(~tcp & maybe_ike(F.col("sport"), F.col("dport"), body), body))]
    stack = F.when(F.col("tcpip").isNotNull(), F.array(F.struct(F.lit("tcpip").alias("protocol"), F.col("tcpip.role").alias("role"), F.col("tcpip.features").alias("features"))))
    none = F.array().cast("array<struct<protocol:string,role:string,features:string>>")
    return F.concat(*(F.coalesce(x, none) for x in (stack, *told)))


def one_pass(packets: DataFrame) -> DataFrame:
    """The packets that matter (capture, frame, flow columns, transport), each with what it tells alone, and with its
    body if flows may need it: SSH lines and key exchanges, and long headers of QUIC."""
    tcp, body = F.col("transport") == TCP, F.col("body")
    df = with_tcpip(decode(packets))
    of_flow = (tcp & (is_banner(body) | maybe_kexinit(body))) | (~tcp & maybe_quic(body))
    df = df.select("capture", "frame", *FLOW, "transport", messages_of(df).alias("found"), F.when(of_flow, body).alias("body"))
    # A generator drops the other packets: a filter would be pushed below the parsers and run them again.
    kept = F.when((F.size("found") > 0) | F.col("body").isNotNull(), F.array(F.struct("found", "body")))
    return df.select("capture", "frame", *FLOW, "transport", F.explode(kept).alias("told")).select("capture", "frame", *FLOW, "transport", "told.*")


def candidates(packets: DataFrame) -> DataFrame:
    """All (protocol, role, features) with flow and order, before first sight decides. packets: capture, frame,
    payload; they are read, decoded and parsed once, and what matters is stored."""
    stored = materialise(one_pass(packets))
    found = stored.select("capture", "frame", *FLOW, F.posexplode("found").alias("place", "f"))
    stage = F.when(F.col("f.protocol") == "dtls", DTLS_STAGE).when(F.col("f.protocol") == "ike", IKE_STAGE).otherwise(TCP_STAGE)
    out = found.select("capture", "frame", *FLOW, "f.*", "place", stage.alias("stage"))
    flows = stored.where("body is not null").drop("found")
    ssh = ssh_rows(flows.where(F.col("transport") == TCP)).withColumns({"protocol": F.lit("ssh"), "stage": F.when(F.col("place") == 1, SSH_LEFT).otherwise(TCP_STAGE), "place": F.col("place") + (1 << 20)})
    q = quic(flows.where(F.col("transport") != TCP)).withColumns({"protocol": F.lit("quic"), "stage": F.lit(QUIC_STAGE)})
    return out.unionByName(ssh).unionByName(q)


def observations(rows: DataFrame, mode: str = "passive") -> DataFrame:
    """Rows of first_seen() as observations, with `capture`, and `stage` and `place` for output in order."""
    df = fingerprint_columns(rows, mode).withColumn("flow", F.struct(*FLOW))
    return df.select("capture", *(c for c in COLUMNS if c in df.columns), "stage", "place")


def extract(packets: DataFrame) -> DataFrame:
    return observations(first_seen(candidates(packets)))

"""Queries over probe answers of every protocol, probes as rows, dissected fields, record files, and names of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import synth as s
from ..functions import names
from ..functions.features import feature_map
from ..functions.lineage import materialise, new_path
from ..functions.wire import raw, text, u16
from ..operators import active, dissector, messages, similarity, ssh
from ..operators.components import grow, grown
from ..sources import probes
from ..sources import records as record_source
from ..streaming import stream
from .catalogue import FEATURES_SQL, IKE_SQL, SSH_SQL, _ike, _sa, c, people_features, query, ssh_lists, table
from .flow_queries import _kind, event_stream

# Probe answers


def _answers(spark: SparkSession, d: str, name: str, key: str, protocol: str, probe: str, response: Column) -> DataFrame:
    """A target per row of a table, with its answer; the key is the port."""
    flow = F.struct(F.lit("t").alias("src"), F.lit(1).alias("sport"), F.lit("s").alias("dst"), F.lit(2).alias("dport"))
    rows = table(spark, d, name).select(F.lit("h").alias("host"), c(key).cast("int").alias("port"), F.lit(protocol).alias("protocol"), F.lit(probe).alias("probe"), F.lit(1).alias("probe_rank"), response.alias("response"), flow.alias("flow"))
    return active.active(rows, force=True).select(F.col("port").cast("long").alias("key"), "role", "features")


@query(f"SELECT s_suppkey AS key, 'peer' AS role, 'ssh|peer|id=' || s_name || '|' || CASE WHEN s_suppkey % 2 = 0 THEN '{SSH_SQL}|follows=False' ELSE '{ssh.BANNER_ONLY}' END AS features FROM supplier WHERE s_suppkey % 30 < 20")
def active_ssh(spark, d):
    """The identification line is the twentieth at the latest; a key exchange may follow it."""
    before = text(F.repeat(F.lit("welcome\r\n"), (c("s_suppkey") % 30).cast("int")))
    kex = F.when(c("s_suppkey") % 2 == 0, s.ssh_kexinit(ssh_lists(), 0)).otherwise(raw(""))
    return _answers(spark, d, "supplier", "s_suppkey", "ssh", "SSH", F.concat(before, s.ssh_banner(F.col("s_name")), kex))


@query("SELECT p_partkey AS key, 'server' AS role, 'rdp|server|tpkt_v=3|tpkt_rsv=0|tpkt_len=19|x224_len=14|pdu=208|dst_ref=0|src_ref=' || (p_partkey % 65536) || '|class=0|neg_type=2|neg_flags=' || p_size || '|neg_len=8|neg_proto=|neg_selected=1' AS features FROM part WHERE p_partkey % 3 > 0")
def active_rdp(spark, d):
    """Only the first unit counts, and only if it is a server's."""
    confirm = s.tpkt(0xD0, 0, c("p_partkey") % 65536, s.negotiation(2, c("p_size"), 1))
    request = s.tpkt(0xE0, 0, 0, s.negotiation(1, 0, 3))
    return _answers(spark, d, "part", "p_partkey", "rdp", "RDP", F.when(c("p_partkey") % 3 == 0, F.concat(request, confirm)).otherwise(F.concat(confirm, request)))


@query("SELECT o_orderkey AS key, 'server' AS role, 'dtls|server|v=65277|c=' || (o_orderkey % 200 + 4865) || '|e=23|sv=' AS features FROM orders WHERE o_orderkey % 4 <> 1")
def active_dtls(spark, d):
    """A ServerHello, behind a fragment or another record or not; an answer that asks for a cookie has no features."""
    hello = s.hello_server(0xFEFD, c("o_orderkey") % 200 + 4865, s.extension(23, raw("")))
    whole, part = s.dtls_record(2, hello), s.dtls_record(2, F.substring(hello, 1, 20), whole=F.octet_length(hello))
    verify = s.dtls_record(3, raw("FEFF02ABCD"), 0xFEFF)
    kind = c("o_orderkey") % 4
    return _answers(spark, d, "orders", "o_orderkey", "dtls", "DTLSv1.2", F.when(kind == 1, verify).when(kind == 2, F.concat(part, whole)).otherwise(whole))


@query("SELECT p_partkey, lower(to_hex(p_partkey % 251 + 1)) AS cookie, 'DTLSv1.' || CASE WHEN p_partkey % 2 = 0 THEN '2' ELSE '0' END AS probe, 1::BIGINT AS sequence FROM part")
def active_dtls_retry(spark, d):
    """The hello that repeats a cookie, as its bytes say it: behind record and message heads, version, random and an
    empty session id."""
    verify = s.dtls_record(3, F.concat(raw("FEFF01"), F.substring(u16(c("p_partkey") % 251 + 1), 2, 1)), 0xFEFF)
    probe = F.concat(F.lit("DTLSv1."), F.when(c("p_partkey") % 2 == 0, "2").otherwise("0"))
    rows = table(spark, d, "part").select("p_partkey", probe.alias("probe"), verify.alias("response")).withColumn("cookie", active.dtls_cookie("response"))
    second = rows.withColumn("request", probes.cookie_retry("probe", "cookie"))
    number = lambda at, size: F.conv(F.hex(F.substring("request", at, size)), 16, 10).cast("long")
    found = F.expr("substring(request, 62, int(conv(hex(substring(request, 61, 1)), 16, 10)))")
    said = F.when(number(26, 2) == 0xFEFD, "DTLSv1.2").when(number(26, 2) == 0xFEFF, "DTLSv1.0")
    return second.select("p_partkey", F.lower(F.regexp_replace(F.hex(found), "^0", "")).alias("cookie"), said.alias("probe"), number(10, 2).alias("sequence"))


@query("SELECT p_partkey AS key, 'responder' AS role, 'ike|responder" + IKE_SQL.replace("p_partkey AS frame, ", "").format(flags=8, p=0, q=0))
def active_ike(spark, d):
    """Whatever its flags say, an answer is a responder's, and a proposal of protocol 0 shows 0."""
    return _answers(spark, d, "part", "p_partkey", "ike", "IKEv2", _ike(_sa(0)))


# Probes


@query("""WITH t AS (SELECT s_suppkey, s_name, s_suppkey % 5 AS k FROM supplier),
p AS (SELECT * FROM (VALUES (0,'tls',443,'TLSv1.3',1),(0,'tls',443,'TLSv1.2',2),(0,'tls',443,'TLSv1.1',3),(0,'tls',443,'TLSv1.0',4),(0,'tls',443,'SSLv3',5),(0,'tls',443,'SSLv2',6),
 (1,'dtls',443,'DTLSv1.2',1),(2,'ssh',22,'SSH',1),(3,'rdp',3389,'RDP',1),(4,'ike',500,'IKEv2',1)) AS v(k, protocol, port, probe, probe_rank))
SELECT s_name AS host, port::INT AS port, protocol, probe, probe_rank::INT AS probe_rank, 5000::INT AS timeout_ms FROM t JOIN p USING (k)""")  # fmt: skip
def probe_plan(spark, d):
    """Probes in the order in which they are tried; one DTLS version is forced, an unknown SSH probe is not."""
    kind, of = c("s_suppkey") % 5, lambda *v: F.element_at(F.array(*map(F.lit, v)), (c("s_suppkey") % 5 + 1).cast("int"))
    targets = table(spark, d, "supplier").where(kind.isNotNull()).select(F.col("s_name").alias("host"), of(443, 443, 22, 3389, 500).alias("port"), of("tls", "dtls", "ssh", "rdp", "ike").alias("protocol"), F.col("s_name").alias("name"))
    return probes.plan(targets, {"dtls": "DTLSv1.2", "ssh": "SSHv9"}).select("host", "port", "protocol", "probe", "probe_rank", "timeout_ms")


def _requests(spark: SparkSession, d: str, protocol: str, port: Column, name: Column) -> DataFrame:
    targets = table(spark, d, "supplier").select(F.col("s_name").alias("host"), port.cast("int").alias("port"), F.lit(protocol).alias("protocol"), name.alias("name"))
    return probes.plan(targets)


_SUITES13, _SUITES12 = "4865-4867-4866-", "49195-49199-52393-52392-49196-49200-49162-49161-49171-49172-156-157-47-53"
_LEGACY = "49162-49161-49171-49172-49159-49169-51-50-57-47-53-10-5-4"


@query(f"""SELECT s_name AS host, probe, 'tls|client|v=' || v || '|c=' || cs || '|e=' || CASE WHEN s_suppkey % 2 = 0 THEN '0-' ELSE '' END || es || '|g=29-23-24-25|p=0|sv=' || sv || '|alpn=h2,http/1.1|sig=' || sig AS features
FROM supplier, (VALUES ('TLSv1.3', 771, '{_SUITES13}{_SUITES12}', '10-11-16-13-43-51', '772-771', '2052-2053-1027-1283-1025-1281'), ('TLSv1.2', 771, '{_SUITES12}', '10-11-16-13', '', '1025-1027-1281-1283-513'),
 ('TLSv1.1', 770, '{_LEGACY}', '10-11-16', '', ''), ('TLSv1.0', 769, '{_LEGACY}', '10-11-16', '', ''), ('SSLv3', 768, '{_LEGACY}', '10-11-16', '', '')) AS t(probe, v, cs, es, sv, sig)""")  # fmt: skip
def probe_tls(spark, d):
    """What the hellos offer, read by the parser of passive traffic; a server name goes along where one is known."""
    rows = _requests(spark, d, "tls", F.lit(443), F.when(c("s_suppkey") % 2 == 0, F.col("s_name"))).where("probe <> 'SSLv2'")
    return rows.select("host", "probe", F.explode(messages.tcp_messages("request")).alias("f")).select("host", "probe", "f.features")


@query("SELECT s_name AS host, '802e0100020015000000100100800200800300800400800500800600400700c0' || repeat('00', 16) AS request FROM supplier")
def probe_sslv2(spark, d):
    return _requests(spark, d, "tls", F.lit(443), F.col("s_name")).where("probe = 'SSLv2'").select("host", F.lower(F.hex("request")).alias("request"))


@query(f"""SELECT s_name AS host, probe, 'dtls|client|v=' || v || '|c=' || cs || '|e=' || es || '|g=29-23-24-25|p=0|sv=' || sv || '|alpn=co,http/1.1|sig=' || sig AS features
FROM supplier, (VALUES ('DTLSv1.3', 65277, '{_SUITES13}{_SUITES12}', '10-11-16-13-43-51', '65276-65277', '2052-2053-1027-1283-1025-1281'), ('DTLSv1.2', 65277, '{_SUITES12}', '10-11-16-13', '', '2052-2053-1027-1283-1025-1281'),
 ('DTLSv1.0', 65279, '{_LEGACY}', '10-11-16', '', '')) AS t(probe, v, cs, es, sv, sig)""")  # fmt: skip
def probe_dtls(spark, d):
    rows = _requests(spark, d, "dtls", F.lit(443), F.col("s_name"))
    return rows.select("host", "probe", F.explode(messages.dtls_messages("request")).alias("f")).select("host", "probe", "f.features")


@query("""SELECT s_name AS host, CASE WHEN s_suppkey % 2 = 0 THEN '00000000' ELSE '' END AS marker,
'ike|initiator|v=2.0|ex=34|flags=8|np=33|p=33-34-40|sa=1:1=12.256,2=5,3=12,4=14;1:1=12.128,2=2,3=2,4=14;1:1=20.256,2=5,4=14|ke=14|n=' AS features FROM supplier""")
def probe_ike(spark, d):
    """The marker of four zeros goes to port 4500 only."""
    rows = _requests(spark, d, "ike", F.when(c("s_suppkey") % 2 == 0, 4500).otherwise(500), F.col("s_name"))
    marked = F.when(F.hex(F.substring("request", 1, 4)) == "00000000", "00000000").otherwise("")
    return rows.select("host", marked.alias("marker"), F.explode(messages.ike_messages("request")).alias("f")).select("host", "marker", "f.features")


@query("SELECT s_name AS host, '030000130ee00000000000010008000b000000' AS rdp, '5353482d322e302d7368616b657072696e740d0a' AS ssh FROM supplier")
def probe_rdp_ssh(spark, d):
    """The bytes of the RDP request (11 asks for TLS, CredSSP and extended CredSSP) and of the SSH line."""
    rows = _requests(spark, d, "rdp", F.lit(3389), F.col("s_name")).select("host", F.lower(F.hex("request")).alias("rdp"))
    return rows.join(_requests(spark, d, "ssh", F.lit(22), F.col("s_name")).select("host", F.lower(F.hex("request")).alias("ssh")), "host")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'r' ELSE s_name END AS src, CASE WHEN s_suppkey % 3 = 0 THEN 1000 ELSE 443 END::INT AS sport, CASE WHEN s_suppkey % 3 < 2 THEN 'l' ELSE '' END AS dst,
CASE WHEN s_suppkey % 3 < 2 THEN '50000' ELSE '' END AS dport FROM supplier""")  # fmt: skip
def answer_flow(spark, d):
    """From the target to the scanner; what the socket doesn't tell comes from the target."""
    end = lambda host, port, when: F.when(when, F.struct(host.alias("host"), F.lit(port).alias("port")))
    kind = c("s_suppkey") % 3
    flow = probes.oriented(end(F.lit("l"), 50000, kind < 2), end(F.lit("r"), 1000, kind != 1), F.struct(F.col("s_name").alias("host"), F.lit(443).alias("port")))
    return table(spark, d, "supplier").select("s_suppkey", flow.alias("f")).select("s_suppkey", "f.src", "f.sport", "f.dst", F.coalesce(F.col("f.dport").cast("string"), F.lit("")).alias("dport"))


# Dissected fields


def _longs(*values: int | Column) -> Column:
    return F.array(*(F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in values))


def frames_of(rows: DataFrame, key: Column, held: dict[str, Column], stream_key: Column | None = None, *more: Column) -> DataFrame:
    """Dissected frames of rows; fields that aren't held are null."""
    columns = [held.get(n, F.lit(None).cast("array<bigint>")).alias(n) for n in dissector.INT_FIELDS] + [held.get(n, F.lit(None).cast("array<string>")).alias(n) for n in dissector.TEXT_FIELDS]
    return rows.select(F.lit("t").alias("capture"), key.alias("frame"), (F.lit("1") if stream_key is None else stream_key.cast("string")).alias("stream"), *more, *columns)


def _when(condition: Column, values: Column) -> Column:
    return F.when(condition, values)


def _told(frames: DataFrame) -> DataFrame:
    return dissector.dissect(frames).select("frame", "protocol", "role", "features")


QUIC_HEAD = "'quic|peer|v=1|type=initial|dcid_len=' || (o_orderkey % 21) || '|scid_len=8|token_len=' || (o_orderkey % 70) || '|len=' || (o_orderkey % 1200)"


@query(f"""SELECT o_orderkey AS frame, 'quic' AS protocol, CASE o_orderkey % 3 WHEN 0 THEN 'peer' WHEN 1 THEN 'client' ELSE 'server' END AS role, CASE o_orderkey % 3 WHEN 0 THEN {QUIC_HEAD}
 WHEN 1 THEN 'quic|client|v=1|tls_v=771|c=' || (o_orderkey % 200 + 4865) || '-4866|e=10-16|g=2570-29|p=0|sv=772|alpn=h3,h3-29|sig=1027' ELSE 'quic|server|v=1|tls_v=771|c=' || (o_orderkey % 200 + 4865) || '|e=43|sv=772' END AS features
FROM orders WHERE o_orderkey % 5 > 0""")  # fmt: skip
def dissector_quic(spark, d):
    """Hellos inside an Initial, or its header; no TLS rows besides, and nothing of packets without a token length."""
    k, quic = c("o_orderkey"), c("o_orderkey") % 5 > 0
    client, server = k % 3 == 1, k % 3 == 2
    held = {
        "quic_version": _longs(1), "quic_token_len": _when(quic, _longs(k % 70)), "quic_dcil": _longs(k % 21), "quic_scil": _longs(8), "quic_length": _longs(k % 1200),
        "tls_hs_type": _when(client | server, _longs(F.when(client, 1).otherwise(2))), "tls_version": _longs(771), "tls_cipher": F.when(client, _longs(2570, k % 200 + 4865, 4866)).otherwise(_longs(k % 200 + 4865)),
        "tls_ext_type": F.when(client, _longs(6682, 10, 16)).otherwise(_longs(43)), "tls_groups": _longs(2570, 29), "tls_points": _longs(0), "tls_sv": F.when(client, _longs(2570, 772)).otherwise(_longs(772)), "tls_sig": _longs(1027), "tls_alpn": F.array(F.lit("h3"), F.lit("h3-29")),
    }
    return _told(frames_of(table(spark, d, "orders"), k, held))


@query("""SELECT o_orderkey AS frame, 'dtls' AS protocol, CASE WHEN o_orderkey % 2 = 0 THEN 'client' ELSE 'server' END AS role, CASE WHEN o_orderkey % 2 = 0 THEN 'dtls|client|v=65277|c=' || (o_orderkey % 200 + 4865) || '-255|e=10-13|g=29-23|p=0|sv=|alpn=|sig=1025'
 ELSE 'dtls|server|v=65277|c=' || (o_orderkey % 200 + 4865) || '|e=23|sv=' END AS features FROM orders""")  # fmt: skip
def dissector_dtls(spark, d):
    """Frames with an epoch give DTLS rows only, though they hold TLS fields, too."""
    k = c("o_orderkey")
    client = k % 2 == 0
    held = {
        "dtls_epoch": _longs(0), "dtls_hs_type": _longs(F.when(client, 1).otherwise(2)), "dtls_version": _longs(65277), "dtls_cipher": F.when(client, _longs(k % 200 + 4865, 255)).otherwise(_longs(k % 200 + 4865)),
        "dtls_ext_type": F.when(client, _longs(10, 13)).otherwise(_longs(23)), "dtls_groups": _longs(29, 23), "dtls_points": _longs(0), "dtls_sig": _longs(1025), "tls_hs_type": _longs(1), "tls_version": _longs(771),
    }
    return _told(frames_of(table(spark, d, "orders"), k, held))


@query("""SELECT p_partkey AS frame, 'ike' AS protocol, CASE WHEN p_partkey % 2 = 0 THEN 'initiator' ELSE 'responder' END AS role, 'ike|' || CASE WHEN p_partkey % 2 = 0 THEN 'initiator|v=2.0|ex=34|flags=8' ELSE 'responder|v=2.0|ex=34|flags=32' END
 || '|np=33|p=33-34-40-41|sa=1:1=20.256,2=5,4=' || (p_size % 30) || ';3:1=12,5=1|ke=' || (p_size % 30) || '|n=16388-' || (p_partkey % 100) AS features FROM part WHERE p_partkey % 7 > 0""")  # fmt: skip
def dissector_ike(spark, d):
    """Transforms are dealt to proposals by their counts; other major versions give nothing."""
    held = {
        "ike_mjver": _longs(F.when(c("p_partkey") % 7 > 0, 2).otherwise(1)), "ike_mnver": _longs(0), "ike_exchtype": _longs(34), "ike_flags": _longs(F.when(c("p_partkey") % 2 == 0, 8).otherwise(32)), "ike_nextpay": _longs(33, 34, 40, 41, 0),
        "ike_prop_proto": _longs(1, 3), "ike_prop_ntrans": _longs(3, 2), "ike_tf_type": _longs(1, 2, 4, 1, 5), "ike_encr": _longs(20, 12), "ike_prf": _longs(5), "ike_dh": _longs(c("p_size") % 30), "ike_esn": _longs(1), "ike_klen": _longs(256),
        "ike_ke_group": _longs(c("p_size") % 30), "ike_notify": _longs(16388, c("p_partkey") % 100),
    }
    return _told(frames_of(table(spark, d, "part"), c("p_partkey"), held))


@query("""SELECT p_partkey AS frame, 'rdp' AS protocol, CASE WHEN p_partkey % 2 = 0 THEN 'client' ELSE 'server' END AS role, CASE WHEN p_partkey % 2 = 0
 THEN 'rdp|client|tpkt_v=3|tpkt_rsv=0|tpkt_len=19|x224_len=14|pdu=224|dst_ref=0|src_ref=' || (p_partkey % 65536) || '|class=0|neg_type=1|neg_flags=0|neg_len=8|neg_proto=' || p_size || '|neg_selected='
 ELSE 'rdp|server|tpkt_v=3|tpkt_rsv=0|tpkt_len=19|x224_len=14|pdu=208|dst_ref=0|src_ref=' || (p_partkey % 65536) || '|class=0|neg_type=2|neg_flags=31|neg_len=8|neg_proto=|neg_selected=' || p_size END AS features FROM part""")  # fmt: skip
def dissector_rdp(spark, d):
    client = c("p_partkey") % 2 == 0
    held = {
        "rdp_tpkt_version": _longs(3), "rdp_tpkt_reserved": _longs(0), "rdp_tpkt_length": _longs(19), "rdp_cotp_li": _longs(14), "rdp_cotp_type": _longs(F.when(client, 14).otherwise(13)), "rdp_cotp_class": _longs(0), "rdp_destref": _longs(0),
        "rdp_srcref": _longs(c("p_partkey") % 65536), "rdp_neg_type": _longs(F.when(client, 1).otherwise(2)), "rdp_neg_len": _longs(8), "rdp_req_flags": _longs(0), "rdp_req_proto": _longs(c("p_size")), "rdp_rsp_flags": _longs(31), "rdp_sel_proto": _longs(c("p_size")),
    }
    return _told(frames_of(table(spark, d, "part"), c("p_partkey"), held))


def _ssh_fields() -> dict[str, Column]:
    """Of each user's events some hold a line, some a key exchange."""
    line = F.concat(F.when(c("event_id") % 3 == 0, "SSH-2.0-").otherwise("SSH-"), F.lit("Soft_"), (c("event_id") % 5).cast("string"), F.lit("\r\n"))
    return {"ssh_protocol": F.when(_kind() == 0, F.array(line)), "ssh_kex": F.when(_kind() == 1, F.array(F.lit("a,b"))), "ssh_hostkey": F.array(F.lit("x"), F.lit("y")), "ssh_follows": F.when(c("event_id") % 8 < 4, _longs(c("event_id") % 2))}


DISSECTED_SSH_SQL = """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE 'SSH-' END || 'Soft_' || (event_id % 5) END AS line, event_id % 4 = 1 AND user_id % 2 = 0 AS kex FROM events),
n AS (SELECT *, count(line) OVER u AS lines, sum(kex::INT) OVER u AS nth, first_value(line IGNORE NULLS) OVER u AS client FROM e WINDOW u AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, last_value(CASE WHEN lines > 1 THEN line END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS server FROM n)
SELECT event_id + 1 AS frame, 'ssh|peer|id=' || coalesce(CASE WHEN nth = 1 THEN client ELSE server END, '') || '|kex=a,b|hostkey=x|enc_c2s=|enc_s2c=|mac_c2s=|mac_s2c=|comp_c2s=|comp_s2c=|lang_c2s=|lang_s2c=|follows=' || CASE WHEN event_id % 8 < 4 THEN CASE WHEN event_id % 2 = 0 THEN 'False' ELSE 'True' END ELSE '' END AS features FROM m WHERE kex"""  # fmt: skip


@query(DISSECTED_SSH_SQL)
def dissector_ssh(spark, d):
    """The first key exchange of a stream has its first line, later ones the latest of the others."""
    return _told(frames_of(table(spark, d, "events"), c("event_id") + 1, _ssh_fields(), c("user_id"))).select("frame", "features")


@query(DISSECTED_SSH_SQL)
def stream_dissector_ssh(spark, d):
    """The same from a stream, with the lines of each stream of frames as keyed state."""
    frames = frames_of(event_stream(spark, d), c("event_id") + 1, _ssh_fields(), c("user_id"), F.col("ts"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.STATE_STORE)
    try:
        out = stream.drain(stream.dissected_ssh_stream(frames, "3650 days"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return out.select("frame", "features")


# Records


def _record_file(spark: SparkSession, d: str) -> str:
    """Records of customers as JSON texts in the shared folder: single objects, objects over several lines, and arrays."""
    flow = F.struct(F.lit("10.0.0.1").alias("src"), c("c_custkey").cast("int").alias("sport"))
    rows = table(spark, d, "customer").select((c("c_custkey") % 3).alias("kind"), F.to_json(F.struct(F.lit("tls").alias("protocol"), F.col("c_mktsegment").alias("role"), people_features().alias("features"), c("c_custkey").cast("int").alias("frame"), flow.alias("flow"), F.lit(True).alias("unknown"))).alias("one"))
    value = F.when(F.col("kind") == 0, F.col("one")).when(F.col("kind") == 1, F.regexp_replace("one", ",", ",\n ")).otherwise(F.concat(F.lit("["), "one", F.lit(" ,\n{}]")))
    path = new_path(spark)
    rows.select(value.alias("value")).write.text(path)
    return path


@query(f"SELECT c_custkey::INT AS frame, c_mktsegment AS role, '10.0.0.1' AS src, regexp_replace({FEATURES_SQL}, ',', CASE WHEN c_custkey % 3 = 1 THEN ',' || chr(10) || ' ' ELSE ',' END, 'g') AS features FROM customer")
def json_scan(spark, d):
    """Values one after another, in any of the forms: what an object doesn't have is null, and other keys are dropped."""
    rows = record_source.read_records(spark, _record_file(spark, d)).where("protocol is not null")
    return rows.select("frame", "role", "flow.src", "features")


@query("SELECT count(*) + count(*) FILTER (WHERE c_custkey % 3 = 2) AS records, 1::BIGINT AS first_record, count(*) + count(*) FILTER (WHERE c_custkey % 3 = 2) AS last_record, count(*) + count(*) FILTER (WHERE c_custkey % 3 = 2) AS numbers, count(*) FILTER (WHERE c_custkey % 3 = 2) AS empty FROM customer")
def record_numbers(spark, d):
    """Records are numbered from 1 without a gap, items of arrays one by one."""
    rows = record_source.read_records(spark, _record_file(spark, d))
    return rows.agg(F.count(F.lit(1)).alias("records"), F.min("record").alias("first_record"), F.max("record").alias("last_record"), F.count_distinct("record").alias("numbers"), F.count(F.when(F.col("protocol").isNull(), 1)).alias("empty"))


@query("SELECT p_partkey, (p_partkey % 140 - 5)::BIGINT AS threshold, (p_size % 3)::BIGINT AS top, p_partkey % 140 - 5 BETWEEN 0 AND 128 AND p_size % 3 >= 1 AS accepted FROM part")
def argument_checks(spark, d):
    """Which thresholds and list lengths the similarity operators accept."""
    asked = table(spark, d, "part").select("p_partkey", (c("p_partkey") % 140 - 5).alias("threshold"), (c("p_size") % 3).alias("top"))
    return asked.withColumn("accepted", similarity.arguments_accepted(F.col("threshold"), F.col("top")))


@query("SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey) AS component FROM customer")
def components_in_batches(spark, d):
    """Each customer is linked to the next of its nation; the links come in three batches, in no order of the chains."""
    following = F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    links = table(spark, d, "customer").select(c("c_custkey").alias("a"), F.coalesce(following, F.col("c_custkey")).cast("long").alias("b"))
    labels, merges = (spark.createDataFrame([], s) for s in ("node long, component long", "component long, into long"))
    for batch in range(3):
        added, merges = grow(labels, merges, links.where(F.pmod(F.xxhash64("a"), F.lit(3)) == batch))
        labels, merges = labels.unionByName(materialise(added)), materialise(merges)
    return grown(labels, merges)


# Names


@query("""SELECT p_partkey AS frame, 'NAT_DETECTION_SOURCE_IP' AS notify, CASE p_partkey % 50 WHEN 7 THEN 'INVALID_SYNTAX' WHEN 9 THEN 'INVALID_MESSAGE_ID' WHEN 11 THEN 'INVALID_SPI' WHEN 14 THEN 'NO_PROPOSAL_CHOSEN' WHEN 17 THEN 'INVALID_KE_PAYLOAD' WHEN 24 THEN 'AUTHENTICATION_FAILED'
 WHEN 34 THEN 'SINGLE_PAIR_REQUIRED' WHEN 35 THEN 'NO_ADDITIONAL_SAS' WHEN 36 THEN 'INTERNAL_ADDRESS_FAILURE' WHEN 37 THEN 'FAILED_CP_REQUIRED' WHEN 38 THEN 'TS_UNACCEPTABLE' WHEN 39 THEN 'INVALID_SELECTORS' END AS other,
 CASE WHEN p_size % 3 = 0 THEN 'DTLS 1.0' WHEN p_size % 3 = 1 THEN 'DTLS 1.2' ELSE 'DTLS 1.3' END AS version, CASE p_partkey % 4 WHEN 0 THEN 'TLS_AES_128_GCM_SHA256' WHEN 1 THEN 'TLS_AES_256_GCM_SHA384' WHEN 2 THEN 'TLS_CHACHA20_POLY1305_SHA256' END AS cipher FROM part""")  # fmt: skip
def code_names(spark, d):
    """Names of notifications, DTLS versions and cipher suites; codes without one have none."""
    version = F.element_at(F.array(F.lit(65279), F.lit(65277), F.lit(65276)), (c("p_size") % 3 + 1).cast("int"))
    features = F.concat(F.lit("ike|responder|n=16388-"), (c("p_partkey") % 50).cast("string"), F.lit("|v="), version.cast("string"), F.lit("|c="), (c("p_partkey") % 4 + 4865).cast("string"))
    rows = table(spark, d, "part").select(c("p_partkey").alias("frame"), feature_map(features).alias("m"))
    notes = F.split(F.col("m")["n"], "-")
    return rows.select("frame", names.named(notes[0], names.IKE_NOTIFIES).alias("notify"), names.named(notes[1], names.IKE_NOTIFIES).alias("other"), names.named(F.col("m")["v"], names.DTLS_VERSIONS).alias("version"), names.named(F.col("m")["c"], names.CIPHER_SUITES).alias("cipher"))

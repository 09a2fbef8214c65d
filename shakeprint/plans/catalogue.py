"""Queries over the driver's tables: frames are made from columns, decoded and parsed, and the SQL beside each query
says from the columns what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import synth as s
from ..functions import features as ff
from ..functions.names import IKE_PAYLOADS
from ..functions.wire import prefixed, raw, text, u8, u16, u32
from ..operators import messages
from ..operators.link import decode, tcp_segments, udp_datagrams
from ..operators.tcpip import tcpip

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that may be one small file, dealt over all cores before frames are made from it."""
    return table(spark, sf_dir, name).repartition(spark.sparkContext.defaultParallelism)


def query(oracle: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return register


def c(name: str, kind: str = "long") -> Column:
    return F.col(name).cast(kind)


def day(column: str) -> Column:
    """Days of a timestamp since 1970."""
    return F.unix_date(F.col(column).cast("date")).cast("long")


GREASE_SQL = "((v & 3855) = 2570 AND (v // 256) = (v & 255))"
#: Lists of a row: values from its columns and two reserved ones.
def people_features() -> Column:
    return F.concat(F.lit("tls|server|v=771|c="), (c("c_custkey") % 7 + 4865).cast("string"), F.lit("|e=43-51-"), c("c_nationkey").cast("string"), F.lit("|sv=772|x="), F.col("c_mktsegment"))

FEATURES_SQL = "'tls|server|v=771|c=' || (c_custkey % 7 + 4865) || '|e=43-51-' || c_nationkey || '|sv=772|x=' || c_mktsegment"


def simhash_sql(source: str, key: str, features: str) -> str:
    """(key, simhash128) of a query with key and features, in SQL."""
    return f"""
t0 AS (SELECT {key}, {features} AS f FROM {source}),
tok AS (SELECT {key}, unnest(CASE WHEN len(list_filter(string_split(translate(f, '|,-', '==='), '='), lambda x: x <> '')) = 0 THEN [f]
        ELSE list_filter(string_split(translate(f, '|,-', '==='), '='), lambda x: x <> '') END) AS token FROM t0),
h AS (SELECT {key}, sha256(token) AS h FROM tok),
nib AS (SELECT {key}, p, ('0x' || substr(h, p, 1))::INT AS d FROM h, (SELECT unnest(range(1, 33)) AS p)),
vote AS (SELECT {key}, p, sum(CASE WHEN d & 8 > 0 THEN 1 ELSE -1 END) AS b8, sum(CASE WHEN d & 4 > 0 THEN 1 ELSE -1 END) AS b4,
         sum(CASE WHEN d & 2 > 0 THEN 1 ELSE -1 END) AS b2, sum(CASE WHEN d & 1 > 0 THEN 1 ELSE -1 END) AS b1 FROM nib GROUP BY ALL),
sim AS (SELECT {key}, string_agg(substr('0123456789abcdef', (CASE WHEN b8 >= 0 THEN 8 ELSE 0 END + CASE WHEN b4 >= 0 THEN 4 ELSE 0 END
        + CASE WHEN b2 >= 0 THEN 2 ELSE 0 END + CASE WHEN b1 >= 0 THEN 1 ELSE 0 END)::INT + 1, 1), '' ORDER BY p) AS simhash128 FROM vote GROUP BY {key})"""


B64_SQL = "translate(to_base64(encode({})), '+/=', '-_')"


# Digests and encodings


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def fan_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", ff.sha256(F.col("text")).alias("sha256"))


@query(f"SELECT doc_id, {B64_SQL.format('text')} AS b64 FROM documents")
def fan_b64url(spark, d):
    return table(spark, d, "documents").select("doc_id", ff.base64url(F.col("text")).alias("b64"))


@query(f"WITH {simhash_sql('customer', 'c_custkey', FEATURES_SQL)} SELECT c_custkey, simhash128 FROM sim")
def fan_simhash128(spark, d):
    return table(spark, d, "customer").select("c_custkey", ff.simhash128(people_features()).alias("simhash128"))


ODD_SQL = "CASE s_suppkey % 4 WHEN 0 THEN '|,-=' WHEN 1 THEN 'a=a=b' WHEN 2 THEN s_name || '=' || s_name ELSE '' END"


@query(f"WITH {simhash_sql('supplier', 's_suppkey', ODD_SQL)} SELECT s_suppkey, simhash128 FROM sim")
def fan_simhash_odd(spark, d):
    k = c("s_suppkey") % 4
    f = F.when(k == 0, "|,-=").when(k == 1, "a=a=b").when(k == 2, F.concat("s_name", F.lit("="), "s_name")).otherwise("")
    return table(spark, d, "supplier").select("s_suppkey", ff.simhash128(f).alias("simhash128"))


@query(f"""WITH {simhash_sql('customer', 'c_custkey', FEATURES_SQL)}
SELECT c_custkey, 'fan1:tls:server:passive:' || {B64_SQL.format('f')} || ':sha256:' || sha256(f) AS fingerprint,
 'fan1:tls:server:passive:' || {B64_SQL.format('f')} || ':simhash128:' || simhash128 AS fingerprint_simhash128, sha256(f) AS sha256, simhash128 FROM t0 JOIN sim USING (c_custkey)""")  # fmt: skip
def fan_fingerprint(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.lit("tls").alias("protocol"), F.lit("server").alias("role"), people_features().alias("features"))
    return ff.fingerprint_columns(rows).select("c_custkey", "fingerprint", "fingerprint_simhash128", "sha256", "simhash128")


@query(f"SELECT c_custkey, 'tls' AS protocol, 'server' AS role, 'passive' AS mode, {FEATURES_SQL} AS features, c_mktsegment AS x FROM customer")
def fan_parse(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.lit("tls").alias("protocol"), F.lit("server").alias("role"), people_features().alias("features"))
    p = ff.parse_fingerprint(F.col("fingerprint"))
    rows = ff.fingerprint_columns(rows).select("c_custkey", p.alias("p"))
    return rows.select("c_custkey", "p.protocol", "p.role", "p.mode", "p.features", ff.feature_map(F.col("p.features"))["x"].alias("x"))


@query(f"SELECT sha256, count(*) AS n, min(c_custkey) AS first_key FROM (SELECT c_custkey, sha256({FEATURES_SQL}) AS sha256 FROM customer) GROUP BY 1")
def exact_correlation(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", ff.sha256(people_features()).alias("sha256"))
    return rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_key"))


# Lists


@query(f"""SELECT o_orderkey, array_to_string(list_transform(list_filter([2570, o_orderkey % 65536, 6682, 2586, 64250, 2826, o_custkey], lambda v: NOT {GREASE_SQL}), lambda v: v::VARCHAR), '-') AS kept FROM orders""")
def grease_filter(spark, d):
    a = F.array(*(F.lit(x).cast("long") if isinstance(x, int) else x for x in (2570, c("o_orderkey") % 65536, 6682, 2586, 64250, 2826, c("o_custkey"))))
    return table(spark, d, "orders").select("o_orderkey", ff.join_ints(a).alias("kept"))


@query("SELECT o_orderkey, o_orderkey || '-' || o_custkey || '-2570' AS joined FROM orders")
def join_values(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ff.join_values(F.array(c("o_orderkey"), c("o_custkey"), F.lit(2570).cast("long"))).alias("joined"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN '' ELSE (o_orderkey % 65536) || '-' || (o_custkey % 65536) END AS listed FROM orders")
def u16_decode(spark, d):
    k = c("o_orderkey") % 5
    two = F.concat(u16(c("o_orderkey") % 65536), u16(c("o_custkey") % 65536))
    data = F.when(k == 0, raw("")).when(k == 1, raw("7F")).when(k == 2, two).otherwise(F.concat(two, raw("FF")))
    return table(spark, d, "orders").select("o_orderkey", ff.join_values(ff.u16_list(data)).alias("listed"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN t <= 32 THEN 32 WHEN t <= 64 THEN 64 WHEN t <= 128 THEN 128 ELSE 255 END::INT AS bucket FROM (SELECT *, (l_partkey * 7 + l_linenumber) % 256 AS t FROM lineitem)")
def ttl_bucket(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ff.ttl_bucket((c("l_partkey") * 7 + c("l_linenumber")) % 256).cast("int").alias("bucket"))


# Decoding

LINE = "l_orderkey * 8 + l_linenumber"
def line_key() -> Column:
    return (c("l_orderkey") * 8 + c("l_linenumber")).alias("frame")

def _ttl() -> Column:
    return c("l_partkey") % 255 + 1

def _win() -> Column:
    return c("l_partkey") * 13 % 65536

def _sport() -> Column:
    return c("l_suppkey") % 60000 + 1024



def line_frames(spark: SparkSession, d: str, payload: Column) -> DataFrame:
    return spread(spark, d, "lineitem").select(line_key(), payload.alias("payload"))


def _syn(options: Column, body: Column | None = None, flags: Column | int = 2, df: Column | int = 1, ident: Column | int = 0) -> Column:
    segment = s.tcp(raw("") if body is None else body, _sport(), 443, flags, _win(), options)
    return s.ethernet(s.ipv4(segment, 6, s.address4(c("l_orderkey")), s.address4(c("l_partkey")), _ttl(), ident, df))


ADDRESS_SQL = f"{s.address4_text('l_orderkey % 16777216')} AS src, {s.address4_text('l_partkey % 16777216')} AS dst"


@query(f"""SELECT {LINE} AS frame, {ADDRESS_SQL}, (l_suppkey % 60000 + 1024)::INT AS sport, 443::INT AS dport, 24::INT AS flags, (l_partkey * 13 % 65536)::INT AS "window",
 (l_partkey % 255 + 1)::INT AS ttl, 4::INT AS ip_version, (40 + length(l_returnflag))::INT AS ip_len, true AS ip_df, (l_orderkey % 65536)::INT AS ip_id, lower(hex(encode(l_returnflag))) AS body FROM lineitem""")  # fmt: skip
def decode_tcp4(spark, d):
    rows = tcp_segments(line_frames(spark, d, _syn(raw(""), text(F.col("l_returnflag")), 24, 1, c("l_orderkey") % 65536)))
    return rows.select("frame", "src", "dst", "sport", "dport", "flags", "window", "ttl", "ip_version", "ip_len", "ip_df", "ip_id", F.lower(F.hex("body")).alias("body"))


#: Both sides of an IPv6 flow: runs of zero groups of several lengths, at the start, inside and at the end.
def v6_source() -> Column:
    return F.concat(raw("20010DB8"), u32(F.lit(0)), u32(c("l_linenumber") % 2), u32(c("l_orderkey")))

V6_SRC_SQL = """CASE WHEN l_linenumber % 2 = 0 THEN '2001:db8::' || CASE WHEN l_orderkey = 0 THEN '' WHEN l_orderkey < 65536 THEN to_hex(l_orderkey) ELSE to_hex(l_orderkey // 65536) || ':' || to_hex(l_orderkey % 65536) END
 ELSE '2001:db8::1:' || to_hex(l_orderkey // 65536) || ':' || to_hex(l_orderkey % 65536) END"""


@query(f"""SELECT {LINE} AS frame, lower({V6_SRC_SQL}) AS src, 'fe80::' AS dst, (l_suppkey % 60000 + 1024)::INT AS sport, 22::INT AS dport, 64::INT AS ttl, 6::INT AS ip_version, (60 + 2)::INT AS ip_len, false AS ip_df, 0::INT AS ip_id FROM lineitem""")
def decode_tcp6(spark, d):
    packet = s.ipv6(s.tcp(raw("0102"), _sport(), 22), 6, v6_source(), F.unhex(F.lit("FE80" + "0" * 28)))
    rows = tcp_segments(line_frames(spark, d, s.ethernet(packet, 0x86DD)))
    return rows.select("frame", "src", "dst", "sport", "dport", "ttl", "ip_version", "ip_len", "ip_df", "ip_id")


@query(f"SELECT {LINE} AS frame, {ADDRESS_SQL}, (l_suppkey % 60000 + 1024)::INT AS sport, 53::INT AS dport, lower(hex(encode(l_linestatus))) AS body FROM lineitem")
def decode_udp4(spark, d):
    rows = udp_datagrams(line_frames(spark, d, s.udp4(text(F.col("l_linestatus")), c("l_orderkey"), c("l_partkey"), _sport(), 53)))
    return rows.select("frame", "src", "dst", "sport", "dport", F.lower(F.hex("body")).alias("body"))


@query(f"SELECT {LINE} AS frame, '::ffff:10.0.0.1' AS src, '::' AS dst, 5353::INT AS sport, 5353::INT AS dport FROM lineitem")
def decode_udp6(spark, d):
    packet = s.ipv6(s.udp(raw("00"), 5353, 5353), 17, raw("00000000000000000000FFFF0A000001"), raw("0" * 32))
    return udp_datagrams(line_frames(spark, d, s.ethernet(packet, 0x86DD))).select("frame", "src", "dst", "sport", "dport")


@query(f"SELECT {LINE} AS frame, 6::INT AS transport, 443::INT AS dport FROM lineitem WHERE l_linenumber % 2 = 0")
def decode_vlan(spark, d):
    """One tag is passed over; a second one hides the packet."""
    packet = s.ipv4(s.tcp(raw(""), _sport(), 443), 6, s.address4(c("l_orderkey")), s.address4(c("l_partkey")))
    inner = F.when(c("l_linenumber") % 2 == 0, s.ethernet(packet, 0x0800, F.lit(7))).otherwise(s.ethernet(F.concat(raw("00080800"), packet), 0x8100, F.lit(7)))
    return decode(line_frames(spark, d, inner)).select("frame", "transport", "dport")


@query(f"SELECT {LINE} AS frame, (l_linenumber % 7 >= 5) AS whole FROM lineitem WHERE l_linenumber % 7 >= 5")
def decode_short(spark, d):
    """Frames cut in the Ethernet, IP and TCP headers give nothing."""
    cut = F.element_at(F.array(*(F.lit(x) for x in (13, 20, 33, 40, 53))), (c("l_linenumber") % 7 + 1).cast("int") % 5 + 1)
    payload = F.when(c("l_linenumber") % 7 >= 5, _syn(raw(""))).otherwise(F.substring(_syn(raw("")), 1, cut))
    return decode(line_frames(spark, d, payload)).select("frame", F.lit(True).alias("whole"))


@query(f"SELECT {LINE} AS frame, (l_linenumber % 8 - 0)::INT AS n FROM lineitem WHERE l_linenumber % 8 > 0")
def udp_length_clip(spark, d):
    """The UDP length cuts the payload; what is empty then gives no row, and padding behind the packet isn't read."""
    datagram = s.udp(raw("0102030405060708"), 1, 2, c("l_linenumber") % 8 + 8)
    packet = s.ipv4(datagram, 17, s.address4(c("l_orderkey")), s.address4(c("l_partkey")), pad=raw("EEEEEEEE"))
    return udp_datagrams(line_frames(spark, d, s.ethernet(packet))).select("frame", F.octet_length("body").cast("int").alias("n"))


# TCP/IP

def _mss() -> Column:
    return c("l_partkey") % 65536

def _ws() -> Column:
    return c("l_suppkey") % 15

def _ts() -> Column:
    return c("l_linenumber") % 3

#: Four layouts of options.
def option_bytes() -> Column:
    return (
    F.when(c("l_linenumber") % 4 == 0, F.concat(raw("0204"), u16(_mss()), raw("0402080A"), u32(_ts()), u32(c("l_linenumber") % 2), raw("010303"), u8(_ws())))
    .when(c("l_linenumber") % 4 == 1, F.concat(raw("0204"), u16(_mss()), raw("01030300"), raw("01010402")))
    .when(c("l_linenumber") % 4 == 2, F.concat(raw("0204"), u16(_mss()), raw("00000001")))
    .otherwise(F.concat(raw("2206AABBCCDD"), raw("FE04"), u16(_mss()), raw("050A0000000000000000"), raw("01010309")))
)

OPTIONS_SQL = """CASE l_linenumber % 4
 WHEN 0 THEN 'mss' || (l_partkey % 65536) || ',sackok,ts,nop,ws' || (l_suppkey % 15)
 WHEN 1 THEN 'mss' || (l_partkey % 65536) || ',nop,ws0,nop,nop,sackok'
 WHEN 2 THEN 'mss' || (l_partkey % 65536) || ',eol'
 ELSE 'tfo,opt254:' || lpad(lower(to_hex(l_partkey % 65536)), 4, '0') || ',sack8,nop,nop,bad3' END"""
QUIRKS_SQL = """array_to_string(list_sort(list_filter([CASE WHEN l_linenumber % 4 = 0 AND l_linenumber % 2 <> 0 THEN 'ts-echo-nz' END, CASE WHEN l_linenumber % 4 = 2 THEN 'nz-eol-pad' END,
 CASE WHEN l_linenumber % 4 = 3 THEN 'bad-opt-len' END, CASE WHEN l_linenumber % 5 = 0 THEN 'data-in-syn' END, CASE WHEN l_orderkey % 2 = 0 THEN 'no-df' END,
 CASE WHEN l_orderkey % 2 = 1 AND l_orderkey % 3 > 0 THEN 'df-nz-id' END], lambda x: x IS NOT NULL)), '-')"""
ROLE_SQL = "CASE WHEN l_linenumber % 6 = 0 THEN 'server' ELSE 'client' END"


def _stack(spark: SparkSession, d: str) -> DataFrame:
    body = F.when(c("l_linenumber") % 5 == 0, raw("ABCD")).otherwise(raw(""))
    flags = F.when(c("l_linenumber") % 6 == 0, 0x12).otherwise(0x02)
    return tcpip(tcp_segments(line_frames(spark, d, _syn(option_bytes(), body, flags, c("l_orderkey") % 2, c("l_orderkey") % 3))))


@query(f"SELECT {LINE} AS frame, {OPTIONS_SQL} AS opts, {QUIRKS_SQL} AS ql FROM lineitem")
def tcp_options(spark, d):
    rows = _stack(spark, d).select("frame", ff.feature_map(F.col("features")).alias("m"))
    return rows.select("frame", F.col("m")["opts"].alias("opts"), F.col("m")["ql"].alias("ql"))


@query(f"""SELECT {LINE} AS frame, {ROLE_SQL} AS role, 'tcpip2|' || {ROLE_SQL} || '|ip=4|ttl=' || (l_partkey % 255 + 1) || '|it=' || CASE WHEN l_partkey % 255 < 32 THEN 32 WHEN l_partkey % 255 < 64 THEN 64 WHEN l_partkey % 255 < 128 THEN 128 ELSE 255 END
 || '|olen=' || CASE l_linenumber % 4 WHEN 0 THEN 20 WHEN 1 THEN 12 WHEN 2 THEN 8 ELSE 24 END || '|win=' || (l_partkey * 13 % 65536) || '|mss=' || CASE WHEN l_linenumber % 4 = 3 THEN '' ELSE (l_partkey % 65536)::VARCHAR END
 || '|ws=' || CASE l_linenumber % 4 WHEN 0 THEN (l_suppkey % 15)::VARCHAR WHEN 1 THEN '0' ELSE '' END || '|sack=' || CASE WHEN l_linenumber % 4 < 2 THEN '1' ELSE '0' END
 || '|ts=' || CASE WHEN l_linenumber % 4 > 0 THEN '' WHEN l_linenumber % 3 = 0 THEN 'zero' ELSE 'nz' END || '|opts=' || {OPTIONS_SQL} || '|df=' || (l_orderkey % 2) || '|plen=' || CASE WHEN l_linenumber % 5 = 0 THEN 2 ELSE 0 END || '|ql=' || {QUIRKS_SQL} AS features FROM lineitem""")  # fmt: skip
def tcpip_features(spark, d):
    return _stack(spark, d).select("frame", "role", "features")


QUERIES["tcpip_quirks"] = lambda spark, d: tcp_options(spark, d).groupBy("ql").agg(F.count(F.lit(1)).alias("n"))
ORACLES["tcpip_quirks"] = f"SELECT ql, count(*) AS n FROM ({ORACLES['tcp_options']}) GROUP BY ql"


@query(f"SELECT {LINE} AS frame, CASE WHEN l_partkey & 16 > 0 THEN 'server' ELSE 'client' END AS role FROM lineitem WHERE l_partkey & 7 IN (2)")
def syn_only(spark, d):
    rows = tcp_segments(line_frames(spark, d, _syn(raw(""), flags=c("l_partkey").bitwiseAND(0x17)))).where("flags & 8 = 0")
    return tcpip(rows).select("frame", "role")


# TLS and DTLS

def order_key() -> Column:
    return c("o_orderkey").alias("frame")

def _cipher() -> Column:
    return c("o_orderkey") % 200 + 4865

def _group() -> Column:
    return c("o_custkey") % 30 + 1



def order_found(spark: SparkSession, d: str, payload: Column, parse, transport: str = "tcp") -> DataFrame:
    """frame, protocol, role, features of payloads that travel in whole frames."""
    make = s.tcp4 if transport == "tcp" else s.udp4
    frames = spread(spark, d, "orders").select(order_key(), make(payload, c("o_orderkey"), c("o_custkey"), c("o_orderkey") % 60000 + 1024, 443 if transport == "tcp" else 4433).alias("payload"))
    rows = tcp_segments(frames) if transport == "tcp" else udp_datagrams(frames)
    return rows.select("frame", F.explode(parse("body")).alias("f")).select("frame", "f.*")


def client_extensions() -> Column:
    return F.concat(
        s.extension(0x1A1A, raw("")),
        s.extension(10, F.concat(raw("0006"), s.u16s(0x2A2A, _group(), 23))),
        s.extension(11, raw("0100")),
        s.extension(16, prefixed(F.concat(prefixed(text(F.lower(F.substring("o_orderpriority", 3, 4))), 1), raw("026832")), 2)),
        s.extension(43, F.concat(raw("04"), s.u16s(0x3A3A, 772))),
        s.extension(13, F.concat(raw("0004"), s.u16s(1027, 2052))),
    )


CLIENT_SQL = "v=771|c=' || (o_orderkey % 200 + 4865) || '-4866|e=10-11-16-43-13|g=' || (o_custkey % 30 + 1) || '-23|p=0|sv=772|alpn=' || lower(substr(o_orderpriority, 3, 4)) || ',h2|sig=1027-2052'"


@query(f"SELECT o_orderkey AS frame, 'tls' AS protocol, 'client' AS role, 'tls|client|{CLIENT_SQL} AS features FROM orders")
def tls_client(spark, d):
    hello = s.hello_client(771, s.u16s(0x0A0A, _cipher(), 4866), client_extensions())
    return order_found(spark, d, s.record(s.handshake(1, hello)), messages.tcp_messages)


@query("SELECT o_orderkey AS frame, 'tls' AS protocol, 'server' AS role, 'tls|server|v=' || (769 + o_orderkey % 3) || '|c=' || (o_orderkey % 200 + 4865) || '|e=' || CASE WHEN o_orderkey % 2 = 0 THEN '43-51' ELSE '' END || '|sv=' || CASE WHEN o_orderkey % 2 = 0 THEN '772' ELSE '' END AS features FROM orders")
def tls_server(spark, d):
    more = s.hello_server(c("o_orderkey") % 3 + 769, _cipher(), F.concat(s.extension(43, raw("0304")), s.extension(51, raw("001D0000")), s.extension(0x4A4A, raw(""))))
    none = s.hello_server(c("o_orderkey") % 3 + 769, _cipher(), None)
    return order_found(spark, d, s.record(s.handshake(2, F.when(c("o_orderkey") % 2 == 0, more).otherwise(none))), messages.tcp_messages)


def _server() -> Column:
    return s.hello_server(771, _cipher(), None)



@query("SELECT o_orderkey AS frame, 'tls|server|v=771|c=' || (o_orderkey % 200 + 4865) || '|e=|sv=' AS features FROM orders WHERE o_orderkey % 2 = 0")
def tls_truncated_record(spark, d):
    """A later record that is cut off voids the segment, hellos before it included."""
    cut = F.when(c("o_orderkey") % 2 == 0, raw("1503010001")).otherwise(raw("16030100FF01"))
    whole = F.when(c("o_orderkey") % 2 == 0, F.concat(cut, raw("00"))).otherwise(cut)
    return order_found(spark, d, F.concat(s.record(s.handshake(2, _server())), whole), messages.tcp_messages).select("frame", "features")


@query("SELECT o_orderkey AS frame, 'tls|server|v=771|c=' || (o_orderkey % 200 + 4865) || '|e=|sv=' AS features FROM orders")
def tls_coalesced(spark, d):
    """Of several messages in a record only the first is read."""
    both = F.concat(s.handshake(2, _server()), s.handshake(1, s.hello_client(771, s.u16s(1), None)))
    return order_found(spark, d, s.record(both), messages.tcp_messages).select("frame", "features")


@query(f"SELECT o_orderkey AS frame, 'dtls|client|{CLIENT_SQL} AS features FROM orders")
def dtls_client(spark, d):
    hello = s.hello_client(771, s.u16s(_cipher(), 4866), client_extensions(), cookie=raw("C00C1E"))
    return order_found(spark, d, s.dtls_record(1, hello), messages.dtls_messages, "udp").select("frame", "features")


@query("SELECT o_orderkey AS frame, 'dtls|server|v=65277|c=' || (o_orderkey % 200 + 4865) || '|e=23|sv=' AS features FROM orders")
def dtls_server(spark, d):
    return order_found(spark, d, s.dtls_record(2, s.hello_server(0xFEFD, _cipher(), s.extension(23, raw("")))), messages.dtls_messages, "udp").select("frame", "features")


@query("SELECT o_orderkey AS frame, 'dtls|server|v=65277|c=' || (o_orderkey % 200 + 4865) || '|e=23|sv=' AS features FROM orders WHERE o_orderkey % 3 > 0")
def dtls_fragment_skip(spark, d):
    """Fragments are passed over; another whole hello in the datagram counts, and a record of another kind ends it."""
    hello = s.hello_server(0xFEFD, _cipher(), s.extension(23, raw("")))
    part = s.dtls_record(2, F.substring(hello, 1, 20), whole=F.octet_length(hello))
    other = F.when(c("o_orderkey") % 3 == 0, raw("30FEFD" + "0" * 20)).otherwise(raw(""))
    return order_found(spark, d, F.concat(part, other, s.dtls_record(2, hello)), messages.dtls_messages, "udp").select("frame", "features")


# RDP, IKE, SSH


@query("SELECT p_partkey AS frame, 'client' AS role, 'rdp|client|tpkt_v=3|tpkt_rsv=0|tpkt_len=19|x224_len=14|pdu=224|dst_ref=0|src_ref=' || (p_partkey % 65536) || '|class=0|neg_type=1|neg_flags=0|neg_len=8|neg_proto=' || p_size || '|neg_selected=' AS features FROM part")
def rdp_request(spark, d):
    return part_found(spark, d, s.tpkt(0xE0, 0, c("p_partkey") % 65536, s.negotiation(1, 0, c("p_size"))), messages.rdp_messages, 3389)


@query("SELECT p_partkey AS frame, 'server' AS role, 'rdp|server|tpkt_v=3|tpkt_rsv=0|tpkt_len=' || CASE WHEN p_size % 2 = 0 THEN 19 ELSE 11 END || '|x224_len=' || CASE WHEN p_size % 2 = 0 THEN 14 ELSE 6 END || '|pdu=208|dst_ref=' || (p_partkey % 65536) || '|src_ref=4660|class=0|neg_type=' || CASE WHEN p_size % 2 = 0 THEN '2|neg_flags=' || (p_size % 256) || '|neg_len=8|neg_proto=|neg_selected=2' ELSE '|neg_flags=|neg_len=|neg_proto=|neg_selected=' END AS features FROM part")
def rdp_confirm(spark, d):
    rest = F.when(c("p_size") % 2 == 0, s.negotiation(2, c("p_size") % 256, 2)).otherwise(raw(""))
    return part_found(spark, d, s.tpkt(0xD0, c("p_partkey") % 65536, 4660, rest), messages.rdp_messages, 3389)


@query("SELECT p_partkey AS frame, 'client' AS role, 'rdp|client|tpkt_v=3|tpkt_rsv=0|tpkt_len=' || (38 + length(p_brand)) || '|x224_len=' || (33 + length(p_brand)) || '|pdu=224|dst_ref=0|src_ref=0|class=0|neg_type=1|neg_flags=0|neg_len=8|neg_proto=11|neg_selected=' AS features FROM part")
def rdp_cookie(spark, d):
    cookie = F.concat(text(F.concat(F.lit("Cookie: mstshash="), "p_brand")), raw("0D0A"), s.negotiation(1, 0, 11))
    return part_found(spark, d, s.tpkt(0xE0, 0, 0, cookie), messages.rdp_messages, 3389)


def part_found(spark: SparkSession, d: str, payload: Column, parse, port: int, transport: str = "tcp") -> DataFrame:
    make = s.tcp4 if transport == "tcp" else s.udp4
    frames = table(spark, d, "part").select(c("p_partkey").alias("frame"), make(payload, c("p_partkey"), c("p_size"), c("p_partkey") % 60000 + 1024, port).alias("payload"))
    rows = tcp_segments(frames) if transport == "tcp" else udp_datagrams(frames)
    return rows.select("frame", F.explode(parse("body")).alias("f")).select("frame", "f.role", "f.features")


def _sa(protocol: Column | int = 1) -> Column:
    one = s.ike_proposal(False, c("p_size") % 200 + 1, protocol, [s.ike_transform(False, 1, 20, 256), s.ike_transform(False, 2, 5), s.ike_transform(True, 4, c("p_partkey") % 50)])
    return F.concat(one, s.ike_proposal(True, 2, protocol, [s.ike_transform(True, 1, 12, 128)]))


def _ike(sa: Column, flags: Column | int = 8) -> Column:
    chain = F.concat(s.ike_payload(34, sa), s.ike_payload(40, F.concat(u16(c("p_partkey") % 50), raw("0000AABB"))), s.ike_payload(41, raw("1122")), s.ike_payload(0, raw("01004004CAFE")))
    return s.ike_message(33, chain, flags)


IKE_SQL = "|v=2.0|ex=34|flags=' || {flags} || '|np=33|p=33-34-40-41|sa={p}:1=20.256,2=5,4=' || (p_partkey % 50) || ';{q}:1=12.128|ke=' || (p_partkey % 50) || '|n=16388' AS features FROM part"


@query("SELECT p_partkey AS frame, 'initiator' AS role, 'ike|initiator" + IKE_SQL.format(flags=8, p=1, q=1))
def ike_init(spark, d):
    return part_found(spark, d, _ike(_sa()), messages.ike_messages, 500, "udp")


@query("SELECT p_partkey AS frame, 'responder' AS role, 'ike|responder" + IKE_SQL.format(flags=32, p=1, q=1))
def ike_natt(spark, d):
    """Four zero bytes before the message are passed over."""
    return part_found(spark, d, F.concat(raw("00000000"), _ike(_sa(), 32)), messages.ike_messages, 4500, "udp")


@query("SELECT p_partkey AS frame, 'initiator' AS role, 'ike|initiator" + IKE_SQL.format(flags=8, p="' || (p_size % 200 + 1) || '", q=2))
def ike_sa(spark, d):
    """A proposal of protocol 0 shows its own number."""
    return part_found(spark, d, _ike(_sa(0)), messages.ike_messages, 500, "udp")


@query("SELECT p_partkey AS frame FROM part WHERE p_partkey % 3 = 1")
def ike_port_filter(spark, d):
    port = F.when(c("p_partkey") % 3 == 1, 500).otherwise(501)
    frames = table(spark, d, "part").select(c("p_partkey").alias("frame"), s.udp4(_ike(_sa()), c("p_partkey"), c("p_size"), F.lit(9999), port).alias("payload"))
    rows = udp_datagrams(frames).where(messages.maybe_ike(F.col("sport"), F.col("dport"), F.col("body")))
    return rows.select("frame")


def ssh_lists() -> list[Column]:
    return [F.lit(x) for x in ("curve25519-sha256,ecdh-sha2-nistp256", "ssh-ed25519")] + [F.col("s_name")] * 2 + [F.lit(x) for x in ("hmac-sha2-256", "hmac-sha2-512", "none", "zlib", "", "")]

SSH_SQL = "kex=curve25519-sha256,ecdh-sha2-nistp256|hostkey=ssh-ed25519|enc_c2s=' || s_name || '|enc_s2c=' || s_name || '|mac_c2s=hmac-sha2-256|mac_s2c=hmac-sha2-512|comp_c2s=none|comp_s2c=zlib|lang_c2s=|lang_s2c="


@query("SELECT s_suppkey AS frame, 'ssh|peer|id=' || s_name || '|" + SSH_SQL + "|follows=' || CASE WHEN s_suppkey % 2 = 1 THEN 'True' ELSE 'False' END AS features FROM supplier")
def ssh_inline(spark, d):
    payload = F.concat(s.ssh_banner(F.col("s_name")), s.ssh_kexinit(ssh_lists(), c("s_suppkey") % 2))
    frames = table(spark, d, "supplier").select(c("s_suppkey").alias("frame"), s.tcp4(payload, c("s_suppkey"), c("s_nationkey"), F.lit(22), 40000).alias("payload"))
    return tcp_segments(frames).select("frame", F.explode(messages.ssh_messages("body")).alias("f")).select("frame", "f.features")


# X.509

_NAME = {"cn": "550403", "o": "55040A"}


def _certificate(extensions: Column | None) -> Column:
    key = F.unhex(F.repeat(F.lit("04"), 65))
    issuer = s.distinguished((_NAME["cn"], F.lit("CA, Root|1")), (_NAME["o"], F.col("c_mktsegment")))
    subject = s.distinguished((_NAME["cn"], F.col("c_name")))
    serial = F.concat(raw("00"), u32(c("c_custkey")))
    ends = F.concat(F.lpad((c("c_nationkey") % 20 + 24).cast("string"), 2, "0"), F.lit("0101000000Z"))
    return s.certificate(serial, issuer, subject, F.lit("230101000000Z"), ends, key, extensions)


def _san() -> Column:
    host = text(F.concat(F.lit("h"), c("c_custkey").cast("string"), F.lit(".example")))
    return s.sequence(s.der(0x82, host), s.der(0x87, raw("0A000001")), s.der(0x81, text(F.lit("a@b.c"))), s.der(0xA4, raw("3000")))


def certificate_found(spark: SparkSession, d: str, certificates: list[Column], extra: Column | None = None) -> DataFrame:
    listed = F.concat(*(F.concat(prefixed(x, 3), *([extra] if extra is not None else [])) for x in certificates))
    body = prefixed(listed, 3) if extra is None else F.concat(raw("00"), prefixed(listed, 3))
    frames = spread(spark, d, "customer").select(c("c_custkey").alias("frame"), s.tcp4(s.record(s.handshake(11, body)), c("c_custkey"), c("c_nationkey"), F.lit(443), 50000).alias("payload"))
    rows = tcp_segments(frames).select("frame", F.explode(messages.tcp_messages("body")).alias("f"))
    return rows.select("frame", "f.protocol", "f.role", "f.features")


def x509_sql(idx: int, san: str, ext: str, tail: str = "") -> str:
    days = "date_diff('day', DATE '2023-01-01', make_date(2000 + c_nationkey % 20 + 24, 1, 1))"
    serial = "CASE WHEN c_custkey < 256 THEN 1 WHEN c_custkey < 65536 THEN 2 ELSE 3 END"
    return rf"""'x509|server|idx={idx}|ver=3|serial_len=' || {serial} || '|sig=1.2.840.113549.1.1.11|tbs_sig=1.2.840.113549.1.1.11|issuer=2.5.4.3=CA\, Root\|1,2.5.4.10=' || c_mktsegment || '|subject=2.5.4.3=' || c_name
 || '|valid_days=' || {days} || '|spki_alg=1.2.840.10045.2.1|spki_param=1.2.840.10045.3.1.7|pk_bits=520|san=' || {san} || '{tail}|ext={ext}'"""


SAN_SQL = "'dns:h' || c_custkey || '.example,ip:10.0.0.1,email:a@b.c,gn164:' || substr(sha256('\\x30\\x00'::BLOB), 1, 16)"
_NONE_TAIL = "|ku=|eku=|bc=|ski=|aki=|pol=|aia=|crldp=|nc="


@query(f"SELECT c_custkey AS frame, 'x509' AS protocol, 'server' AS role, {x509_sql(0, chr(39) * 2, '', _NONE_TAIL)} AS features FROM customer")
def x509_leaf(spark, d):
    return certificate_found(spark, d, [_certificate(None)])


@query(f"""SELECT c_custkey AS frame, 'x509' AS protocol, 'server' AS role, {x509_sql(0, SAN_SQL, '0:2.5.29.17-1:2.5.29.15-0:2.5.29.37-1:2.5.29.19-0:2.5.29.14-0:2.5.29.32',
 "|ku=030205a0|eku=1.3.6.1.5.5.7.3.1-1.3.6.1.5.5.7.3.2|bc=ca:1,path:3|ski=' || substr(sha256(unhex('0402' || lpad(to_hex(c_custkey % 65536), 4, '0'))), 1, 16) || '|aki=|pol=2.23.140.1.2.1|aia=|crldp=|nc=")} AS features FROM customer""")  # fmt: skip
def x509_san(spark, d):
    e = s.certificate_extension
    usages = s.sequence(s.oid("2B06010505070301"), s.oid("2B06010505070302"))
    more = [e("551D11", _san()), e("551D0F", raw("030205A0"), True), e("551D25", usages), e("551D13", raw("30060101FF020103"), True), e("551D0E", F.concat(raw("0402"), u16(c("c_custkey") % 65536))), e("551D20", s.sequence(s.sequence(s.oid("67810C010201"))))]
    return certificate_found(spark, d, [_certificate(F.concat(*more))])


@query(f"SELECT c_custkey AS frame, {x509_sql(0, chr(39) * 2, '', _NONE_TAIL)} AS features FROM customer UNION ALL SELECT c_custkey AS frame, {x509_sql(1, chr(39) * 2, '', _NONE_TAIL)} AS features FROM customer")
def x509_chain(spark, d):
    """The layout with a context length and extensions behind each certificate gives the whole chain."""
    return certificate_found(spark, d, [_certificate(None)] * 2, raw("0000")).select("frame", "features")


@query(f"SELECT c_custkey AS frame, {x509_sql(0, chr(39) * 2, '', _NONE_TAIL)} AS features FROM customer")
def x509_chain_old(spark, d):
    """In the older layout the next certificate's length is misread, so only the first certificate shows."""
    return certificate_found(spark, d, [_certificate(None)] * 2).select("frame", "features")


# Lookups

@query("SELECT p_partkey AS frame, string_agg(name, ',' ORDER BY pos) AS names FROM part, (VALUES (0,'SA'),(1,'KE'),(2,'Nonce'),(3,'Notify')) AS v(pos, name) GROUP BY p_partkey")
def payload_names(spark, d):
    """Codes of exploded lists joined to a small table of names."""
    names = spark.createDataFrame(list(IKE_PAYLOADS.items()), "code int, name string")
    codes = F.split(ff.feature_map(F.col("features"))["p"], "-")
    rows = ike_init(spark, d).select("frame", F.posexplode(codes).alias("pos", "code")).withColumn("code", F.col("code").cast("int"))
    named = rows.join(F.broadcast(names), "code", "left")
    return named.groupBy("frame").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), ",").alias("names"))



"""Parsers against published example strings and hand-made bytes."""

import pytest

from shakeprint.functions.features import simhash_of
from shakeprint.functions.wire import Malformed
from shakeprint.operators import active, dissector, ike, quic, rdp, ssh, tcpip, tls, x509
from shakeprint.sources import capture, probes, records


def test_simhash_vector():
    assert simhash_of("tls|server|v=771|c=4865|e=43-51|sv=772") == "27e858630013202205e751ce7a23bcea"
    assert len(simhash_of("")) == 32 and simhash_of("a=a") == simhash_of("a")


def test_tcp_options():
    o = tcpip.read_options(bytes.fromhex("020405b40402080a000000010000000001030307"))
    assert ",".join(o["tokens"]) == "mss1460,sackok,ts,nop,ws7" and (o["mss"], o["ws"], o["sack"], o["ts"], o["quirks"]) == ("1460", "7", "1", "nz", [])
    assert tcpip.read_options(b"\x02")["tokens"] == ["bad2"] and tcpip.read_options(b"\x02")["quirks"] == ["trunc-opt"]
    assert tcpip.read_options(b"\x02\x01")["quirks"] == ["bad-opt-len"]
    assert tcpip.read_options(b"\x00\x00\x01")["quirks"] == ["nz-eol-pad"]
    assert tcpip.read_options(b"\x04\x03\xff")["tokens"] == ["opt4:ff"]


def test_tls_records():
    hello = probes.tls_hello("TLSv1.2")
    ((protocol, role, features),) = tls.tls_messages(hello)
    assert (protocol, role) == ("tls", "client") and "|sv=|alpn=h2,http/1.1|sig=1025-1027-1281-1283-513" in features
    assert tls.tls_messages(hello + b"\x17\x03\x03\x00\x01\x00") == tls.tls_messages(hello)
    with pytest.raises(Malformed):
        tls.tls_messages(hello + b"\x16\x03\x03\x00\x05\x00")
    with pytest.raises(Malformed):
        tls.tls_messages(b"SSH-2.0-x\r\n")
    assert tls.tls_messages(hello + b"\x16\x03") == tls.tls_messages(hello)


def test_repeated_extension_and_short_body():
    body = b"\x03\x03" + bytes(32) + b"\0" + b"\0\x02\x13\x01" + b"\x01\0"
    ext = bytes.fromhex("000a0006000400170018") + bytes.fromhex("000a00040002001d") + bytes.fromhex("002b00ff02")
    features = tls.client_hello(body + len(ext).to_bytes(2, "big") + ext)
    assert "|e=10-10-43|g=29|" in features and "|sv=|" in features


def test_dtls():
    role, features = tls.dtls_hello(probes.dtls_hello("DTLSv1.3", cookie=b"abc"))
    assert role == "client" and features.startswith("dtls|client|v=65277|c=4865-4867-4866-") and "|sv=65276-65277|" in features
    assert tls.dtls_hello(b"\x16\x03\x03" + bytes(30)) is None
    assert active.dtls_server(bytes.fromhex("16feff0000000000000000") + bytes.fromhex("0012") + bytes.fromhex("030000060000000000000006feff03aabbcc")) == (None, b"\xaa\xbb\xcc")


def test_rdp_examples():
    assert rdp.x224(probes.rdp_request(3)) == [("client", "rdp|client|tpkt_v=3|tpkt_rsv=0|tpkt_len=19|x224_len=14|pdu=224|dst_ref=0|src_ref=0|class=0|neg_type=1|neg_flags=0|neg_len=8|neg_proto=3|neg_selected=")]
    confirm = bytes.fromhex("030000130ed00000123400020108000200 0000".replace(" ", ""))
    ((role, features),) = rdp.x224(confirm)
    assert role == "server" and features.endswith("|pdu=208|dst_ref=0|src_ref=4660|class=0|neg_type=2|neg_flags=1|neg_len=8|neg_proto=|neg_selected=2")
    assert active.rdp_server(confirm) == features and active.rdp_server(probes.rdp_request()) is None
    assert rdp.x224(confirm[:-1]) == [] and len(rdp.x224(confirm * 2)) == 2
    with pytest.raises(Malformed):
        rdp.x224(confirm[:-1], strict=True)


def test_ike():
    role, features = ike.message(probes.ike_init())
    assert role == "initiator" and features == "ike|initiator|v=2.0|ex=34|flags=8|np=33|p=33-34-40|sa=1:1=12.256,2=5,3=12,4=14;1:1=12.128,2=2,3=2,4=14;1:1=20.256,2=5,4=14|ke=14|n="
    assert ike.message(probes.ike_init(port=4500)) == (role, features)
    refused = bytes(range(1, 17)) + bytes([41, 0x20, 34, 0x20]) + bytes(4) + (36).to_bytes(4, "big") + bytes.fromhex("000000080000000e")
    assert ike.message(refused) == ("responder", "ike|responder|v=2.0|ex=34|flags=32|np=41|p=41|sa=|ke=|n=14")
    assert ike.message(refused, active=True) is None
    assert ike.proposals(bytes.fromhex("0000000805000000")) == "5:" and ike.proposals(bytes.fromhex("0000000805000000"), True) == "0:"
    assert ike.message(b"\0" * 60) is None


def test_ssh():
    lists = ["curve25519-sha256,ecdh-sha2-nistp256", "rsa-sha2-512"] + ["x"] * 8
    body = b"\x14" + bytes(16) + b"".join(len(x).to_bytes(4, "big") + x.encode() for x in lists) + b"\x00" + bytes(4)
    packet = (len(body) + 5).to_bytes(4, "big") + b"\x04" + body + bytes(4)
    role, features = ssh.inline(b"SSH-2.0-TestSSH_1.0\r\n" + packet)
    assert features.startswith("ssh|peer|id=TestSSH_1.0|kex=curve25519-sha256,ecdh-sha2-nistp256|hostkey=rsa-sha2-512|") and features.endswith("|follows=False")
    assert ssh.kexinit(packet[:-1]) is None and ssh.banner(b"SSH-2.0-x") is None
    assert ssh.banner(b"SSH-2.0\n")[0] == "SSH-2.0" and ssh.banner(b"SSH-2.0-a-b c\n")[0] == "a-b c"
    assert active.ssh_server(b"hello\r\nSSH-2.0-x\r\n") == ssh.features("x") and active.ssh_server(b"a\n" * 30) is None


def test_quic_frames():
    data = bytes.fromhex("0001") + bytes.fromhex("0200000000") + bytes.fromhex("060003") + b"abc" + bytes.fromhex("060302") + b"de" + bytes.fromhex("1c000000") + bytes.fromhex("06100a")
    assert list(quic.crypto_frames(data)) == [(0, b"abc"), (3, b"de")]
    assert quic.contiguous({0: b"abc", 2: b"cd", 9: b"x"}) == b"abcd"
    assert list(quic.long_packets(b"\x40" + bytes(20))) == []


def test_der():
    assert x509.oid(bytes.fromhex("2a864886f70d01010b")) == "1.2.840.113549.1.1.11" and x509.oid(b"\x88\x37") == "3.16.55"
    with pytest.raises(Malformed):
        x509.node_of(b"\x30\x05\x02\x01")
    with pytest.raises(Malformed):
        x509.node_of(b"\x30\x80" * 5)
    deep = b""
    for _ in range(100):
        deep = b"\x30" + (len(deep).to_bytes(1, "big") if len(deep) < 128 else b"\x82" + len(deep).to_bytes(2, "big")) + deep
    with pytest.raises(Malformed):
        x509.node_of(deep)
    assert x509.general_name(x509.Node(0x87, bytes(16))) == "ip:::" and x509.general_name(x509.Node(0x87, b"abc")) == "ip:616263"
    assert x509.certificate_chain(b"\0\0\x04\0\0\x01\x30") == []


def test_proposals_of_dissected_fields():
    ids = {1: [12, 20], 2: [5], 3: [], 4: [14, 19], 5: []}
    assert dissector.proposals_of([1, 1], [3, 2], [1, 2, 4, 1, 4], ids, [256]) == "1:1=12.256,2=5,4=14;1:1=20,4=19"
    assert dissector.proposals_of([1], [], [1, 9], {1: [7]}, []) == "1:1=7,9=0"


def test_captures():
    frames = [b"a" * 20, b"b" * 3]
    assert [p for _, _, p in capture.frames(capture.pcap_bytes(frames))] == frames
    assert [p for _, _, p in capture.frames(capture.pcapng_bytes(frames))] == frames
    cut = capture.pcap_bytes(frames)[:-1]
    assert [p for _, _, p in capture.frames(cut)] == [frames[0], b"bb"]
    with pytest.raises(Malformed):
        list(capture.frames(b"nope"))
    assert list(capture.frames(b"\x0a\x0d\x0d\x0a" + (28).to_bytes(4, "big") + bytes(20))) == []


def test_json_values():
    assert list(records.json_values('{"a": 1}\n{"a": 2} [{"a": 3},\n{"a": 4}]')) == [{"a": k} for k in (1, 2, 3, 4)]
    for text, message in (("", "at least one"), ("3", "input must be"), ("[1]", "item 1"), ('{"a":1}\n{', "line 2")):
        with pytest.raises(ValueError, match=message):
            list(records.json_values(text))

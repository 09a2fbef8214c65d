"""Every query with an SQL twin against DuckDB over the smallest tables, and operators on edge cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from shakeprint import synth
from shakeprint.functions.features import checked_simhash, fingerprint_columns
from shakeprint.functions.lineage import materialise
from shakeprint.functions.wire import prefixed, raw, u16
from shakeprint.operators import active, dissector, flows, render, similarity
from shakeprint.operators.components import components, grow, grown
from shakeprint.plans import catalogue
from shakeprint.sources import records

#: Slow ones are left to the driver's own comparison.
SLOW = {"quic_fallback", "protocol_counts", "cluster_json", "jsonl_sink"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in catalogue.ORACLES if n not in SLOW))
def test_query(spark, sf_dir, duck, name):
    found = __spark_entry__.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (found, want))
    assert len(a) == len(b) and (a == b).all().all()


def test_dtls_cookie_of_every_part(spark, sf_dir):
    """The rows that active_dtls_cookie and its SQL leave out, too: cookies of fewer digits, and keys that wrap."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").union(spark.range(9000, 20001, 97).toDF("p_partkey"))
    key = F.col("p_partkey") * 7 % 65536
    body = F.concat(raw("FEFF"), prefixed(u16(key), 1))
    rows = parts.select(key.alias("key"), synth.dtls_record(3, body, 0xFEFF).alias("response"))
    got = rows.select("key", F.lower(F.hex(active.dtls_cookie("response"))).alias("cookie")).collect()
    assert len(got) == parts.count() > 200 and all(r.cookie == f"{r.key:04x}" for r in got) and any(r.key < 4096 for r in got)


def test_dissector_with_reserved_ciphers_only(spark):
    """The rows that dissector_tls and its SQL leave out: nothing is left of the cipher list."""
    held = {"tls_hs_type": [1], "tls_version": [771], "tls_cipher": [2570], "tls_ext_type": [6682, 10], "tls_groups": [2570, 29], "tls_points": [0], "tls_sv": [772], "tls_sig": [1027]}
    row = ["o", 1, "1", *(held.get(n) for n in dissector.INT_FIELDS), *(["h2"] if n == "tls_alpn" else None for n in dissector.TEXT_FIELDS)]
    kinds = ["capture string, frame long, stream string", *(f"{n} array<bigint>" for n in dissector.INT_FIELDS), *(f"{n} array<string>" for n in dissector.TEXT_FIELDS)]
    for cipher in (2570, 6682, 64250):
        row[3 + dissector.INT_FIELDS.index("tls_cipher")] = [cipher]
        got = dissector.dissect(spark.createDataFrame([tuple(row)], ", ".join(kinds))).collect()
        assert [r.features for r in got] == ["tls|client|v=771|c=|e=10|g=2570-29|p=0|sv=772|alpn=h2|sig=1027"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_components_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (7, 7), (200, 100)], "a int, b int")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 100}
    assert components(edges.limit(0)).count() == 0


def test_components_that_grow(spark):
    """After each batch of edges, what one run over all of them gives; old labels are never written again."""
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(5, 5), (200, 200)]
    label = {}
    labels, merges = (spark.createDataFrame([], s) for s in ("node long, component long", "component long, into long"))
    for at in range(0, len(edges), 24):
        batch = edges[at : at + 24]
        added, merges = grow(labels, merges, spark.createDataFrame([*batch, (None, 3)], "a long, b long"))
        added, merges = materialise(added), materialise(merges)
        for a, b in batch:
            for x in (a, b):
                label.setdefault(x, x)
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
        assert added.join(labels, "node").count() == 0
        labels = labels.unionByName(added)
        assert {r.node: r.component for r in grown(labels, merges).collect()} == label
    assert merges.count() == merges.select("component").distinct().count()


def test_threshold_checks(spark):
    for bad in (-1, 129):
        with pytest.raises(ValueError):
            similarity.check_arguments(bad)
    with pytest.raises(ValueError):
        similarity.check_arguments(1, 0)
    for text in (None, "12", "z" * 32):
        with pytest.raises(Exception, match="simhash128"):
            spark.createDataFrame([(text,)], "s string").select(checked_simhash(F.col("s"))).collect()
    assert spark.createDataFrame([("0X" + "A" * 32,)], "s string").select(checked_simhash(F.col("s"))).first()[0] == "a" * 32


def test_pairs_for_many_thresholds(spark):
    import random

    rng = random.Random(0)
    base = rng.getrandbits(128)
    hashes = [base ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(0, 9))) for _ in range(60)] * 2
    df = spark.createDataFrame([(k, f"{h:032x}", "p", "r", "m") for k, h in enumerate(hashes)], "record long, simhash128 string, protocol string, role string, mode string")
    recs = similarity.records(df)
    for t in (0, 1, 3, 12, 63, 127, 128):
        want = {(a, b, (hashes[a] ^ hashes[b]).bit_count()) for b in range(len(hashes)) for a in range(b) if (hashes[a] ^ hashes[b]).bit_count() <= t}
        for how in (["loop"] if t == 0 else [None] if t == 128 else ["loop", "index"]):
            assert {tuple(r) for r in similarity.record_pairs(recs, t, how).collect()} == want, (t, how)


def test_first_seen_and_renderers(spark):
    rows = spark.createDataFrame([("c", "tls", "server", "f", "a", 1, "b", 2, 0, 5, 0), ("c", "tls", "server", "f", "a", 1, "b", 2, 0, 3, 1), ("d", "tls", "server", "f", "a", 1, "b", 2, 0, 9, 0)], "capture string, protocol string, role string, features string, src string, sport int, dst string, dport int, stage int, frame int, place int")
    assert sorted((r.capture, r.frame) for r in flows.first_seen(rows).collect()) == [("c", 3), ("d", 9)]
    o = fingerprint_columns(rows.limit(1)).withColumn("flow", F.struct("src", "sport", "dst", "dport")).select("capture", "features", "flow", "frame", "mode", "stage", "place")
    assert render.jsonl(o).first().line == '{"features":"f","flow":{"dport":2,"dst":"b","sport":1,"src":"a"},"frame":5,"mode":"passive"}'
    none = spark.createDataFrame([], "line string")
    assert [r.line for r in render.text_or(none, "No clusters found at Hamming distance <= 12.").collect()] == ["No clusters found at Hamming distance <= 12."]
    label = spark.createDataFrame([({"src": None, "sport": 1, "dst": "b", "dport": None},)], f"flow {records.FLOW}").select(render.flow_label(F.col("flow"))).first()[0]
    assert label == "?:1 -> b:?"


def test_read_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"simhash128": "' + "0" * 32 + '", "flow": {"src": "x"}}\n[{"protocol": "p"}, {}]')
    (tmp_path / "b.json").write_text('{"role": "r"}')
    rows = records.read_records(spark, str(tmp_path)).orderBy("record").collect()
    assert [r.record for r in rows] == [1, 2, 3, 4] and rows[0].flow.src == "x" and rows[1].protocol == "p" and rows[3].role == "r"

import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from shakeprint.llm import language_id, toxicity
from shakeprint.llm.common import materialise, table
from tests.llm.test_dedup import brute_components, brute_exact, brute_fingerprint
from tests.llm.test_tokens import check_pieces


def test_names_and_stages():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "exact_dedup", "simhash", "packing"]


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        at[name] = docs
        docs = stage(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == columns
            docs = materialise(docs)
    rows = {n: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()] for n, df in at.items()}
    model = toxicity.train(at["toxicity"], table(spark, sf_dir, "labels"))
    scores = model.scores(model.marginals([t for _, t in rows["toxicity"]]))
    assert {i for i, _ in rows["language_id"]} == {i for (i, _), s in zip(rows["toxicity"], scores, strict=True) if s < 0.5}
    parser = language_id.CrossParser(dict(language_id.train(at["language_id"])))
    kept = {i for (i, _), (lang, _, rate) in zip(rows["language_id"], parser.predict([t for _, t in rows["language_id"]]), strict=True) if lang != "und" and rate <= language_id.MAX_PHRASES}
    assert {i for i, _ in rows["exact_dedup"]} == kept
    assert {i for i, _ in rows["simhash"]} == {x[0] for x in brute_exact(rows["exact_dedup"]) if x[3]}
    fps = [(i, brute_fingerprint(t)) for i, t in rows["simhash"]]
    assert {i for i, _ in rows["packing"]} == {i for (i, _), c in zip(fps, brute_components(fps), strict=True) if i == c}
    pieces = docs.collect()
    check_pieces(pieces, dict(rows["packing"]), 2048)
    run = corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32")
    assert sorted(map(tuple, run.collect())) == sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces)


def test_languages_that_no_one_speaks_go(spark):
    learned = (("en", "the quick brown fox jumps over the lazy dog and runs away " * 20),)
    rows = [(1, "the lazy dog runs over the fox"), (2, "1234 !!"), (3, "qzx vkw jqp xzv qqk"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    out = {r.doc_id: r.rejected for r in language_id.rejects(language_id.identify(df, learned)).collect()}
    assert out == {1: False, 2: True, 3: True, 4: True}


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, and columns named like those that the stages make."""
    text = "the quick brown fox jumps over the lazy dog and runs away from every hound in town "
    rows = [(k, text + f"number {'abcdefghij'[k % 10] * 3} " * 5, "en", "s") for k in range(40)]
    rows += [(50, None, None, None), (51, "", "en", "s"), (52, "", "en", "s"), (53, rows[3][1], "en", "s"), (3, rows[3][1], "en", "s"), (None, rows[4][1] + " more", "en", "s"), (54, "12 !!", "en", "s"), (55, " \n", "fr", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = docs.withColumns({n: F.lit(n) for n in ("row", "_kept", "id", "k", "score", "rejected", "kept", "component_id", "start")})
    spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for df in (clash, clash.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            if name != "packing":
                assert out.columns == clash.columns, name
            found = out.collect()
            if df is not clash:
                assert found == []
                continue
            ids = sorted((r.doc_id for r in found), key=str)
            if name == "toxicity":  # the labels tell nothing here
                assert len(found) == len(rows)
            elif name == "language_id":
                assert sorted((r[0] for r in rows if any(map(str.isalpha, r[1] or ""))), key=str) == ids
            elif name == "exact_dedup":
                want = [x[0] for x in brute_exact([(r[0], r[1]) for r in rows]) if x[3]]
                assert ids == sorted(want, key=str)
            elif name == "simhash":
                fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
                named = dict(zip((i for i, _ in fps), brute_components(fps), strict=True))
                assert set(ids) - {None} == {i for i, c in named.items() if i is not None and i == c}
            else:
                assert sum(r.start == 0 for r in found) == len(rows)


def test_toxicity_stage_drops_labelled_rows(spark):
    """Against the labels, not the model: of rows that nothing is learned from, and of all."""
    sf_dir = "/root/testdata/sf0.1"
    if not Path(sf_dir).exists():
        pytest.skip("the driver's tables aren't here")
    docs = table(spark, sf_dir, "documents")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).select("doc_id").collect()}
    toxic = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").where("toxic is not null").collect()}
    texts = {r.doc_id for r in docs.select("doc_id").collect()}
    for some in (texts, {k for k in texts if zlib.crc32(str(k).encode()) % 5 == 0}):
        dropped = [k for k in some if toxic.get(k) == 1 and k not in kept]
        marked = [k for k in some if toxic.get(k) == 1]
        clean = [k for k in some if toxic.get(k) == 0]
        assert len(dropped) >= 20 and len(dropped) >= 0.9 * len(marked), (len(dropped), len(marked))
        assert sum(k in kept for k in clean) >= 0.99 * len(clean)
    assert len(kept) > 0.8 * len(texts)

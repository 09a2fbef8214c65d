"""op11 to op13: against plain loops over the libraries' own results, and the SQL twin of the draw."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shakeprint.llm import align, common, queries, resample, token_counts
from shakeprint.llm.byte_bpe import byte_characters

A, B, W = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
FIRST = Tokenizer.from_file(A)
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=B)
WORDS = Tokenizer.from_file(W)
BYTE_OF = {c: b for b, c in enumerate(byte_characters())}
ALIGNER, PRE = align.Aligner(A, B), token_counts.PreTokens(W)
PARTS = [*" \n\t\r\x0b\x1c\x85\xa0 　'sabZ.,!1²İẞñ́😀ῼ▁\x00", "<|endoftext|>", "<|startoftext|>", "<s>", "<0x0A>", " the", " word", ");\r", "'ll"]
TEXT = st.lists(st.one_of(st.sampled_from(PARTS), st.characters(exclude_categories=["Cs"])), max_size=30).map("".join)


def aligned(text):
    """(a ids, b ids, groups, linked pairs) by a loop over bytes; None without tokens."""
    if not text:
        return None
    ids = FIRST.encode(" " + text, add_special_tokens=False).ids, SECOND.encode(text)
    spelled = (
        [bytes(BYTE_OF[c] for c in FIRST.id_to_token(i)) for i in ids[0]],
        [bytes([int(SECOND.id_to_piece(i)[3:5], 16)]) if SECOND.is_byte(i) else SECOND.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
    )
    if any(b"".join(x) != (" " + text).encode() for x in spelled):
        return None
    owner = [[k for k, t in enumerate(x) for _ in t] for x in spelled]
    pairs = list(dict.fromkeys(zip(*owner, strict=True)))  # a byte's two tokens overlap
    groups, held, ends = [], ([], []), [set(np.cumsum([len(t) for t in x]).tolist()) for x in spelled]
    for at in range(1, len(owner[0]) + 1):
        for k in (0, 1):
            if at in ends[k]:
                held[k].append(str(ids[k][owner[k][at - 1]]))
        if at in ends[0] and at in ends[1]:
            groups.append(",".join(held[0]) + "|" + ",".join(held[1]))
            held = ([], [])
    return ids[0], ids[1], groups, [(ids[0][x], ids[1][y]) for x, y in pairs]


def alignment_rows(docs):
    """What align() returns, of (doc_id, text) pairs."""
    found = [(k, aligned(t)) for k, t in docs]
    count = Counter(p for _, x in found if x for p in x[3])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for k, x in found:
        yield (k, 0, 0, 0, 0, 0, 0, "") if x is None else (
            k, len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(count[p] == most[p[1]] for p in x[3]), sum(count[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest(),
        )


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_alignment_of_any_text(text):
    got, want = ALIGNER.align([text])[0], aligned(text)
    if want is None:
        assert got == (0, 0, 0, "", b"")
    else:
        assert got[:4] == (len(want[0]), len(want[1]), len(want[2]), hashlib.sha256(";".join(want[2]).encode()).hexdigest())
        pairs = np.frombuffer(got[4], "<i8")
        assert list(zip((pairs >> align.PAIR_BITS).tolist(), (pairs & (1 << align.PAIR_BITS) - 1).tolist(), strict=True)) == want[3]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_union_find(n, edges):
    edges = [(a % n, b % n) for a, b in edges]
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    left, right = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    assert align.roots(n, left, right).tolist() == label


def test_second_tokenizer_without_its_space():
    """The model that leaves out its own space gives the ids of the one that puts it."""
    for text in ("a b", " a", "\n a", "x  y", "<s>", "é\xa0z"):
        assert ALIGNER.b.model.encode(" " + text) == SECOND.encode(text)


@pytest.mark.parametrize("head", [1 << 18, 1, 40])
def test_alignment_rows(spark, odd_docs, no_docs, monkeypatch, head):
    """All pairs frequent, none, and some of both."""
    monkeypatch.setattr(common.join_values, "__defaults__", (head,))
    clash = odd_docs.withColumns({"pair": F.lit(1), "_row": F.lit(2), "n_a": F.lit(3), "id": F.lit(4)})
    got = sorted(map(tuple, align.align(clash).collect()), key=str)
    assert got == sorted(alignment_rows((r.doc_id, r.text) for r in odd_docs.collect()), key=str)
    assert align.align(no_docs).count() == 0


def test_alignment_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_cross_tokenizer_alignment(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(alignment_rows(docs)) and len(got) == len(docs)


def test_a_full_cache_changes_nothing():
    small = align.Aligner(A, B, limit=2)
    texts = ["one two three", "two " * 50 + "four", "x" * 500 + " one", "one two three"]
    assert [small.align([t])[0] for t in texts] == ALIGNER.align(texts)
    cut = token_counts.PreTokens(W, limit=2)
    assert [pieces_of(cut, t) for t in texts] == [library_count(t) for t in texts]


def pieces_of(cut, text):
    _, names, counts = cut.frequencies([text])
    return sum(cut.pieces(n) * k for n, k in zip(names.to_pylist(), counts.tolist(), strict=True))


def library_count(text):
    return len(WORDS.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_pre_tokens_count_as_the_library(text):
    assert pieces_of(PRE, text) == library_count(text)


def test_other_tokenizer_files():
    """One whose pre-tokenizer keeps white space: a text is one chunk, with added tokens by their default, as one id."""
    plain, cut = Tokenizer.from_file(A), token_counts.PreTokens(A)
    assert not cut.independent
    for text in ("a  b\n\n c<|endoftext|> d", "", " x", "é\r\n"):
        assert pieces_of(cut, text) == len(plain.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("head", [1 << 18, 1, 8])
def test_token_count_rows(odd_docs, no_docs, monkeypatch, head):
    monkeypatch.setattr(common.join_values, "__defaults__", (head,))
    clash = odd_docs.withColumns({"name": F.lit(1), "_row": F.lit(2), "n_tokens": F.lit(3), "n": F.lit(4)})
    got = sorted(map(tuple, token_counts.count_tokens(clash, limit=3).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), n := library_count(r.text), n > 3) for r in odd_docs.collect()]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(no_docs).count() == 0


def test_token_count_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := library_count(r.text), n > 2048) for r in docs]
    assert sorted(map(tuple, queries.op13_token_counts(spark, sf_dir).collect())) == sorted(want)


def draw(docs, target, percent=resample.PERCENT, least=resample.MIN_WORDS, seed=resample.SEED):
    """What resample() returns, of (doc_id, text) pairs and texts."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(f.encode()) % resample.BUCKETS for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]

    known = [(k, *features(t)) for k, t in docs]
    s, t = Counter(b for _, _, f in known for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + resample.BUCKETS) / ((s[b] + 1.0) * (all_t + resample.BUCKETS)))) for b in range(resample.BUCKETS)]
    rows = []
    for k, n, f in known:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in rows]


@pytest.mark.parametrize(("percent", "least"), [(25, 20), (100, 1), (60, 2), (0, 0)])
def test_draw_rows(spark, odd_docs, no_docs, percent, least):
    target = spark.createDataFrame([("one two abc",), (None,), ("",), ("Été 😀 word",)], "text string")
    clash = odd_docs.withColumns({"bucket": F.lit(1), "_row": F.lit(2), "score": F.lit(3), "n_words": F.lit(4)})
    got = [tuple(r) for r in resample.resample(clash, target, percent=percent, min_words=least).collect()]
    want = draw([(r.doc_id, r.text) for r in odd_docs.collect()], [r.text for r in target.collect()], percent, least)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert resample.resample(no_docs, target).count() == 0
    got = [tuple(r) for r in resample.resample(odd_docs, target.limit(0), percent=percent, min_words=least).collect()]
    assert sorted(got, key=str) == sorted(draw([(r.doc_id, r.text) for r in odd_docs.collect()], [], percent, least), key=str)


def test_ties_go_to_the_smaller_id(spark):
    """Texts and noise alike: only the id tells."""
    docs = [(k, "one two three") for k in (5, 3, 9, None)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = resample.resample(frame, frame.limit(0), percent=100, min_words=1).collect()
    assert {r.doc_id: r["rank"] for r in got} == {r[0]: r[4] for r in draw(docs, [], 100, 1)}


def test_draw_query(spark, sf_dir):
    docs, target = (spark.read.parquet(f"{sf_dir}/{n}.parquet").select(*c).collect() for n, c in (("documents", ("doc_id", "text")), ("benchmark", ("text",))))
    got = sorted((tuple(r) for r in queries.op12_importance_resampling(spark, sf_dir).collect()), key=lambda r: r[0])
    assert got == sorted(draw(docs, [r.text for r in target]), key=lambda r: r[0])
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert sorted(con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({resample.ORACLE})").fetchall(), key=lambda r: r[0]) == got

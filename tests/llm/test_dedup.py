import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from shakeprint.llm import exact_dedup, golay, simhash


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is not None, i or 0))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[norm])
        keep = best[2] if best[1] else None
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_against_brute_force(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    clash = odd_docs.withColumns({"keep_id": F.lit(1), "sha": F.lit("x"), "share": F.lit(2), "size": F.lit(0)})
    for salts in (1, 7):
        assert sorted(map(tuple, exact_dedup.exact_dedup(clash, salts=salts).collect()), key=str) == brute_exact(rows)
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    kept = exact_dedup.exact_dedup(clash, carry=True).where("kept").select("row.*")
    assert kept.columns == clash.columns
    plan = exact_dedup.exact_dedup(odd_docs)._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan.lower() and "SortAggregate" in plan and "Python" not in plan


def test_golay_is_perfect():
    rng = np.random.default_rng(0)
    assert len(set(golay._tables()[1].tolist())) == 2048  # each remainder tells another error of three bits at most
    for m in rng.integers(0, 4096, 100).tolist():
        word = m << 11 ^ golay._remainder(m << 11)
        flipped = word ^ sum(1 << int(b) for b in rng.choice(23, rng.integers(0, 4), replace=False))
        assert golay.nearest(np.array([flipped], np.uint32))[0] == m
    for w in rng.integers(0, 1 << 23, 50).tolist():
        around = golay.around(np.array([w]))[0]
        assert {int(golay.nearest(np.array([w ^ 1 << b], np.uint32))[0]) for b in range(23)} <= set(around.tolist())
        assert 1 <= (around >= 0).sum() <= 6


def test_near_fingerprints_share_a_key():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    near = np.array([int(f) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for f in fps], np.uint64)
    asking, kept = {}, {}
    for at, key, asks in zip(*simhash.probe_keys(fps), strict=True):
        if asks:
            asking.setdefault(at, set()).add(key)
    for at, key, asks in zip(*simhash.probe_keys(near), strict=True):
        if not asks:
            kept.setdefault(at, set()).add(key)
    assert all(asking[k] & kept[k] for k in range(len(fps)))


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def brute_components(pairs):
    """Smallest id reachable, over rows of (id, fingerprint)."""
    n = len(pairs)
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            if (pairs[a][1] ^ pairs[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(pairs):
        low.setdefault(find(k), []).append(i)
    return [min((i for i in low[find(k)] if i is not None), default=None) for k in range(n)]


def test_near_dedup_against_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(200)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for k in range(40):  # a chain of near copies, and copies
        words = list(base)
        for _ in range(k % 6):
            words[rng.randrange(300)] = rng.choice(vocabulary)
        rows.append((100 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit(2)})
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dedup(df).collect()), key=str)
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    assert got == sorted(((i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps), strict=True)), key=str)
    assert simhash.near_dedup(no_docs).count() == 0

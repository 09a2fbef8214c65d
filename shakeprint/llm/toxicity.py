"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give scores and offending spans."""

from __future__ import annotations

import math
import re
import warnings
from dataclasses import dataclass
from itertools import chain as flat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_chars, held_out, rows
from .crf import Model, train as train_chain
from .sampling import labelled_ids, labelled_texts

#: Labelled rows taken of each label, the longest text taken to learn from, and the characters taken of each label.
SAMPLE_ROWS, SAMPLE_MAX_CHARS, SAMPLE_CHARS = 1_000, 20_000, 3_000_000
#: A word or beginning marks toxic words if it is in so many toxic texts and such a share of them, is so much likelier
#: there, and the log likelihood that this isn't chance exceeds the log of the number of candidates by so much.
SEED_TEXTS, SEED_SHARE, SEED_RATIO, SEED_EVIDENCE = 3, 0.015, 5.0, 5.0
PREFIXES = range(3, 9)
#: Texts of the sample in which a feature must occur to have a weight.
FEATURE_TEXTS = 3
#: Passages of so many words that an earlier text has are not learned from again.
PASSAGE_WORDS = 5
BATCH_CHARS, CACHE_WORDS = 1_000_000, 150_000
WORD = re.compile(r"[^\W\d_]+")


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:k] for k in PREFIXES if len(word) >= k)]


@dataclass
class Toxicity:
    """A tagger of words, and the weights that make a document's score of its words' marginals."""

    tagger: Model
    weights: list[float]

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def odds(self, lists: list[list[str]]) -> np.ndarray:
        used = set().union(*lists) if lists else set()
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        for word in used.difference(self.known):
            self.known[word] = self.tagger.odds(features(word))
        size = sum(map(len, lists))
        return np.fromiter(map(self.known.__getitem__, flat.from_iterable(lists)), float, size)

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        """The probability of each word of each text that it is toxic."""
        lists = [WORD.findall(lowered(t or "")) for t in texts]
        ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        odds = self.odds(lists)
        first = np.zeros(len(odds), bool)
        first[starts[starts < ends]] = True
        p = self.tagger.chain.marginals(odds, first)
        return [p[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        x = np.array([summary(p) for p in marginals]).reshape(-1, SUMMARY)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


SUMMARY = 5


def summary(p: np.ndarray) -> tuple[float, ...]:
    """What a document's score is made of: the expected number of toxic words, their share and the surest one."""
    if not len(p):
        return (1.0, 0.0, 0.0, 0.0, 0.0)
    total = float(p.sum())
    return (1.0, math.log1p(total), math.log1p(1000 * total / (len(p) + 20)) / 5, float(p.max()), math.log1p(float((p > 0.5).sum())))


def spans(text: str, p: np.ndarray) -> str:
    """`first-end` code points of the words that are likelier toxic than not, neighbours joined."""
    words = [(m.start(), m.end()) for m in WORD.finditer(lowered(text))]
    out: list[list[int]] = []
    last = -2
    for k in np.flatnonzero(p > 0.5).tolist():
        if k == last + 1:
            out[-1][1] = words[k][1]
        else:
            out.append(list(words[k]))
        last = k
    return ",".join(f"{a}-{b}" for a, b in out)


def fit_scores(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> list[float]:
    """Logistic regression whose slopes aren't negative: more toxic words never lower a score. Newton's method, with
    steps halved until the penalised likelihood grows, so that it can't swing about where the classes are separable;
    a slope that turns negative is set to zero and left out."""
    size = x.shape[1]
    penalty = ridge * np.eye(size)
    penalty[0, 0] = 1e-6
    free = np.ones(size, bool)
    sign = 1.0 - 2.0 * y

    def loss(w: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0.0, sign * (x @ w)) + 0.5 * w @ penalty @ w)

    while True:
        w = np.zeros(size)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            grad = (x.T @ (weight * (y - p)) - penalty @ w)[free]
            hess = ((x * (weight * p * (1 - p))[:, None]).T @ x + penalty)[np.ix_(free, free)]
            step = np.zeros(size)
            step[free] = np.linalg.solve(hess + 1e-9 * np.eye(len(hess)), grad)
            now, scale = loss(w), 1.0
            while loss(w + scale * step) > now and scale > 1e-9:
                scale /= 2
            w = w + scale * step
            if np.abs(scale * step).max() < 1e-6:
                break
        below = free & (w < 0)
        below[0] = False
        if not below.any():
            return w.tolist()
        free[np.argmin(np.where(below, w, 0.0))] = False


def fresh(lists: list[list[str]]) -> np.ndarray:
    """True for the words, text after text, that are in no passage of an earlier text."""
    seen: set[int] = set()
    out = []
    for words in lists:
        keep = np.ones(len(words), bool)
        shingles = [hash(x) for x in zip(*(words[k:] for k in range(PASSAGE_WORDS)), strict=False)]
        for k, s in enumerate(shingles):
            if s in seen:
                keep[k : k + PASSAGE_WORDS] = False
        seen.update(shingles)
        out.append(keep)
    return np.concatenate(out)


@dataclass
class Table:
    """The features of each kind of word, as numbers: those of kind k are flat[start[k] : start[k + 1]]."""

    names: list[str]
    flat: np.ndarray
    start: np.ndarray

    def of(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of all those kinds, and from which of them each comes."""
        size = self.start[kinds + 1] - self.start[kinds]
        at = np.repeat(self.start[kinds] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.flat[at], np.repeat(np.arange(len(kinds)), size)


def feature_table(words: list[str]) -> Table:
    names: dict[str, int] = {}
    flat, start = [], [0]
    for w in words:
        flat += [names.setdefault(f, len(names)) for f in features(w)]
        start.append(len(flat))
    return Table(list(names), np.array(flat, np.int64), np.array(start, np.int64))


def count(table: Table, kind: np.ndarray, size: np.ndarray, toxic: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By clean and toxic: texts with each feature, its occurrences, and words; only of words in new passages."""
    texts, times, words = np.zeros((2, len(table.names))), np.zeros((2, len(table.names))), np.ones(2)
    ends = np.cumsum(size)
    for a, b, y in zip((ends - size).tolist(), ends.tolist(), toxic.tolist(), strict=True):
        mine, n = np.unique(kind[a:b][new[a:b]], return_counts=True)
        ids, of = table.of(mine)
        held, inverse = np.unique(ids, return_inverse=True)
        texts[y, held] += 1
        times[y, held] += np.bincount(inverse, n[of], len(held))
        words[y] += n.sum()
    return texts, times, words


def seeds(texts: np.ndarray, times: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which features (words and beginnings) occur far more often in toxic texts than in clean ones."""
    n0, n1 = int((toxic == 0).sum()) + 1, int(toxic.sum()) + 1
    ratio = times[1] / words[1] / ((times[0] + 0.5) / words[0])
    evidence = texts[1] * np.log((texts[1] + 1e-9) / n1 / ((texts[0] + 0.5) / n0))
    enough = SEED_EVIDENCE + np.log(max(1, len(evidence)))
    return (texts[1] >= max(SEED_TEXTS, SEED_SHARE * n1)) & (ratio >= SEED_RATIO) & (evidence >= enough)


def untold(prior: float) -> Toxicity:
    """The model of labels that tell nothing: one score for all."""
    one = np.zeros(1, np.int64)
    p = min(max(prior, 1e-6), 0.49)
    return Toxicity(train_chain(["none"], one, one, one, one, np.ones(1, bool), rounds=1), [math.log(p / (1 - p)), *[0.0] * (SUMMARY - 1)])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Learns from a bounded sample: about SAMPLE_ROWS texts of each label outside the held-out fold, none above
    SAMPLE_MAX_CHARS, with SAMPLE_CHARS together. A word of a toxic text is labelled toxic if it or a beginning of it is
    far more frequent in toxic texts; all other words are labelled clean. Without labels of both kinds, or if they
    don't tell any word, as when they are too few (it warns then), every score is the share of toxic labels, but below
    0.5: nothing is predicted toxic on no evidence."""
    ids, counts = labelled_ids(labels, id_col, label_col, SAMPLE_ROWS)
    rows = labelled_texts(docs, ids, id_col, text_col, SAMPLE_MAX_CHARS, labels.schema[label_col].dataType.simpleString(), SAMPLE_CHARS)
    rows = list({text: (text, int(label == 1)) for _, text, label in rows}.values())
    toxic = np.array([y for _, y in rows], np.int64)
    if not len(rows) or toxic.min() == toxic.max():
        return untold(float(toxic.mean()) if len(rows) else 0.0)
    lists = [WORD.findall(lowered(t)) for t, _ in rows]
    new = fresh(lists)
    kinds = {w: k for k, w in enumerate(dict.fromkeys(flat.from_iterable(lists)))}
    kind = np.fromiter((kinds[w] for w in flat.from_iterable(lists)), np.int64)
    size = np.array([len(x) for x in lists])
    table = feature_table(list(kinds))
    del lists, kinds
    texts, times, total = count(table, kind, size, toxic, new)
    marked = seeds(texts, times, total, toxic)
    share = {1: sum(n for k, n in counts.items() if k == 1), 0: sum(n for k, n in counts.items() if k != 1)}
    if not marked.any():
        warnings.warn(f"{int(toxic.sum())} toxic and {int((toxic == 0).sum())} clean texts don't tell any toxic word", stacklevel=2)
        return untold(share[1] / max(1, share[0] + share[1]))
    ids, of = table.of(np.arange(len(table.start) - 1))
    is_marked = np.bincount(of, marked[ids], len(table.start) - 1) > 0
    label = (is_marked[kind] & (np.repeat(toxic, size) == 1)).astype(np.int64)
    first = np.zeros(len(kind), bool)
    first[(np.cumsum(size) - size)[size > 0]] = True
    used = texts.sum(0) >= FEATURE_TEXTS
    model = Toxicity(train_chain(table.names, ids[used[ids]], of[used[ids]], kind, label, first), [0.0] * SUMMARY)
    x = np.array([summary(p) for at in range(0, len(rows), 200) for p in model.marginals([t for t, _ in rows[at : at + 200]])])
    weight = np.where(toxic == 1, share[1] / max(1, toxic.sum()), share[0] / max(1, (toxic == 0).sum()))
    model.weights = fit_scores(x, toxic, weight / weight.mean())
    model.known = {}
    return model


def score(df: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, spans (and with carry the input row as struct `row`).

    spans lists the `first-end` code points of offending words. Null text counts as empty; a text without words has the
    score of no toxic word. Whole texts are scored, however long. Repeated rows are each scored, equal texts alike; a
    score of just 0.5 is predicted toxic; null ids are held out.
    An empty table gives no rows. Only id and text are read (all columns with carry), whatever others are named.
    """
    fields = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", T.StringType())]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *fields, *([T.StructField("row", df.schema)] if carry else [])])
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"), *([F.struct("*").alias("row")] if carry else []))

    def run(batches):
        for batch in batches:
            scores, marked = [], []
            for some in by_chars(rows(batch, 0, 1), BATCH_CHARS):
                p = model.marginals([t for _, t in some])
                scores += model.scores(p).tolist()
                marked += [spans(t, x) if len(x) and x.max() > 0.5 else "" for (_, t), x in zip(some, p, strict=True)]
            values = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(marked, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *values, *([batch.column(3)] if carry else [])], names=schema.names)

    return source.mapInArrow(run, schema)

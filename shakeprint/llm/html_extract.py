"""HTML extraction: a linear-chain conditional random field over a page's leaf blocks, decoded by Viterbi."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_chars, rows
from .crf import Model, numbered, train
from .html_blocks import Block, Element, leaf_blocks
from .html_pages import labelled_pages

BATCH_CHARS = 1_000_000
TELLING = {"article", "main", "nav", "header", "footer", "aside", "form", "section"}
PLAIN = {"p", "b", "em", "a", "code", "div", "ul", "li"}


@lru_cache(maxsize=20_000)
def path_features(path: tuple[Element, ...]) -> tuple[str, ...]:
    """Features of the elements around a block: every tag, every name, the innermost tag, and whether the innermost
    telling element holds the article or something else."""
    out = {"leaf " + path[-1].tag if path else "leaf none"}
    own = [e for e in path if not e.scope]
    for e in path:
        if e.scope == "wide":
            out.update(f"wide {x}" for x in (e.tag, *e.names))
    for e in own:
        out.add(e.tag)
        out.update(f".{n}" for n in e.names)
    telling = [e.tag for e in own if e.tag in TELLING]
    out.add("in " + (telling[-1] if telling else "none"))
    # What stands between the main element, if there is one, and the block; and the nearest element that tells.
    main = next((k for k, e in enumerate(own) if e.holds), -1)
    out.update(f"below {x}" for e in own[main + 1 :] for x in (e.tag, *e.names) if e.tag not in PLAIN or e.names)
    out.update(f"above {x}" for e in own[: max(main, 0)] for x in e.names)
    near = next((e for e in reversed(own) if e.names or e.tag in TELLING), None)
    out.update(f"near {x}" for x in ((near.tag, *near.names) if near else ("none",)))
    return tuple(sorted(out))


def text_features(b: Block) -> list[str]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    out = [f"words {min(7, words.bit_length())}", f"linked {4 * b.link_chars // n}"]
    if b.text[-1] in ".!?:…\"'”":
        out.append("ends")
    if "©" in b.text:
        out.append("copyright sign")
    if b.text.count("|") + b.text.count("·") + b.text.count("»"):
        out.append("bars")
    return out


def features(b: Block) -> list[str]:
    return [*path_features(tuple(b.path)), *text_features(b)]


@lru_cache(maxsize=4)
def trained(pages: int | None = None, seed: int | None = None) -> Model:
    """The field trained on generated labelled pages; the same on every worker."""
    made = labelled_pages(**({"count": pages} if pages else {}), **({"seed": seed} if seed else {}))
    return fit([p for p in made if p[0]])


def fit(pages: list[tuple[list[Block], list[int]]]) -> Model:
    """Trains on (blocks, labels) of pages; label 1 is main text."""
    flat = [b for blocks, _ in pages for b in blocks]
    label = np.array([y for _, labels in pages for y in labels], np.int64)
    first = np.zeros(len(flat), bool)
    first[np.cumsum([0, *(len(b) for b, _ in pages[:-1])])] = True
    return train(*numbered([features(b) for b in flat]), np.arange(len(flat)), label, first, rounds=400, rate=0.2, decay=1e-5, least=0.005)


def main_text(html: str | None, model: Model | None = None) -> str:
    blocks = leaf_blocks(html or "")
    if not blocks:
        return ""
    model = model or trained()
    weigh = _weigher(id(model), model)
    odds = [weigh(tuple(b.path)) + sum(model.weights.get(f, 0.0) for f in text_features(b)) for b in blocks]
    return "\n".join(b.text for b, y in zip(blocks, model.chain.viterbi(odds), strict=True) if y)


_WEIGHERS: dict = {}


def _weigher(key: int, model: Model):
    if key not in _WEIGHERS:

        @lru_cache(maxsize=20_000)
        def weigh(path: tuple[Element, ...]) -> float:
            return model.odds(path_features(path))

        _WEIGHERS.clear()
        _WEIGHERS[key] = weigh
    return _WEIGHERS[key]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list | None = None) -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    Blocks that the field labels as main text, in page order, one a line; of equally likely labellings the one with less
    main text at the end. labelled: (html blocks, labels) of pages to
    train on instead of the generated ones. Null html counts as empty: empty text, 0. Repeated rows, null ids and null
    urls are kept; an empty table gives no rows. Whole pages are read, however long. Other columns are not read.
    """
    model = fit(labelled) if labelled else trained()
    schema = T.StructType([df.schema[id_col], df.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for some in by_chars(rows(batch, 0, 2, 1), BATCH_CHARS):
                texts = [main_text(html, model) for _, html, _ in some]
                arrays = [pa.array([i for i, _, _ in some], batch.schema.field(0).type), pa.array([u for _, _, u in some], batch.schema.field(1).type), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, schema)

"""Fingerprint records from JSON text: lines, objects one after another, one object, or arrays of objects."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import number_rows

FLOW = "struct<src:string,sport:int,dst:string,dport:int>"
SCHEMA = f"mode string, protocol string, role string, fingerprint string, fingerprint_simhash128 string, features string, sha256 string, simhash128 string, flow {FLOW}, frame int"
#: What a record may hold besides; wrong types there are kept as text.
NUMBERED = f"{SCHEMA}, file string, item long"
ROWS_A_BATCH = 4096


def json_values(text: str) -> Iterator[dict]:
    """The objects of a text; ValueError with the line for what is no JSON, no object, or nothing at all."""
    decoder, at, count = json.JSONDecoder(), 0, 0
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            break
        try:
            value, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError as e:
            line = text.count("\n", 0, e.pos) + 1
            raise ValueError(f"invalid JSON on line {line}: {e}") from e
        count += 1
        items = value if isinstance(value, list) else [value]
        for k, item in enumerate(items, 1):
            if not isinstance(item, dict):
                raise ValueError(f"JSON array item {k} is not an object" if isinstance(value, list) else "input must be JSON object lines, JSON objects, one JSON object, or a JSON array")
            yield item
    if not count:
        raise ValueError("input must contain at least one JSON value")


def _clean(item: dict) -> dict:
    flow = item.get("flow")
    number = lambda x: x if isinstance(x, int) else None
    text = lambda x: x if isinstance(x, str) or x is None else json.dumps(x)
    out = {k: text(item.get(k)) for k in ("mode", "protocol", "role", "fingerprint", "fingerprint_simhash128", "features", "sha256")}
    out["simhash128"] = item["simhash128"] if isinstance(item.get("simhash128"), str) else None
    out["flow"] = {"src": text(flow.get("src")), "sport": number(flow.get("sport")), "dst": text(flow.get("dst")), "dport": number(flow.get("dport"))} if isinstance(flow, dict) else None
    return out | {"frame": number(item.get("frame"))}


def record_batches(file: str, text: str, kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The records of a text as they are parsed, so that no more than a batch of them is held."""
    values = enumerate(json_values(text))
    while rows := [_clean(x) | {"file": file, "item": k} for k, x in islice(values, ROWS_A_BATCH)]:
        yield pa.RecordBatch.from_pylist(rows, schema=kind)


def read_records(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Records numbered from 1 in the order of files and of items in them.

    lines: the input is JSON Lines, which Spark splits and reads in parallel, strictly; otherwise each file is one task's
    work, in any of the forms.
    """
    if lines:
        raw = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
        listed = raw.select("*", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("item"))
        return numbered(listed)

    ddl = spark.createDataFrame([], NUMBERED).schema
    kind = pa.schema([(f.name, _arrow(f.dataType)) for f in ddl])

    def run(batches):
        for batch in batches:
            for file, text in zip(*batch.columns, strict=True):  # one text at a time as a string
                yield from record_batches(file.as_py(), text.as_py(), kind)

    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    return numbered(texts.mapInArrow(run, NUMBERED))


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in t])
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[t.simpleString()]


def numbered(listed: DataFrame) -> DataFrame:
    """Adds `record`, numbers from 1 by (file, item)."""
    return number_rows(listed, [F.col("file"), F.col("item")], "record").drop("file", "item")

"""What the driver and a task hold doesn't grow with the input."""

import json

import pyarrow as pa
import pytest

from shakeprint.operators import components as c
from shakeprint.sources import records


def test_components_broadcast_nothing(spark, monkeypatch):
    """Each round's joins go by shuffle, so no label passes the driver, and the result is the same."""
    plans = []
    stored = c.materialise_at

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(c, "materialise_at", seen)
    monkeypatch.setattr(c, "materialise", lambda df: seen(df)[0])
    labels, merges = (spark.createDataFrame([], s) for s in ("node long, component long", "component long, into long"))
    for batch in ([(k, k + 1) for k in range(0, 20, 2)], [(k, k + 1) for k in range(1, 20, 4)]):
        added, merges = c.grow(labels, merges, spark.createDataFrame(batch, "a long, b long"))
        labels, merges = labels.unionByName(c.materialise(added)), c.materialise(merges)
    out = c.grown(labels, merges)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert {r.node: r.component for r in out.collect()} == {k: k // 4 * 4 for k in range(20)}


def test_records_come_as_they_are_parsed():
    """The first batch is there before the rest of the text is looked at."""
    kind = pa.schema([("role", pa.string()), ("file", pa.string()), ("item", pa.int64())])
    text = "\n".join(json.dumps({"role": str(k)}) for k in range(records.ROWS_A_BATCH + 5)) + "\n{"
    found = records.record_batches("f", text, kind)
    first = next(found)
    assert first.num_rows == records.ROWS_A_BATCH and first.to_pylist()[-1] == {"role": "4095", "file": "f", "item": 4095}
    with pytest.raises(ValueError, match="line 4102"):
        next(found)

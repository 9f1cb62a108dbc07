"""What a task's Python worker holds while it runs, and what it returns."""

import re
from pathlib import Path

import corpus_pipeline
import pyarrow as pa
from conftest import DATA

from millrace.llm import mixing
from millrace.llm.shared import lean

PINNED = []


def anonymous_mb() -> float:
    return int(re.search(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def hungry(batches):
    for batch in batches:
        held = [bytes(1000) for _ in range(300_000)]
        PINNED.append(bytes(1000))  # in use above all that is freed
        yield batch
        del held


def test_a_task_returns_the_memory_that_it_freed():
    batch = pa.record_batch({"x": pa.array([1])})
    before = anonymous_mb()
    assert list(lean(hungry)(iter([batch]))) == [batch]
    assert anonymous_mb() - before < 100


def test_texts_are_cut_a_few_at_a_time():
    n = 1000
    columns = [pa.array(range(n)), pa.array(["en"] * n), pa.array([None] * n, pa.string()), pa.array([1] * n), pa.array([b"some text"] * n), pa.array([[{"lo": 0, "hi": 5}], None] * (n // 2))]
    out = list(corpus_pipeline._without_repeats(iter([pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "source", "n_chars", "text_", "spans_"])])))
    assert max(b.num_rows for b in out) <= 256
    assert [t for b in out for t in b.column(1).to_pylist()] == ["text", "some text"] * (n // 2)
    assert [d for b in out for d in b.column(0).to_pylist()] == list(range(n))


def test_the_mix_starts_no_python(spark):
    mix = mixing.mix_sources(spark.read.parquet(f"{DATA}/documents.parquet"))
    for df in (mix.sources, mix.schedule, mix.pieces):
        assert "Scan ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()

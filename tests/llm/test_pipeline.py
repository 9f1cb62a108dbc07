"""Stages of the corpus pipeline against brute force, each on the rows that its predecessor kept."""

import re

import corpus_pipeline
import numpy as np
import pytest
from conftest import DATA
from test_packing import ids_of
from test_small_cases import shingles
from test_suffix_dedup import brute

from millrace.llm import mixing
from millrace.llm.shared import staged


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10**7, "123 456 !!", None, "src0", 10), (10**7 + 1, None, None, None, None)], docs.schema)
    out = [docs.unionAll(extra)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], DATA), name))
    return [{"df": df, "rows": df.collect()} for df in out]


def test_columns(stages):
    for s in stages[:-1]:
        assert s["df"].columns == corpus_pipeline.COLUMNS


def test_language_rejects_only_what_has_no_language(stages):
    before, after = ({r["doc_id"] for r in s["rows"]} for s in stages[:2])
    text = {r["doc_id"]: r["text"] for r in stages[0]["rows"]}
    assert all(not any(map(str.isalpha, text[d] or "")) for d in before - after)
    assert {10**7, 10**7 + 1} <= before - after


def test_near_copies_leave_one(stages):
    text = {r["doc_id"]: shingles(r["text"].lower()) for r in stages[1]["rows"]}
    kept = {r["doc_id"] for r in stages[2]["rows"]}
    alike = lambda a, b: len(text[a] & text[b]) / len(text[a] | text[b])
    near = [(a, b) for a in kept for b in kept if a < b and len(text[a]) > 20 and alike(a, b) >= 0.85]
    assert not near
    for d in text.keys() - kept:
        assert max(alike(d, x) for x in text if x != d) > 0.6


def test_repeats_are_gone(stages):
    before, after = ({r["doc_id"]: r for r in s["rows"]} for s in stages[2:4])
    assert before.keys() == after.keys()
    for d, flags in brute({d: r["text"] for d, r in before.items()}, corpus_pipeline.REPEAT_BYTES).items():
        data = before[d]["text"].encode()
        assert after[d]["text"] == bytes(b for b, f in zip(data, flags) if not f).decode("utf-8", "ignore")
        assert after[d]["n_chars"] == len(after[d]["text"])


def test_mix_meets_targets(stages):
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    size: dict = {}
    for r in stages[3]["rows"]:
        size[r["source"]] = size.get(r["source"], 0) + words(r["text"])
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    target = mixing.targets([size[s] for s in sources], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sources))])
    taken: dict = {}
    for r in stages[4]["rows"]:
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in zip(sources, target))


def test_packing_has_every_token(stages):
    n = sum(len(x) for x in ids_of([r["text"] for r in stages[4]["rows"]]))
    assert sum(r["length"] for r in stages[5]["rows"]) == n
    used = np.bincount([r["sequence_id"] for r in stages[5]["rows"]], weights=[r["length"] for r in stages[5]["rows"]])
    assert used.max() <= 2048


def test_rows_are_followed_through_all_stages(stages):
    """What a stage drops never comes back, and what the last one packs is what the one before it holds."""
    ids = [{r["doc_id"] for r in s["rows"]} for s in stages]
    assert all(after <= before for before, after in zip(ids, ids[1:]))
    assert ids[3] == ids[2] and ids[4] == ids[5]
    raw = {r["doc_id"]: r["text"] or "" for r in stages[0]["rows"]}
    for r in stages[4]["rows"]:
        left = iter(raw[r["doc_id"]])
        assert all(c in left for c in r["text"])  # nothing but cuts
    tokens = sorted((r["doc_id"], len(own)) for r, own in zip(stages[4]["rows"], ids_of([r["text"] for r in stages[4]["rows"]])))
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in stages[5]["rows"] if r["start"] == 0) == tokens


def test_nulls_everywhere(spark, tmp_path):
    """Rows with a null in each column, repeated ones, and a column whose name the stages use themselves."""
    words = " ".join(f"word{i}" for i in range(120))
    rows = [(1, words, "en", "a", 5), (1, words, "en", "a", 5), (None, words + " more", None, None, None), (2, None, "en", "a", None), (3, "", None, "b", 0), (None, None, None, None, None), (4, "some other text of its own", "en", None, 3)]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], corpus_pipeline.SCHEMA + ", size int, score string")
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == corpus_pipeline.COLUMNS or name == "packing"
        assert out.count() > 0 or name == "language_id"


def test_run_and_empty_table(spark, stages, tmp_path):
    assert corpus_pipeline.run(spark, DATA).columns == stages[-1]["df"].columns
    docs = spark.createDataFrame([], corpus_pipeline.SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0

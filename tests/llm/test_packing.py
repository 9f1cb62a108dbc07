import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import DATA
from millrace.llm import packing


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return [c.ids + [1] for c in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_word_coder_equals_the_tokenizer():
    texts = ["", " ", "It's  <|endoftext|> ÉCOLE\n\nnée", "a\tb\x0bc d'll 3.14 ...!?", "́x y", "ΣΑΣ ς", "日本 語 　x"]
    coder = packing.WordCoder(public_tokenizers.path(packing.TOKENIZER))
    assert [np.frombuffer(c, "<u4").tolist() for c in coder(texts, 1)] == ids_of(texts)


def test_every_id_is_in_one_place(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(None, None), (7, "twin"), (7, "twin"), (10**6, "word " * 9000)], "doc_id long, text string"))
    rows = packing.pack_documents(docs).collect()
    want = ids_of([r["text"] for r in docs.orderBy("doc_id").collect() if r["doc_id"] not in (None, 7)])
    pieces: dict = {}
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 2048
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc_id, own in zip(sorted(k for k in pieces if k not in (None, 7)), want, strict=True):
        own_rows = sorted(pieces[doc_id], key=lambda r: r["start"])
        assert sum((list(r["ids"]) for r in own_rows), []) == own
        assert [r["start"] for r in own_rows] == np.cumsum([0, *[r["length"] for r in own_rows[:-1]]]).tolist()
        assert all(r["doc_tokens"] == len(own) for r in own_rows)
    assert len(pieces[7]) == 3 and pieces[None][0]["length"] == 1
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert total / (2048 * len(sequences)) > 0.9
    # an empty table, and sequences as rows
    assert packing.pack_documents(docs.limit(0)).count() == 0
    made = packing.sequences(packing.pack_documents(docs)).select(F.size("input_ids").alias("n")).collect()
    assert len(made) == len(sequences) and all(r["n"] == 2048 or r["n"] & (r["n"] - 1) == 0 for r in made)


def test_plan_holds_the_demand_with_little_padding():
    rng = np.random.default_rng(0)
    lengths = np.concatenate([rng.integers(1, 2049, 50_000), np.full(20_000, 700)])
    least, fine, unit = packing.steps()
    classes = np.minimum(np.where(lengths <= least, -(-lengths // fine) * fine, -(-lengths // unit) * unit), 2048)
    sizes, at, demand = np.unique(classes, return_inverse=True, return_counts=True)
    plan = packing.plan(sizes, demand, 2048)
    order = np.argsort(at, kind="stable")
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at)) - np.searchsorted(at[order], at[order])
    used = np.bincount(plan.sequences(at, rank), weights=lengths)
    assert used.max() <= 2048
    # no plan of uncut pieces needs fewer sequences than the linear program
    main = sizes > least
    _, x = packing.column_generation(sizes[main] // unit, demand[main].astype(float), 2048 // unit)
    assert (used > 0).sum() <= 1.01 * x.sum()

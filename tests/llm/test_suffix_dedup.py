import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import suffix_dedup
from millrace.llm.run_index import RunIndex, common


def brute(texts: dict[int, str | None], length: int) -> dict[int, list[bool]]:
    """Per document, which bytes are covered by a string of ``length`` bytes that starts elsewhere too."""
    starts: dict[bytes, int] = {}
    data = {k: (t or "").encode() for k, t in texts.items()}
    for t in data.values():
        for i in range(len(t) - length + 1):
            starts[t[i : i + length]] = starts.get(t[i : i + length], 0) + 1
    out = {}
    for k, t in data.items():
        flags = [False] * len(t)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                flags[i : i + length] = [True] * length
        out[k] = flags
    return out


def corpus(seed: int) -> dict[int, str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 6)))
    shared = ["".join(word() for _ in range(30)) for _ in range(4)]
    texts: dict[int, str | None] = {0: None, 1: "", 2: "a" * 300, 3: "ab" * 150, 4: shared[0], 5: shared[0]}
    for i in range(6, 60):
        parts = ["".join(word() for _ in range(rng.randint(1, 40)))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared)[rng.randint(0, 30) :], word()]
        texts[i] = "".join(parts)
    return texts


@pytest.mark.parametrize("most", [512, 4, 1])
def test_against_brute_force(spark, most):
    """A small ``most`` parts crowded anchors down to whole windows."""
    texts = corpus(1)
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, spans string")
    got = suffix_dedup.mark_repeats(df, ["doc_id"], length=40, anchor=12, most=most).mapInArrow(suffix_dedup._digest, suffix_dedup.DIGEST)
    got = {r["doc_id"]: r for r in got.collect()}
    assert set(got) == set(texts)
    removed = 0
    for k, flags in brute(texts, 40).items():
        data = (texts[k] or "").encode()
        keep = bytes(b for b, f in zip(data, flags) if not f)
        r = got[k]
        removed += sum(flags)
        assert (r["n_bytes"], r["n_removed"]) == (len(data), sum(flags)), k
        assert r["n_spans"] == sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags)), k
        assert r["kept_sha256"] == hashlib.sha256(keep).hexdigest(), k
        assert r["text"] == keep.decode("utf-8", "ignore"), k
    assert removed > 1000


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "xyz" * 20), (1, "xyz" * 20), (None, "unlike all the others")], "doc_id long, text string")
    got = suffix_dedup.mark_repeats(df, ["doc_id"], length=40, anchor=12).select("doc_id", F.size("spans_").alias("n"), "text_").collect()
    assert len(got) == 3
    assert sum(r["n"] > 0 for r in got if r["n"] is not None) == 2
    assert suffix_dedup.mark_repeats(df.limit(0), ["doc_id"]).count() == 0


def test_matching_statistics():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))).encode() for _ in range(12)]
    index = RunIndex.build(texts)
    got, at = index.matching_statistics(), 0
    every = [(t, i) for t in range(len(texts)) for i in range(len(texts[t]))]
    for t, text in enumerate(texts):
        for i in range(len(text)):
            best = 0
            for t2, j in every:
                if (t2, j) != (t, i):
                    n = 0
                    while i + n < len(text) and j + n < len(texts[t2]) and text[i + n] == texts[t2][j + n]:
                        n += 1
                    best = max(best, n)
            assert got[at + i] == best
        at += len(text) + 1


def thue_morse(n: int, a: str = "ab") -> str:
    return "".join(a[bin(i).count("1") % 2] for i in range(n))


def test_matches_are_compared_by_bytes():
    """These two strings have equal polynomial hashes modulo 2**64."""
    one, other = thue_morse(2048).encode(), thue_morse(2048, "ba").encode()
    h = [suffix_dedup.prefix_hashes(np.frombuffer(t, np.uint8))[-1] for t in (one, other)]
    assert h[0] == h[1]
    where = np.array([0]), np.array([2049])
    data = np.frombuffer(one + b"\0" + other + b"\0", np.uint8)
    assert common(data, np.repeat([2048, 4097], 2049), *where)[0] == 0


def test_strings_with_equal_hashes_stay(spark):
    df = spark.createDataFrame([(1, thue_morse(2048)), (2, thue_morse(2048, "ba")), (3, "c" * 30)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans_"] for r in suffix_dedup.mark_repeats(df, ["doc_id"], length=1500, anchor=1200).collect()}
    for k, flags in brute({1: thue_morse(2048), 2: thue_morse(2048, "ba")}, 1500).items():
        assert sum(hi - lo for lo, hi in suffix_dedup.merged(got[k])) == sum(flags)


def test_every_verdict_comes_from_an_index(spark, tmp_path, monkeypatch):
    """Without the index nothing is found, not even among exact copies or in crowds."""
    rng = random.Random(5)
    shared = "".join(rng.choice("abc ") for _ in range(90))
    texts = [shared] * 3 + ["".join(rng.choice("abc ") for _ in range(50)) + shared for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = suffix_dedup.mark_repeats(df, ["doc_id"], length=40, anchor=12, most=4).where("size(spans_) > 0").count()
    assert found == len(texts)
    monkeypatch.setattr(suffix_dedup, "_index", lambda length: lambda batches: iter(()))
    assert suffix_dedup.mark_repeats(df, ["doc_id"], length=40, anchor=12, most=4).where("size(spans_) > 0").count() == 0


def test_one_passage_in_many_texts(spark):
    """A crowd whose members all differ outside the passage, some of which share more."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, left = word(70), [word(30) for _ in range(3)]
    texts = {i: word(rng.randint(0, 40)) + rng.choice(left)[rng.randint(0, 25) :] + passage[: rng.randint(35, 70)] + word(20) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["spans_"] for r in suffix_dedup.mark_repeats(df, ["doc_id"], length=48, anchor=16, most=3).collect()}
    for k, flags in brute(texts, 48).items():
        cover = np.zeros(len(flags), bool)
        for lo, hi in suffix_dedup.merged(got[k]):
            cover[lo:hi] = True
        assert cover.tolist() == flags, k


def test_anchor_must_fit(spark):
    with pytest.raises(ValueError):
        suffix_dedup.mark_repeats(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), ["doc_id"], length=10, anchor=11)


def test_a_twin_adds_one_sample():
    """The index of texts of which some are twins says what that of all texts says."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() for _ in range(20)]
    twins = [i % 3 == 0 for i in range(20)]
    got = RunIndex.build(texts, twins).matching_statistics()
    every = texts + [t for t, two in zip(texts, twins) if two]
    assert got.tolist() == RunIndex.build(every).matching_statistics()[: len(got)].tolist()
    assert len(RunIndex.build(texts, [True] * 20).tails) == 20


@pytest.mark.parametrize("most", [512, 4, 1])
def test_passages_against_brute_force(spark, most):
    """Both lengths at once; the shorter one is found inside, across and outside of what the longer one removes."""
    texts, rng = corpus(2), random.Random(2)
    shared = texts[4] or ""
    for i in range(60, 100):
        own = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 40))) for _ in range(3)]
        at = [rng.randint(0, 40) for _ in range(2)]
        texts[i] = f"{own[0]}{shared[at[0] : at[0] + rng.randint(30, 70)]}{own[1]}{own[1][::-1]}{shared[at[1] : at[1] + rng.randint(30, 45)]}{own[2]}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marked = suffix_dedup.mark_repeats(df, ["doc_id"], length=60, anchor=16, most=most, passages=(36, 8))
    got = {r["doc_id"]: r for r in marked.mapInArrow(suffix_dedup._digest, f"{suffix_dedup.DIGEST}, {suffix_dedup.PASSAGES}").collect()}
    assert set(got) == set(texts)
    long, short = brute(texts, 60), brute(texts, 36)
    for k, r in got.items():
        data = (texts[k] or "").encode()
        for flags, count, left in ((long[k], "n_removed", "text"), (short[k], "n_repeated", "unrepeated_text")):
            keep = bytes(b for b, f in zip(data, flags) if not f)
            assert (r[count], r[left]) == (sum(flags), keep.decode("utf-8", "ignore")), k
    assert sum(map(sum, short.values())) > sum(map(sum, long.values())) + 500 > 1000


def test_passages_of_over_50_words(spark, tmp_path):
    """A passage of 51 words has 300 bytes or so: the contract's 400 leave it, the text without repeated passages must not have it."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 7))) for _ in range(n))
    passages = [prose(51) for _ in range(5)]
    clean = {i: prose(200) for i in range(20)}
    planted = {100 + i: f"{prose(90)} {passages[i % 5]} {prose(90)}" for i in range(20)}
    spark.createDataFrame([*clean.items(), *planted.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in suffix_dedup.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    assert all(240 < len(p) < 400 for p in passages)
    for k, text in clean.items():
        assert (got[k]["n_repeated"], got[k]["unrepeated_text"]) == (0, text)
    for k, text in planted.items():
        passage = passages[k % 5]
        assert (got[k]["n_removed"], got[k]["text"]) == (0, text)
        assert passage not in got[k]["unrepeated_text"]
        assert len(passage) <= got[k]["n_repeated"] <= len(passage) + 10

import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash


def brute_fingerprint(text: str | None, k: int = 3) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: dict[int, int], budget: int) -> dict[int, int]:
    label = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= budget and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def corpus() -> dict[int, str | None]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    texts: dict[int, str | None] = {0: None, 1: "", 2: " \t\n", 3: "One", 4: "one", 5: "one TWO"}
    base = [rng.choices(words, k=rng.randint(20, 80)) for _ in range(12)]
    for i in range(6, 120):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts[i] = " ".join(own)
    return texts


def test_fingerprint():
    for t in corpus().values():
        assert simhash.fingerprint((t or "").encode(), 3) == brute_fingerprint(t)


@pytest.mark.parametrize("budget", [0, 2, 5])
def test_trie_finds_all_pairs(budget):
    rng = np.random.default_rng(budget)
    near = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (20, 15), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (20, 15), dtype=np.uint64))
    values = np.unique(np.concatenate([near, (near[:, None] ^ flips).ravel()]))
    got = {(int(i), int(j)) for a, b in simhash.trie_pairs(values, budget) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bin(int(values[i] ^ values[j])).count("1") <= budget}
    assert got == want


def test_query_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, fp int")
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = {k: brute_fingerprint(v) for k, v in texts.items()}
    label = brute_components(fps, 2)
    assert got == {k: (fps[k], label[k]) for k in texts}
    assert len(set(label.values())) < len(label)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "z y x w")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1), (1, 1), (None, 1), (None, None)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0

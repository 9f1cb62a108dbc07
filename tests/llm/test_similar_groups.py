"""Near copies of the pipeline against exact similarities."""

import random

import numpy as np

from millrace.llm import simhash


def shingles(words: list[str], k: int = 5) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def alike(a: list[str], b: list[str]) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def fresh(rng: random.Random, n: int) -> list[str]:
    return [f"{rng.getrandbits(40):x}" for _ in range(n)]


def components_of(spark, texts: list[list[str]], **more) -> list[int]:
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    of = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, **more).collect()}
    return [of[i] for i in range(len(texts))]


def test_pairs_below_the_bound_do_not_link(spark):
    rng, texts = random.Random(1), []
    for i in range(120):
        own = fresh(rng, 200)
        other = list(own)
        for at in rng.sample(range(200), 5 if i % 2 else 1):
            other[at] = fresh(rng, 1)[0]
        texts += [own, other]
    of = components_of(spark, texts)
    below = 0
    for i in range(0, len(texts), 2):
        s = alike(texts[i], texts[i + 1])
        below += 0.7 < s < 0.8
        if s < 0.8:
            assert of[i] != of[i + 1]
        elif s > 0.9:
            assert of[i] == of[i + 1]
    assert below > 20


def test_block_edits_and_short_texts_link(spark):
    rng, texts = random.Random(2), []
    for _ in range(40):
        for n, more in ((200, 50), (200, 22), (12, 1), (20, 4), (30, 5), (40, 4)):  # appended; the other way round, cut off
            own = fresh(rng, n)
            texts += [own, own + fresh(rng, more)]
        own = fresh(rng, 225)
        texts += [own, own[:90] + fresh(rng, 20) + own[110:]]  # a block replaced
    of = components_of(spark, texts)
    assert all(alike(texts[i], texts[i + 1]) >= 0.79 for i in range(0, len(texts), 2))
    pairs = [i for i in range(0, len(texts), 2) if alike(texts[i], texts[i + 1]) >= 0.8]
    assert len(pairs) >= 200
    assert all(of[i] == of[i + 1] for i in pairs)


def test_large_groups_are_joined_in_parts(spark):
    rng, texts = random.Random(3), []
    for _ in range(3):
        base = fresh(rng, 60)
        for _ in range(60):
            own = list(base)
            for at in rng.sample(range(60), rng.randint(0, 3)):
                own[at] = fresh(rng, 1)[0]
            texts.append(own)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(texts[i], texts[j]) >= 0.8 and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    assert 10 < len(set(label)) < 150
    assert components_of(spark, texts, part_rows=5) == label


def test_large_groups_of_fingerprints_are_parted(spark):
    rng = np.random.default_rng(4)
    base = (np.uint64(0x1234ABCD) << np.uint64(32)) | rng.integers(0, 1 << 32, 600, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    values = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame(list(enumerate(values.view(np.int64).tolist())), "node long, fp long")
    keyed, _ = simhash.meeting_places(df, 2, most=100)
    assert keyed.groupBy("way", "key").count().agg({"count": "max"}).first()[0] <= 100
    label = np.arange(len(values))
    for a, b in simhash.trie_pairs(values, 2):
        label = simhash.hook(label, a, b)
    got = np.arange(len(values))
    rows = simhash.links(df, 2, most=100).collect()
    got = simhash.hook(got, np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows]))
    assert got.tolist() == label.tolist()
    assert len(np.unique(label)) < len(values) - 150

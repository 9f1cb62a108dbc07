"""Nulls, ties, repeated rows, empty tables and clashing column names; properties that SQL does not show."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, mixing, sharding, simhash, topk_search, url_filter
from millrace.llm.shared import shared_dir, staged


# -- url filters


def judged(spark, urls, **more):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    return {r["page_id"]: r for r in url_filter.filter_urls(df, **more).collect()}


def test_url_cases(spark):
    urls = ["http://EXAMPLE.com/en/7x", "https://a.b.com/en/", "http://notcom/en/", "http://com/en/1?q", "no scheme", None, "", "x://", "http://example.com", "http://s.example.com/en/7/#f", "http://acom/en/", "a://b://c/d", "http://example.net/de/8", "http://x.net/de/8"]
    got = judged(spark, urls)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("example.com", "/en/7x", "example.com/en/7", "allow"), ("a.b.com", "/en/", "com/en/", "block"), ("notcom", "/en/", None, "allow"), ("com", "/en/1", "com/en/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("example.com", "", None, "allow"), ("s.example.com", "/en/7/", "example.com/en/7", "allow"), ("acom", "/en/", None, "allow"), ("b:", "//c/d", None, "allow"), ("example.net", "/de/8", "example.net/de/8", "block"), ("x.net", "/de/8", "net/de/", "allow"),
    ]
    assert judged(spark, []) == {}
    assert judged(spark, ["http://a.b/c"], rules=[("block", "b/")], default="review")[0]["verdict"] == "block"


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"))
    for modulus in (7, 5000):
        rule = F.xxhash64("key") % modulus == 0
        levels = url_filter.build_cascade(keys.where(rule), keys)
        assert len(levels) > 1
        rows = keys.select(F.array(*[url_filter._hash(F.col("key"), i) for i in range(len(levels))]).alias("h"), rule.alias("w")).collect()
        assert (url_filter._held(levels, np.array([r["h"] for r in rows])) == np.array([r["w"] for r in rows])).all()
    # few listed keys among many others: the levels stay as small as the list
    assert sum(x.bits for x in levels) < 40_000


def test_cascades_by_parts_judge_alike(spark):
    rng = random.Random(2)
    rules = [(rng.choice(["allow", "block"]), f"{rng.choice(['a.com', 'com', 'b.a.com', 'org'])}/{rng.choice('xyz')}{rng.choice('xyz')}") for _ in range(30)]
    urls = [f"http://{rng.choice(['a.com', 'b.a.com', 'c.b.a.com', 'z.org', 'org'])}/{''.join(rng.choice('xyz') for _ in range(3))}" for _ in range(200)]
    assert judged(spark, urls, rules=rules, part_keys=5) == judged(spark, urls, rules=rules)
    assert {r["verdict"] for r in judged(spark, urls[:3], rules=[]).values()} == {"allow"}


# -- exact top-k


def test_topk_cases(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, None), (5, [1.0, None]), (6, [float("inf"), 0.0]), (7, [-1.0, 0.0]), (8, []), (None, [1.0, 1.0]), (3, [0.5, 0.5])]
    v = topk_search.integer_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int"))
    got = [tuple(r) for r in topk_search.search(v, v.where("vec_id = 1"), 3).orderBy("rank").collect()]
    assert got == [(1, 1, 2, 32768), (1, 2, 3, 32768), (1, 3, 3, 32768)]
    assert topk_search.search(v, v.limit(0)).count() == 0 and topk_search.search(v.limit(0), v).count() == 0
    own = v.unionAll(spark.createDataFrame([(1, [-256, 0])], "vec_id long, weights array<long>"))
    twice = sorted((tuple(r)[1:] for r in topk_search.search(v, own.where("vec_id = 1"), 2).collect()), key=lambda r: (r[2], -r[0]))
    assert twice == [(2, 8, 0), (2, 3, 32768), (1, 2, 32768), (1, 7, 65536)]  # each row of weights is a query of its own
    some = [r["vec_id"] for r in topk_search.search(v, v.where("vec_id = 1"), 50).orderBy("rank").collect()]
    assert some == [2, 3, 3, 8, 7]


@pytest.mark.parametrize(("block", "part"), [(3, 7), (4, 1000), (100, 50)])
def test_topk_against_brute_force(spark, block, part):
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (300, 9)) / 4
    v = topk_search.integer_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in topk_search.search(v, v.where("vec_id % 30 = 0"), 4, block, part).collect())
    s = np.floor(x * 256).astype(int) @ np.floor(x * 256).astype(int).T
    want = [(q, k + 1, c, int(s[q, c])) for q in range(0, 300, 30) for k, c in enumerate(sorted((c for c in range(300) if c != q), key=lambda c: (-s[q, c], c))[:4])]
    assert got == sorted(want)


# -- mixing


def corpus(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 0) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size int")


def test_mix_reaches_targets(spark):
    rng = random.Random(0)
    docs = corpus(spark, [(i, " \n".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)])
    mix = mixing.mix_sources(docs, slots=256)
    target = {r["source"]: (r["quota"], r["target"]) for r in mix.sources.collect()}
    taken = {r["source"]: r["n"] for r in mix.pieces.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    assert taken == {k: q for k, (q, _) in target.items()}
    assert all(abs(q - t) <= 1 for q, t in target.values())
    most = mix.pieces.groupBy("doc_id", "size").agg(F.sum("length").alias("n")).where("n > 3 * size").count()
    assert most == 0
    # each slot of the schedule is one block of its source, and blocks are of equal size up to a word
    blocks = mix.pieces.where("length > 0").groupBy("source", "rank").agg(F.sum("length").alias("n"), F.countDistinct("slot").alias("s")).collect()
    for source in target:
        own = [r for r in blocks if r["source"] == source]
        assert max(r["n"] for r in own) - min(r["n"] for r in own) <= 1 and {r["s"] for r in own} == {1}
    rows = mixing.mixed_documents(docs, mix)
    words = rows.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in words} == {k: n for k, n in taken.items() if n}
    assert rows.columns == docs.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, mixing.mixed_documents(docs, mixing.mix_sources(docs, slots=256)).collect()))


def test_mix_cases(spark):
    docs = corpus(spark, [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (3, " \t", "y")])
    mix = mixing.mix_sources(docs)
    assert mix.pieces.where("size = 0").count() == 3
    assert mixing.mixed_documents(docs, mix).count() == 2
    assert mixing.mix_sources(docs.limit(0)).pieces.count() == 0
    assert mixing.targets([10, 10], [5, 1], 3.0) == pytest.approx([50 / 3, 10 / 3])
    assert mixing.targets([1, 100], [5, 1], 3.0) == pytest.approx([3.0, 98.0])


# -- sharding


def test_store(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 16, fanout=2, smallest=1 << 10)
    with pytest.raises(ValueError):
        store.read()
    df = spark.createDataFrame([(1, None), (None, "x"), (1, None)], "version int, path string")
    for _ in range(5):
        store.append(df.coalesce(1))
    before = len(store.manifest()["shards"])
    assert store.append(df.limit(0)) == 6
    version = store.compact()
    assert version > 6 and len(store.manifest()["shards"]) < before
    assert sorted(map(str, store.read().collect())) == sorted(map(str, [r for _ in range(5) for r in df.collect()]))
    assert store.read(2).count() == 6
    with pytest.raises(sharding.CommitConflict):
        store.commit(2, "", [])
    with pytest.raises(ValueError):
        store.append(spark.range(1))
    # what a writer left that died before, and what one may still write
    store._write(df, store.manifest()["version"])
    ahead = store._write(df, store.manifest()["version"] + 1)
    n = len(ahead)
    assert store.vacuum() > 0
    assert store.read().count() == 15
    listed = {s.path for s in store.manifest()["shards"]}
    left = {f"data/{d}/{f}" for d, _ in store._list("data") for f, _ in store._list(f"data/{d}") if f.endswith(".parquet")}
    assert left == listed | {s.path for s in ahead} and n


def test_arrivals_of_one_file_are_compacted(spark, tmp_path):
    """All rows in one file still arrive in parts, and their shards are merged."""
    spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(str(tmp_path / "one"))
    df = spark.read.parquet(str(tmp_path / "one"))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, smallest=1 << 10)
    for own in sharding.arrivals(df, 8, "id"):
        store.append(own)
    assert (len(store.manifest()["shards"]), store.manifest()["version"]) == (8, 8)
    assert store.compact() > 8 and len(store.manifest()["shards"]) < 8
    assert sorted(store.read().collect()) == sorted(df.collect())


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda key, default=None: None)

    class Context:
        master, getCheckpointDir = "spark://one:7077", staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)


# -- components and wide SimHash


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 5), (4, 3), (9, 8), (7, 7), (None, 1), (3, 2)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges, "a", "b").collect()}
    assert got == {5: 2, 4: 2, 3: 2, 2: 2, 9: 8, 8: 8}
    assert components.components(edges.limit(0), "a", "b").count() == 0
    chain = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r["component"] for r in components.components(chain, "a", "b").collect()} == {0}
    # hubs: more neighbours than a task should have
    hubs = spark.range(1, 3000).select(F.col("id").alias("a"), (F.col("id") % 3 + 10_000).alias("b")).unionAll(spark.range(1, 2).select(F.lit(10_000), F.lit(10_001)))
    got = {r["node"]: r["component"] for r in components.components(hubs, "a", "b").collect()}
    assert len(got) == 3002 and all(c == (2 if n % 3 == 2 and n < 10_000 or n == 10_002 else 1) for n, c in got.items())


def shingles(text, k=5):
    words = text.split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def test_similar_groups(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(60, 300))
        texts.append(base)
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, len(base) // 12)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(own)
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    sets = [shingles(t) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(i, j) >= 0.8]
    assert len(pairs) > 40
    assert np.mean([group[i] == group[j] for i, j in pairs]) > 0.97
    for i in range(len(texts)):
        if group[i] != i:
            assert max(alike(i, j) for j in range(len(texts)) if j != i and group[j] == group[i]) > 0.6
    same = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (None, "a b")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.similar_groups(same).collect()), key=str)
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (None, 1)]
    assert simhash.similar_groups(same.limit(0)).count() == 0


def test_staged_keeps_rows(spark):
    df = spark.range(10).repartition(3)
    assert staged(df, "x").count() == 10

"""Whole queries against brute force over the smallest tables."""

import hashlib

import numpy as np
from conftest import DATA
from test_simhash import brute_components, brute_fingerprint
from test_suffix_dedup import brute

from millrace.llm import langid, registry, weighted_sampling


def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_op2(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in registry.QUERIES["op2_document_fingerprints"](spark, DATA).collect()}
    assert set(got) == set(docs)
    down = sorted(docs, reverse=True)
    exact, seen = [], {}
    for i, d in enumerate(down):
        text, after = docs[d]["text"] or "", docs[down[(i + 1) % len(down)]]["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (weighted_sampling.Sampler().begin([t.encode()])[0] for t in (text, edited, after))
        for x, y, near in ((a, b, r["near_edited"]), (a, c, r["near_next"])):
            both = x | y
            if both:
                exact.append((sum(min(x[w], y[w]) for w in both) / sum(max(x[w], y[w]) for w in both), near))
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    errors = np.array([near - true for true, near in exact])
    assert abs(errors.mean()) < 0.01 and errors.std() < 0.06


def test_op3_held_out_accuracy(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in registry.QUERIES["op3_language_id"](spark, DATA).collect()}
    assert set(got) == set(docs)
    held = [r for r in got.values() if r["held_out"] and r["lang_pred"] != "und"]
    assert len(held) > 20
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_op4(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r for r in registry.QUERIES["op4_suffix_dedup"](spark, DATA).collect()}
    assert set(got) == set(docs)
    for k, flags in brute({k: r["text"] for k, r in docs.items()}, 400).items():
        data, r = (docs[k]["text"] or "").encode(), got[k]
        assert (r["n_bytes"], r["n_removed"]) == (len(data), sum(flags))
        assert r["n_spans"] == sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
        assert r["kept_sha256"] == hashlib.sha256(bytes(b for b, f in zip(data, flags) if not f)).hexdigest()


def test_op10(spark):
    docs = documents(spark)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.QUERIES["op10_simhash_near_dedup"](spark, DATA).collect()}
    fps = {k: brute_fingerprint(r["text"]) for k, r in docs.items()}
    label = brute_components(fps, 2)
    assert got == {k: (f"{fps[k]:016x}", label[k]) for k in docs}


def test_forward_sums_all_segmentations():
    pieces = langid.Vocabulary.at(langid.public_tokenizers.path(langid.VOCABULARY))
    p = np.random.default_rng(0).random((len(pieces.pieces), 2))
    number = {x: i for i, x in enumerate(pieces.pieces) if x}
    words = ["", "the", "Über", "日本x", "abcdefghijklmnopqrstuvwxyz" * 3, "a"]

    def total(s: str, language: int) -> float:
        sums = [1.0] + [0.0] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - pieces.longest), e):
                i = number.get(s[b:e], 0 if e - b == 1 else None)
                if i is not None:
                    sums[e] += sums[b] * p[i, language]
        return sums[-1]

    got = langid.log_probabilities(words, pieces, p)
    want = [[np.log(total("▁" + w, i)) for i in range(2)] for w in words]
    assert np.allclose(got, want)


def test_expected_counts_add_up():
    pieces = langid.Vocabulary.at(langid.public_tokenizers.path(langid.VOCABULARY))
    p = np.full(len(pieces.pieces), 1 / len(pieces.pieces))
    words, weights = ["there", "x" * 40, "日本"], np.array([1.0, 2.0, 3.0])
    counts = langid.expected_counts(words, pieces, p, weights)
    length = np.array([max(1, len(x)) for x in pieces.pieces])
    assert np.isclose((counts * length).sum(), sum((len(w) + 1) * n for w, n in zip(words, weights)))


def test_und_and_nulls(spark):
    model = langid.Model(["a", "b"], np.full((len(langid.Vocabulary.at(langid.public_tokenizers.path(langid.VOCABULARY)).pieces), 2), 1e-4))
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "12 ²³ !?", 5), (None, "words", 5)], "doc_id long, text string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    assert got == {1: ("und", 0.0), 2: ("und", 0.0), 3: ("und", 0.0), None: ("a", 0.5)}
    assert langid.learn(df.limit(0).selectExpr("doc_id", "text", "'x' as lang")).languages == []
    assert {r["lang_pred"] for r in langid.identify(df, langid.Model([], np.zeros((1, 0)))).collect()} == {"und"}


def test_edits_of_one_document_and_of_none(spark):
    one = spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")
    r = weighted_sampling.with_edits(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"abcd abcd").hexdigest()
    assert weighted_sampling.with_edits(one.limit(0)).count() == 0
    some = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, "x z"), (2, None), (2, "")], "doc_id long, text string")
    assert weighted_sampling.with_edits(some).count() == 5
    assert weighted_sampling.fingerprints(some).where("fingerprint rlike '^0+$'").count() == 2


def test_samples_do_not_depend_on_what_is_kept(monkeypatch):
    """Tables of kept draws take less than 24 MB; without room for any, in other orders and with long texts the samples are the same."""
    texts = [" ".join(f"w{(i * j) % 97 if j % 3 else i * 50 + j}" for j in range(400)).encode() for i in range(40)] + [b"", b"a a A b"]
    many = [weighted_sampling.text_of(x.fingerprint(c)) for x in [weighted_sampling.Sampler()] for c in x.begin(texts)]
    own = weighted_sampling.Sampler()
    assert sum(a.nbytes for x in vars(own).values() for a in (x if isinstance(x, list) else [x]) if isinstance(a, np.ndarray)) < 24 << 20
    alone = [weighted_sampling.text_of(own.fingerprint(own.begin([t])[0])) for t in reversed(texts)]
    monkeypatch.setattr(weighted_sampling, "WORDS", 4)
    monkeypatch.setattr(weighted_sampling, "OFTEN", 2)
    none = weighted_sampling.Sampler()
    drawn = [weighted_sampling.text_of(none.fingerprint(none.begin([t])[0])) for t in texts]
    assert many == alone[::-1] == drawn and many[-2] == "0" * 512

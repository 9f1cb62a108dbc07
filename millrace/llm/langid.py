"""Language ID (operator 3): unigrams over a fixed public vocabulary of pieces, marginalised over segmentations.

Each language has a probability for every piece of the vocabulary. A word's probability is the sum over all ways to write it
as a sequence of pieces, found by a forward algorithm that goes over the word's positions; a text's is the product over its
words. The probabilities are learnt by expectation maximisation: a forward-backward pass gives each piece's expected count.
Both passes handle many words at once, as arrays of (word, position, piece length).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, partitions, staged, table

VOCABULARY = "piece_bpe_32k.model"
#: About so many documents of each language are learnt from (chosen by a hash of their id); all are, if there are fewer.
PER_LANGUAGE = 4000
#: The most languages; a model is a table of languages by pieces.
MAX_LANGUAGES = 256
ROUNDS = 3
#: The weight of all languages' mean in each one's probabilities, in counts.
PRIOR = 2000.0
FOLDS = 5
#: The most words whose probabilities a task keeps, and the most characters handled at once.
CACHE = 100_000
CHARS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A word is a run of letters of the lower-cased text.
_WORD = re.compile(r"[^\W\d_]+")


class Vocabulary:
    """The pieces that are made of characters, by hash; piece 0 stands for a character that is no piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = sorted({model.id_to_piece(i) for i in ids})
        self.pieces = ["", *pieces]
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self._hashes, self._ids = hashes[order], (order + 1).astype(np.int32)
        # the hash's upper bits lead to the first entry that may be it
        self._shift = np.uint64(64 - 18)
        self._first = np.searchsorted(self._hashes, np.arange(1 << 18, dtype=np.uint64) << self._shift).astype(np.int32)
        self._most = int(np.bincount((self._hashes >> self._shift).astype(np.int64)).max())

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        h = (h ^ (h >> 31)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return np.uint64(h)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 if none."""
        out = np.full(hashes.shape, -1, np.int32)
        at = self._first[(hashes >> self._shift).astype(np.int64)]
        for i in range(self._most):
            own = np.minimum(at + i, len(self._hashes) - 1)
            out = np.where(self._hashes[own] == hashes, self._ids[own], out)
        return out

    @staticmethod
    @lru_cache(maxsize=2)
    def at(path: str) -> Vocabulary:
        """Loaded once a process."""
        return Vocabulary(path)

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids[word, end, k]): the piece of k + 1 characters that ends after position ``end``, -1 if none. A word starts with U+2581."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        width = int(lengths.max(initial=0))
        codes = np.zeros((len(words), width), np.uint64)
        flat = np.frombuffer("".join(f"▁{w}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.arange(width) < lengths[:, None]
        codes[inside] = flat.astype(np.uint64) + np.uint64(1)
        longest = min(self.longest, width)
        ids = np.full((len(words), width, longest), -1, np.int32)
        h = np.zeros((len(words), width), np.uint64)
        for k in range(longest):
            # h[:, s] is the hash of k + 1 characters from s on
            h = h[:, : width - k] * _BASE + codes[:, k:]
            mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            ids[:, k:, k] = np.where(inside[:, k:], self.look_up(mixed), -1)
        ids[:, :, 0] = np.where(inside & (ids[:, :, 0] < 0), 0, ids[:, :, 0])
        return lengths, ids


def forward(ids: np.ndarray, lengths: np.ndarray, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha[word, position, language], log scale of each position): sums over all segmentations of the first characters.

    ``table_`` is (pieces + 1, languages), its last row zero, or the same with a word axis for one language a word.
    """
    n, width, longest = ids.shape
    each = table_.shape[-1]
    alpha, scale = np.zeros((n, width + longest, each)), np.zeros((n, width + longest))
    alpha[:, longest - 1] = 1.0
    so_far = np.zeros(n)
    for e in range(width):
        # pieces of k + 1 characters come from position e - k
        came = alpha[:, e : e + longest][:, ::-1]
        now = np.einsum("nkl,nkl->nl", came, table_[ids[:, e]])
        alpha[:, e + longest] = now
        scale[:, e + longest] = so_far
        if e % 8 == 7:
            # what later positions look back on is scaled together
            window = alpha[:, e + 1 : e + longest + 1]
            most = window.max(axis=(1, 2))
            most[most == 0] = 1.0
            window /= most[:, None, None]
            so_far = so_far + np.log(most)
            scale[:, e + 1 : e + longest + 1] = so_far[:, None]
    return alpha[:, longest - 1 :], scale[:, longest - 1 :]


def _chunks(words: list[str]) -> Iterator[np.ndarray]:
    """Indices of words of similar length, CHARS characters at most together (or one word)."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        step = max(1, CHARS // 16 // int(size[order[lo]]))
        hi = min(len(order), lo + step)
        while hi > lo + 1 and (int(size[order[hi - 1]]) * (hi - lo) > CHARS // 16 or size[order[hi - 1]] > 2 * size[order[lo]]):
            hi = lo + max(1, (hi - lo) // 2)
        yield order[lo:hi]
        lo = hi


def log_probabilities(words: list[str], vocabulary: Vocabulary, probabilities: np.ndarray) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations of each word."""
    padded = np.vstack([probabilities, np.zeros((1, probabilities.shape[1]))])
    out = np.zeros((len(words), probabilities.shape[1]))
    for at in _chunks(words):
        lengths, ids = vocabulary.lattice([words[i] for i in at])
        alpha, scale = forward(ids, lengths, padded)
        row = np.arange(len(at))
        out[at] = np.log(np.maximum(alpha[row, lengths], 1e-300)) + scale[row, lengths][:, None]
    return out


def expected_counts(words: list[str], vocabulary: Vocabulary, probabilities: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected number of each piece in the weighted words under one language's ``probabilities`` (pieces,)."""
    padded = np.append(probabilities, 0.0)[:, None]
    out = np.zeros(len(probabilities))
    for at in _chunks(words):
        lengths, ids = vocabulary.lattice([words[i] for i in at])
        n, width, longest = ids.shape
        # gamma of a piece from s to e is alpha[s] * p * beta[e] / alpha[end]; beta by the same pass over the reversed lattice
        alpha, up = forward(ids, lengths, padded)
        back = np.full_like(ids, -1)
        row = np.arange(n)
        for k in range(longest):
            # the piece of k + 1 characters that starts at s ends after s + k; reversed, it ends after position length - 1 - s
            s = np.arange(width - k)
            end = lengths[:, None] - 1 - s
            good = end >= k
            r, c = np.nonzero(good)
            back[r, end[r, c], k] = ids[r, s[c] + k, k]
        beta, down = forward(back, lengths, padded)
        total = np.log(np.maximum(alpha[row, lengths, 0], 1e-300)) + up[row, lengths]
        for k in range(longest):
            r, e = np.nonzero(ids[:, :, k] >= 0)
            s, rest = e - k, lengths[r] - 1 - e
            live = (s >= 0) & (rest >= 0)
            r, e, s, rest = r[live], e[live], s[live], rest[live]
            piece = ids[r, e, k]
            a, b = alpha[r, s, 0], beta[r, rest, 0]
            with np.errstate(divide="ignore"):
                log = np.log(a) + up[r, s] + np.log(b) + down[r, rest] - total[r]
            out += np.bincount(piece, weights[at][r] * np.exp(np.minimum(log + np.log(np.maximum(probabilities[piece], 1e-300)), 0.0)), minlength=len(out))
    return out


@dataclass
class Model:
    languages: list[str]
    probabilities: np.ndarray  # (pieces, languages)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """(pieces, languages) probabilities: each language's counts and PRIOR counts of the mean, which has a little of every piece."""
    mean = (counts + 1e-12).sum(axis=1) + 0.01
    mean /= mean.sum()
    return (counts + PRIOR * mean[:, None]) / (counts.sum(axis=0) + PRIOR)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod FOLDS; 0 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def learn(docs: DataFrame, vocabulary: str | None = None, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """A model of the values of ``lang``, from documents outside fold 0 whose text and lang are not null.

    About ``per_language`` documents of each language are learnt from. No such documents give a model of no language.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    known = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(found)
    size = len(Vocabulary.at(path).pieces)
    if not languages:
        return Model([], np.zeros((size, 0)))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / found[k])))])
    number = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    words = sample.select(number[F.col("lang")].cast("long").alias("language"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_counted), "language long, word string, n long")
    counts = staged(words.groupBy("language", "word").agg(F.sum("n").alias("n")).repartition(partitions(spark)), "word-counts")
    probabilities = np.full((size, len(languages)), 1.0 / size)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(probabilities)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, total = Vocabulary.at(path), np.zeros(shared.value.shape)
            for batch in batches:
                language, word, n = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for i in np.unique(language):
                    own = np.flatnonzero(language == i)
                    total[:, i] += expected_counts([word[j] for j in own], pieces, shared.value[:, i], n[own].astype(float))
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(total[piece, language])], ["piece", "language", "n"])

        # at most a row for each piece and language
        got = counts.mapInArrow(lean(run), "piece long, language long, n double").groupBy("piece", "language").agg(F.sum(F.round("n", 9).cast("decimal(28,9)")).cast("double").alias("n")).toPandas()
        total = np.zeros((size, len(languages)))
        total[got["piece"], got["language"]] = got["n"]
        probabilities = smoothed(total)
    return Model(languages, probabilities)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each batch has each word, by language."""
    for batch in batches:
        counts: Counter = Counter()
        for lo in range(0, batch.num_rows, 128):
            for language, text in zip(*(c.slice(lo, 128).to_pylist() for c in batch.columns), strict=True):
                counts.update((language, w) for w in _WORD.findall(text.lower()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int64()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["language", "word", "n"])


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model, vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all) columns of docs, lang_pred string, score double: the likeliest language of each whole text, and its probability among the model's.

    Languages are equally likely beforehand; ties go to the first by name. ``und`` with score 0 if the text is null or has no
    letter, or if the model has no language. Repeated rows are judged alike; an empty table gives an empty result. Columns
    of docs named lang_pred or score are replaced.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kept = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, pieces = shared.value, Vocabulary.at(path)
        known: dict[str, int] = {}
        logs = np.zeros((0, len(m.languages)))
        for batch in batches:
            pred: list[str] = []
            score = np.zeros(batch.num_rows)
            for lo in range(0, batch.num_rows, 128):
                texts = batch.column(len(kept)).slice(lo, 128).to_pylist()
                own = [_WORD.findall(t.lower()) if m.languages and t and _has_letter(t) else [] for t in texts]
                words = set().union(*own)
                new = list(words.difference(known))
                if new:
                    if len(known) > CACHE:
                        known, logs, new = {}, logs[:0], list(words)
                    known.update(zip(new, range(len(logs), len(logs) + len(new)), strict=True))
                    logs = np.vstack([logs, log_probabilities(new, pieces, m.probabilities)])
                for i, words in enumerate(own):
                    if not words:
                        pred.append("und")
                        continue
                    total = logs[list(map(known.__getitem__, words))].sum(axis=0)
                    best = int(total.argmax())
                    pred.append(m.languages[best])
                    score[lo + i] = 1.0 / np.exp(total - total[best]).sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(pred, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").cast("string").alias("text_of_"))
    fields = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(lean(run), fields)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language: (doc_id, held_out, lang_pred, score).

    ``und`` with score 0 where the text is null or has no letter, or nothing could be learnt; ties go to the first language by name. A null doc_id
    is held out; a null lang teaches nothing. Repeated rows are judged alike; no rows give no rows; other columns are ignored.
    """
    docs = table(spark, sf_dir, "documents")
    judged = identify(docs.select("doc_id", "text"), learn(docs), keep=["doc_id"])
    return judged.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")

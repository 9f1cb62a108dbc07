"""Document fingerprints (operator 2): consistent weighted sampling of words by their counts.

For sample k, each word t with count w draws r and c from Gamma(2, 1) and b from [0, 1), all from a hash of (t, k). With
n = floor(ln w / r + b) the word bids ln c - r * (n - b + 1), and the least bid's (word, n) is the sample (Ioffe, 2010). Two texts share
a sample with a probability equal to the generalised Jaccard similarity of their counts: the sum of the lesser counts over
the sum of the greater.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import partitions, table

SAMPLES = 128
#: Hexadecimal digits of a sample in a fingerprint.
DIGITS = 4
#: The most words whose bids are kept (512 bytes each), and the most words that occur often in a text whose draws are (1,536 bytes).
WORDS, OFTEN = 1 << 14, 1 << 13
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _gamma_quantiles(bits: int = 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**bits equal parts, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    lo, hi = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return (lo + hi) / 2


class Sampler:
    """Fingerprints of bags of words. Draws are made for the words of a few texts at a time and used for all of them."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        g = _gamma_quantiles()
        self._r, self._log_c = g.astype(np.float32), np.log(g).astype(np.float32)
        self._seeds = np.random.default_rng(2010).integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # bids of words that occur once, and the draws of words that occur more often
        self._index: dict[bytes, int] = {}
        self._hash = np.zeros(WORDS, np.uint64)
        self._bids = np.zeros((WORDS, samples), np.float32)
        self._often: dict[bytes, int] = {}
        self._draws = [np.zeros((OFTEN, samples), np.float32) for _ in range(3)]

    def _drawn(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(r, ln c, b, the bid of a word that occurs once) for word hashes and all samples."""
        x = h[:, None] * self._seeds
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x = x.astype("<u8", copy=False)
        parts = x.view("<u2").reshape(*x.shape, 4)  # the lowest first
        r, log_c = self._r.take(parts[..., 0], mode="clip"), self._log_c.take(parts[..., 1], mode="clip")
        b = x.view("<u4").reshape(*x.shape, 2)[..., 1].astype(np.float32)
        b *= np.float32(2.0**-32)
        return r, log_c, b, log_c - r * (1 - b)

    def begin(self, texts: list[bytes]) -> list[Counter]:
        """Counts of the words of ``texts``; bids and draws for them are ready afterwards, unless they are too many to keep."""
        counts = [Counter(_WORD.findall(t.translate(_UPPER))) for t in texts]
        every = set().union(*counts)
        new = [w for w in every if w not in self._index]
        if len(self._index) + len(new) > WORDS:
            self._index, new = {}, list(every)
        if len(new) <= WORDS:
            n = len(self._index)
            self._index.update(zip(new, range(n, n + len(new)), strict=True))
            h = self._hash[n : n + len(new)] = self._hashes(new)
            for lo in range(0, len(new), 256):
                self._bids[n + lo : n + min(lo + 256, len(new))] = self._drawn(h[lo : lo + 256])[3]
        every = {w for c in counts for w, k in c.items() if k > 1}
        new = [w for w in every if w not in self._often]
        if len(self._often) + len(new) > OFTEN:
            self._often, new = {}, list(every)
        if len(new) <= OFTEN:
            n = len(self._often)
            self._often.update(zip(new, range(n, n + len(new)), strict=True))
            h = self._hashes(new)
            for lo in range(0, len(new), 256):
                for kept, drawn in zip(self._draws, self._drawn(h[lo : lo + 256])[:3], strict=True):
                    kept[n + lo : n + min(lo + 256, len(new))] = drawn
        return counts

    @staticmethod
    def _hashes(words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words))

    def fingerprint(self, counts: Counter) -> np.ndarray:
        """(samples,) of 16 bits; zeros for no words."""
        k, i = np.arange(self.samples), np.zeros(self.samples, np.int64)
        best, won, level = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.int64)
        if not counts:
            return np.zeros(self.samples, np.uint16)
        words, w = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
        at = np.fromiter(map(self._index.get, words, repeat(-1)), np.int64, len(words))
        kept = bool((at >= 0).all())
        h = self._hash[at] if kept else self._hashes(words)
        for often in (False, True):
            some = np.flatnonzero((w > 1) == often)
            if often:
                place = np.fromiter((self._often.get(words[i], -1) for i in some.tolist()), np.int64, len(some))
                known = bool((place >= 0).all())
            for lo in range(0, len(some), 1024):
                own = some[lo : lo + 1024]
                if often:
                    r, log_c, b = (d.take(place[lo : lo + 1024], axis=0) for d in self._draws) if known else self._drawn(h[own])[:3]
                    n = np.floor(np.log(w[own]).astype(np.float32)[:, None] / r + b)
                    bid = log_c - r * (n - b + 1)
                else:
                    bid = self._bids.take(at[own], axis=0) if kept else self._drawn(h[own])[3]
                got = bid.min(axis=0)
                row, sample = np.divmod(np.flatnonzero(bid == got)[::-1], self.samples)
                i[sample] = row  # the first of equal ones, as it comes last
                win = got < best
                best[win], won[win], level[win] = got[win], h[own][i[win]], n[i, k][win].astype(np.int64) if often else 0
        x = (won + level.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return np.maximum((x >> np.uint64(48)).astype(np.uint16), 1)


def text_of(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint string): ``samples`` samples of DIGITS hexadecimal digits each, of every whole text.

    Words are runs of non-white ASCII, A-Z lower-cased, weighted by their count. Null, empty and wordless texts have a fingerprint of
    zeros, which no other text has. Equal texts have equal fingerprints; repeated rows are returned as they come; an empty
    table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sampler(samples)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            out: list[str] = []
            for lo in range(0, len(texts), 16):
                out += [text_of(own.fingerprint(c)) for c in own.begin(texts[lo : lo + 16])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose second half comes from the next document.

    The order is by descending doc_id (nulls last), then by a hash of the text; after the last document comes the first, so
    a single document is its own next. Rows are dealt into ranges of ids; a range's first document also goes to the end
    of the range before it, so a task needs no row of another one.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", F.lit([i / n for i in range(1, n)] or [0.5]), 100 * n).alias("q")).first()["q"]
    cuts = sorted(set(map(float, cuts or [0.0])))
    asked = rows.withColumn("id", F.col("doc_id").cast("double"))
    ranged = Bucketizer(splits=[-np.inf, *cuts, np.inf], inputCol="id", outputCol="up", handleInvalid="keep").transform(asked)
    # range 0 has the greatest ids; rows without an id are in a range of their own, the last
    last = len(cuts) + 1
    down = F.when(F.col("up") < last, last - 1 - F.col("up")).otherwise(last).cast("int")
    rows = ranged.select("doc_id", "text", down.alias("range"), F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)).alias("order"))
    firsts = sorted((r["range"], r["order"]) for r in rows.groupBy("range").agg(F.min("order").alias("order")).collect())
    ahead = spark.createDataFrame([(r, order, firsts[i - 1][0]) for i, (r, order) in enumerate(firsts)], "range int, order long, ahead int")
    own = F.struct("range", F.lit(False).alias("extra"))
    places = F.when(F.col("ahead").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("ahead").alias("range"), F.lit(True).alias("extra"))))
    every = rows.join(F.broadcast(ahead), ["range", "order"], "left").select("doc_id", "text", "order", F.explode(places).alias("place")).select("doc_id", "text", "order", "place.range", "place.extra")
    dealt = every.withColumn("tie", F.xxhash64("text")).repartitionById(n, F.col("range")).sortWithinPartitions("range", "extra", "order", "tie").select("doc_id", "text", "range", "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sampler(samples)
        held: list[tuple] = []  # (doc_id, text, range, extra)
        out: list[tuple] = []
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

        def settle(group: list[tuple]) -> None:
            """All but the last row of ``group`` have their next row after them."""
            edited = []
            for (_, text, r, extra), (_, after, r2, _) in zip(group, group[1:]):
                half = len(text) // 2
                edited.append(text[: len(text) - half] + after[:half] if r == r2 and not extra else "")
            counts = own.begin([*(t.encode() for _, t, _, _ in group), *(t.encode() for t in edited)])
            marks = [own.fingerprint(c) for c in counts]
            for i, e in enumerate(edited):
                if group[i][2] == group[i + 1][2] and not group[i][3]:
                    mine, theirs, new = marks[i], marks[i + 1], marks[len(group) + i]
                    out.append((group[i][0], len(group[i][1]), hashlib.sha256(e.encode()).hexdigest(), text_of(mine), text_of(new), likeness(mine, new), likeness(mine, theirs)))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) > 16 or sum(len(x[1]) for x in held) > 1 << 20:
                    settle(held)
                    held = held[-1:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()
        settle(held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, EDITED)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its edited text: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    A null text is empty, and has the fingerprint of a text without words. Documents go by descending doc_id (null last, ties and repeated rows in
    any order, each a document of its own); after the last comes the first, so a table of one row is edited with itself. No rows
    give no rows; other columns are ignored.
    """
    return with_edits(table(spark, sf_dir, "documents"))

"""Packing (operator 9): cutting-stock column generation over the histogram of piece lengths.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens. Pieces fall into length classes (a fixed number of
them, whatever the input), whose counts are the demands of a cutting-stock problem: a linear program over patterns, each a
way to fill a sequence. It is solved on the driver by column generation, the columns priced by a knapsack dynamic
program. The patterns' numbers are rounded down and the little that is left is packed first-fit. Pieces are ranked within
their class and take the patterns' places in rank order, so the assignment is a look-up of (class, rank) in a table of
bounded size.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import lean, staged, table

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: The id that ends each document.
END = 1
#: The most words whose ids a task keeps.
CACHE = 500_000
#: Pieces that are ranked together.
GROUP = 4096


#: Texts of these bytes in Latin-1 are parted here as the tokenizer parts them; fixed values: its letters, and everything it takes for one.
_UPPER = bytes(c for c in range(256) if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7)
_LOWER = bytes(c + 32 for c in _UPPER)
_LETTERS = bytes(c for c in range(256) if 97 <= c <= 122 or c in (0xAA, 0xB5, 0xBA) or c >= 0xDF and c != 0xF7)
_PLAIN = bytes(range(32, 127)) + b"\t\n\r" + _UPPER + _LETTERS
_TO_LOWER = bytes.maketrans(_UPPER, _LOWER)
#: How byte-level vocabularies write a byte: printable ones as themselves, the others in order from U+0100 on.
_HIDDEN = [c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 172 or c >= 174)]
_SHOWN = {c: 256 + i for i, c in enumerate(_HIDDEN)}
_PART = re.compile(b"'s|'t|'re|'ve|'m|'ll|'d|[%s]+|[0-9]|[^ \t\n\r%s0-9]+" % (_LETTERS, _LETTERS))


class _Known(dict):
    """Ids of parts; one that is missing is encoded."""

    def __init__(self, tokenizer):
        super().__init__({"": b""})
        self._tokenizer, self._model = tokenizer, tokenizer.model

    def __missing__(self, part: bytes | str) -> bytes:
        if isinstance(part, bytes):  # one part: the model's pairs are merged in it
            ids = [t.id for t in self._model.tokenize(part.decode("latin-1").encode().decode("latin-1").translate(_SHOWN))]
        else:
            ids = self._tokenizer.encode(part, add_special_tokens=False).ids
        own = self[part] = array("I", ids).tobytes()
        return own


class WordCoder:
    """Ids of whole texts, as little-endian bytes. No id reaches across the parts into which the tokenizer cuts a text, so each part is encoded once.

    Texts of plain Latin-1 characters are cut here, after lower-casing; others at spaces and line ends only, which are always cuts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        self._tokenizer = Tokenizer.from_file(path)
        self._known = _Known(self._tokenizer)

    @staticmethod
    def _parts(text: str) -> list:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = None
        if raw is None or b"<|" in raw or raw.translate(None, _PLAIN):
            return text.replace("\n", " ").split(" ")
        return _PART.findall(raw.translate(_TO_LOWER))

    def __call__(self, texts: list[str], end: int) -> list[bytes]:
        last, ids = array("I", [end]).tobytes(), self._known.__getitem__
        out = [b"".join(map(ids, self._parts(t))) + last for t in texts]
        if len(self._known) > CACHE:
            self._known = _Known(self._tokenizer)
        return out


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids array<int>]) of the pieces of each document, null texts being empty."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                coded = coder(batch.column(1).slice(lo, 256).to_pylist(), END)
                counts = np.array([len(c) // 4 for c in coded])
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(len(coded)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(counts[doc] - start, capacity)
                views = [memoryview(c) for c in coded]
                crc = [zlib.crc32(views[d][4 * s : 4 * (s + k)]) for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(doc + lo)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if ids:
                    flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(flat)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(lean(run), fields)


# -- the cutting-stock problem


def steps(capacity: int = CAPACITY) -> tuple[int, int, int]:
    """(least, fine, unit): lengths up to ``least`` fall into classes of ``fine`` and fill gaps; longer ones into classes of ``unit``, which the linear program packs."""
    return capacity // 32, max(1, capacity // 1024), max(1, capacity // 128)


def class_of(length: Column, capacity: int = CAPACITY) -> Column:
    """The size of a length's class: the length rounded up."""
    least, fine, unit = steps(capacity)
    up = lambda step: F.ceil(length / step) * step
    return F.least(F.when(length <= least, up(fine)).otherwise(up(unit)), F.lit(capacity)).cast("long")


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling (with repeats), and how many of each size it takes. sizes ascend."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        worth[c] = worth[c - 1]
        if k := fit[c]:
            got = worth[c - sizes[:k]] + values[:k]
            best = int(got.argmax())
            if got[best] > worth[c]:
                worth[c], last[c] = got[best], best
    taken, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            taken[last[c]] += 1
            c -= sizes[last[c]]
    return float(worth[capacity]), taken


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan; no library threads are started beside the session's."""
    m = len(a)
    both = np.hstack([a, np.eye(m)])
    for i in range(m):
        k = i + int(np.abs(both[i:, i]).argmax())
        both[[i, k]] = both[[k, i]]
        both[i] /= both[i, i]
        others = np.arange(m) != i
        both[others] -= np.outer(both[others, i], both[i])
    return both[:, m:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a column) and how often the linear program uses each: the sum is least, up to ``gap``, and demand is met or exceeded.

    The basis begins with a pattern of each size alone. A size whose price is negative takes a surplus column; else the
    knapsack gives the pattern that is worth most. All sizes ascend.
    """
    m = len(sizes)
    per = capacity // sizes
    basis, cost, inverse, x = np.diag(per).astype(float), np.ones(m), np.diag(1.0 / per), demand / per
    bound = 0.0
    for step in range(rounds):
        price = cost @ inverse
        low = int(price.argmin())
        if price[low] < -1e-9:
            column, price_of = np.zeros(m), 0.0
            column[low] = -1.0
        else:
            price = np.maximum(price, 0)
            worth, taken = knapsack(sizes, price, capacity)
            bound = max(bound, float(demand @ price) / max(worth, 1.0))
            if worth <= 1 + 1e-9 or cost @ x <= (1 + gap) * bound:
                break
            column, price_of = taken.astype(float), 1.0
        way = inverse @ column
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / way[up]
        out = int(ratio.argmin())
        theta = ratio[out]
        x = np.maximum(x - theta * way, 0)
        x[out], basis[:, out], cost[out] = theta, column, price_of
        inverse[out] /= way[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(way[others], inverse[out])
        if step % 100 == 99:  # keep rounding errors down
            inverse = _inverse(basis)
            x = np.maximum(inverse @ demand, 0)
    return basis[:, cost > 0].astype(np.int64), x[cost > 0]


@dataclass
class Plan:
    """Places for the pieces of each class: ranks from ``first`` on fill sequences from ``sequence`` on, ``each`` to a sequence."""

    sizes: np.ndarray
    keys: np.ndarray  # class index << 48 | first rank, sorted
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray

    def sequences(self, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.keys, (at << 48) | rank, side="right") - 1
        return self.sequence[i] + (rank - self.first[i]) // self.each[i]


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> Plan:
    """Patterns for the whole demand (sizes ascend): the linear program's, rounded down, then first-fit, the longest first, for the rest and the short ones."""
    least, _, unit = steps(capacity)
    rest = demand.copy()
    groups: list[list] = []  # [counts of a sequence, number of sequences, tokens left in each]
    main = np.flatnonzero(sizes > least)
    if len(main):
        patterns, x = column_generation(-(-sizes[main] // unit), demand[main].astype(float), capacity // unit)
        for column, n in zip(patterns.T, np.floor(x + 1e-6).astype(np.int64).tolist(), strict=True):
            own = np.zeros(len(sizes), np.int64)
            own[main] = column
            if n and (space := capacity - int(own @ sizes)) >= 0:
                groups.append([own, n, space])
                rest = np.maximum(rest - n * own, 0)
    for i in range(len(sizes) - 1, -1, -1):
        size, left = int(sizes[i]), int(rest[i])
        for g in groups:
            if left >= g[1] and (k := min(g[2] // size, left // g[1])):
                g[0][i] += k
                g[2] -= k * size
                left -= k * g[1]
        per = capacity // size
        for n, k in ((left // per, per), (1, left % per)):
            if n and k:
                own = np.zeros(len(sizes), np.int64)
                own[i] = k
                groups.append([own, n, capacity - k * size])
    rows, sequence, rank = [], 0, np.zeros(len(sizes), np.int64)
    for own, n, _ in groups:
        for i in np.flatnonzero(own).tolist():
            rows.append((i, int(rank[i]), sequence, int(own[i])))
            rank[i] += n * own[i]
        sequence += n
    rows.sort()
    at, first, seq, each = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ((),) * 4))
    return Plan(sizes, (at << 48) | first, first, seq, each)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, start, length and any others) with (sequence_id, offset): sequences of at most ``capacity`` tokens.

    Columns of ``pieces`` named sequence_id or offset are replaced.

    Pieces of length 1 to ``capacity``; each gets one place, and the places of a sequence follow one another from 0. Equal
    rows are pieces of their own. An empty table gives an empty result. A rerun gives the same result. To the driver go the
    counts of the length classes, fewer than 200.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    size = class_of(F.col("length"), capacity)
    counts = {r["size_"]: r["n"] for r in pieces.groupBy(size.alias("size_")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= s <= capacity for s in counts):
        raise ValueError(f"a piece's length is from 1 to {capacity}")
    sizes = np.array(sorted(counts), np.int64)
    made = plan(sizes, np.array([counts[s] for s in sizes.tolist()], np.int64), capacity)

    # ranks: groups of a class by hash, ranked inside and one after the other
    groups = max(16, sum(counts.values()) // GROUP)
    rows = pieces.select("doc_id", "start", "length", F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row_"))  # whatever its other columns are called
    dealt = rows.withColumn("size_", size).withColumn("group_", F.pmod(F.xxhash64("doc_id", "start", "length"), F.lit(groups)))
    own = Window.partitionBy("size_", "group_").orderBy("doc_id", "start")
    before = Window.partitionBy("size_").orderBy("group_").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("size_", "group_").agg(F.count(F.lit(1)).alias("n_")).select("size_", "group_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    ranked = dealt.withColumn("rank_", F.row_number().over(own)).join(base, ["size_", "group_"]).withColumn("rank_", F.col("rank_") - 1 + F.col("base_"))
    shared = spark.sparkContext.broadcast(made)

    @F.pandas_udf("long")
    def place(size: pd.Series, rank: pd.Series) -> pd.Series:
        p = shared.value
        return pd.Series(p.sequences(np.searchsorted(p.sizes, size.to_numpy()), rank.to_numpy()))

    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("sequence_id", place("size_", "rank_"))
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select("row_.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset): the documents' pieces, packed.

    A document is its tokens and the id 1; null texts are empty, so they are that id alone. Documents are cut at multiples of
    ``capacity``. ``ids=False`` leaves the ids out and keeps their CRC-32 (of unsigned little-endian 32-bit integers).
    """
    return pack(staged(cut_pieces(docs, tokenizer, capacity, ids), "pieces"), capacity)


def sequences(packed: DataFrame, pad: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, input_ids array<int>): a row for each sequence of ``packed`` (with ids), padded to ``capacity`` unless its length is a power of two."""
    own = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("own"))
    flat = F.flatten(F.transform("own", lambda x: x["ids"]))
    n = F.size("flat")
    padded = F.when(n.bitwiseAND(n - 1) == 0, F.col("flat")).otherwise(F.concat("flat", F.array_repeat(F.lit(pad), F.lit(capacity) - n)))
    return own.select("sequence_id", flat.alias("flat")).select("sequence_id", padded.alias("input_ids"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is its end mark alone. Repeated rows, and rows without a doc_id, are documents of their own; of pieces that are alike it is
    not said which goes where. A long text is cut at multiples of 2048. No rows give no rows; other columns are ignored.
    """
    return pack_documents(table(spark, sf_dir, "documents"), ids=False)

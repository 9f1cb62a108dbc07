"""Exact top-k search (operator 6): exhaustive term-at-a-time accumulation over integer vectors.

A dimension is a term, its posting list the rows that have weight there. A block of query rows walks its terms and adds
weight times posting into dense score arrays, one per candidate part; each part selects its k best per query, and the parts'
lists are merged. Queries are rows of a table, dealt into blocks of about ``block``, candidates into parts of about ``part``;
each block meets each part in one group of a shuffle, where the block is held and the candidates stream by. All candidates
are scored, none is skipped, and no vector passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions, table

#: Candidates scored at once, so that a block of scores stays in the processor's cache.
ROWS = 4096
#: Queries scored at once.
TOGETHER = 32


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, weights array<long>): floor(scale * x) of each component; vectors null, with a null or a non-finite component, and rows without an id are left out."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v).cast("long")).alias("weights"))


def _dense(weights: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``width`` columns; missing components are zero."""
    ends, flat = weights.offsets.to_numpy().astype(np.int64), weights.values.to_numpy(zero_copy_only=False)
    n = np.diff(ends)
    if len(n) and (n == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(n), width), np.int64)
    at = np.repeat(np.arange(len(n)), n), np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], n)
    keep = at[1] < width
    out[at[0][keep], at[1][keep]] = flat[ends[0] : ends[-1]][keep]
    return out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, a term at a time."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    kind = np.int32 if most < 2**31 else np.int64
    out = np.zeros((len(queries), len(rows)), kind)
    term = np.empty_like(out)
    for d in range(rows.shape[1]):
        weight = queries[:, d].astype(kind)
        if not weight.any():
            continue
        posting = np.flatnonzero(rows[:, d])
        if 4 * len(posting) < len(rows):
            out[:, posting] += weight[:, None] * rows[posting, d].astype(kind)[None, :]
        elif len(posting):
            out += np.multiply(weight[:, None], rows[:, d].astype(kind)[None, :], out=term)
    return out


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Indices of the k best by (score down, id up), without ``own``."""
    take = np.flatnonzero(ids != own)
    if len(take) > k:
        s = scores[take]
        least = np.partition(s, len(s) - k)[len(s) - k]
        above, level = take[s > least], take[s == least]
        if len(level) > k:  # many ties: the smallest ids
            level = level[np.argpartition(ids[level], k - 1)[:k]]
        take = np.concatenate([above, level])
    order = np.lexsort((ids[take], -scores[take].astype(np.int64)))
    return take[order[:k]]


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = 8192, part: int = 1 << 15) -> DataFrame:
    """The ``k`` best candidates of each query: (query_id, rank, vec_id, score); both inputs as of :func:`integer_vectors`.

    Ties go to the smaller vec_id; a candidate with the query's own vec_id is never returned; with fewer candidates all are.
    Components that one vector has and another lacks count as zero. Repeated candidate rows are candidates of their own. A
    query row repeated with equal weights is asked once; one repeated with other weights is a query of its own, with ranks of its
    own under the same query_id. Empty tables give an empty result. Scores are 64-bit integers.
    """
    n = partitions(candidates.sparkSession)
    asked = queries.select("vec_id", "weights").distinct()
    blocks, parts = max(1, -(-asked.count() // block)), max(n, -(-candidates.count() // part))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    ask = F.xxhash64("vec_id", "weights")
    left = asked.select(F.pmod(ask, F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"), F.lit(0).alias("side"), ask.alias("ask"), "vec_id", "weights")
    # a part takes rows in turn, so no vector, however often it is repeated, fills one
    turn = F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")
    right = candidates.select("vec_id", "weights", turn.alias("part")).select(every(blocks).alias("block"), "part", F.lit(1).alias("side"), F.lit(0).cast("long").alias("ask"), "vec_id", "weights")
    met = left.unionAll(right).repartition(n, "block", "part").sortWithinPartitions("block", "part", "side")
    best = met.mapInArrow(_scorer(k), "query_id long, ask long, vec_id long, score long")
    w = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Block:
    """The queries of one block, and the best candidates that each has met."""

    def __init__(self, queries: list[pa.RecordBatch], k: int):
        t = pa.Table.from_batches(queries).combine_chunks()
        lists = t["weights"].combine_chunks()
        self.names, self.asks, self.k = t["vec_id"].to_numpy(), t["ask"].to_numpy(), k
        self.width = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
        self.weights = _dense(lists, self.width)
        self.best: list[np.ndarray | None] = [None] * len(self.names)  # per query: (ids, scores), at most k of them

    def meet(self, all_ids: np.ndarray, weights: pa.ListArray) -> None:
        all_rows = _dense(weights, self.width)
        for lo in range(0, len(all_ids), ROWS):
            ids, rows = all_ids[lo : lo + ROWS], np.asfortranarray(all_rows[lo : lo + ROWS])
            for q in range(0, len(self.names), TOGETHER):
                scores = _scores(self.weights[q : q + TOGETHER], rows)
                for i, own in enumerate(scores, start=q):
                    at = _best(own, ids, self.names[i], self.k)
                    new = np.stack([ids[at], own[at].astype(np.int64)])
                    if self.best[i] is not None:
                        new = np.concatenate([self.best[i], new], axis=1)
                        new = new[:, np.lexsort((new[0], -new[1]))[: self.k]]
                    self.best[i] = new

    def found(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.names), 4096):
            own = [(i, x) for i, x in enumerate(self.best[lo : lo + 4096], start=lo) if x is not None and x.shape[1]]
            if own:
                of, pairs = np.repeat([i for i, _ in own], [x.shape[1] for _, x in own]), np.concatenate([x for _, x in own], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.names[of], self.asks[of], pairs[0], pairs[1])], ["query_id", "ask", "vec_id", "score"])


def _scorer(k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (block, part, side): the queries of a group, then its candidates."""
        at, queries, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                group, own = tuple(where[:2, lo].tolist()), batch.slice(lo, hi - lo)
                if group != at:
                    if block is not None:
                        yield from block.found()
                    at, queries, block = group, [], None
                if where[2, lo] == 0:
                    queries.append(own.select(["ask", "vec_id", "weights"]))
                elif queries:
                    block = block or _Block(queries, k)
                    block.meet(own.column("vec_id").to_numpy(), own.column("weights"))
        if block is not None:
            yield from block.found()

    return score


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for each whose vec_id is divisible by 50: (query_id, rank, vec_id, score).

    Vectors null, or with null or non-finite components, and rows without a vec_id take no part; an empty array scores 0 with all.
    Ties, repeated rows and empty tables are as in :func:`search`; other columns are ignored.
    """
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::bigint AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::integer AS rank, vec_id, score FROM r WHERE k <= 5
"""

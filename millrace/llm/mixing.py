"""Mixing sources to target weights (operator 7): a low-discrepancy source schedule over equal-token blocks.

Slot i of the schedule has the golden-ratio point frac((i + 1/2) / phi), which falls into one source's interval of the
cumulative target weights; slots are ranked per source. Each source's documents are shuffled by a digest of their id into
one stream of words, the stream is cut into as many equal blocks as the source has slots (running round again where the
target exceeds the source), and block r fills the slot of rank r.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, staged, table

#: The schedule's slots; with the extra slots of sources too small to meet a point, the schedule is broadcast.
SLOTS = 1 << 16
#: One row per source goes to the driver; more sources than this are refused.
MAX_SOURCES = 100_000
#: Documents of a source are summed up in groups of about this many.
GROUP = 4096
GOLDEN = (math.sqrt(5) - 1) / 2


@dataclass
class Mix:
    sources: DataFrame  # source, sid, source_size, target, quota (whole words), slots
    schedule: DataFrame  # slot, sid, rank
    pieces: DataFrame  # doc_id, source, size, position (in its source's stream), slot, rank, copy, start, length (words), text_hash


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size; the excess is reshared by weight."""
    total = sum(sizes)
    rest, weight, out = total, sum(weights), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i] / weights[i], i)):
        if most * sizes[i] <= rest / weight * weights[i] if weight else False:
            out[i] = float(most * sizes[i])
            rest, weight = rest - most * sizes[i], weight - weights[i]
    share = rest / weight if weight else 0.0
    return [x or (share * w if s else 0.0) for x, w, s in zip(out, weights, sizes, strict=True)]


def schedule(quotas: list[int], slots: int = SLOTS) -> pd.DataFrame:
    """(slot, sid, rank), ``slots`` rows and one more for each source that no point met."""
    total = sum(quotas)
    if not total:
        return pd.DataFrame({"slot": np.array([], np.int64), "sid": np.array([], np.int32), "rank": np.array([], np.int64)})
    slots = min(slots, total)
    point = np.modf((np.arange(slots) + 0.5) * GOLDEN)[0]
    ends = np.cumsum(np.array(quotas, dtype=float)) / total
    sid = np.minimum(np.searchsorted(ends, point, side="right"), len(quotas) - 1)
    while (np.array(quotas)[sid] == 0).any():  # a point on the last edge
        sid[np.array(quotas)[sid] == 0] -= 1
    met = np.bincount(sid, minlength=len(quotas))
    sid = np.concatenate([sid, [i for i, q in enumerate(quotas) if q and not met[i]]]).astype(np.int32)
    order = np.argsort(sid, kind="stable")
    rank = np.empty(len(sid), np.int64)
    first = np.concatenate([[0], np.cumsum(np.bincount(sid, minlength=len(quotas)))[:-1]])
    rank[order] = np.arange(len(sid)) - first[sid[order]]
    return pd.DataFrame({"slot": np.arange(len(sid), dtype=np.int64), "sid": sid, "rank": rank})


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, weights=(5.0, 2.0, 1.0), most: float = 3.0, slots: int = SLOTS, seed: str = "") -> Mix:
    """Mix documents (doc_id, text, source) so that each source's words come to its target.

    Size: words of the text, 0 for null and empty texts. Sources take ``weights`` in turn by code point, null last, and share
    the total size; a target above ``most`` times its source's size is cut there and the excess reshared by weight. A
    document is used up to ``most`` times, whole or in part, in blocks that may cut it. Documents of size 0 are returned with one piece of
    length 0 and no slot. Repeated rows are documents of their own; the order of equal ones is free, as their pieces are
    alike. An empty table gives empty results. Other columns are ignored. Reruns agree.
    """
    spark = docs.sparkSession
    sized = staged(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")), "sizes")
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in rows]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
    quotas = [min(math.floor(t + 0.5), math.floor(most * s)) for t, s in zip(target, sizes, strict=True)]
    plan = schedule(quotas, slots)
    met = np.bincount(plan["sid"], minlength=len(rows)) if len(plan) else np.zeros(len(rows), int)
    # Arrow tables become local rows; rows of Python would start Python workers of another kind on each executor
    columns = [("source", pa.string()), ("sid", pa.int32()), ("source_size", pa.int64()), ("target", pa.float64()), ("quota", pa.int64()), ("slots", pa.int64()), ("groups", pa.int64())]
    own = [(r["source"], i, sizes[i], target[i], quotas[i], int(met[i]), 1 + r["docs"] // GROUP) for i, r in enumerate(rows)]
    sources = spark.createDataFrame(pa.table({name: pa.array([x[i] for x in own], kind) for i, (name, kind) in enumerate(columns)}))
    slots_df = spark.createDataFrame(pa.table({name: pa.array(plan[name], kind) for name, kind in (("slot", pa.int64()), ("sid", pa.int32()), ("rank", pa.int64()))}))

    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)))
    s = F.broadcast(sources.withColumnRenamed("source", "its"))
    d = sized.join(s, sized["source"].eqNullSafe(s["its"])).drop("its").withColumn("key", key)
    # a group is a slice of the digests, so groups follow one another in the stream
    d = d.withColumn("part", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("groups") / F.lit(1 << 32)).cast("long"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("sid", "part").agg(F.sum("size").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    within = Window.partitionBy("sid", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(parts, ["sid", "part"]).withColumn("position", F.col("base") + F.col("within"))

    # copy c of the stream begins at c * source_size; block r is [r * quota / slots, (r + 1) * quota / slots)
    d = d.withColumn("copy", F.explode(F.expr(f"sequence(0, {math.ceil(most) - 1})")))
    lo, hi = F.col("position") + F.col("copy") * F.col("source_size"), F.least(F.col("position") + F.col("size") + F.col("copy") * F.col("source_size"), F.col("quota"))
    d = d.withColumn("lo", lo).withColumn("hi", hi).withColumn("used", F.col("hi") > F.col("lo")).where("used or copy = 0")
    block = lambda x: F.expr(f"(({x} + 1) * slots - 1) div quota")
    ranks = F.when(F.col("used"), F.sequence(block("lo"), block("hi - 1")))
    d = d.withColumn("rank", F.explode_outer(ranks))
    edge = lambda r: F.expr(f"({r}) * quota div slots")
    start = F.greatest("lo", edge("rank"))
    piece = d.withColumn("start", start - F.col("lo")).withColumn("length", F.when(F.col("used"), F.least("hi", edge("rank + 1")) - start).otherwise(0))
    pieces = piece.join(F.broadcast(slots_df), ["sid", "rank"], "left").select("doc_id", "source", "size", "position", "slot", "rank", "copy", "start", "length", "source_size", "target", "text_hash")
    return Mix(sources, slots_df, pieces)


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them; a text that it takes in part is cut after its last word taken.

    ``docs`` has doc_id, text, source, n_chars and may have other columns; n_chars follows the cut.
    """
    taken = mix.pieces.where("length > 0").groupBy("doc_id", "source", "size", "text_hash", "position", "copy").agg(F.sum("length").alias("taken_"))
    taken = taken.select(F.col("doc_id").alias("d_"), F.col("source").alias("s_"), F.col("text_hash").alias("h_"), F.col("size").alias("size_"), "taken_")
    hashed = docs.withColumn("h0_", F.xxhash64(F.col("text").cast("string")))
    # equal rows are taken one by one, so one of them stands for all
    one = hashed.dropDuplicates(["doc_id", "source", "h0_"])
    joined = one.join(taken, one["doc_id"].eqNullSafe(taken["d_"]) & one["source"].cast("string").eqNullSafe(taken["s_"]) & (one["h0_"] == taken["h_"]))
    words = F.regexp_extract_all("text", F.lit(f"([\\x20\\x09-\\x0D]*{WORD})"), F.lit(1))  # each with the white space before it
    cut = F.array_join(F.slice(words, F.lit(1), F.col("taken_").cast("int")), "")
    text = F.when(F.col("taken_") < F.col("size_"), cut).otherwise(F.col("text"))
    return joined.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes: (doc_id, size, source_size, target, taken), a row a document.

    Null and empty texts have size 0 and nothing taken; a null source is a source, the last; repeated rows are documents of their
    own; no rows give no rows. Other columns are ignored.
    """
    pieces = mix_sources(table(spark, sf_dir, "documents")).pieces
    # position tells documents apart, but for empty ones, of which every row has one piece
    alone = F.when(F.col("size") == 0, F.monotonically_increasing_id())
    return pieces.groupBy("doc_id", "source", "size", "source_size", "target", "position", alone.alias("alone")).agg(F.sum("length").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size FROM documents
), s AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source
), w AS (
  SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, i) AS k FROM w
), step AS (
  SELECT 0::bigint AS k, (SELECT sum(source_size)::double FROM s) AS rest, (SELECT sum(weight) FROM w) AS weight
  UNION ALL
  SELECT o.k, CASE WHEN 3 * o.source_size <= step.rest / step.weight * o.weight THEN step.rest - 3 * o.source_size ELSE step.rest END,
    CASE WHEN 3 * o.source_size <= step.rest / step.weight * o.weight THEN step.weight - o.weight ELSE step.weight END
  FROM step JOIN o ON o.k = step.k + 1
), last AS (SELECT rest / weight AS share FROM step ORDER BY k DESC LIMIT 1), t AS (
  SELECT o.source, o.source_size,
    CASE WHEN 3 * o.source_size <= b.rest / b.weight * o.weight THEN 3.0::double * o.source_size
         WHEN o.source_size > 0 THEN (SELECT share FROM last) * o.weight ELSE 0 END AS target
  FROM o JOIN step b ON b.k = o.k - 1
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, least(floor(t.target + 0.5)::bigint, 3 * t.source_size) AS quota,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::varchar), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(pos + size, quota) - pos) + greatest(0, least(pos + size + source_size, quota) - pos - source_size)
   + greatest(0, least(pos + size + 2 * source_size, quota) - pos - 2 * source_size))::bigint AS taken
FROM p
"""

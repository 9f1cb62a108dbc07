"""URL filters (operator 5): rule look-up through Bloom filter cascades, exact over the corpus's key universe.

A rule is a host and a path prefix, written ``example.com/en/7``. A url's candidate keys are its host's suffixes with its
path's prefixes, for the (labels, path length) shapes that occur in the rules. Level 0 of a cascade encodes the listed
keys, level 1 those candidate keys of the corpus that pass level 0 falsely, level 2 the listed keys that pass level 1, and
so on until a level lets nothing through; over the corpus's own keys membership is then exact, and urls are judged without
a join. Level 0 is so fine that about as many other keys pass it as are listed, so the levels grow with the list, and only by a
logarithm with the corpus. Hashes are drawn anew for each level, so keys that meet in one level part in a later one. A long list
has a cascade for each part of its keys, and the urls are judged by one part after the other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, staged, table

#: Listed keys of one cascade; more are dealt to several cascades by hash. With 40 bits a key a filter has at most 10 MB.
PART_KEYS = 1 << 21

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where it is null or holds no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _hash(key: Column, level: int) -> Column:
    return F.xxhash64(key, F.lit(level))


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray  # of 64 bits each

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Which keys have all their bits set, of the level's hashes ``h``: bit i of a key is at (upper half + i * lower half) % bits."""
        h = h.astype(np.int64).view(np.uint64)
        upper, lower = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        out = np.ones(len(h), bool)
        for i in range(self.hashes):
            at = (upper + np.uint64(i) * lower) % np.uint64(self.bits)
            out &= ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out


def _level(keys: DataFrame, level: int, n: int, share: float) -> Level:
    """A filter of ``n`` keys that others pass with a chance of ``share``: bits are OR-ed by words before and after the shuffle, then gathered (n is about PART_KEYS at most)."""
    hashes = min(40, max(1, round(math.log2(1 / share))))
    bits = max(64, math.ceil(n * hashes / math.log(2) / 64) * 64)
    h = _hash(F.col("key"), level)
    upper, lower = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1))
    at = keys.select(F.explode(F.array(*[(upper + i * lower) % bits for i in range(hashes)])).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["set"].to_numpy(np.int64).view(np.uint64)
    return Level(bits, hashes, words)


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels for the column ``key`` of ``listed``, exact for every key of ``universe`` (distinct keys).

    An empty list gives one empty level, which holds nothing. Null keys are left out.
    """
    inside = listed.select("key").where("key is not null").distinct()
    outside = universe.select("key").where("key is not null").join(inside, "key", "left_anti")
    levels: list[Level] = []
    encode, other, n, rest = inside, outside, inside.count(), outside.count()
    while True:
        if not n and levels:
            return levels
        share = min(0.5, max(n, 1) / max(rest, 1)) if not levels else 0.5
        levels.append(level := _level(encode, len(levels), n, share))
        if not n:
            return levels
        # of the other side, what passes this level falsely is what the next one encodes
        passed = staged(other.where(_test(other.sparkSession, [level])(F.array(_hash(F.col("key"), len(levels) - 1)))), "false-positives")
        encode, other, n, rest = passed, encode, passed.count(), n


def _test(spark: SparkSession, levels: list[Level]):
    """A UDF over a key's hashes for ``levels``: is it held by the cascade that starts there?"""
    shared = spark.sparkContext.broadcast(levels)

    @F.pandas_udf("boolean")
    def held(hashes: pd.Series) -> pd.Series:
        if not len(hashes):
            return pd.Series([], dtype=bool)
        return pd.Series(_held(shared.value, np.stack(hashes.to_numpy())))

    return held


def _held(levels: list[Level], hashes: np.ndarray) -> np.ndarray:
    """Membership by the parity of the first level that does not hold the key. hashes: (keys, levels or more)."""
    first = np.full(len(hashes), len(levels))
    for i in range(len(levels) - 1, -1, -1):
        first[~levels[i].holds(hashes[:, i])] = i
    return first % 2 == 1


def _judge(spark: SparkSession, cascades: dict[str, list[Level]], n_keys: int, depth: int):
    """A UDF over the hashes of a url's keys, end to end: the verdict of each key, null where no cascade holds it."""
    shared = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("array<string>")
    def judge(hashes: pd.Series) -> pd.Series:
        n = len(hashes)
        if not n:
            return pd.Series([], dtype=object)
        flat = np.concatenate(hashes.to_numpy()).reshape(n * n_keys, depth)
        out = np.full(len(flat), None, dtype=object)
        for v, levels in shared.value.items():
            out[_held(levels, flat)] = v
        return pd.Series(list(out.reshape(n, n_keys)))

    return judge


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", part_keys: int = PART_KEYS) -> DataFrame:
    """Judge every url: (id, host, path, rule, verdict).

    Of the rules that fit, the longest string wins (of equally long ones that with more host labels); ``rule`` is null and the
    verdict ``default`` where none fits. A rule listed twice counts as it is listed first; no rules give ``default``. Null urls, and urls without
    ``://``, have empty host and path. Rows repeat as they come; an empty table gives an empty result; other columns of
    ``pages`` are ignored, whatever their names.
    """
    spark = pages.sparkSession
    action: dict[str, str] = {}
    for verdict, key in rules:
        action.setdefault(key, verdict)
    shapes = sorted({(k.partition("/")[0].count(".") + 1, len(k) - len(k.partition("/")[0])) for k in action}) or [(1, 0)]
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    keys = F.array(*[F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, n)) for labels, n in shapes])
    parts = max(1, -(-len(action) // part_keys))
    part = F.pmod(F.xxhash64("key"), F.lit(parts))
    universe = staged(urls.select(F.explode(keys).alias("key")).distinct(), "url-keys")
    listed = spark.createDataFrame(list(action.items()), "key string, verdict string")
    judged = urls.select("*", keys.alias("keys"), F.transform(keys, lambda k: F.lit(None).cast("string")).alias("verdicts"))
    for p in range(parts):
        own = universe.where(part == p) if parts > 1 else universe
        cascades = {v: build_cascade(listed.where((F.col("verdict") == v) & (part == p)), own) for v in sorted(set(action.values()))}
        depth = max(map(len, cascades.values()), default=1)
        verdicts = _judge(spark, cascades, len(shapes), depth)(F.flatten(F.transform("keys", lambda k: F.array(*[_hash(k, i) for i in range(depth)]))))
        if parts > 1:  # a cascade tells nothing of other parts' keys
            mine = lambda k, new: F.when(F.pmod(F.xxhash64(k), F.lit(parts)) == p, new)  # noqa: B023, E731
            verdicts = F.zip_with(F.zip_with("keys", verdicts, mine), "verdicts", lambda new, old: F.coalesce(new, old))
        judged = judged.withColumn("verdicts", verdicts)
        judged = staged(judged, "judged-urls") if p < parts - 1 else judged
    hits = F.filter(F.arrays_zip("keys", "verdicts"), lambda x: x["verdicts"].isNotNull())
    best = F.array_max(F.transform(hits, lambda x: F.struct(F.length(x["keys"]).alias("n"), F.size(F.split(F.substring_index(x["keys"], "/", 1), r"\.")).alias("labels"), x["keys"].alias("key"), x["verdicts"].alias("verdict"))))
    return judged.withColumn("best", best).select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the five rules of RULES: (page_id, host, path, rule, verdict).

    Null urls, urls without ``://``, repeated rows, ties and empty tables are as in :func:`filter_urls`; other columns are ignored.
    """
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hp AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
    ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), hits AS (
  SELECT hp.page_id, hp.host, hp.path, r.rule, r.verdict,
    row_number() OVER (PARTITION BY hp.page_id ORDER BY length(r.rule) DESC) AS k
  FROM hp LEFT JOIN rules r ON (hp.host = r.rule_host OR ends_with(hp.host, '.' || r.rule_host)) AND starts_with(hp.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE k = 1
"""

"""Sharding (operator 8): size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder: ``data/`` holds Parquet shards that are written once and never changed, ``manifests/`` one JSON file
per version. An append writes its rows as small shards and commits a version that lists them besides the old ones. A
compaction takes runs of shards of the same size tier, rewrites each run as one file, and commits a version in which the
new file stands for the run. A version becomes visible by an atomic rename that fails if the name is taken, so a writer
that dies leaves only files that no manifest lists, and of two writers that meet one is told to try again.
Rows pass through DataFrame reads and writes only.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import shared_dir, table

MB = 1 << 20


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Shard:
    path: str  # relative to the store
    bytes: int
    version: int  # that brought it


class ShardStore:
    """``target_bytes``: a shard that large is finished. ``fanout``: the ratio between tiers, and how many shards of a tier make a run."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 * MB, fanout: int = 4, smallest: int = MB, runs_a_job: int = 256):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fanout, self.smallest, self.runs_a_job = target_bytes, fanout, smallest, runs_a_job
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _list(self, name: str) -> list[tuple[str, int]]:
        at = self._at(name)
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    # -- versions

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n, _ in self._list("manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """``{"version", "schema", "shards"}``; version 0 is the empty store, None the newest."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._at(f"manifests/v{version:010d}.json"))
        try:
            said = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return said | {"shards": [Shard(**s) for s in said["shards"]]}

    def commit(self, after: int, schema: str, shards: list[Shard]) -> int:
        """Publish version ``after`` + 1, or raise :class:`CommitConflict` if it exists."""
        version = after + 1
        body = json.dumps({"version": version, "schema": schema, "shards": [vars(s) for s in shards]})
        made, final = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/v{version:010d}.json")
        out = self._fs.create(made, False)
        out.write(body.encode())
        out.close()
        fs = self._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        none[0] = fs.Options.Rename.NONE
        try:
            fs.FileContext.getFileContext(final.toUri(), self._conf).rename(made, final, none)
        except Exception as e:
            self._fs.delete(made, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {version} of {self.path}") from e
            raise
        return version

    # -- data

    def _write(self, df: DataFrame, version: int) -> list[Shard]:
        folder = f"data/{version:010d}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return [Shard(f"{folder}/{n}", size, version) for n, size in self._list(folder) if n.endswith(".parquet")]

    def append(self, df: DataFrame) -> int:
        """Add the rows of ``df`` as they are partitioned, a shard each. Any column types, nulls and repeated rows are kept; no rows give a version without new shards' rows."""
        now = self.manifest()
        if now["schema"] and StructType.fromJson(json.loads(now["schema"])).simpleString() != df.schema.simpleString():
            raise ValueError(f"the store holds {now['schema']}, not {df.schema.json()}")
        new = self._write(df, now["version"] + 1)
        return self.commit(now["version"], now["schema"] or df.schema.json(), now["shards"] + new)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout)) + 1) if size >= self.smallest else 0

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: unfinished shards of one tier, by age, up to the target size; a run has ``fanout`` shards or fills a target."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: (s.version, s.path)):
            if 2 * s.bytes <= self.target_bytes:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        out = []
        for _, own in sorted(tiers.items()):
            run: list[Shard] = []
            for s in own:
                if run and sum(x.bytes for x in run) + s.bytes > self.target_bytes:
                    out.append(run)
                    run = []
                run.append(s)
            if len(run) >= self.fanout:
                out.append(run)
        return [run for run in out if len(run) > 1]

    def compact(self) -> int:
        """Merge until no tier has a run; each round is a version of its own. Returns the newest version."""
        while runs := self.runs((now := self.manifest())["shards"]):
            made: list[Shard] = []
            for i in range(0, len(runs), self.runs_a_job):
                merged = [self._read([s.path for s in run], now["schema"]).coalesce(1) for run in runs[i : i + self.runs_a_job]]
                made += self._write(reduce(DataFrame.unionAll, merged), now["version"] + 1)
            gone = {s.path for run in runs for s in run}
            self.commit(now["version"], now["schema"], [s for s in now["shards"] if s.path not in gone] + made)
        return now["version"]

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (None: the newest)."""
        now = self.manifest(version)
        if not now["schema"]:
            raise ValueError(f"{self.path} is empty")
        return self._read([s.path for s in now["shards"]], now["schema"])

    def vacuum(self, keep: int = 1) -> int:
        """Delete the manifests before the newest ``keep``, and all data files that no kept one lists; the number of data files deleted.

        That includes what dead writers left: a folder is named after the version that its writer wanted to commit, and once that
        version exists nobody else can. Folders of the version to come are left alone.
        """
        versions = sorted(self.versions())
        listed = {s.path for v in versions[-keep:] for s in self.manifest(v)["shards"]}
        gone = 0
        for folder, _ in self._list("data"):
            if int(folder.split("-")[0]) <= max(versions, default=0):
                files = [f"data/{folder}/{n}" for n, _ in self._list(f"data/{folder}")]
                dead = [f for f in files if f.endswith(".parquet") and f not in listed]
                gone += len(dead)
                if len(dead) == sum(f.endswith(".parquet") for f in files):
                    self._fs.delete(self._at(f"data/{folder}"), True)
                else:
                    for f in dead:
                        self._fs.delete(self._at(f), False)
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"manifests/v{v:010d}.json"), False)
        return gone


def arrivals(df: DataFrame, n: int, id_col: str) -> list[DataFrame]:
    """``df`` dealt into ``n`` arrivals by hash of ``id_col``, however its files lie.

    Each has a part of every partition that is read, so its shards are small at any size of the table: at most an nth of
    ``spark.sql.files.maxPartitionBytes``.
    """
    return [df.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(n)) == i) for i in range(n)]


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in eight appends, are compacted, and are read back from the newest version: (doc_id, text_sha256, lang, source, n_chars).

    Every row comes back as often as it is there; nulls stay null (the digest of a null text too); no rows give no rows; other
    columns are kept in the store and not returned.
    """
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", target_bytes=64 * MB)
    for df in arrivals(table(spark, sf_dir, "documents"), 8, "doc_id"):
        store.append(df)
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars")


ORACLE_SQL = "SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars FROM documents"

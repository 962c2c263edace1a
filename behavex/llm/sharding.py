"""Size-tiered shard compaction under versioned manifests, with DataFrame operations only.

A store is a folder: shards/ holds immutable Parquet files, manifests/ one JSON-lines file for each
version, which says what shards it adds and removes. Writers put new files first and then
commit: the manifest is written under a temporary name and renamed without overwriting, so that
of two writers of one version the later fails; readers see a whole version or none. Appends and merges
touch shards of their own only, so that one that comes too late goes on top of the newer version: an append always, a merge while its inputs are still
there. What a writer that died has left is named by no version, and vacuum() takes it away.
Shards of similar size form a tier (sizes within a factor of `factor`); once a tier has `fan_in`
shards they are merged into files of about the target size, and never above two of it again.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from behavex.llm.common import new_path, table
from behavex.sources.files import Folder


class CommitConflict(RuntimeError):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    arrival: str


class ShardStore:
    """An append-only table of shards. The driver holds the manifest alone: a line for each shard. A version's file says what it
    adds and removes; each SNAPSHOT versions one lists all shards, so that a commit's size does not grow with the store."""

    SNAPSHOT = 32

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4, factor: float = 4.0):
        self.spark, self.path, self.target, self.fan_in, self.factor = spark, path.rstrip("/"), target_bytes, fan_in, factor
        self._manifests, self._store = Folder(spark, f"{self.path}/manifests"), Folder(spark, self.path)

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._manifests.names()]

    def manifest(self, version: int | None = None) -> list[Shard]:
        have = self.versions()
        version = (have or [0])[-1] if version is None else version
        shards: dict[str, Shard] = {}
        for v in range(version // self.SNAPSHOT * self.SNAPSHOT or 1, version + 1):
            for line in self._manifests.read(f"v{v:08d}.json").splitlines():
                change = json.loads(line)
                if "gone" in change:
                    shards.pop(change["gone"])
                else:
                    shards[change["path"]] = Shard(**change)
        return list(shards.values())

    def commit(self, base: int, add: list[Shard], gone: list[Shard] | tuple[Shard, ...] = ()) -> int:
        """Makes version base + 1 of the store; fails if that exists."""
        version, drop = base + 1, {s.path for s in gone}
        if version % self.SNAPSHOT == 0:
            add, drop = [s for s in self.manifest(base) if s.path not in drop] + add, set()
        lines = [json.dumps({"gone": p}) for p in sorted(drop)] + [json.dumps(asdict(s)) for s in add]
        if not self._manifests.create_once(f"v{version:08d}.json", "".join(f"{x}\n" for x in lines)):
            raise CommitConflict(f"version {version} of {self.path} exists")
        return version

    def _written(self, folder: str, arrival: str) -> list[Shard]:
        return [Shard(path, size, arrival) for path, size in self._store.files(folder) if path.endswith(".parquet")]

    def append(self, df: DataFrame, arrivals: int = 1) -> int:
        """Writes df as small shards, dealt over so many arrivals by the hash of all its columns that can be hashed, and commits
        each arrival as a version of its own. An empty frame adds a version without shards."""
        folder, key = f"shards/{uuid.uuid4().hex}", "_arrival_" + uuid.uuid4().hex[:8]
        plain = [f"`{c}`" for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]
        by = F.pmod(F.xxhash64(*plain), F.lit(arrivals)) if plain else F.pmod(F.monotonically_increasing_id(), F.lit(arrivals))
        df.withColumn(key, by).write.partitionBy(key).parquet(f"{self.path}/{folder}")
        version = 0
        for i in range(arrivals):
            version = self._on_top(lambda base, i=i: self.commit(base, self._written(f"{folder}/{key}={i}", f"a{base + 1}")))
        return version

    def _on_top(self, commit: Callable[[int], int]) -> int:
        """Commits on top of the newest version, and again if another writer was faster."""
        while True:
            try:
                return commit((self.versions() or [0])[-1])
            except CommitConflict:
                continue

    def tier(self, s: Shard) -> int:
        return int(math.log(max(1.0, s.bytes / 65536), self.factor))

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """The runs to merge now: all shards of a tier that has fan_in of them and lies below the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target // 2:
                tiers.setdefault(self.tier(s), []).append(s)
        return [sorted(r, key=lambda s: s.path) for _, r in sorted(tiers.items()) if len(r) >= self.fan_in]

    def compact(self, rounds: int = 30) -> int:
        """Merges until no tier is full. Each run is a coalesced read and write, without a shuffle; old files
        stay for readers of older versions."""
        for _ in range(rounds):
            todo = self.plan(self.manifest())
            if not todo:
                break
            for run in todo:
                self.merge(run)
        return (self.versions() or [0])[-1]

    def merge(self, run: list[Shard]) -> bool:
        """Puts one run's merged shards in the place of the run, on top of whatever was appended meanwhile; False, and nothing is left
        behind, if another writer has merged one of its shards."""
        folder, paths = f"shards/{uuid.uuid4().hex}", {s.path for s in run}
        n = max(1, round(sum(s.bytes for s in run) / self.target))
        self.spark.read.parquet(*(s.path for s in run)).coalesce(n).write.parquet(f"{self.path}/{folder}")

        def commit(base: int) -> int:
            if not paths <= {s.path for s in self.manifest(base)}:
                return 0
            return self.commit(base, self._written(folder, f"m{base + 1}"), run)

        if self._on_top(commit):
            return True
        self._store.delete(folder)
        return False

    def vacuum(self, keep: int = 1, hours: float = 24.0) -> int:
        """Deletes shards that none of the last `keep` versions names, if they are older than so many hours (a writer may be at work on
        younger ones), and says how many. Older versions can't be read any more."""
        named = {s.path for v in self.versions()[-keep:] for s in self.manifest(v)}
        gone = 0
        for folder in self._store.names("shards"):
            parts = [f"shards/{folder}", *(f"shards/{folder}/{n}" for n in self._store.names(f"shards/{folder}", hidden=True) if "=" in n)]
            for path, _ in [x for p in parts for x in self._store.files(p)]:
                if path.endswith(".parquet") and path not in named and self._store.age_hours(path) >= hours:
                    self._store.delete_path(path)
                    gone += 1
        return gone

    def read(self, version: int | None = None, schema: StructType | None = None) -> DataFrame:
        """The rows of a version; a store without shards gives an empty frame of the schema."""
        paths = [s.path for s in self.manifest(version)]
        if not paths and schema is None:
            raise ValueError("the store has no shards")
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the store: four arrivals, compaction, and what a reader then gets. Nulls,
    repeated rows and empty texts come back as they went in; an empty table comes back empty."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, new_path(spark, "store"))
    store.append(docs, arrivals=4)
    store.compact()
    return store.read(schema=docs.schema).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


OP1_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"

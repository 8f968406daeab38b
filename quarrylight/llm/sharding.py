"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards (Parquet files). Shards of similar size form a tier; when a tier has
`fanout` shards or more, runs of them are merged into files of about the target size. Every change ends with
a manifest of the next version, written aside and renamed into place, which fails if another writer was first; that change
then is made to the newer version. A manifest is a root that names parts, each with up to 10,000 shards; a change writes the parts that
it changes, the others stay. Readers see the old or the new version, never a part of either. Files of no kept version
are removed once they are older than any write or read that may still need them.

The driver handles names and sizes of shards only. Merged rows go straight to the task that writes their shard; a shard is
bounded by the target size, so no key makes a task larger than others.

Defined results: all columns and rows are kept as they are, nulls, empty and repeated ones too; an empty arrival commits
a version without new shards; a shard that alone exceeds the target stays as it is; very long texts
are rows like others; an empty table has a version without shards.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import Counter
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, documents, spare

#: Shards that one part of a manifest names.
MOST_IN_PART = 10_000


class ShardStore:
    """Shards and manifests under one folder of the shared store."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 32 << 20, fanout: int = 4, smallest: int = 64 << 10):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fanout, self.smallest = target_bytes, fanout, smallest

    # names and sizes -------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    @property
    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list:
        at = self._path(name)
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(x.getPath().getName()[1:-5]) for x in self._listed("manifests") if x.getPath().getName().endswith(".json"))

    def _read_json(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _write_json(self, name: str, told: dict) -> None:
        out = self._fs.create(self._path(name), False)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()

    def _root_of(self, version: int) -> dict:
        """{"version", "schema", "parts": {name: number of shards}}: a version's root."""
        return self._read_json(f"manifests/v{version:08d}.json")

    def manifest(self, version: int | None = None) -> dict:
        """{"version": n, "schema": ..., "shards": [{"file", "bytes", "part"}, ...]}; version 0 is empty."""
        known = self.versions()
        version = version if version is not None else (known[-1] if known else 0)
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        root = self._root_of(version)
        shards = [x | {"part": name} for name in root["parts"] for x in self._read_json(f"parts/{name}.json")["shards"]]
        return {"version": root["version"], "schema": root["schema"], "shards": shards, "parts": root["parts"]}

    def _commit(self, version: int, schema: str | None, shards: list[dict], parts: dict[str, int] | None = None) -> None:
        """Write a version's root and rename it into place. Of the last version's parts (with their numbers of shards) those that
        are whole stay as they are; what is new or left of others goes to new parts."""
        held = Counter(x.get("part") for x in shards)
        kept = {name: n for name, n in (parts or {}).items() if held[name] == n}
        rest = [{"file": x["file"], "bytes": x["bytes"]} for x in shards if x.get("part") not in kept]
        for a in range(0, len(rest), MOST_IN_PART):
            name, own = uuid.uuid4().hex, rest[a : a + MOST_IN_PART]
            self._write_json(f"parts/{name}.json", {"shards": own})
            kept[name] = len(own)
        aside, place = f"manifests/{uuid.uuid4().hex}.tmp", f"manifests/v{version:08d}.json"
        self._write_json(aside, {"version": version, "schema": schema, "parts": kept})
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        no_overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(aside), self._path(place), no_overwrite)

    def _shards_in(self, folder: str) -> list[dict]:
        return [{"file": f"{folder}/{x.getPath().getName()}", "bytes": x.getLen()} for x in self._listed(folder) if x.getPath().getName().startswith("part-")]

    # appending, merging, reading ---------------------------------------------------------------------------------------

    def _publish(self, change: Callable[[dict], tuple[str | None, list[dict]] | None], tries: int = 20) -> int | None:
        """Commit what `change` makes of the last manifest (schema, shards), on a newer one if another writer was first.

        None if `change` gives none: what it wanted to replace is gone.
        """
        for _ in range(tries):
            now = self.manifest()
            told = change(now)
            if told is None:
                return None
            try:
                self._commit(now["version"] + 1, *told, now.get("parts"))
                return now["version"] + 1
            except Py4JJavaError as e:
                if "AlreadyExists" not in e.java_exception.getClass().getName() and now["version"] + 1 not in self.versions():
                    raise
        raise RuntimeError(f"{tries} other writers were first")

    def append(self, rows: DataFrame) -> int:
        """Add an arrival; each task's rows become a shard. Returns the new version."""
        folder = f"data/v{self.manifest()['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        new = self._shards_in(folder)
        return self._publish(lambda now: (rows.schema.json(), now["shards"] + new))

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(1, size) / self.smallest, self.fanout)) + 1) if size >= self.smallest else 0

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge: each of two shards or more of one tier, up to about the target size."""
        tiers: dict[int, list[dict]] = {}
        for x in shards:
            if x["bytes"] < self.target:
                tiers.setdefault(self.tier(x["bytes"]), []).append(x)
        runs = []
        for _, own in sorted(tiers.items()):
            if len(own) < self.fanout:
                continue
            run, size = [], 0
            for x in sorted(own, key=lambda x: (x["bytes"], x["file"])):
                if run and size + x["bytes"] > self.target:
                    runs.append(run)
                    run, size = [], 0
                run.append(x)
                size += x["bytes"]
            runs.append(run)
        return [x for x in runs if len(x) > 1]

    def compact(self, most_rounds: int = 20) -> int:
        """Merge until no tier is full. Returns the version reached."""
        for _ in range(most_rounds):
            now = self.manifest()
            runs = self.plan(now["shards"])
            if not runs:
                break
            folder = f"data/v{now['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
            group = {x["file"]: k for k, run in enumerate(runs) for x in run}
            places = self.spark.createDataFrame(list(group.items()), "file string, target int")
            rows = self._read(now["schema"], list(group))
            file, target, told = spare(rows, "file"), spare(rows, "target"), rows.metadataColumn("_metadata")
            named = rows.withColumn(file, F.concat_ws("/", F.lit("data"), F.element_at(F.split(told["file_path"], "/"), -2), told["file_name"]))
            dealt = named.join(places.toDF(file, target), file).repartitionById(len(runs), F.col(target))
            dealt.select(rows.columns).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            new = self._shards_in(folder)

            def swapped(last: dict, group=group, new=new) -> tuple[str | None, list[dict]] | None:
                left = [x for x in last["shards"] if x["file"] not in group]
                return (last["schema"], left + new) if len(left) + len(group) == len(last["shards"]) else None

            if self._publish(swapped) is None:  # another writer has merged some of them
                self._fs.delete(self._path(folder), True)
        return self.manifest()["version"]

    def vacuum(self, retain: int = 1, older_than_seconds: float = 86_400) -> None:
        """Delete the manifests before the last `retain` ones, and the shards that none of those names.

        Only what is older than older_than_seconds goes: a writer's arrival that isn't committed yet and shards that a
        reader of an older version still reads are younger. 0 is for a store that nobody else uses just then.
        """
        stale = time.time() * 1000 - older_than_seconds * 1000
        old = self.versions()[:-retain]
        kept = {x["file"] for v in self.versions()[-retain:] for x in self.manifest(v)["shards"]}
        for status in self._listed("manifests"):
            name = status.getPath().getName()
            if status.getModificationTime() <= stale and (name.endswith(".tmp") or int(name[1:-5]) in old):
                self._fs.delete(status.getPath(), False)
        kept |= {x["file"] for v in self.versions() for x in self.manifest(v)["shards"]}
        named = {name for v in self.versions() for name in self._root_of(v)["parts"]}
        for status in self._listed("parts"):
            if status.getModificationTime() <= stale and status.getPath().getName().removesuffix(".json") not in named:
                self._fs.delete(status.getPath(), False)
        for folder in self._listed("data"):
            files = list(self._fs.listStatus(folder.getPath()))
            names = [f"data/{folder.getPath().getName()}/{x.getPath().getName()}" for x in files]
            young = [x.getModificationTime() > stale for x in files]
            if not any(young) and not any(x in kept for x in names) and folder.getModificationTime() <= stale:
                self._fs.delete(folder.getPath(), True)
                continue
            for x, name, new in zip(files, names, young, strict=True):
                if name not in kept and not new and x.getPath().getName().startswith("part-"):
                    self._fs.delete(x.getPath(), False)

    def _read(self, schema: str | None, files: list[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        shape = StructType.fromJson(json.loads(schema)) if schema else StructType()
        return self.spark.read.schema(shape).parquet(*(f"{self.root}/{x}" for x in files)) if files else self.spark.createDataFrame([], shape)

    def read(self, version: int | None = None) -> DataFrame:
        now = self.manifest(version)
        return self._read(now["schema"], [x["file"] for x in now["shards"]])


def shard(docs: DataFrame, root: str, arrivals: int = 3, target_bytes: int = 32 << 20) -> ShardStore:
    """docs as `arrivals` arrivals, each appended and then compacted."""
    store = ShardStore(docs.sparkSession, root, target_bytes)
    for k in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k))
        store.compact()
        store.vacuum(older_than_seconds=0)  # the only writer, and nobody reads yet
    return store


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document lies in the last version: doc_id, shard, version, text_bytes, text_crc32 (null text: null)."""
    store = shard(documents(spark, sf_dir), Scratch(spark, "shards").path("store"))
    raw = F.col("text").cast("binary")
    rows = store.read()
    return rows.select("doc_id", rows.metadataColumn("_metadata")["file_name"].alias("shard"), F.lit(store.manifest()["version"]).alias("version"), F.octet_length(raw).cast("long").alias("text_bytes"), F.crc32(raw).alias("text_crc32"))

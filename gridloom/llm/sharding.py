"""Operator 3: sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards, without a shuffle. Shards belong to tiers
by size; when a tier has ``FAN_IN`` runs or more, the runs of this tier alone are merged into files
of about ``TARGET_BYTES``, the lowest tier first: one scan packs whole shards into tasks by their bytes
and each task writes one file, so a row is read and written once for each tier it rises and never
shuffled. A version of the data set is
a manifest that lists its files with bytes, rows and tier. It is written beside the others and put
in place by a rename that fails if the version exists: a reader sees the old or the new version as
a whole, a writer that lost a race starts again from the version that won, and files of a failed or
interrupted run are in no manifest. The driver handles names and sizes of files only, and hands a
folder of which every file is live to a scan by the folder's name. The rename that fails if its target
exists is that of Hadoop's FileContext, which is atomic on HDFS and on local paths, not on object stores.

Defined results: the columns of the input are kept as they are, whatever their names, with nulls
and repeated rows; an empty table gives a version without files, which reads as an empty table.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm.common import scratch_path, table

TARGET_BYTES = 128 << 20
SHARD_ROWS = 2000
FAN_IN = 4
#: Lots in which the query has its table arrive; together they are the whole table.
ARRIVALS = 3
#: Size from which tiers are counted; a file this full is not merged again.
LEAST_BYTES, FULL = 64 << 10, 0.75


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, shard_rows: int = SHARD_ROWS, fan_in: int = FAN_IN):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.shard_rows, self.fan_in = target_bytes, shard_rows, max(2, fan_in)
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    # --- manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The files of a version (the latest), and the schema of the rows."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "files": []}
        lines = [r["value"] for r in self.spark.read.text(f"{self.root}/manifests/v{version:09d}.json").collect()]
        head, *files = (json.loads(x) for x in lines)
        return head | {"files": files}

    def commit(self, base: dict, files: list[dict], schema: str) -> dict:
        """Version base + 1 with these files; Conflict if there is one already."""
        version = base["version"] + 1
        lines = [{"version": version, "schema": schema}, *sorted(files, key=lambda f: f["file"])]
        data = "\n".join(json.dumps(x, sort_keys=True) for x in lines)
        draft, final = f"{self.root}/manifests/.draft-{uuid.uuid4().hex}", f"{self.root}/manifests/v{version:09d}.json"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(data.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._path(draft), self._path(final), options)
        except Exception as e:
            self._fs.delete(self._path(draft), False)
            if self._fs.exists(self._path(final)):
                raise Conflict(f"version {version} exists") from e
            raise
        return {"version": version, "schema": schema, "files": files}

    def _commit_change(self, gone: set[str], new: list[dict], schema: str) -> dict:
        """Replaces files in the latest version; starts again when another writer was first."""
        while True:
            base = self.manifest()
            left = [f for f in base["files"] if f["file"] not in gone]
            if len(left) + len(gone) != len(base["files"]):
                raise Conflict("another writer has merged these shards")
            try:
                return self.commit(base, left + new, schema)
            except Conflict:
                continue

    # --- files

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / LEAST_BYTES, self.fan_in)))

    def _entries(self, folder: str) -> list[dict]:
        """Name, bytes, rows and tier of the files of a folder that hold rows."""
        sizes = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if s.getPath().getName().endswith(".parquet")}
        if not sizes:
            return []
        counted = self.spark.read.parquet(f"{self.root}/{folder}").groupBy(F.col("_metadata.file_name").alias("name")).count().collect()
        return [{"file": f"{folder}/{r['name']}", "bytes": sizes[r["name"]], "rows": r["count"], "tier": self.tier(sizes[r["name"]]), "of": len(sizes)} for r in counted]

    def _paths(self, files: list[dict]) -> list[str]:
        """What a scan of these files reads: whole folders where it needs all of their files."""
        folders = defaultdict(list)
        for f in files:
            folders[f["file"].rsplit("/", 1)[0]].append(f)
        return [f"{self.root}/{p}" for folder, own in sorted(folders.items()) for p in ([folder] if len(own) == own[0]["of"] else sorted(f["file"] for f in own))]

    def append(self, rows: DataFrame) -> dict:
        """An arrival: its partitions as small immutable shards, and a version that holds them."""
        folder = f"data/arrival-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", self.shard_rows).option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self._commit_change(set(), self._entries(folder), rows.schema.json())

    def due(self, files: list[dict]) -> list[list[dict]]:
        """Runs to merge, a list for each tier below the target that has enough of them, the lowest tier first."""
        tiers = defaultdict(list)
        for f in files:
            if f["bytes"] < FULL * self.target_bytes:
                tiers[f["tier"]].append(f)
        return [runs for _, runs in sorted(tiers.items()) if len(runs) >= self.fan_in]

    def compact(self) -> dict:
        """Merges until no tier has enough runs, each merge a version of its own."""
        now, stuck = self.manifest(), set()
        while runs := next((r for r in self.due(now["files"]) if r[0]["tier"] not in stuck), None):
            merged = self._merge(runs, now["schema"])
            if len(merged) >= len(runs):
                stuck.add(runs[0]["tier"])  # as few files as their sizes allow; what was written is in no manifest
                continue
            now = self._commit_change({f["file"] for f in runs}, merged, now["schema"])
        return now

    def _merge(self, runs: list[dict], schema: str) -> list[dict]:
        """One scan in which each task reads whole shards up to the target size and writes one file."""
        folder = f"data/merged-{uuid.uuid4().hex}"
        packing = {"spark.sql.files.maxPartitionBytes": str(self.target_bytes), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: self.spark.conf.get(k, None) for k in packing}
        try:
            for k, v in packing.items():
                self.spark.conf.set(k, v)
            rows = self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*self._paths(runs))
            rows.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)
        merged = self._entries(folder)
        if sum(f["rows"] for f in merged) != sum(f["rows"] for f in runs):
            raise RuntimeError("a merge must keep every row")
        return merged

    def vacuum(self, keep: int = 1) -> int:
        """Deletes files that none of the last versions lists; for when no older version is being read."""
        used = {f["file"] for v in self.versions()[-keep:] for f in self.manifest(v)["files"]}
        gone = 0
        data = self._path(f"{self.root}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = folder.getPath().getName()
            files = [s.getPath() for s in self._fs.listStatus(folder.getPath())]
            live = [p for p in files if f"data/{name}/{p.getName()}" in used]
            if not live:
                self._fs.delete(folder.getPath(), True)
                gone += len(files)
            else:
                for p in files:
                    if p.getName().endswith(".parquet") and p not in live:
                        gone += self._fs.delete(p, False)
        return gone

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, read from the files of its manifest alone."""
        found = self.manifest(version)
        if not found["files"]:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(found["schema"])) if found["schema"] else StructType())
        return self.spark.read.schema(StructType.fromJson(json.loads(found["schema"]))).parquet(*self._paths(found["files"]))


def query(spark, sf_dir: str) -> DataFrame:
    """Documents arrive in ``ARRIVALS`` lots, each followed by compaction and a vacuum; the rows of the last version."""
    store, docs = ShardStore(spark, scratch_path(spark, "shards")), table(spark, sf_dir, "documents")
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ARRIVALS))
    for n in range(ARRIVALS):
        store.append(docs.filter(lot == n))
        store.compact()
        store.vacuum()
    return store.read().select("doc_id", "lang", "source", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


SQL = "SELECT doc_id, lang, source, strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents"

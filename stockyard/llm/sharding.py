"""Size-tiered compaction over immutable Parquet shards and a versioned manifest.

Layout of a store:  data/<commit>-*/part-*.parquet  and  manifest/v0000000001.json.

An append writes its rows as new shards and commits the next manifest. Compaction puts the live shards into tiers by size (each tier
`ratio` times the one below); a tier with a run of `fanin` shards or more is merged into files of about the target size, and one commit
swaps the old names for the new. Shards are never changed; readers of an old version keep their files until expire().

A commit is a rename of a complete file onto a name that must not exist, so of two writers one fails and starts again from the newer
version; a job that dies before it leaves only files that no manifest names. Rows move by DataFrame reads and writes alone; the driver
handles file names and sizes.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.llm import common as C

TARGET_BYTES, RATIO, FANIN = 128 << 20, 4, 4


class CommitConflict(RuntimeError):
    """Another writer made this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, target_bytes: int = TARGET_BYTES, ratio: int = RATIO, fanin: int = FANIN, smallest: int = 64 << 10):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.target, self.ratio, self.fanin, self.smallest = target_bytes, ratio, fanin, smallest

    # Manifests

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:010d}.json"

    def version(self) -> int:
        """The newest version; 0 is the empty store."""
        fs, p = C.filesystem(self.spark, f"{self.path}/manifest")
        return max([0, *(int(s.getPath().getName()[1:11]) for s in fs.listStatus(p) if s.getPath().getName()[0] == "v")]) if fs.exists(p) else 0

    def shards(self, version: int | None = None) -> list[dict]:
        """name, bytes and level of the shards of a version."""
        version = self.version() if version is None else version
        if not version:
            return []
        fs, p = C.filesystem(self.spark, self._manifest(version))
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)["shards"]

    def commit(self, base: int, shards: list[dict]) -> int:
        """Make version base + 1, whole or not at all."""
        jvm, to = self.spark._jvm, self._manifest(base + 1)
        temp = f"{self.path}/manifest/.{uuid.uuid4().hex}"
        fs, p = C.filesystem(self.spark, temp)
        stream = fs.create(p, False)
        stream.write(bytearray(json.dumps({"version": base + 1, "shards": shards}).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # without OVERWRITE
        try:
            context.rename(p, jvm.org.apache.hadoop.fs.Path(to), options)
        except Exception as e:
            fs.delete(p, False)
            if fs.exists(jvm.org.apache.hadoop.fs.Path(to)):
                raise CommitConflict(to) from e
            raise
        return base + 1

    # Data

    def _write(self, df: DataFrame, level: int) -> list[dict]:
        """Write rows as new shards: those that hold rows, with their sizes."""
        to = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(to)
        return self._found(to, level)

    def _found(self, folder: str, level: int) -> list[dict]:
        fs, p = C.filesystem(self.spark, folder)
        return [{"name": s.getPath().toString(), "bytes": s.getLen(), "level": level} for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]

    def append(self, df: DataFrame) -> int:
        """One arrival: its rows as small shards, then a commit, tried again on a conflict."""
        new = self._write(df.select(*[F.col(f"`{c}`") for c in self.schema.fieldNames()]), 0)
        return self._swap([], new)

    def append_each(self, df: DataFrame, arrival: str) -> int:
        """Many arrivals in one job: rows with the same value of `arrival` come together; each value is one append with its own version."""
        to = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.partitionBy(arrival).parquet(to)
        fs, p = C.filesystem(self.spark, to)
        version = self.version()
        for folder in sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()):
            version = self._swap([], self._found(folder, 0))
        return version

    def _swap(self, old: list[dict], new: list[dict]) -> int:
        gone = {s["name"] for s in old}
        while True:
            base = self.version()
            live = self.shards(base)
            if gone - {s["name"] for s in live}:
                raise CommitConflict("another compaction took these shards")
            try:
                return self.commit(base, [s for s in live if s["name"] not in gone] + new)
            except CommitConflict:
                continue

    def tier(self, size: int) -> int:
        t = 0
        while size > self.smallest:
            size, t = size // self.ratio, t + 1
        return t

    def plan(self) -> list[list[dict]]:
        """Runs to merge: tiers of `fanin` or more shards below the target size, smallest tier first."""
        tiers: dict[int, list[dict]] = {}
        for s in self.shards():
            if s["bytes"] < self.target * 3 // 4:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return [sorted(run, key=lambda s: (s["bytes"], s["name"])) for _, run in sorted(tiers.items()) if len(run) >= self.fanin]

    def compact(self) -> int:
        """Merge until no tier has a run: each pass reads a tier's shards once and packs them, without a shuffle, into target-sized files.

        A run that the reader's splits can't pack into fewer files stays as it is, and the other tiers go on.
        """
        stuck: set[frozenset[str]] = set()
        named = lambda run: frozenset(s["name"] for s in run)
        while runs := [r for r in self.plan() if named(r) not in stuck]:
            for run in runs:
                files = max(1, round(sum(s["bytes"] for s in run) / self.target))
                merged = self._write(self.spark.read.schema(self.schema).parquet(*[s["name"] for s in run]).coalesce(files), 1 + max(s["level"] for s in run))
                if len(merged) >= len(run):
                    self._drop(merged)
                    stuck.add(named(run))
                else:
                    self._swap(run, merged)
        return self.version()

    def read(self, version: int | None = None) -> DataFrame:
        names = [s["name"] for s in self.shards(version)]
        return self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    def _drop(self, shards: list[dict]) -> None:
        for s in shards:
            C.drop_path(self.spark, s["name"])

    def expire(self, keep: int = 1) -> None:
        """Delete the shards that only versions before the last `keep` name, then those manifests."""
        last = self.version()
        old = range(1, last - keep + 1)
        live = {s["name"] for v in range(max(1, last - keep + 1), last + 1) for s in self.shards(v)}
        fs, p = C.filesystem(self.spark, f"{self.path}/manifest")
        there = [v for v in old if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._manifest(v)))]
        self._drop([{"name": n} for n in {s["name"] for v in there for s in self.shards(v)} - live])
        for v in there:
            C.drop_path(self.spark, self._manifest(v))


    def clear_orphans(self, older_s: float = 86_400) -> int:
        """Delete what no manifest names and nobody has touched for older_s seconds: files of jobs that died. Gives their number."""
        fs, p = C.filesystem(self.spark, self.path)
        if not fs.exists(p):
            return 0
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        live = {path(s["name"]).toUri().getPath() for v in range(1, self.version() + 1) if fs.exists(path(self._manifest(v))) for s in self.shards(v)}
        before, n = time.time() - older_s, 0
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().getName()
            orphan = name.startswith(".") if f.getPath().getParent().getName() == "manifest" else f.getPath().toUri().getPath() not in live
            if orphan and not name.endswith(".crc") and f.getModificationTime() / 1000 <= before:
                n += bool(fs.delete(f.getPath(), False))
        return n


def store_of(docs: DataFrame, path: str, arrivals: int = 6, key: str = "doc_id", **options) -> ShardStore:
    """Append docs in `arrivals` batches, compact, and expire what no reader needs.

    Rows with a null key come in one batch; nulls, empty texts and repeated rows are kept as they are. Columns keep their names; one
    called _arrival would clash and raises.
    """
    if "_arrival" in docs.columns:
        raise ValueError("the column name _arrival is taken")
    store = ShardStore(docs.sparkSession, path, docs.schema, **options)
    store.append_each(docs.withColumn("_arrival", F.pmod(F.xxhash64(C.col(key)), F.lit(arrivals))), "_arrival")
    store.compact()
    store.expire()
    return store


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = store_of(docs, C.new_path(spark, "shards"))
    pending = F.lit(bool(store.plan())).alias("pending")  # of the manifest: has a tier a run left to merge?
    return store.read().select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("text_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), pending)


QUERIES = {"op6_sharding": op6_sharding}
ORACLE_SQL = {"op6_sharding": "SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS text_chars, sha256(text) AS text_sha256, FALSE AS pending FROM documents"}

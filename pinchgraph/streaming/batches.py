"""Tables written by micro-batches, safe to replay and to restart.

Every batch owns one folder `run=<query id>/batch=<id>` of its table.  Batch ids count from 0 for each
checkpoint, and the query id belongs to the checkpoint: running a batch again overwrites its own folder and
reads the table without it, while a query with a new checkpoint sees all that others wrote and never touches it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pinchgraph.storage import drop_scratch


def _folder_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


@dataclass(frozen=True)
class BatchKey:
    """A micro-batch: the query id of its checkpoint and its number there."""

    run: str
    batch: int


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark keeps in a checkpoint from its first start on; another checkpoint has another id."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _earlier(key: BatchKey) -> Column:
    """Rows of other runs, and of the same run's batches before this one."""
    return (F.col("run") != key.run) | (F.col("batch") < key.batch)


def _key_of(folder) -> BatchKey:
    return BatchKey(folder.getParent().getName().removeprefix("run="), int(folder.getName().removeprefix("batch=")))


class BatchTable:
    """A Parquet table of one folder per micro-batch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path
        self.schema = spark.createDataFrame([], schema).schema

    def _folder(self, key: BatchKey) -> str:
        return f"{self.path}/run={key.run}/batch={key.batch}"

    def read(self, before: BatchKey | None = None) -> DataFrame:
        """All rows, or those without what the given batch and later ones of the same run wrote."""
        if not _folder_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        rows = self._keyed().parquet(self.path)
        return (rows if before is None else rows.where(_earlier(before))).drop("run", "batch")

    def _keyed(self):
        keys = [T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())]
        return self.spark.read.schema(T.StructType(self.schema.fields + keys))

    def read_folders(self, keys: Iterable[BatchKey]) -> DataFrame:
        """The rows of some batches, one at least, with `run` and `batch`."""
        return self._keyed().option("basePath", self.path).parquet(*[self._folder(k) for k in keys])

    def folders(self) -> list[tuple[BatchKey, bool]]:
        """The batches that stand here, and whether each was written to its end; names only are listed."""
        if not _folder_exists(self.spark, self.path):
            return []
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run=*/batch=*")
        system = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
        marked = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run=*/batch=*/_SUCCESS")
        done = {_key_of(f.getPath().getParent()) for f in system.globStatus(marked)}
        return [(k, k in done) for k in sorted({_key_of(f.getPath()) for f in system.globStatus(pattern)}, key=lambda k: (k.run, k.batch))]

    def read_batch(self, key: BatchKey) -> DataFrame:
        """The rows one batch has written."""
        return self.spark.read.schema(self.schema).parquet(self._folder(key))

    def write(self, rows: DataFrame, key: BatchKey) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(self._folder(key))


#: Of a run, the batches that a segment covers: [first, last] pairs.
Ranges = dict[str, list[list[int]]]


def _ranges(keys: Iterable[BatchKey]) -> Ranges:
    out: Ranges = {}
    for k in sorted(keys, key=lambda k: (k.run, k.batch)):
        spans = out.setdefault(k.run, [])
        if spans and spans[-1][1] + 1 == k.batch:
            spans[-1][1] = k.batch
        else:
            spans.append([k.batch, k.batch])
    return out


@dataclass(frozen=True)
class Segment:
    """A part of an index: the batches whose keys it holds, its level and the segments it was merged from."""

    name: str
    level: int
    covers: Ranges
    replaces: tuple[str, ...] = ()

    def has(self, key: BatchKey) -> bool:
        return any(a <= key.batch <= b for a, b in self.covers.get(key.run, []))


class KeyIndex:
    """The keys of a `BatchTable` by hash bucket, so that a micro-batch reads the buckets of its own keys only.

    Keys of finished batches are gathered `every` so many batches into a segment, a folder partitioned by bucket; `fan`
    segments of a level are merged into one of the next, so there are few files however many batches
    there were, and a key is rewritten as often as there are levels.  Batches not gathered yet (fewer than `every`) are read from
    the table itself, which stays the only truth: the index is never ahead of it, and may be deleted at any time.
    A segment counts once its manifest is written; what a merge has replaced is ignored, then removed.
    """

    def __init__(self, table: BatchTable, key: str, buckets: int = 256, every: int = 8, fan: int = 8):
        self.table, self.key, self.buckets, self.every, self.fan = table, key, buckets, every, fan
        self.spark, self.path = table.spark, f"{table.path}_keys"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _manifests(self) -> list[Segment]:
        path = f"{self.path}/manifests"
        if not _folder_exists(self.spark, path):
            return []
        rows = self.spark.read.schema("value string").option("recursiveFileLookup", True).text(path).collect()  # a line per segment
        return [Segment(d["name"], d["level"], d["covers"], tuple(d["replaces"])) for d in map(json.loads, (r.value for r in rows))]

    def segments(self) -> list[Segment]:
        every = self._manifests()
        gone = {name for s in every for name in s.replaces}
        return [s for s in every if s.name not in gone]

    def _read(self, segments: Iterable[Segment]) -> DataFrame:
        kind = self.table.schema[self.key].dataType.simpleString()
        rows = self.spark.read.schema(f"`{self.key}` {kind}, run string, batch bigint, segment string, bucket int")
        return rows.option("basePath", f"{self.path}/segments").parquet(*[f"{self.path}/segments/segment={s.name}" for s in segments])

    def _add(self, rows: DataFrame, level: int, covers: Ranges, replaces: tuple[str, ...] = ()) -> None:
        segment = Segment(uuid.uuid4().hex[:12], level, covers, replaces)
        dealt = rows.select(self.key, "run", "batch", self._bucket()).repartition("bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/segments/segment={segment.name}")
        line = json.dumps({"name": segment.name, "level": level, "covers": covers, "replaces": list(replaces)})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{self.path}/manifests/{segment.name}")

    def _remove_replaced(self) -> None:
        every = self._manifests()
        here = {s.name for s in every}
        gone = [name for s in every for name in s.replaces if name in here]
        drop_scratch(self.spark, [f"{self.path}/segments/segment={n}" for n in gone] + [f"{self.path}/manifests/{n}" for n in gone])

    def _fresh(self, before: BatchKey, segments: list[Segment]) -> list[tuple[BatchKey, bool]]:
        open_ = [(k, done) for k, done in self.table.folders() if k.run != before.run or k.batch < before.batch]
        return [(k, done) for k, done in open_ if not any(s.has(k) for s in segments)]

    def gather(self, before: BatchKey) -> None:
        """Put finished batches before the given one into a segment once there are `every` of them, and merge full levels."""
        keys = [k for k, done in self._fresh(before, self.segments()) if done]
        if len(keys) < self.every:
            return
        self._add(self.table.read_folders(keys).select(self.key, "run", "batch"), 0, _ranges(keys))
        level = 0
        while len(full := [s for s in self.segments() if s.level == level]) >= self.fan:
            covers = _ranges(BatchKey(run, n) for s in full for run, spans in s.covers.items() for a, b in spans for n in range(a, b + 1))
            self._add(self._read(full), level + 1, covers, tuple(s.name for s in full))
            level += 1
        self._remove_replaced()

    def known(self, keys: DataFrame, before: BatchKey) -> DataFrame:
        """Stored keys that may be among `keys`: those of their buckets, and those of batches not gathered yet."""
        segments = self.segments()
        fresh = [k for k, _ in self._fresh(before, segments)]
        found = self.spark.createDataFrame([], T.StructType([self.table.schema[self.key]]))
        if segments:
            touched = [r.bucket for r in keys.select(self._bucket()).distinct().collect()]  # at most `buckets` numbers
            found = found.unionByName(self._read(segments).where(F.col("bucket").isin(touched) & _earlier(before)).select(self.key))
        return found.unionByName(self.table.read_folders(fresh).select(self.key)) if fresh else found

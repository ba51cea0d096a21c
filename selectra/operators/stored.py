"""Keyed tables that grow: leaves of a hash tree, a manifest of the live ones, merges that touch few of them.

A row's leaf is the first bits of its key's hash; a leaf that would pass ``split_rows`` is written as several with more
bits. A merge reads and rewrites only the leaves its batch touches, into a new folder, and then puts a new manifest in
place by one rename: before it, readers see the old table, after it the new one, and a crash in between leaves an unused
folder. A manifest names the last batch merged, so a batch that comes again changes nothing. What is read is the table
itself, however many batches made it. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

SPLIT_ROWS = 1_000_000
#: bits of a leaf at most; manifests kept, for readers who opened the table before the last merges
MOST_BITS, KEPT_MANIFESTS = 20, 2
#: prefixes of a depth per leaf there, up to which leaves are looked up in an array
DENSE = 64


@dataclass(frozen=True)
class Leaf:
    bits: int
    prefix: int
    rows: int = 0
    folder: str | None = None


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    batch: int | None = None
    leaves: tuple[Leaf, ...] = field(default=(Leaf(0, 0),))


class KeyedTable:
    """A table below ``path`` with the given key and columns."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], schema: StructType, split_rows: int = SPLIT_ROWS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.schema, self.split_rows = schema, split_rows
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def manifest(self) -> Manifest:
        versions = self._versions()
        return self._load(versions[-1]) if versions else Manifest()

    def _load(self, version: int) -> Manifest:
        stream = self._files.open(self._path(f"{self.path}/manifests/{version:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return Manifest(held["version"], held["batch"], tuple(Leaf(**leaf) for leaf in held["leaves"]))

    def _publish(self, manifest: Manifest) -> None:
        """One rename makes the new manifest the latest."""
        waiting = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._files.create(waiting)
        text = json.dumps({"version": manifest.version, "batch": manifest.batch, "leaves": [vars(x) for x in manifest.leaves]})
        out.write(bytearray(text.encode()))
        out.close()
        if not self._files.rename(waiting, self._path(f"{self.path}/manifests/{manifest.version:012d}.json")):
            raise RuntimeError(f"manifest {manifest.version} is there already: another writer was at work")

    def _sweep(self) -> None:
        """Old manifests go, and folders that no kept manifest names (what a crash or an older version left)."""
        versions = self._versions()
        for version in versions[:-KEPT_MANIFESTS]:
            self._files.delete(self._path(f"{self.path}/manifests/{version:012d}.json"), False)
        live = {leaf.folder.split("/")[0] for v in versions[-KEPT_MANIFESTS:] for leaf in self._load(v).leaves if leaf.folder}
        folder = self._path(f"{self.path}/rows")
        for status in self._files.listStatus(folder) if self._files.exists(folder) else []:
            if status.getPath().getName() not in live:
                self._files.delete(status.getPath(), True)

    def _read(self, leaves: Sequence[Leaf]) -> DataFrame:
        folders = [f"{self.path}/rows/{leaf.folder}" for leaf in leaves if leaf.folder]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        return self._read(self.manifest().leaves)

    def _place(self, leaves: Sequence[Leaf]) -> Column:
        """The number of a row's leaf: per depth an array by prefix, or a map where few of the prefixes are leaves."""
        hashed, found = F.xxhash64(*self.key), []
        for bits in sorted({leaf.bits for leaf in leaves}):
            prefix = F.call_function("shiftrightunsigned", hashed, F.lit(64 - bits)) if bits else F.lit(0).cast("bigint")
            of = {leaf.prefix: i for i, leaf in enumerate(leaves) if leaf.bits == bits}
            if 1 << bits <= DENSE * len(of):  # looked up at once, while a map is searched entry by entry
                numbers = F.split(F.lit(",".join(str(of.get(p, -1)) for p in range(1 << bits))), ",").cast("array<int>")
                found.append(F.nullif(F.get(numbers, prefix.cast("int")), F.lit(-1)))
                continue
            table = F.map_from_arrays(F.array(*[F.lit(p).cast("bigint") for p in of]), F.array(*map(F.lit, of.values())))
            found.append(F.try_element_at(table, prefix))
        return F.coalesce(*found)

    def merge(self, batch: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], batch_id: int | None = None) -> bool:
        """Replace the table by ``merged(table, batch)``, leaf by leaf: the rows of a key may depend only on the rows of
        that key. False if the batch was merged before."""
        now = self.manifest()
        if batch_id is not None and now.batch is not None and batch_id <= now.batch:
            return False
        batch = batch.select(*self.schema.names)
        counts = dict(batch.groupBy(self._place(now.leaves).alias("leaf")).count().collect())
        kept = [leaf for i, leaf in enumerate(now.leaves) if i not in counts]
        touched = [leaf for i, leaf in enumerate(now.leaves) if i in counts]
        fresh: list[Leaf] = []
        for i, leaf in enumerate(now.leaves):
            if i in counts:  # twice as many leaves until none can pass the limit
                more = 0
                while leaf.bits + more < MOST_BITS and (leaf.rows + counts[i]) >> more > self.split_rows:
                    more += 1
                fresh += [Leaf(leaf.bits + more, (leaf.prefix << more) + k) for k in range(1 << more)]
        if fresh:
            folder = f"{now.version + 1:012d}-{uuid.uuid4().hex[:8]}"
            name = "leaf"
            while name in self.schema.names:
                name += "_"
            rows = merged(self._read(touched), batch).select(*self.schema.names).withColumn(name, self._place(fresh))
            rows.repartition(name).write.partitionBy(name).parquet(f"{self.path}/rows/{folder}")
            written = dict(self.spark.read.parquet(f"{self.path}/rows/{folder}").groupBy(F.col(name).cast("int")).count().collect())
            fresh = [Leaf(x.bits, x.prefix, written.get(i, 0), f"{folder}/{name}={i}" if i in written else None)
                     for i, x in enumerate(fresh)]
        self._publish(Manifest(now.version + 1, now.batch if batch_id is None else batch_id, (*kept, *fresh)))
        self._sweep()
        return True

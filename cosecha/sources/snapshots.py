"""Tables that change together: Parquet in buckets of a key, under one manifest that a rename replaces.

A change reads and writes only the buckets that its rows touch, into new folders; the manifest then names
these in the place of the old ones. Readers see all tables before a change or all after it, a lost
executor or driver leaves only folders that nothing names, and a change that carries the number of a
micro-batch that the manifest has seen is not made again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosecha.sources.sinks import upsert

#: Buckets of a table: what a change to one key rewrites is one of these.
BUCKETS = 64


@dataclass
class Store:
    """Tables by name, each with its columns (DDL) and the key that deals its rows to buckets.

    One writer at a time: a stream's micro-batches, or jobs that follow each other. The folders that a change
    replaced stay for readers that still use them, until ``vacuum``.
    """

    spark: SparkSession
    path: str
    schemas: Mapping[str, str]
    keys: Mapping[str, str]
    buckets: int = BUCKETS
    _fresh: list[str] = field(default_factory=list)

    def _files(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        place = hadoop.Path(self.path)
        return hadoop, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """Folder of each bucket by table, and the last micro-batch of each stream."""
        hadoop, files = self._files()
        newest = max((s.getPath().getName() for s in (files.listStatus(hadoop.Path(self.path)) if files.exists(hadoop.Path(self.path)) else []) if s.getPath().getName().startswith("manifest-")), default=None)
        if newest is None:
            return {"tables": {}, "batches": {}}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/{newest}", wholetext=True).collect()))

    def _bucket(self, table: str):
        return F.pmod(F.xxhash64(F.col(self.keys[table])), F.lit(self.buckets)).cast("int")

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table as of now, or only some of its buckets."""
        named = self.manifest()["tables"].get(table, {})
        paths = sorted({f"{self.path}/{folder}/bucket={b}" for b, folder in named.items() if buckets is None or int(b) in buckets})
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets of the keys in ``rows``: at most ``buckets`` small numbers."""
        return sorted(r[0] for r in rows.select(self._bucket(table).alias("b")).distinct().collect())

    def change(self, contents: Mapping[str, tuple[list[int], DataFrame]], stream: str | None = None, batch: int | None = None) -> bool:
        """Give the named buckets of tables new rows, all together; False if the ``batch`` of ``stream`` was there before."""
        state = self.manifest()
        if stream is not None and state["batches"].get(stream, -1) >= batch:
            return False
        for table, (buckets, rows) in contents.items():
            folder = f"{table}-{uuid.uuid4().hex}"
            named = [c.split()[0] for c in self.schemas[table].split(",")]
            rows.select(*named).withColumn("bucket", self._bucket(table)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            hadoop, files = self._files()
            written = {int(s.getPath().getName().removeprefix("bucket=")) for s in files.listStatus(hadoop.Path(f"{self.path}/{folder}")) if s.getPath().getName().startswith("bucket=")}
            own = state["tables"].setdefault(table, {})
            if not written <= set(buckets):
                raise ValueError(f"rows of {table} beyond the buckets that were given")
            for b in buckets:
                own.pop(str(b), None)
            own.update({str(b): folder for b in written})
        if stream is not None:
            state["batches"][stream] = batch
        self._swap(state)
        return True

    def _swap(self, state: dict) -> None:
        hadoop, files = self._files()
        numbers = [int(s.getPath().getName().split("-")[1]) for s in files.listStatus(hadoop.Path(self.path)) if s.getPath().getName().startswith("manifest-")] if files.exists(hadoop.Path(self.path)) else []
        draft, final = hadoop.Path(f"{self.path}/.draft-{uuid.uuid4().hex}"), hadoop.Path(f"{self.path}/manifest-{max(numbers, default=0) + 1:012d}")
        out = files.create(draft)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        # A name that exists is not replaced: of two writers the second fails.
        if not files.rename(draft, final):
            raise RuntimeError(f"another writer changed {self.path}")

    def delete(self, folder: str) -> None:
        """Delete a folder of the same file system, if it is there."""
        hadoop, files = self._files()
        files.delete(hadoop.Path(folder), True)

    def vacuum(self) -> None:
        """Delete the folders and manifests that the newest manifest does not name; no reader may use older ones."""
        hadoop, files = self._files()
        state = self.manifest()
        live = {f for own in state["tables"].values() for f in own.values()}
        names = [s.getPath().getName() for s in files.listStatus(hadoop.Path(self.path))]
        newest = max(n for n in names if n.startswith("manifest-"))
        for name in names:
            if name not in live and name != newest:
                files.delete(hadoop.Path(f"{self.path}/{name}"), True)

    def upsert(self, table: str, incoming: DataFrame, keys: list[str], newest: str, stream: str | None = None, batch: int | None = None) -> bool:
        """Of each key the row with the largest ``newest``, old or incoming, the incoming one on ties; other buckets are not read."""
        buckets = self.touched(table, incoming)
        return self.change({table: (buckets, upsert(self.read(table, buckets), incoming, keys, newest))}, stream, batch)

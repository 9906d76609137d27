"""Tables whose folders never change, and numbered manifests that say which folders are the tables now.

A change writes new folders first and then one manifest, which appears under its number by a rename. Readers take the manifest
with the highest number, so they see all of a change or nothing of it; what a lost writer left behind is in no manifest. A manifest also
keeps, for each stream, the last batch that went in: a batch that is replayed changes nothing.

One writer at a time. Rows of a table are in buckets by a hash of its key; a change writes the buckets it touches, each
by as many tasks as its rows ask for, and takes the folders of the others over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scholion.sources.scratch import stored

BUCKETS = 64


class Snapshots:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; an empty one where there is none."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}, "batches": {}}
        rows = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{known[-1] if version is None else version}")
        return json.loads(rows.first()[0])

    def applied(self, stream: str, batch: int) -> bool:
        """Whether a stream's batch went in already."""
        return self.manifest()["batches"].get(stream, -1) >= batch

    def commit(self, before: dict, tables: dict[str, dict], stream: str | None = None, batch: int | None = None) -> int:
        """Publishes what ``written`` and ``appended`` gave as the version after ``before``; fails if another one did."""
        version = before["version"] + 1
        batches = before["batches"] | ({stream: batch} if stream is not None else {})
        body = json.dumps({"version": version, "tables": before["tables"] | tables, "batches": batches})
        draft, final = self._at(f"drafts/{uuid.uuid4().hex}"), self._at(f"manifests/{version}")
        out = self._fs.create(draft, True)
        out.write(bytearray(body.encode()))
        out.close()
        self._fs.mkdirs(self._at("manifests"))
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.path} is there already: another writer was faster")
        return version

    def _write(self, rows: DataFrame, name: str, bucket: Column, key: Column) -> dict[str, str]:
        """New folders of a table by bucket."""
        folder = f"{name}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", bucket).repartition("_bucket", key).sortWithinPartitions("_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}

    def written(self, before: dict, name: str, rows: DataFrame, replaced: DataFrame, key: str) -> dict:
        """The table ``name`` with ``rows`` in place of those whose ``key`` is among ``replaced``, as ``commit`` takes it."""
        held = before["tables"].get(name, {"schema": rows.schema.jsonValue(), "folders": {}})
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
        replaced = stored(replaced.select(key).distinct(), "replaced")
        touched = {str(r[0]) for r in replaced.select(bucket).unionByName(rows.select(bucket)).distinct().collect()}  # BUCKETS at most
        old = [f for b, f in held["folders"].items() if b in touched]
        if old:
            kept = self._parquet(old, held["schema"]).join(replaced, key, "left_anti")
            rows = rows.unionByName(kept, allowMissingColumns=True)
        schema = rows.schema.jsonValue()
        new = self._write(rows, name, bucket, F.xxhash64(F.lit(1), F.col(key)))
        return {name: {"schema": schema, "folders": {b: f for b, f in held["folders"].items() if b not in touched} | new}}

    def appended(self, before: dict, name: str, rows: DataFrame, bucket: Column, key: Column) -> dict:
        """The table ``name`` with the folders of ``rows`` added to those that it has of each bucket."""
        held = before["tables"].get(name, {"schema": rows.schema.jsonValue(), "folders": {}})
        new = self._write(rows, name, bucket, key)
        folders = {b: [*held["folders"].get(b, []), *([new[b]] if b in new else [])] for b in held["folders"].keys() | new.keys()}
        return {name: {"schema": held["schema"], "folders": folders}}

    def _parquet(self, folders: list[str], schema: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(schema)).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, name: str, manifest: dict | None = None, buckets: set[str] | None = None) -> DataFrame:
        """The table ``name`` as one manifest has it, or some of its buckets."""
        table = (manifest or self.manifest())["tables"][name]
        folders = [f for b, v in table["folders"].items() if buckets is None or b in buckets for f in (v if isinstance(v, list) else [v])]
        return self._parquet(folders, table["schema"]) if folders else self.spark.createDataFrame([], StructType.fromJson(table["schema"]))

    def vacuum(self, keep: int = 2) -> None:
        """Deletes the manifests but the last ``keep``, and the folders that none of these names."""
        known = self.versions()
        used = {f.rsplit("/", 1)[0] for v in known[-keep:] for t in self.manifest(v)["tables"].values() for x in t["folders"].values() for f in (x if isinstance(x, list) else [x])}
        tables = {n for v in known for n in self.manifest(v)["tables"]}
        for v in known[:-keep]:
            self._fs.delete(self._at(f"manifests/{v}"), False)
        for name in tables:
            for folder in self._names(name):
                if f"{name}/{folder}" not in used:
                    self._fs.delete(self._at(f"{name}/{folder}"), True)

"""Relations kept in the shared folder as versions of signed rows, in buckets of a key.

A version holds rows with a count n: positive ones came, negative ones went. What a relation holds is the sum of n over its
versions, where it isn't zero, so a change writes only what it changes and a reader merges. Rows lie in
`buckets` folders by the hash of the relation's key: a read by keys opens only their buckets. A version counts once its
manifest is written, which is the last thing a commit does. Each commit writes to folders of its own, so what a lost commit left behind is
never read, and of two commits of one version the later one fails. A manifest that cannot be read is passed over, and with it those after it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.sources.workspace import materialize

#: Keys up to this many are broadcast to the rows of their buckets; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


@dataclass(frozen=True)
class Relation:
    """columns is DDL without n; rows lie in buckets by key, and inside them in `spread` parts by another column."""

    name: str
    columns: str
    key: str
    spread: str | None = None

    @property
    def names(self) -> list[str]:
        return T.StructType.fromDDL(self.columns).fieldNames()


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    buckets: int = 64

    def manifests(self) -> list[dict]:
        """The manifests of the versions that count, in order."""
        try:
            rows = self.spark.read.schema("value string, version int").text(f"{self.root}/manifest").collect()
        except AnalysisException:  # nothing was written yet
            return []
        out: list[dict] = []
        for row in sorted(rows, key=lambda r: r.version):
            try:
                said = json.loads(row.value)
            except ValueError:
                break
            if not isinstance(said, dict) or row.version != len(out):
                break
            out.append(said)
        return out

    def last(self) -> dict | None:
        said = self.manifests()
        return said[-1] if said else None

    def bucket(self, key: Column) -> Column:
        """The bucket of a key; Spark's own partitioning by the key into `buckets` partitions makes the same parts."""
        return F.pmod(F.hash(key), F.lit(self.buckets)).cast("int")

    def write(self, relation: Relation, rows: DataFrame, folder: str, placed: bool = False, parts: int = 1) -> DataFrame:
        """Write signed rows (columns, n) of a version to be, and give them as written. placed: they are partitioned by the key into a multiple of `buckets` already.

        Each bucket is dealt to `parts` tasks, which should grow with the rows, so that none sees a share of them that grows.
        """
        held = rows.select(*relation.names, F.col("n").cast("long").alias("n"), self.bucket(F.col(relation.key)).alias("bucket"))
        if relation.spread:
            held = held.repartition(*((self.buckets * parts,) if parts > 8 else ()), F.col("bucket"), F.pmod(F.xxhash64(relation.spread), F.lit(max(8, parts)))).sortWithinPartitions("bucket", relation.key)
        elif not placed:
            # a partition of a multiple of the buckets lies in one bucket
            held = held.repartition(self.buckets * parts, F.col(relation.key)).sortWithinPartitions("bucket", relation.key)
        path = f"{self.root}/{relation.name}/version={folder}"
        held.write.partitionBy("bucket").parquet(path)
        return self.spark.read.schema(T.StructType.fromDDL(f"{relation.columns}, n long, bucket int")).parquet(path).drop("bucket")

    def commit(self, changes: Mapping[Relation, DataFrame | None], said: dict, folder: str | None = None, parts: int = 1) -> dict:
        """Write a version: signed rows of some relations, None where they lie in the folder already; then the manifest with what is said of it."""
        version, folder = len(self.manifests()), folder or uuid.uuid4().hex
        todo = [(r, rows) for r, rows in changes.items() if rows is not None]
        with ThreadPoolExecutor(max(1, len(todo))) as pool:  # the relations are jobs of their own
            for done in [pool.submit(self.write, r, rows, folder, parts=parts) for r, rows in todo]:
                done.result()
        said = {**said, "folder": folder, "relations": sorted(r.name for r in changes)}
        self.spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("error").text(f"{self.root}/manifest/version={version}")
        return said

    def rows(self, relation: Relation, keys: DataFrame | None = None) -> tuple[DataFrame, int]:
        """The signed rows of all versions as they were written (columns, n), and how many versions they come from; with keys as in read."""
        folders = [said["folder"] for said in self.manifests() if relation.name in said["relations"]]
        schema = T.StructType.fromDDL(f"{relation.columns}, n long, version string, bucket int")
        if not folders:
            return self.spark.createDataFrame([], schema).select(*relation.names, "n"), 0
        path = f"{self.root}/{relation.name}"
        rows = self.spark.read.schema(schema).option("basePath", path).parquet(*(f"{path}/version={f}" for f in folders))
        if keys is not None:
            wanted = materialize(keys.select(relation.key).where(F.col(relation.key).isNotNull()).distinct(), "keys")
            held = [r.bucket for r in wanted.select(self.bucket(F.col(relation.key)).alias("bucket")).distinct().collect()]  # as many as there are buckets at most
            rows = rows.where(F.col("bucket").isin(sorted(held)) if held else F.lit(False))
            rows = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, relation.key, "left_semi")
        return rows.select(*relation.names, "n"), len(folders)

    def read(self, relation: Relation, keys: DataFrame | None = None) -> DataFrame:
        """The rows (columns, n) that the relation holds now; with keys, those of these keys, from their buckets only.

        keys has the relation's key among its columns; it is worked out once and kept.
        """
        rows, versions = self.rows(relation, keys)
        return rows.groupBy(*relation.names).agg(F.sum("n").alias("n")).where("n <> 0") if versions > 1 else rows

    def compacted(self, root: str, relations: list[Relation]) -> Store:
        """A store of one version with the same rows, in another folder."""
        out = Store(self.spark, root, self.buckets)
        said = self.last() or {}
        out.commit({r: self.read(r) for r in relations}, {k: v for k, v in said.items() if k not in ("folder", "relations")})
        return out


def changed(kept: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """Signed rows that turn kept (columns, n) into fresh (columns, n): rows of both cancel."""
    both = fresh.select(*columns, "n").unionByName(kept.select(*columns, (-F.col("n")).alias("n")))
    return both.groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")

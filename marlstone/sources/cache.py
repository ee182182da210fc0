"""A kept cache of values by key, for conversions and replies that cost more than reading them back.

Values are structs, kept as JSON. A change writes what it changes (versioned.Store) and a look-up opens the buckets of its keys only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import upkeep
from marlstone.sources.versioned import Relation, Store
from marlstone.sources.workspace import materialize

ENTRIES = Relation("entries", "key string, value string, size long, mtime timestamp", "key")
BROKEN = "_broken"


@dataclass(frozen=True)
class KeyedCache:
    """schema is the DDL of a value; entries above most_entry_bytes are never taken, most_bytes and most_entries hold after each write."""

    store: Store
    schema: str
    most_entry_bytes: int = upkeep.CACHE["entry_bytes"]
    most_bytes: int = upkeep.CACHE["bytes"]
    most_entries: int = upkeep.CACHE["entries"]
    days: int = upkeep.CACHE["ttl_days"]

    def entries(self, keys: DataFrame | None = None) -> DataFrame:
        return self.store.read(ENTRIES, keys).select(*ENTRIES.names)

    def _change(self, gone: DataFrame, fresh: DataFrame | None = None) -> int:
        """Take entries out and put others in, as one version; gives how many rows that are."""
        rows = gone.select(*ENTRIES.names, F.lit(-1).alias("n"))
        rows = materialize(rows if fresh is None else rows.unionByName(fresh.select(*ENTRIES.names, F.lit(1).alias("n"))), "entries")
        changed = rows.count()
        if changed:
            self.store.commit({ENTRIES: rows}, {"changed": changed})
        return changed

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, value) of the keys (key) that the cache has; entries that do not read as the schema are misses and are taken out."""
        held = self.entries(keys)
        read = materialize(held.withColumn("v", F.from_json("value", f"{self.schema}, {BROKEN} string", {"columnNameOfCorruptRecord": BROKEN})), "read")
        broken = F.col("v").isNull() | F.col(f"v.{BROKEN}").isNotNull()
        self._change(read.where(broken))
        return read.where(~broken).select("key", F.col("v").dropFields(BROKEN).alias("value"))

    def set(self, fresh: DataFrame, at: Column) -> None:
        """Put values (key, value) in place of those of equal key. Null keys and values and values that are too large are passed over in silence; of a repeated key the greatest JSON counts."""
        told = fresh.where("key IS NOT NULL AND value IS NOT NULL").select("key", F.to_json("value").alias("value"))
        told = told.withColumn("size", F.octet_length("value").cast("long")).where(F.col("size") <= self.most_entry_bytes)
        new = materialize(told.groupBy("key").agg(F.max(F.struct("value", "size")).alias("v")).select("key", "v.value", "v.size", at.alias("mtime")), "fresh")
        self._change(self.entries(new), new)
        self._change(upkeep.evicted(self.entries(), self.most_bytes, self.most_entries))

    def invalidate(self, keys: DataFrame | None = None, prefix: str | None = None) -> int:
        """Take out the entries of the keys (key), or of all keys that begin with the prefix."""
        return self._change(self.entries(keys) if prefix is None else self.entries().where(F.startswith("key", F.lit(prefix))))

    def purge(self, now: Column) -> int:
        """Take out entries older than the days that they live."""
        return self._change(upkeep.expired(self.entries(), now, self.days))

    def clear(self) -> int:
        return self._change(self.entries())

"""The kept cache: hits, misses, corrupt and large entries, caps."""

from pyspark.sql import functions as F

from marlstone.sources.cache import ENTRIES, KeyedCache
from marlstone.sources.versioned import Store

VALUE = "key string, value struct<text:string,pages:int>"


def test_values_come_back_until_they_are_taken_out(spark, tmp_path):
    cache = KeyedCache(Store(spark, str(tmp_path / "c"), 2), "text string, pages int", most_entry_bytes=60, most_bytes=1000, most_entries=3)
    frame = lambda rows: spark.createDataFrame(rows, VALUE)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    at = lambda day: F.to_timestamp(F.lit(f"2024-05-{day:02d}"))
    got = lambda *k: {r.key: (r.value.text, r.value.pages) for r in cache.get(keys(*k)).collect()}
    assert got("pdf:a") == {}
    cache.set(frame([("pdf:a", ("é\"x", 1)), ("pdf:b", ("y", None)), (None, ("z", 1)), ("n", None), ("big", ("w" * 100, 1)), ("pdf:a", ("a", 2))]), at(1))
    assert got("pdf:a", "pdf:b", "big", "n", None) == {"pdf:a": ("é\"x", 1), "pdf:b": ("y", None)}
    cache.set(frame([("pdf:a", ("new", 3))]), at(2))
    assert got("pdf:a") == {"pdf:a": ("new", 3)}

    # an entry that another writer left half written
    broken = spark.createDataFrame([("bad", '{"text": "x', 11)], "key string, value string, size long").select("key", "value", "size", at(3).alias("mtime"), F.lit(1).alias("n"))
    cache.store.commit({ENTRIES: broken}, {})
    assert got("bad", "pdf:b") == {"pdf:b": ("y", None)}
    assert sorted(r.key for r in cache.entries().collect()) == ["pdf:a", "pdf:b"]

    # the oldest goes when there are more than three
    cache.set(frame([("t:1", ("1", 1)), ("t:2", ("2", 1))]), at(4))
    assert sorted(r.key for r in cache.entries().collect()) == ["pdf:a", "t:1", "t:2"]
    assert cache.invalidate(prefix="t:") == 2 and cache.invalidate(keys("t:1")) == 0
    assert cache.purge(at(30)) == 0 and cache.purge(F.to_timestamp(F.lit("2034-01-01"))) == 1
    cache.set(frame([("x", ("1", 1))]), at(5))
    assert cache.clear() == 1 and cache.entries().count() == 0

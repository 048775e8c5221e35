"""The shard store: odd rows, empty arrivals, tiers, versions, and two writers."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm.sharding import ShardStore, shard

SCHEMA = "doc_id long, text string, path string, bytes long, tier int"
ROWS = [(1, "a", "x", 1, 0), (1, "a", "x", 1, 0), (None, None, None, None, None), (2, "", "y", 0, 9), (3, "word " * 200_000, None, -1, 1), (3, None, "x", 2, None)]


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_odd_rows_and_empty_arrivals(spark, tmp_path):
    some = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    none = spark.createDataFrame([], SCHEMA)
    out = shard(ShardStore(spark, f"{tmp_path}/a", fan_in=2), [none, some, none, some, some])
    assert out.columns == some.columns
    assert rows_of(out) == Counter(ROWS * 3)
    empty = shard(ShardStore(spark, f"{tmp_path}/b"), [none, none])
    assert empty.columns == some.columns and empty.count() == 0


def test_tiers_merge_and_old_versions_stay_readable(spark, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/c", fan_in=4)
    for k in range(3):
        store.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
    assert store.compact() == 0 and store.manifest().count() == 3
    store.append(spark.range(30, 40).coalesce(1))
    assert store.compact() == 1 and store.manifest().count() == 1
    assert store.read(4).count() == store.read().count() == 40
    assert store.read(2).agg(F.max("id")).first()[0] == 19
    assert store.vacuum() == 0 and store.versions() == [4, 5]
    assert store.vacuum(keep=1) == 4 and store.versions() == [5]
    assert rows_of(store.read()) == Counter((i,) for i in range(40))


def test_large_shards_are_left_alone(spark, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/d", target_bytes=400, fan_in=2)
    for _ in range(3):
        store.append(spark.range(100).coalesce(1))
    assert store.compact() == 0 and store.manifest().count() == 3


def test_one_of_two_writers_wins(spark, tmp_path):
    store = ShardStore(spark, f"{tmp_path}/e")
    store.append(spark.range(5).coalesce(1))
    with pytest.raises(Exception, match="exists"):
        store.commit(store.manifest(), 1)
    assert store.versions() == [1] and store.read().count() == 5


def test_a_lost_race_is_tried_again(spark, tmp_path):
    store, other = (ShardStore(spark, f"{tmp_path}/f") for _ in range(2))
    store.append(spark.range(3).coalesce(1))
    seen = iter([[1]])  # the other writer commits just after the versions were listed
    listed = store.versions
    store.versions = lambda: next(seen, None) or listed()
    new = store._write(spark.range(10, 12).coalesce(1), 2)
    other.append(spark.range(5, 7).coalesce(1))
    assert store._next(lambda newest: store.manifest(newest).unionByName(new)) == 3
    assert rows_of(store.read()) == Counter((i,) for i in (0, 1, 2, 5, 6, 10, 11))

"""The object store: checksums, marks, missing keys, listings."""

import hashlib
import random

import pytest

from tallyforge.sources import store

KIND = "key string, content binary, expected string"


def rows(contents, wrong=()):
    return [(k, c, hashlib.sha256(c).hexdigest() if k not in wrong else "0" * 64) for k, c in contents.items()]


def test_objects_come_back_in_order(spark, tmp_path):
    r = random.Random(1)
    contents = {f"uploads/{r.choice('abc')}/{r.choice(['x', 'y.z', 'y'])}-{k}": bytes(r.randrange(256) for _ in range(r.randrange(50))) for k in range(200)}
    contents |= {"top": b"", "uploads/a.txt": b"1", "uploads/a-b": b"2"}
    root = f"file://{tmp_path}/s"
    for _ in range(2):
        # a repeated put changes nothing
        store.put(spark.createDataFrame(rows(contents), KIND).repartition(4), root)
    assert store.writes_done(root) == 2
    found = store.listing(spark, root, content=True).collect()
    assert {x["key"]: bytes(x["content"]) for x in found} == contents and all(x["size"] == len(contents[x["key"]]) for x in found)
    for prefix in ("", "uploads/", "uploads/a", "uploads/a/", "uploads/b/y", "no/such", "to"):
        keys = [x["key"] for x in store.listing(spark, root, prefix).orderBy("key").collect()]
        assert keys == sorted(k for k in contents if k.startswith(prefix))
    assert [k for k, _ in store.Files(root).walk("uploads")] == sorted(k for k in contents if k.startswith("uploads/"))


def test_a_wrong_checksum_is_refused_and_leaves_no_mark(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    with pytest.raises(Exception, match="ChecksumMismatch"):
        store.put(spark.createDataFrame(rows({"a": b"1", "b": b"2"}, wrong="b"), KIND).coalesce(1), root)
    assert store.writes_done(root) == 0
    assert "b" not in {x["key"] for x in store.listing(spark, root).collect()}


def test_get_raises_and_delete_does_not(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    keys = spark.createDataFrame([("a",), ("gone",)], "key string")
    store.put(spark.createDataFrame([("a", b"1", None), ("c/d", b"3", None)], KIND), root)
    assert {x["key"]: x["found"] for x in store.exists(keys, root).collect()} == {"a": True, "gone": False}
    with pytest.raises(Exception, match="NotFound"):
        store.get(keys, root).collect()
    store.delete(keys, root)
    store.delete(keys, root)
    assert [x["key"] for x in store.listing(spark, root).collect()] == ["c/d"]
    assert store.listing(spark, f"{root}/never").count() == 0


@pytest.mark.parametrize("key", ["", "/a", "a/../b", "a//b", "./a", "a\\b", "_store/x"])
def test_keys_stay_below_the_root(tmp_path, key):
    with pytest.raises(ValueError):
        store.Files(str(tmp_path)).put(key, b"")


def test_a_listing_has_no_partition_for_each_object(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    contents = {f"up/{a}{b}/{k}": b"x" for a in "ab" for b in "01" for k in range(60)} | {f"flat/{k}": b"" for k in range(50)}
    store.put(spark.createDataFrame(rows(contents), KIND).coalesce(2), root)
    for prefix, most in (("up/a", 2), ("up/", 4), ("flat/", 1), ("", 5)):
        found = store.listing(spark, root, prefix)
        keys = [x["key"] for x in found.collect()]
        assert keys == sorted(k for k in contents if k.startswith(prefix))
        assert found.rdd.getNumPartitions() <= most


def test_contents_are_handed_on_in_parts(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    contents = {f"up/{k:02}": bytes([k]) * 1000 for k in range(30)}
    store.put(spark.createDataFrame(rows(contents), KIND).coalesce(1), root)
    monkeypatch.setattr(store, "PART_BYTES", 4000)
    reader = store._Reader({"path": root, "prefix": ""})
    parts = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.nbytes for b in parts) < 5000 and len(parts) == 8
    assert {k: c for b in parts for k, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist())} == contents
    got = store.get(spark.createDataFrame([(k,) for k in contents], "key string"), root).collect()
    assert {x["key"]: bytes(x["content"]) for x in got} == contents

"""The keyed post table: same rows as the batch jobs, few files touched."""
import datetime as dt
import os

import pytest

from murmur.sources import ingest as I
from murmur.sources.keyed import KeyedTable

SCHEMA = "platform string, post_id string, likes int, crawl_time timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def rows_of(spark, ids, likes=0, minute=0):
    return spark.createDataFrame([("weibo" if i % 2 else "x", f"p{i}", likes + i, T0 + dt.timedelta(minutes=minute)) for i in ids], SCHEMA)


def values(df):
    return sorted((r.platform, r.post_id, r.likes, r.crawl_time) for r in df.collect())


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_insert_ignore_equals_the_batch_job(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=8)
    stored = rows_of(spark, range(50))
    table.append(stored)
    for batch in (rows_of(spark, range(40, 80), 1000, 5).unionByName(rows_of(spark, range(60, 90), 2000, 3)), rows_of(spark, range(10), 7, 1)):
        stored = I.ingest_ignore(stored, batch)
        table.insert_ignore(batch)
        assert values(table.read()) == values(stored)
    assert table.read().count() == 90


def test_upsert_equals_the_batch_job(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=8)
    table.append(rows_of(spark, range(50)))
    batch = rows_of(spark, range(45, 70), 1000, 5).unionByName(rows_of(spark, [46, 69], 5000, 9))
    table.upsert(batch)
    assert values(table.read()) == values(I.ingest_upsert(rows_of(spark, range(50)), batch))
    table.upsert(rows_of(spark, [200], 1))
    assert table.read().filter("post_id = 'p200'").count() == 1


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, buckets=16)
    table.append(rows_of(spark, range(400)))
    before, pieces = files(path + "/data"), table.pieces()
    table.upsert(rows_of(spark, [17], 9000))
    after = table.pieces()
    changed = [b for b in after if after[b] != pieces.get(b)]
    assert len(changed) == 1 and before.items() <= files(path + "/data").items()
    assert len(set(files(path + "/data")) - set(before)) == 1
    table.insert_ignore(rows_of(spark, range(400, 403)))
    assert sum(len(v) for v in table.pieces().values()) <= sum(len(v) for v in after.values()) + 3


def test_new_keys_read_no_stored_rows(spark, tmp_path):
    """The filters rule new keys out without a look at the stored keys."""
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=8)
    table.append(rows_of(spark, range(500)))
    assert table.maybe_known(rows_of(spark, range(1000, 1300))).count() <= 3
    assert table.maybe_known(rows_of(spark, range(300))).count() == 300


def test_failed_write_is_not_seen_and_tried_again(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    table.append(rows_of(spark, range(20)))
    commit = KeyedTable._commit
    monkeypatch.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.insert_ignore(rows_of(spark, range(10, 40)), mark=5)
    monkeypatch.setattr(KeyedTable, "_commit", commit)
    assert table.read().count() == 20 and table.mark() is None
    for _ in range(2):      # the second time finds its mark
        table.insert_ignore(rows_of(spark, range(10, 40)), mark=5)
    assert table.read().count() == 40 and table.mark() == 5 and table.version() == 2


def test_compaction_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, buckets=2)
    for k in range(10):
        table.insert_ignore(rows_of(spark, range(k * 10, k * 10 + 15)), mark=k)
    assert max(len(v) for v in table.pieces().values()) <= 8 and table.mark() == 9
    want, count = values(table.read()), len(files(path + "/data"))
    table.compact(1)
    table.vacuum()
    assert values(table.read()) == want and len(want) == 105
    assert all(len(v) == 1 for v in table.pieces().values()) and len(files(path + "/data")) < count


def test_null_keys_and_empty_batches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), buckets=4)
    with pytest.raises(FileNotFoundError):
        table.read()
    odd = spark.createDataFrame([(None, "a", 1, T0), (None, "a", 2, T0), ("x", None, 3, T0)], SCHEMA)
    table.insert_ignore(odd)
    table.insert_ignore(odd)
    table.insert_ignore(odd.limit(0))
    assert sorted(r.likes for r in table.read().collect()) == [1, 3]

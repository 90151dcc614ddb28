import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import snapshots
from corpusloom.operators.snapshots import ConflictError, SnapshotTable
from corpusloom.operators.store import IdentityMismatch, VectorStore

KIND = "document_id string, chunk_id long, text string"
FIRST = [("a", 1, "x"), ("a", 2, "y"), ("b", 3, None), ("c", 4, "z"), ("c", 4, "z")]


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def manifest(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "document_id string")


def held(table, version=None):
    return sorted(map(tuple, table.rows(version).collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), buckets=3)
    t.change(frame(spark, FIRST))
    return t


def test_one_commit_upserts_drops_stale_rows_and_prunes(spark, table):
    made = table.change(frame(spark, [("a", 1, "new"), ("d", 9, "w")]), manifest(spark, ["a", "b", "d", "unknown", "a"]))
    assert held(table) == sorted([("a", 1, "new"), ("b", 3, None), ("d", 9, "w")], key=repr)
    assert held(table, made.version - 1) == sorted(FIRST, key=repr)  # repeated rows stay, old snapshots are readable
    assert table.versions() == [0, 1, 2]
    assert table.change(frame(spark, []), manifest(spark, ["a", "b", "d"])).version == made.version  # nothing to do, no snapshot
    with pytest.raises(ValueError, match="empty manifest"):
        table.change(manifest=manifest(spark, []))
    with pytest.raises(ValueError, match="no snapshot 7"):
        table.snapshot(7)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), buckets=50)
    t.change(frame(spark, [(f"d{k}", k, "x") for k in range(200)]))
    before = t.snapshot()
    after = t.change(frame(spark, [("d7", 7, "y")]))
    assert len({b for b in after.folders if after.folders[b] != before.folders.get(b)}) == 1 and len(held(t)) == 200


def test_a_failing_batch_leaves_the_old_snapshot(spark, table):
    bad = frame(spark, [("a", 1, "n"), ("b", 2, "n")]).withColumn("text", F.when(F.col("document_id") == "b", F.raise_error(F.lit("no vector")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no vector"):
        table.change(bad)
    with pytest.raises(Exception, match="document_id is null"):
        table.change(frame(spark, [(None, 1, "n")]))
    with pytest.raises(ValueError, match="columns"):
        table.change(frame(spark, [("a", 1, "n")]).withColumn("more", F.lit(1)))
    assert table.versions() == [0, 1] and held(table) == sorted(FIRST, key=repr)


def test_a_crash_between_files_and_snapshot(spark, table, monkeypatch):
    """The driver dies after the files are written: readers see the old snapshot, the next commit works, expire sweeps what was left."""
    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_commit", lambda self, new: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.change(frame(spark, [("a", 5, "lost")]))
    again = SnapshotTable(spark, table.path)
    assert held(again) == sorted(FIRST, key=repr)
    again.change(frame(spark, [("a", 6, "kept")]))
    assert ("a", 6, "kept") in held(again)
    now = held(again)
    assert again.expire(keep=1) == 0  # a writer may still be at work on young files
    assert again.expire(keep=1, older=0) >= 1 and held(again) == now and len(again.versions()) == 1
    with pytest.raises(ValueError, match="stays"):
        again.expire(keep=0)


def test_two_writers(spark, table, monkeypatch):
    """Both start from the same snapshot: the second finds its number taken and works its change off on top of the first."""
    other, step, met = SnapshotTable(spark, table.path), SnapshotTable._next, []

    def late(self, now, new, keep):
        made = step(self, now, new, keep)
        if self is table and not met:
            met.append(other.change(frame(spark, [("a", 7, "first"), ("e", 8, "first")])))
        return made

    monkeypatch.setattr(SnapshotTable, "_next", late)
    table.change(frame(spark, [("a", 9, "second")]))
    assert held(table) == sorted([("a", 9, "second"), ("b", 3, None), ("c", 4, "z"), ("c", 4, "z"), ("e", 8, "first")], key=repr)
    monkeypatch.setattr(SnapshotTable, "_commit", lambda self, new: False)
    with pytest.raises(ConflictError):
        table.change(frame(spark, [("a", 9, "third")]))


def test_empty_table_and_names_that_exist(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    assert t.rows() is None and t.snapshot() is None and t.change(frame(spark, [])).version == 0
    files = snapshots.Files(spark, t.path)
    assert not files.create(f"{t.path}/log/{0:020d}.json", "{}") and json.loads(files.read(f"{t.path}/log/{0:020d}.json"))["version"] == 0
    assert [n for n in files.names(f"{t.path}/log") if n.startswith(".") and not n.endswith(".crc")] == []
    with pytest.raises(ValueError, match="bucket"):
        SnapshotTable(spark, t.path, buckets=0)


def test_identity_and_rows_belong_together(spark, tmp_path):
    identity = {"backend": "local", "model": "hash", "dimension": 2, "fingerprint": "f"}
    index = VectorStore(spark, str(tmp_path / "i"), identity, buckets=2)
    with pytest.raises(IdentityMismatch, match="no identity"):
        index.replace(frame(spark, FIRST))
    index.initialize()
    index.initialize()
    index.replace(frame(spark, FIRST))
    index.check_provider_model("m1")
    index.check_provider_model("m1")
    with pytest.raises(IdentityMismatch, match="m1"):
        index.check_provider_model("m2")
    for gone in (index.table.snapshot().folders.values()):
        index.table._files.delete(f"{index.table.path}/{gone}")
    with pytest.raises(IdentityMismatch, match="lacks"):
        index.initialize()
    bare = VectorStore(spark, str(tmp_path / "j"), identity)
    bare.table.change(frame(spark, FIRST))
    with pytest.raises(IdentityMismatch, match="no identity"):
        bare.initialize()
    for version in bare.table.versions():
        bare.table._files.delete(bare.table._log(version))
    with pytest.raises(IdentityMismatch, match="rows and no identity"):
        bare.initialize()
